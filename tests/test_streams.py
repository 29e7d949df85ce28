"""Streams that are stopped and started again, sinks that fail half way, and the sketch of storms against exact medians."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import lag as K
from plumbline.streaming import storms as A
from plumbline.streaming import windows as W

T0 = dt.datetime(2024, 1, 1)


def snapshot(group, minute, lag):
    parts = [{"partition": 0, "log_end_offset": lag + 7, "committed_offset": 7}, {"partition": 1, "log_end_offset": 1, "committed_offset": 5}, {"partition": None}]
    return json.dumps({"group": group, "ts": (T0 + dt.timedelta(minutes=minute)).isoformat(), "topics": [{"topic": "t", "partitions": parts}]})


def test_lag_alerts_after_a_restart(spark, tmp_path):
    K.with_keyed_state(spark)
    rng, source, out = random.Random(3), tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    snaps = [(g, 10 * i, rng.randrange(5)) for i in range(60) for g in "abc" if rng.random() < (0.8 if g != "c" or i < 20 else 0)]
    for half in (0, 1):
        with open(source / f"{half}.json", "w") as f:
            f.write("\n".join(snapshot(*s) for s in snaps if (s[1] >= 300) == half))
        lags = K.read_lag_snapshots(spark, str(source), stream=True).filter("part = 0 and end_offset > 0").withColumn("lag", F.col("end_offset") - F.col("committed"))
        W.run_once(K.lag_alerts(lags, 3, 1200), f"{out}/rows", f"{out}/checkpoint")
    got = sorted(map(str, spark.read.schema(K.LAG_ALERTS).parquet(f"{out}/rows").collect()))
    table = K.total_lags(K.read_lag_snapshots(spark, str(source)))
    want = sorted(map(str, K.lag_alerts_of_table(table, 3, 1200).select("group", "ts", "kind", "from_lag", "to_lag", "growth_pct").collect()))
    assert got == want and any("rising" in x for x in want) and any("'c'" in x and "stalled" in x for x in want)


def test_sketch():
    rng = random.Random(1)
    for n in (1, 2, 9, 500):
        values = [rng.randrange(1, 10_000) for _ in range(n)]
        counts = {}
        for v in values:
            counts[A.Sketch.place(v)] = counts.get(A.Sketch.place(v), 0) + 1
        exact = sorted(values)[n // 2]
        assert A.Sketch.upper_median(counts) == pytest.approx(exact, rel=A.ERROR * 1.001)


def test_storms_after_a_restart(spark, tmp_path):
    K.with_keyed_state(spark)
    rng, source, out = random.Random(5), str(tmp_path / "in"), str(tmp_path / "out")
    alerts, minute = [], 0
    for i in range(400):  # twenty buckets a day or so, some of them storms
        minute += 60 + rng.randrange(20)
        alerts += [(T0 + dt.timedelta(minutes=minute, seconds=s % 250), "prod") for s in range(rng.choice([1, 2, 3, 3, 4, 40]))]
    cut = len(alerts) // 2
    schema = "ts timestamp, scope string"
    for part in (alerts[:cut], alerts[cut:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        W.run_once(A.storm_stream(stream, "ts", "scope", "1 minute", horizon_days=3), f"{out}/rows", f"{out}/checkpoint")
    got = {(r.bucket_s, r.n): r.median for r in spark.read.parquet(f"{out}/rows").collect()}
    counts = {}
    for ts, _ in alerts:
        s = int(ts.replace(tzinfo=dt.timezone.utc).timestamp()) // 300 * 300
        counts[s] = counts.get(s, 0) + 1
    last, want = max(counts), {}
    for s, n in counts.items():
        held = sorted(m for t, m in counts.items() if t <= s and t // 86400 > s // 86400 - 3)
        if s < last and n >= 5 and n >= 3 * held[len(held) // 2]:
            want[s, n] = held[len(held) // 2]
    assert got.keys() == want.keys() and len(want) > 30 and all(got[k] == pytest.approx(want[k], rel=0.0101) for k in want)


def test_late_rows_once_although_a_sink_fails(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, T0, T0 + dt.timedelta(seconds=600 if i % 5 == 0 else 10)) for i in range(100)] + [(100, T0, None)]
    schema = "id long, ts timestamp, arrival timestamp"
    spark.createDataFrame(rows, schema).write.parquet(source)

    def fail(_):
        raise RuntimeError("between the sinks")

    def run(between=None):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
        q = W.split_late(s, "ts", "arrival", 120, f"{out}/on_time", f"{out}/late", between).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="between the sinks"):
        run(fail)
    assert W.read_batches(spark, "id long", f"{out}/on_time").count() > 0
    run()
    run()
    on_time, late = (sorted(r.id for r in W.read_batches(spark, "id long", f"{out}/{side}").collect()) for side in ("on_time", "late"))
    assert late == list(range(0, 100, 5)) and on_time == sorted({*range(101)} - set(late))
