"""Consumer lag as a stream: offset snapshots from files, backlogs that keep rising, and groups that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A snapshot file: one JSON document for each group and time.
SNAPSHOT = "`group` string, ts timestamp, topics array<struct<topic: string, partitions: array<struct<partition: int, log_end_offset: long, committed_offset: long, consume_rate: double, produce_rate: double>>>>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def read_lag_snapshots(spark: SparkSession, path: str, stream: bool = False, files_at_once: int | None = None) -> DataFrame:
    """``group, ts, topic, part, end_offset, committed, consume_rate, produce_rate`` of snapshot files (JSON lines), one row for each partition.

    Null offsets are 0, null rates stay; a snapshot without partitions gives no rows. A stream
    takes new files as they come, each once, whatever is restarted.
    """
    reader = spark.readStream if stream else spark.read
    if stream and files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    raw = reader.schema(SNAPSHOT).json(path)
    topics = raw.select("group", "ts", F.explode("topics").alias("t"))
    parts = topics.select("group", "ts", F.col("t.topic").alias("topic"), F.explode("t.partitions").alias("p"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.select("group", "ts", "topic", F.coalesce("p.partition", F.lit(0)).alias("part"), zero("p.log_end_offset").alias("end_offset"), zero("p.committed_offset").alias("committed"), F.col("p.consume_rate").alias("consume_rate"), F.col("p.produce_rate").alias("produce_rate"))


def total_lags(parts: DataFrame) -> DataFrame:
    """``group, ts, lag`` of a table of partitions: what a group has not read at a time; committed offsets beyond the end count as none."""
    return parts.groupBy("group", "ts").agg(F.sum(F.greatest(F.col("end_offset") - F.col("committed"), F.lit(0))).alias("lag"))


class LagWatch(StatefulProcessor):
    """Of a group the last lags, the time of the last one, and whether its silence has been told."""

    def __init__(self, snapshots: int, silence_s: int):
        self.snapshots, self.silence_ms = snapshots, silence_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lag", "lags array<long>, last_ms long, told boolean")

    def _row(self, key, ms: int, kind: str, low, high) -> tuple:
        growth = None if low in (None, 0) or high is None else round(100 * (high / low - 1), 1)
        return (key[0], pd.Timestamp(ms, unit="ms"), kind, low, high, growth)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["group", "ts", "kind", "from_lag", "to_lag", "growth_pct"])
        return out.astype({"from_lag": "Int64", "to_lag": "Int64", "growth_pct": "float64", "ts": "datetime64[ns]"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lags, last, told = self.state.get() if self.state.exists() else ([], None, False)
        lags, out = list(lags), []
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "lag"], kind="stable")
        for ms, lag in zip(frame["ms"].tolist(), frame["lag"].tolist()):
            if last is not None and ms - last > self.silence_ms and not told:
                out.append(self._row(key, last + self.silence_ms, "stalled", None, lags[-1]))
            lags, last, told = [*lags, lag][-self.snapshots :], ms if last is None else max(ms, last), False
            if len(lags) == self.snapshots and all(a < b for a, b in zip(lags, lags[1:])):
                out.append(self._row(key, ms, "rising", lags[0], lag))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.silence_ms)
        self.state.update((lags, last, told))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lags, last, told = self.state.get()
        out = [] if told else [self._row(key, last + self.silence_ms, "stalled", None, lags[-1])]
        self.state.update((list(lags), last, True))
        yield self._frame(out)

    def close(self) -> None:
        pass


LAG_ALERTS = "`group` string, ts timestamp, kind string, from_lag long, to_lag long, growth_pct double"


def lag_alerts(lags: DataFrame, snapshots: int = 3, silence_s: int = 3600, bound: str = "0 seconds") -> DataFrame:
    """``group, ts, kind, from_lag, to_lag, growth_pct`` of a stream of ``group, ts, lag``, one row for each snapshot.

    'rising': the last ``snapshots`` lags rise, each above the one before; 'stalled': no snapshot for ``silence_s``,
    told once, at the end of that time, by the next snapshot or by a timer of the watermark (``bound``).
    A group's state is its last few lags. Snapshots of a group come in the order of their times;
    later ones than the bound are dropped.
    """
    narrow = lags.select("group", "ts", F.unix_millis("ts").alias("ms"), F.col("lag").cast("long").alias("lag")).withWatermark("ts", bound)
    return narrow.groupBy("group").transformWithStateInPandas(LagWatch(snapshots, silence_s), LAG_ALERTS, "Append", "EventTime")


def lag_alerts_of_table(lags: DataFrame, snapshots: int = 3, silence_s: int = 3600) -> DataFrame:
    """The same of a table: what a stream has told when its watermark has reached the table's last time."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("group").orderBy("ts", "lag")
    x = lags.withColumn("run", F.array_agg("lag").over(w.rowsBetween(1 - snapshots, 0))).withColumn("next", F.lead("ts").over(w))
    rises = F.forall(F.sequence(F.lit(1), F.lit(snapshots - 1)), lambda i: F.get("run", i - 1) < F.get("run", i))
    first = F.get("run", F.lit(0))
    up = x.filter((F.size("run") == snapshots) & rises).select("group", "ts", F.lit("rising").alias("kind"), first.alias("from_lag"), F.col("lag").alias("to_lag"), F.round(100 * (F.col("lag") / F.nullif(first, F.lit(0)) - 1), 1).alias("growth_pct"))
    ends = F.col("ts") + F.make_interval(secs=F.lit(silence_s))
    still = x.join(F.broadcast(lags.agg(F.max("ts").alias("__now")))).filter((F.coalesce("next", "__now") > ends) | (F.col("next").isNull() & (F.col("__now") >= ends)))
    return up.unionByName(still.select("group", ends.alias("ts"), F.lit("stalled").alias("kind"), F.lit(None).cast("long").alias("from_lag"), F.col("lag").alias("to_lag"), F.lit(None).cast("double").alias("growth_pct")))
