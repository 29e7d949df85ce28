"""Queries of files, ledgers, rewrites and streams: tables written to the shared scratch folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import telemetry as T
from plumbline.sources import csvs as C
from plumbline.sources import databases as D
from plumbline.sources import files as I
from plumbline.sources import lines as L
from plumbline.sources import publish as P
from plumbline.sources import tables as S
from plumbline.streaming import lag as K
from plumbline.streaming import storms as A
from plumbline.streaming import windows as W

from .registry import query

CELLS = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer"


def cells(spark, d):
    k = F.col("c_custkey")
    return S.table(spark, d, "customer").select(k.cast("string").alias("c_custkey"), F.when(k % 10 == 0, "N/A").when(k % 5 == 0, " null").otherwise(F.col("c_mktsegment")).alias("segment"))


@query("src_rows_csv", CELLS)
def src_rows_csv(spark, d):
    I.write_csv(cells(spark, d), path := I.scratch(spark, "csv"))
    return I.read_rows_csv(spark, path)


@query("src_rows_jsonl", CELLS)
def src_rows_jsonl(spark, d):
    cells(spark, d).write.json(path := I.scratch(spark, "jsonl"))
    return I.read_rows_jsonl(spark, path)


def broken(spark, d):
    """A file with a mark, a repeated name, mojibake, short and long rows, and cells with delimiters, quotes and line breaks; some rows are like the header."""
    k = F.col("c_custkey")
    note = (
        F.when(k % 10 == 3, "x;y").when(k % 10 == 4, "").when(k % 7 == 0, ";CafÃ©")
        .when(k % 10 == 5, F.concat(F.lit(';"a; ""'), k.cast("string"), F.lit('"" b"')))
        .when(k % 10 == 6, F.concat(F.lit(';"first\nsecond; '), k.cast("string"), F.lit('"'))).otherwise(";z")
    )
    line = F.when(k % 100 == 1, "id;name;name").when(k % 10 == 3, F.concat(k.cast("string"), F.lit(";"), "c_mktsegment", F.lit(";"), note)).otherwise(F.concat(k.cast("string"), F.lit(";"), "c_mktsegment", note))
    head = spark.createDataFrame([("﻿id;name;name",)], "line string")
    path = I.scratch(spark, "broken")
    head.unionByName(S.table(spark, d, "customer").select(line.alias("line"))).coalesce(1).write.text(path)  # one file, as such a file comes
    return path


@query("src_csv_repair", """SELECT CASE WHEN c_custkey % 100 = 1 THEN 'id' ELSE CAST(c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey % 100 = 1 THEN 'name' ELSE c_mktsegment END AS name,
CASE WHEN c_custkey % 100 = 1 THEN 'name' WHEN c_custkey % 10 = 3 THEN 'x;y' WHEN c_custkey % 10 = 4 THEN NULL WHEN c_custkey % 7 = 0 THEN 'Café' WHEN c_custkey % 10 = 5 THEN 'a; "' || c_custkey || '" b' WHEN c_custkey % 10 = 6 THEN 'first' || chr(10) || 'second; ' || c_custkey ELSE 'z' END AS name_2 FROM customer""")
def src_csv_repair(spark, d):
    return C.repair_csv(spark, broken(spark, d))[0]


@query("src_csv_findings", """SELECT * FROM (SELECT 'CD001' AS code, 'low' AS severity, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'CD002', CASE WHEN count(*) FILTER (c_custkey % 10 IN (3, 4)) >= 0.2 * count(*) THEN 'high' ELSE 'medium' END, count(*) FILTER (c_custkey % 10 IN (3, 4)) FROM customer
UNION ALL SELECT 'CD003', 'medium', 2 * count(*) FILTER (c_custkey % 10 = 6 AND c_custkey % 7 <> 0) FROM customer UNION ALL SELECT 'CD005', 'medium', count(*) FILTER (c_custkey % 7 = 0 AND c_custkey % 10 NOT IN (3, 4) AND c_custkey % 100 <> 1) FROM customer UNION ALL SELECT 'CD007', 'medium', 1) WHERE n > 0""")
def src_csv_findings(spark, d):
    return C.repair_csv(spark, broken(spark, d))[1]


@query("src_log_text", "SELECT CAST(0 AS BIGINT) AS first_n, count(*) AS lines FROM events")
def src_log_text(spark, d):
    S.table(spark, d, "events").select(F.concat_ws(" ", F.col("ts").cast("string"), "event_type").alias("line")).coalesce(4).write.text(path := I.scratch(spark, "logs"))
    lines = L.numbered_lines(spark, path).filter("line <> ''")
    return lines.agg(F.min("n").alias("first_n"), F.count(F.lit(1)).alias("lines"))


@query("src_event_log", "SELECT l_suppkey AS stage, count(*) AS tasks, CAST(max(CAST(l_quantity AS BIGINT)) AS BIGINT) AS max_ms FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1")
def src_event_log(spark, d):
    li = S.table(spark, d, "lineitem")
    end = F.struct(F.lit("SparkListenerTaskEnd").alias("Event"), F.col("l_suppkey").alias("Stage ID"), F.struct(F.col("l_linenumber").cast("long").alias("Index"), F.lit(1000).cast("long").alias("Launch Time"), (1000 + F.col("l_quantity").cast("long")).alias("Finish Time"), (F.col("l_partkey") % 5 == 0).alias("Failed"), F.lit(False).alias("Killed")).alias("Task Info"))
    li.select(F.to_json(end).alias("line")).write.option("compression", "gzip").text(path := I.scratch(spark, "eventlog"))
    return T.stage_skew(I.read_event_log(spark, path), ["stage"]).select("stage", "tasks", F.col("max_ms"))


@query("ln_from_spark", "SELECT 'file:/lake/t' || l_partkey % 40 AS src, 'file:/lake/out' || l_suppkey % 7 AS dst, count(DISTINCT l_orderkey) AS runs, CAST(max(l_orderkey * 1000) AS BIGINT) AS last_ms FROM lineitem GROUP BY 1, 2")
def ln_from_spark(spark, d):
    """Edges from a compressed event log with one write for each order and target, which scans the folders of the order's parts; plans are spelled out after the shuffle."""
    li = S.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 7).alias("to"), (F.col("l_partkey") % 40).cast("int").alias("of"))
    before, after = "(1) Scan parquet \nOutput [1]: [a#0]\nBatched: true\nLocation: InMemoryFileIndex [file:/lake/t", "]\nReadSchema: struct<a:int>\n\n"
    scans = F.when(F.size("of") > 0, F.concat(F.lit(before), F.array_join(F.col("of").cast("array<string>"), after + before), F.lit(after))).otherwise("")
    insert = F.concat(F.lit("(4) Execute InsertIntoHadoopFsRelationCommand\nInput: []\nArguments: file:/lake/out"), F.col("to").cast("string"), F.lit(", false, Parquet, [path=x], Overwrite, [a]\n"))
    plans = li.groupBy("l_orderkey", "to").agg(F.collect_list("of").alias("of")).withColumn("scans", scans)
    event = F.struct(F.lit("org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart").alias("Event"), F.col("l_orderkey").alias("executionId"), (F.col("l_orderkey") * 1000).alias("time"), F.concat(F.lit("== Physical Plan ==\n\n"), "scans", insert).alias("physicalPlanDescription"))
    plans.select(F.to_json(event).alias("line")).write.option("compression", "gzip").text(path := I.scratch(spark, "sqllog"))
    return I.read_plan_edges(spark, path)


@query("src_orc", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def src_orc(spark, d):
    """A catalogued file connector: ORC there and back."""
    S.table(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.orc(path := I.scratch(spark, "orc"))
    return spark.read.orc(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("snk_csv", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def snk_csv(spark, d):
    I.write_csv(S.table(spark, d, "orders").select("o_orderkey"), path := I.scratch(spark, "export"))
    return spark.read.option("header", True).schema("o_orderkey long").csv(path).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("snk_history", "SELECT o_orderpriority AS check_name, '2' AS run, count(*) FILTER (o_orderkey % 2 = 0) AS n FROM orders GROUP BY 1")
def snk_history(spark, d):
    o, path = S.table(spark, d, "orders"), I.scratch(spark, "ledger")
    I.append_ledger(o.groupBy(F.col("o_orderpriority").alias("check_name")).agg(F.count(F.lit(1)).alias("n")), path, "1")
    I.append_ledger(o.filter("o_orderkey % 2 = 0").groupBy(F.col("o_orderpriority").alias("check_name")).agg(F.count(F.lit(1)).alias("n")), path, "2")
    return I.latest(spark, path, ["check_name"])


@query("snk_backfill", "SELECT strftime(o_orderdate, '%Y') AS pt, CASE WHEN strftime(o_orderdate, '%Y') IN ('1996', '1997') THEN count(*) FILTER (o_orderstatus = 'F') ELSE count(*) END AS n FROM orders GROUP BY 1, strftime(o_orderdate, '%Y')")
def snk_backfill(spark, d):
    """Two years rewritten twice with corrected rows: the others stay, and the second run changes nothing."""
    o, path = S.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy").alias("pt")), I.scratch(spark, "backfill")
    o.write.partitionBy("pt").parquet(path)
    for _ in range(2):
        I.backfill(o.filter("o_orderstatus = 'F'"), path, "pt", ["1996", "1997"])
    return spark.read.schema("o_orderkey long, o_orderstatus string, pt string").parquet(path).groupBy("pt").agg(F.count(F.lit(1)).alias("n"))


@query("snk_publish_merge", """WITH o AS (SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS slot FROM orders), d AS (SELECT DISTINCT slot FROM o WHERE slot >= '1996-03-01' AND slot <= '1996-04-30')
SELECT slot, count(*) AS n, CAST(sum(CAST(CASE WHEN o_orderkey % 3 = 0 AND slot IN (SELECT slot FROM d) THEN 0 ELSE o_totalprice END AS DECIMAL(20, 2))) AS DOUBLE) AS total FROM o WHERE slot >= '1996-01-01' AND slot <= '1996-12-30' GROUP BY 1""")
def snk_publish_merge(spark, d):
    """A year of days, two months of which get corrected rows by key, twice."""
    import datetime as dt

    day = lambda m, k: dt.datetime(1996, m, k)
    o, path = S.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("slot")), I.scratch(spark, "published")
    P.publish(o, path, P.slots(day(1, 1), day(12, 30)))
    for _ in range(2):
        P.publish(o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0).cast(o.schema["o_totalprice"].dataType)), path, P.slots(day(3, 1), day(4, 30)), "merge", ["o_orderkey"])
    rows = P.read_published(spark, path, f"o_orderkey long, o_totalprice {o.schema['o_totalprice'].dataType.simpleString()}")
    return rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("total"))


@query("snk_publish_hours", "SELECT strftime(ts, '%Y-%m-%d %H') AS slot, count(*) AS n FROM events WHERE hour(ts) <> 5 OR event_type = 'click' GROUP BY 1")
def snk_publish_hours(spark, d):
    """Events by hours; the fifth hour of every day is replaced by its clicks."""
    e, path = S.table(spark, d, "events").select("event_id", "event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH").alias("slot")), I.scratch(spark, "hours")
    every = [r.slot for r in e.select("slot").distinct().collect()]  # of a table of some weeks
    P.publish(e, path, every)
    P.publish(e.filter("event_type = 'click'"), path, [h for h in every if h.endswith(" 05")])
    return P.read_published(spark, path, "event_id long, event_type string").groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


@query("src_jdbc", "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def src_jdbc(spark, d):
    """Orders through a database in memory, read in eight parts of even size by a skewed key (on one machine only: the database lives in its JVM)."""
    url, options = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    S.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_custkey") * F.col("o_custkey")).alias("k")).write.jdbc(url, "orders", properties=options)
    return D.read_evenly(spark, url, "orders", "k", 8, 0.5, **options).groupBy(*["o_orderpriority"]).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


@query("prt_compact_run", "SELECT count(*) AS n FROM orders")
def prt_compact_run(spark, d):
    a, b = I.scratch(spark, "small"), I.scratch(spark, "large")
    S.table(spark, d, "orders").repartition(12).write.parquet(a)
    I.compact(spark, a, b, 2)
    return spark.read.parquet(b).agg(F.count(F.lit(1)).alias("n"))


def event_stream(spark, d):
    """Events through a file source, with the arrival that the batch queries derive; times in UTC."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    late = F.col("event_id") * 7919 % 97 + F.when(F.col("event_id") % 250 == 0, 7200).otherwise(0)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("arrival", F.timestamp_seconds(F.unix_timestamp("ts") + late))


def through(spark, stream, mode="append"):
    out = I.scratch(spark, "stream")
    W.run_once(stream, f"{out}/rows", f"{out}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("wm_apply", "WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 2 MINUTE AS mark FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, n FROM w, m WHERE s + INTERVAL 1 HOUR <= mark")
def wm_apply(spark, d):
    """Hourly counts behind the measured bound; the last windows stay open until later events come."""
    return through(spark, W.tumbling(event_stream(spark, d), "ts", "2 minutes", "1 hour", ("event_type",))).withColumn("start", F.col("start").cast("string"))


@query("wm_sliding", "WITH w AS (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS s, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 2 MINUTE AS mark FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, n FROM w, m WHERE s + INTERVAL 3 HOUR <= mark")
def wm_sliding(spark, d):
    """Counts of three hours, every hour."""
    return through(spark, W.tumbling(event_stream(spark, d), "ts", "2 minutes", "3 hours", ("event_type",), "1 hour")).withColumn("start", F.col("start").cast("string"))


@query("wm_dedup", "SELECT event_id, user_id FROM events")
def wm_dedup(spark, d):
    """Every event comes twice, as from a source that delivers at least once."""
    s = event_stream(spark, d).select("event_id", "user_id", "ts")
    return through(spark, W.deduplicated(s.unionByName(s), "ts", "2 minutes", ["event_id"])).select("event_id", "user_id")


@query("wm_late", "SELECT event_id % 250 = 0 AS late, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def wm_late(spark, d):
    """Late events in a folder of their own, by batch."""
    s, out = event_stream(spark, d).select("event_id", "ts", "arrival"), I.scratch(spark, "late")
    W.split_late(s, "ts", "arrival", 120, f"{out}/on_time", f"{out}/late").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    sides = [W.read_batches(spark, "event_id long", f"{out}/{side}").withColumn("late", F.lit(side == "late")) for side in ("on_time", "late")]
    return sides[0].unionByName(sides[1]).groupBy("late").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


#: An offset snapshot of each group and hour: the end grows with the events, the committed offset with the clicks.
SNAPSHOTS = """
h AS (SELECT 'g' || user_id % 12 AS grp, date_trunc('hour', ts) AS t, count(*) AS n, count(*) FILTER (event_type = 'click') AS c FROM events WHERE (hour(ts) * 7 + user_id % 12) % 11 > 1 GROUP BY 1, 2),
l AS (SELECT grp, t, CAST(greatest(n * 100 - c * 60, 0) + greatest(n * 10 - c * 20, 0) AS BIGINT) AS lag FROM h)"""


def snapshots(spark, d):
    """The snapshots as JSON files, one document for each group and hour."""
    e, t = S.table(spark, d, "events"), F.date_trunc("hour", F.col("ts").cast("timestamp"))
    own = e.filter((F.hour("ts") * 7 + F.col("user_id") % 12) % 11 > 1).groupBy(F.concat(F.lit("g"), (F.col("user_id") % 12).cast("string")).alias("group"), t.alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("c"))
    part = lambda i, a, b: F.struct(F.lit(i).alias("partition"), (F.col("n") * a).alias("log_end_offset"), (F.col("c") * b).alias("committed_offset"))
    own.select("group", "ts", F.array(F.struct(F.lit("t").alias("topic"), F.array(part(0, 100, 60), part(1, 10, 20)).alias("partitions"))).alias("topics")).write.json(path := I.scratch(spark, "lags"))
    return path


@query("src_kafka", f"WITH {SNAPSHOTS} SELECT grp AS \"group\", count(*) AS snapshots, CAST(sum(lag) AS BIGINT) AS lag FROM l GROUP BY 1")
def src_kafka(spark, d):
    """Offset snapshots of groups, read from their files."""
    return K.total_lags(K.read_lag_snapshots(spark, snapshots(spark, d))).groupBy("group").agg(F.count(F.lit(1)).alias("snapshots"), F.sum("lag").alias("lag"))


@query("kfk_lag_stream", f"""WITH {SNAPSHOTS}, x AS (SELECT *, lag(lag, 1) OVER w AS b, lag(lag, 2) OVER w AS a, lead(t) OVER w AS nx, max(t) OVER () AS now FROM l WINDOW w AS (PARTITION BY grp ORDER BY t))
SELECT grp AS "group", strftime(t, '%Y-%m-%d %H:%M:%S') AS ts, 'rising' AS kind, a AS from_lag, lag AS to_lag, CASE WHEN a > 0 THEN round(100 * (CAST(lag AS DOUBLE) / a - 1), 1) END AS growth_pct FROM x WHERE a < b AND b < lag
UNION ALL SELECT grp, strftime(t + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S'), 'stalled', NULL, lag, NULL FROM x WHERE nx > t + INTERVAL 2 HOUR OR nx IS NULL AND now >= t + INTERVAL 2 HOUR""")
def kfk_lag_stream(spark, d):
    """Backlogs that rise three times on end, and groups without a snapshot for two hours, from a stream of snapshot files."""
    K.with_keyed_state(spark)
    path = snapshots(spark, d)
    lags = K.read_lag_snapshots(spark, path, stream=True).withColumn("lag", F.greatest(F.col("end_offset") - F.col("committed"), F.lit(0)))
    whole = lags.withWatermark("ts", "0 seconds").groupBy("group", "ts").agg(F.sum("lag").alias("lag"))
    closed, out = I.scratch(spark, "closed"), I.scratch(spark, "alerts")
    W.run_once(whole, f"{closed}/rows", f"{closed}/checkpoint")
    stream = spark.readStream.schema(whole.schema).parquet(f"{closed}/rows")
    W.run_once(K.lag_alerts(stream, 3, 7200), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(K.LAG_ALERTS).parquet(f"{out}/rows").withColumn("ts", F.col("ts").cast("string"))


@query("alert_storm_stream", """WITH m AS (SELECT max(ts) - INTERVAL 2 MINUTE AS mark FROM events), b AS (SELECT event_type AS scope, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT b.* FROM b, m WHERE s + 3600 <= epoch(mark)),
r AS (SELECT x.scope, x.s, x.n, list(y.n ORDER BY y.n) AS l FROM c x JOIN c y ON x.scope = y.scope AND y.s <= x.s AND y.s // 86400 > x.s // 86400 - 7 GROUP BY 1, 2, 3), g AS (SELECT ln(1.01 / 0.99) AS gamma),
k AS (SELECT scope, s, n, 2 * exp(gamma * ceil(ln(l[len(l) // 2 + 1]) / gamma - 1e-9)) / (1 + exp(gamma)) AS mid FROM r, g) SELECT scope, s AS bucket_s, n, round(mid, 6) AS median FROM k WHERE n >= 5 AND n >= 1.5 * mid""")
def alert_storm_stream(spark, d):
    """Hours with half as many events again as the running median of their kind over seven days."""
    K.with_keyed_state(spark)
    found = A.storm_stream(event_stream(spark, d), "ts", "event_type", "2 minutes", "1 hour", 1.5)
    return through(spark, found).withColumn("median", F.round("median", 6))


@query("wm_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS z, count(*) AS n FROM r GROUP BY user_id, k), m AS (SELECT max(ts) - INTERVAL 2 MINUTE AS mark FROM events) SELECT user_id, rtrim(rtrim(strftime(a, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS start, rtrim(rtrim(strftime(z, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS finish, n FROM s, m WHERE z <= mark""")
def wm_sessions(spark, d):
    return through(spark, W.sessions(event_stream(spark, d), "ts", "2 minutes", "30 minutes", "user_id")).withColumns({c: F.col(c).cast("string") for c in ("start", "finish")})


@query("wm_late_rows", "SELECT event_id, event_id % 250 = 0 AS late FROM events WHERE event_id % 250 = 0")
def wm_late_rows(spark, d):
    """Late rows of the stream, told apart by the bound before any stateful step."""
    tagged = W.tagged_late(event_stream(spark, d), "ts", "arrival", 120)
    return through(spark, tagged.filter("late").select("event_id", "late"))


@query("wm_alert_memory", "WITH f AS (SELECT event_type, value, value > 90 AS up, coalesce(lag(value > 90) OVER (PARTITION BY event_type ORDER BY event_id), false) AS was FROM events) SELECT event_type, CAST(value AS DOUBLE) AS value, CASE WHEN up THEN 'raised' ELSE 'recovered' END AS kind FROM f WHERE up <> was")
def wm_alert_memory(spark, d):
    return through(spark, W.remembered_alerts(event_stream(spark, d), "event_type", "value", 90.0, "event_id"))
