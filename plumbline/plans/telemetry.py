"""Queries of telemetry: events with arrival times, orders as runs, tasks, partitions, requests and bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.values import exact
from plumbline.operators import telemetry as T
from plumbline.sources import tables as S

from .inputs import ARRIVALS, EDGES, arrivals, edges
from .registry import query

SEC = "CAST(epoch(date_trunc('second', ts)) AS BIGINT)"


def events(spark, d):
    return S.table(spark, d, "events").withColumn("s", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))))


@query("wm_lateness", f"""WITH {ARRIVALS}, l AS (SELECT *, arrival_s - event_s AS late, event_s < max(event_s) OVER (ORDER BY arrival_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ooo FROM arrivals), r AS (SELECT late, row_number() OVER (ORDER BY late) - 1 AS rn, count(*) OVER () AS n FROM l WHERE late BETWEEN 0 AND 3600),
q AS (SELECT min(late) FILTER (rn = round_even(0.5 * (n - 1), 0)) AS p50, min(late) FILTER (rn = round_even(0.95 * (n - 1), 0)) AS p95, min(late) FILTER (rn = round_even(0.99 * (n - 1), 0)) AS p99 FROM r), b AS (SELECT *, CAST(greatest(1, ceil(p99 * 1.25)) AS BIGINT) AS bound FROM q)
SELECT count(*) AS events, p50, p95, p99, max(late) AS most, count(*) FILTER (ooo) / CAST(count(*) AS DOUBLE) AS out_of_order, bound, count(*) FILTER (late > bound) / CAST(count(*) AS DOUBLE) AS residual,
concat_ws(',', CASE WHEN count(*) FILTER (late < 0) >= 0.05 * count(*) THEN 'WM001' END, CASE WHEN max(late) >= 10 * p99 THEN 'WM002' END, CASE WHEN count(*) FILTER (late > 3600) > 0 THEN 'WM003' END) AS codes FROM l, b GROUP BY p50, p95, p99, bound""")
def wm_lateness(spark, d):
    return T.lateness(arrivals(spark, d), "event_s", "arrival_s", "event_id")


_STAGES = f"st AS (SELECT event_id, {SEC} AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE {SEC} + event_id * 31 % 5 END AS b, {SEC} + 5 + event_id * 17 % 40 - CASE WHEN event_id % 11 = 0 THEN 30 ELSE 0 END AS c, {SEC} + 50 + event_id * 13 % 9 + CASE WHEN event_id % 500 = 0 THEN 900 ELSE 0 END AS d FROM events)"
_HOPS = f"""{_STAGES}, h AS (SELECT event_id, CASE WHEN b IS NULL THEN 'a->c' ELSE 'a->b' END AS hop, greatest(coalesce(b, c) - a, 0) AS delta FROM st UNION ALL SELECT event_id, 'b->c', greatest(c - b, 0) FROM st WHERE b IS NOT NULL UNION ALL SELECT event_id, 'c->d', greatest(d - c, 0) FROM st UNION ALL SELECT event_id, 'total', greatest(d - a, 0) FROM st)"""


def hops(spark, d):
    e, k = events(spark, d), F.col("event_id")
    st = e.select("event_id", F.col("s").alias("a"), F.when(k % 7 == 0, None).otherwise(F.col("s") + k * 31 % 5).alias("b"), (F.col("s") + 5 + k * 17 % 40 - F.when(k % 11 == 0, 30).otherwise(0)).alias("c"), (F.col("s") + 50 + k * 13 % 9 + F.when(k % 500 == 0, 900).otherwise(0)).alias("d"))
    return T.stage_hops(st, "event_id", ["a", "b", "c", "d"])


@query("lat_stages", f"""WITH {_HOPS}, r AS (SELECT *, row_number() OVER (PARTITION BY hop ORDER BY delta) - 1 AS rn, count(*) OVER (PARTITION BY hop) AS n FROM h), g AS (SELECT hop, count(*) AS n, min(delta) FILTER (rn = round_even(0.5 * (n - 1), 0)) AS p50, min(delta) FILTER (rn = round_even(0.95 * (n - 1), 0)) AS p95, max(delta) AS most FROM r GROUP BY 1)
SELECT *, hop = (SELECT hop FROM g WHERE hop <> 'total' ORDER BY p95 DESC, hop DESC LIMIT 1) AS dominant FROM g""")
def lat_stages(spark, d):
    return T.hop_latency(hops(spark, d))


@query("lat_outliers", f"WITH {_HOPS}, m AS (SELECT median(delta) AS m, count(*) AS n FROM h WHERE hop = 'total'), w AS (SELECT event_id, arg_max(hop, delta * 1000 + ascii(hop) * 1.0) AS worst_hop FROM h WHERE hop <> 'total' GROUP BY 1) SELECT event_id, delta AS total, worst_hop FROM h JOIN w USING (event_id), m WHERE hop = 'total' AND n >= 4 AND delta > 3 * m")
def lat_outliers(spark, d):
    return T.slow_events(hops(spark, d), "event_id")


_SNAP = "sn AS (SELECT 'g' || user_id % 12 AS grp, user_id AS part, max(event_id) * 1000 AS end_offset, min(event_id) * 1000 AS committed, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS consume_rate, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS produce_rate FROM events GROUP BY 1, 2)"


@query("kfk_lag", f"""WITH {_SNAP}, g AS (SELECT grp, CAST(sum(greatest(end_offset - committed, 0)) AS BIGINT) AS lag, max(greatest(end_offset - committed, 0)) AS worst, median(greatest(end_offset - committed, 0)) AS mid, sum(consume_rate) AS c, sum(produce_rate) AS p FROM sn GROUP BY 1),
x AS (SELECT *, worst / nullif(CAST(mid AS DOUBLE), 0) AS ratio, CASE WHEN c > p THEN lag / (c - p) / 60 END AS eta_min FROM g)
SELECT grp, lag, ratio, eta_min, concat_ws(',', CASE WHEN lag >= 1000000 THEN 'KL001 high' WHEN lag >= 100000 THEN 'KL001 mid' END, CASE WHEN ratio >= 20 THEN 'KL002 high' WHEN ratio >= 5 THEN 'KL002 mid' END, CASE WHEN c <= p AND c > 0 THEN 'KL003' END, CASE WHEN c = 0 AND lag > 0 THEN 'KL004' END, CASE WHEN eta_min >= 180 THEN 'KL005 high' WHEN eta_min >= 30 THEN 'KL005 mid' END) AS codes FROM x""")
def kfk_lag(spark, d):
    sn = S.table(spark, d, "events").groupBy(F.concat(F.lit("g"), (F.col("user_id") % 12).cast("string")).alias("grp"), F.col("user_id").alias("part")).agg(
        (F.max("event_id") * 1000).alias("end_offset"), (F.min("event_id") * 1000).alias("committed"), F.count_if(F.col("event_type") == "click").cast("double").alias("consume_rate"), F.count_if(F.col("event_type") == "view").cast("double").alias("produce_rate"))
    return T.consumer_lag(sn, ["grp"])


@query("cdc_gap", """WITH f AS (SELECT 'p' || user_id AS pipeline, 100 AS source_file, max(event_id) * 100000 AS source_pos, 100 - user_id % 3 AS file, min(event_id) * 100000 AS pos, CAST(user_id * 30 AS BIGINT) AS age_s, CAST(4000 AS BIGINT) AS retention_s FROM events GROUP BY user_id),
x AS (SELECT pipeline, source_file - file AS files_behind, CASE WHEN source_file = file THEN source_pos - pos END AS byte_lag, age_s, age_s / CAST(retention_s AS DOUBLE) AS retention_used FROM f)
SELECT pipeline, files_behind, byte_lag, retention_used, concat_ws(',', CASE WHEN files_behind < 0 OR byte_lag < 0 THEN 'ahead' END, CASE WHEN byte_lag >= 209715200 THEN 'bytes high' WHEN byte_lag >= 10485760 THEN 'bytes mid' END, CASE WHEN files_behind > 0 THEN 'files' END, CASE WHEN age_s >= 1800 THEN 'stale high' WHEN age_s >= 300 THEN 'stale mid' END, CASE WHEN retention_used >= 0.8 THEN 'retention high' WHEN retention_used >= 0.5 THEN 'retention mid' END) AS codes FROM x""")
def cdc_gap(spark, d):
    u = F.col("user_id")
    f = S.table(spark, d, "events").groupBy("user_id").agg((F.max("event_id") * 100000).alias("source_pos"), (F.min("event_id") * 100000).alias("pos"))
    return T.cdc_gaps(f.select(F.concat(F.lit("p"), u.cast("string")).alias("pipeline"), F.lit(100).cast("long").alias("source_file"), "source_pos", (100 - u % 3).alias("file"), "pos", (u * 30).alias("age_s"), F.lit(4000).cast("long").alias("retention_s")))


@query("flk_ckpt", """WITH c AS (SELECT user_id AS job, event_id AS run, value AS duration_s, event_type = 'error' AS failed, value * 0.6 AS alignment_s FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY run DESC) AS r FROM c),
g AS (SELECT job, count(*) FILTER (failed) AS failures, max(duration_s) FILTER (r = 1) AS last_s, median(duration_s) FILTER (r > 1) AS before_s FROM r GROUP BY 1) SELECT *, CASE WHEN last_s >= 300 THEN 'high' WHEN last_s >= 60 OR last_s >= 2 * before_s THEN 'mid' END AS slow, TRUE AS aligning FROM g""")
def flk_ckpt(spark, d):
    c = S.table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("run"), F.col("value").alias("duration_s"), (F.col("event_type") == "error").alias("failed"), (F.col("value") * 0.6).alias("alignment_s"))
    return T.checkpoint_health(c, ["job"], "run")


_TASKS = "tk AS (SELECT l_suppkey AS stage, CAST(l_quantity * 1000 AS BIGINT) AS duration_ms, CAST(l_extendedprice * 1000 AS BIGINT) AS shuffle_bytes FROM lineitem)"


def tasks(spark, d):
    return S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stage"), (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"), (F.col("l_extendedprice") * 1000).cast("long").alias("shuffle_bytes"))


@query("spk_stage_skew", f"""WITH {_TASKS}, g AS (SELECT stage, count(*) AS tasks, median(duration_ms) AS p50_ms, max(duration_ms) AS max_ms, median(shuffle_bytes) AS pb, max(shuffle_bytes) AS mb FROM tk GROUP BY 1), x AS (SELECT *, max_ms / p50_ms AS t, mb / pb AS b FROM g)
SELECT stage, tasks, p50_ms, max_ms, t AS ratio, CASE WHEN tasks < 3 THEN NULL WHEN (t >= 5 AND max_ms >= 30000) OR (b >= 5 AND mb >= 134217728) THEN 'high' WHEN (t >= 3 AND max_ms >= 10000) OR (b >= 3 AND mb >= 33554432) THEN 'mid' END AS severity FROM x""")
def spk_stage_skew(spark, d):
    return T.stage_skew(tasks(spark, d), ["stage"])


@query("spk_shuffle_dist", f"""WITH {_TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY shuffle_bytes) - 1 AS rn, count(*) OVER (PARTITION BY stage) AS n FROM tk), g AS (SELECT stage, median(shuffle_bytes) AS p50, max(shuffle_bytes) AS most, min(shuffle_bytes) FILTER (rn = least(floor(n * 0.99), n - 1)) AS p99 FROM r GROUP BY 1)
SELECT stage, p50, p99, most, p99 / p50 AS ratio, CASE WHEN p99 / p50 >= 2 THEN CAST(greatest(2, least(64, ceil(most / (2 * p50)))) AS INTEGER) END AS salts FROM g""")
def spk_shuffle_dist(spark, d):
    return T.shuffle_spread(tasks(spark, d), ["stage"], "shuffle_bytes")


@query("spk_run_diag", """WITH r AS (SELECT user_id AS name, event_id AS run, CAST(value * 1000000 AS BIGINT) AS scan_bytes, event_id % 5 AS spill_bytes, value * (event_id % 4) / 10 AS gc_s, value * (event_id % 3) / 5 AS queue_s, value AS duration_s, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
b AS (SELECT name, median(scan_bytes) FILTER (r > 1) AS base_scan FROM r GROUP BY 1) SELECT name, scan_bytes, base_scan, concat_ws(',', CASE WHEN scan_bytes >= 2 * base_scan THEN 'scan' END, CASE WHEN spill_bytes > 0 THEN 'spill' END, CASE WHEN gc_s >= 0.2 * duration_s THEN 'gc' END, CASE WHEN queue_s >= 0.3 * duration_s THEN 'queue' END) AS codes FROM r JOIN b USING (name) WHERE r = 1""")
def spk_run_diag(spark, d):
    v, k = F.col("value"), F.col("event_id")
    r = S.table(spark, d, "events").select(F.col("user_id").alias("name"), k.alias("run"), (v * 1000000).cast("decimal(20,0)").cast("long").alias("scan_bytes"), (k % 5).alias("spill_bytes"), (v * (k % 4) / 10).alias("gc_s"), (v * (k % 3) / 5).alias("queue_s"), v.alias("duration_s"))
    return T.run_diagnosis(r, ["name"], "run")


#: Parts as stages of the years' runs: an order line is a task.
_STAGES = """tk AS (SELECT 'y' || strftime(o_orderdate, '%Y') AS run, 's' || l_suppkey % 20 AS stage, CAST(l_quantity AS DOUBLE) * CASE WHEN l_orderkey % 97 = 0 THEN 9 ELSE 1 END AS duration_s, CAST(l_linenumber % 3 AS BIGINT) AS spill_bytes, CAST(l_partkey * 1000 AS BIGINT) AS input_bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sg AS (SELECT run, stage, count(*) AS tasks, max(duration_s) AS max_s, median(duration_s) AS median_s, CAST(sum(spill_bytes) AS BIGINT) AS spill_bytes, CAST(sum(input_bytes) AS BIGINT) AS input_bytes FROM tk GROUP BY 1, 2)"""


def staged(spark, d):
    li, o = S.table(spark, d, "lineitem"), S.table(spark, d, "orders")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    slow = F.when(F.col("l_orderkey") % 97 == 0, 9).otherwise(1)
    return T.stage_metrics(x.select(F.concat(F.lit("y"), F.date_format("o_orderdate", "yyyy")).alias("run"), F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("stage"), (F.col("l_quantity").cast("double") * slow).alias("duration_s"), (F.col("l_linenumber") % 3).cast("long").alias("spill_bytes"), (F.col("l_partkey") * 1000).cast("long").alias("input_bytes")), "run", "stage")


@query("spk_run_causes", f"""WITH {_STAGES}, rn AS (SELECT run, CAST(sum(tasks) AS DOUBLE) AS duration_s FROM sg GROUP BY 1), w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY max_s / median_s DESC, stage) AS k FROM sg WHERE median_s > 0)
SELECT run, 'SQ001' AS code, stage, round(least(1.0, (max_s - median_s) / duration_s), 6) AS share FROM w JOIN rn USING (run) WHERE k = 1 AND max_s / median_s >= 5 UNION ALL SELECT run, 'SQ006', min(stage), 0.2 FROM sg WHERE tasks >= 200 AND input_bytes > 0 AND input_bytes / CAST(tasks AS DOUBLE) < 8388608 GROUP BY 1""")
def spk_run_causes(spark, d):
    """Skew and small files of each year's run."""
    stages = staged(spark, d)
    return T.stage_causes(stages, stages.groupBy("run").agg(F.sum("tasks").cast("double").alias("duration_s"))).withColumn("share", F.round("share", 6))


@query("spk_run_diff", f"""WITH {_STAGES}, a AS (SELECT * FROM sg WHERE run = 'y1995' AND stage <> 's3'), b AS (SELECT * FROM sg WHERE run = 'y1996' AND stage <> 's5')
SELECT coalesce(a.stage, b.stage) AS stage, CASE WHEN b.stage IS NULL THEN 'a' WHEN a.stage IS NULL THEN 'b' ELSE 'both' END AS side, CASE WHEN a.stage IS NOT NULL AND b.stage IS NOT NULL THEN round(b.max_s / a.max_s, 2) END AS max_ratio, CASE WHEN a.stage IS NOT NULL AND b.stage IS NOT NULL THEN round(b.median_s / a.median_s, 2) END AS median_ratio, a.spill_bytes AS spill_a, b.spill_bytes AS spill_b FROM a FULL JOIN b ON a.stage = b.stage""")
def spk_run_diff(spark, d):
    """Two years' runs side by side, each without one of the stages."""
    stages = staged(spark, d)
    return T.stage_diff(stages.filter("run = 'y1995' and stage <> 's3'"), stages.filter("run = 'y1996' and stage <> 's5'"))


@query("fresh_table", f"""WITH u AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'ods.' ELSE 'dwd.' END || 't' || user_id AS table_name, {SEC} AS s FROM events), l AS (SELECT *, s - lag(s) OVER (PARTITION BY table_name ORDER BY s) AS gap FROM u), g AS (SELECT table_name, max(s) AS last, count(*) AS n, median(gap) AS typical, arg_max(coalesce(gap, -1), s) AS last_gap FROM l GROUP BY 1), m AS (SELECT max(last) AS now FROM g),
x AS (SELECT table_name, now - last AS age_s, CASE WHEN table_name LIKE 'ods.%' THEN 86400.0 WHEN n >= 3 THEN typical END AS interval_s, CASE WHEN table_name LIKE 'ods.%' THEN 43200 END AS max_age, last_gap FROM g, m)
SELECT table_name, age_s, CAST(interval_s AS DOUBLE) AS interval_s, CASE WHEN age_s > 2 * interval_s THEN 'stalled' WHEN age_s > max_age THEN 'stale' WHEN last_gap > 1.25 * interval_s THEN 'late' WHEN interval_s IS NULL THEN 'unknown' ELSE 'ok' END AS state FROM x""")
def fresh_table(spark, d):
    u = events(spark, d).select(F.concat(F.when(F.col("user_id") % 3 == 0, "ods.").otherwise("dwd."), F.lit("t"), F.col("user_id").cast("string")).alias("table_name"), "s")
    rules = spark.createDataFrame([(1, "ods.*", 86400, 43200), (2, "*", None, None)], "rank int, pattern string, interval_s int, max_age_s int")
    return T.table_freshness(u, rules)


_MISSING = "ms AS (SELECT u.node, CAST(s.day AS DATE) AS day FROM (SELECT DISTINCT 'c' || user_id AS node FROM events) u, (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-20', INTERVAL 1 DAY)) AS day) s ANTI JOIN (SELECT DISTINCT 'c' || user_id AS node, CAST(ts AS DATE) AS day FROM events) h ON u.node = h.node AND CAST(s.day AS DATE) = h.day)"


def gaps(spark, d):
    e = S.table(spark, d, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("node"), F.to_date("ts").alias("day"))
    return T.missing_slots(e, "node", F.col("day"), "2024-01-05", "2024-01-20")


@query("bf_missing_slots", f"WITH {_MISSING} SELECT node, CAST(day AS VARCHAR) AS day FROM ms")
def bf_missing_slots(spark, d):
    return gaps(spark, d).withColumn("day", F.col("day").cast("string"))


@query("bf_cascade", f"WITH RECURSIVE {EDGES}, {_MISSING}, c(node, day, hop) AS (SELECT node, day, 0 FROM ms UNION SELECT dst, day, hop + 1 FROM c JOIN edges ON src = c.node) SELECT node, CAST(day AS VARCHAR) AS day, CAST(max(hop) AS INTEGER) AS hop FROM c GROUP BY 1, 2")
def bf_cascade(spark, d):
    return T.cascade(gaps(spark, d), edges(spark, d)).withColumn("day", F.col("day").cast("string"))


_SLA = "rn AS (SELECT o_orderpriority AS task, CAST(o_orderdate AS DATE) AS day, CAST(1380 AS BIGINT) AS deadline_min, max(1200 + o_orderkey % 400) AS finish_min FROM orders GROUP BY 1, 2)"


@query("sla_board", f"""WITH {_SLA}, l AS (SELECT *, finish_min - deadline_min AS late FROM rn), r AS (SELECT task, late, row_number() OVER (PARTITION BY task ORDER BY late) - 1 AS k, count(*) OVER (PARTITION BY task) AS n FROM l WHERE late > 0), q AS (SELECT task, min(late) FILTER (k = round_even(0.5 * (n - 1), 0)) AS late_p50, min(late) FILTER (k = round_even(0.9 * (n - 1), 0)) AS late_p90 FROM r GROUP BY 1),
f AS (SELECT *, sum(CASE WHEN late > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY task ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM l), s AS (SELECT task, max(n) AS longest, arg_max(n, g) AS live FROM (SELECT task, g, count(*) FILTER (late > 0) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT task, count(*) AS runs, count(*) FILTER (late > 0) AS misses, max(late) FILTER (late > 0) AS worst FROM l GROUP BY 1) SELECT *, 1 - misses / CAST(runs AS DOUBLE) AS attainment FROM b LEFT JOIN q USING (task) LEFT JOIN s USING (task)""")
def sla_board(spark, d):
    rn = S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task"), F.to_date("o_orderdate").alias("day")).agg(F.lit(1380).cast("long").alias("deadline_min"), F.max(1200 + F.col("o_orderkey") % 400).alias("finish_min"))
    return T.sla_board(rn)


@query("sla_trace", """WITH RECURSIVE t AS (SELECT o_orderkey AS k, o_orderkey * 10 AS start, o_orderkey * 10 + 5 + o_orderkey % 7 AS finish FROM orders),
d AS (SELECT k, k // 2 AS dep FROM t WHERE k > 2 UNION SELECT k, k // 3 FROM t WHERE k > 2),
b AS (SELECT d.k, arg_max(dep, (t.finish, CAST(dep AS VARCHAR))) AS dep, max(t.finish) AS f FROM d JOIN t ON t.k = dep GROUP BY 1),
p(step, k) AS (SELECT 0, max(k) FROM t UNION ALL SELECT step + 1, b.dep FROM p JOIN b USING (k))
SELECT p.step, CAST(t.k AS VARCHAR) AS task, start, finish, start - b.f AS wait FROM p JOIN t USING (k) LEFT JOIN b USING (k)""")
def sla_trace(spark, d):
    """The critical path to one task over all orders as tasks: each waits for the two orders at a half and a third of its key."""
    o, k = S.table(spark, d, "orders"), F.col("o_orderkey")
    t = o.select(k.cast("string").alias("task"), (k * 10).alias("start"), (k * 10 + 5 + k % 7).alias("finish"), F.when(k > 2, F.array(F.floor(k / 2).cast("string"), F.floor(k / 3).cast("string"))).otherwise(F.array().cast("array<string>")).alias("deps"))
    return T.critical_run(t, str(o.agg(F.max("o_orderkey")).first()[0]))


_SIG = "left(trim(regexp_replace(regexp_replace(lower({}), '[\\d/:\\\\.\\-_='']+', ' ', 'g'), '\\s+', ' ', 'g')), {})"
_TITLE = "'Job_' || user_id || ' ' || event_type || ': /data/x' || event_id || ' lag=' || event_id % 9"


def titled(spark, d):
    s = lambda c: c.cast("string")
    title = F.concat(F.lit("Job_"), s(F.col("user_id")), F.lit(" "), "event_type", F.lit(": /data/x"), s(F.col("event_id")), F.lit(" lag="), s(F.col("event_id") % 9))
    return events(spark, d).withColumn("title", title)


@query("alert_storm", f"SELECT {_SIG.format(_TITLE, 70)} AS signature, count(*) AS n, min({SEC}) AS first_s, max({SEC}) AS last_s FROM events GROUP BY 1")
def alert_storm(spark, d):
    return T.alert_summary(titled(spark, d), "title", "s")


@query("alert_storm_buckets", f"WITH b AS (SELECT {SEC} // 7200 * 7200 AS bucket_s, count(*) AS n FROM events GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS m FROM b) SELECT bucket_s, n FROM b WHERE n >= 1.3 * (SELECT min(n) FROM r WHERE k = floor(m * 0.5)) AND n >= 5")
def alert_storm_buckets(spark, d):
    return T.alert_storms(events(spark, d), "s", 7200, 1.3)


_ERROR = "CASE user_id % 5 WHEN 0 THEN 'upstream table ods.x' || user_id || ' not found' WHEN 1 THEN 'java.lang.OutOfMemoryError at 10.0.0.' || user_id WHEN 2 THEN 'connection refused: host-' || user_id WHEN 3 THEN 'query time-out after ' || user_id || ' s' ELSE 'strange thing ' || user_id END"


@query("tsk_failures", f"""WITH f AS (SELECT {_ERROR} AS error, event_id % 3 AS retries, CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'failed' END AS st, user_id % 5 AS k FROM events WHERE event_type = 'error')
SELECT CASE k WHEN 0 THEN 'dependency_missing' WHEN 1 THEN 'resource' WHEN 2 THEN 'connection' WHEN 3 THEN 'timeout' ELSE 'other' END AS cause, left(trim(regexp_replace(regexp_replace(lower(error), '[\\d/:\\\\.\\-_'']+', ' ', 'g'), '\\s+', ' ', 'g')), 60) AS signature, count(*) AS n, count(*) FILTER (retries > 0) AS retried, count(*) FILTER (retries > 0 AND st = 'success') AS recovered FROM f GROUP BY 1, 2""")
def tsk_failures(spark, d):
    e = S.table(spark, d, "events").filter("event_type = 'error'")
    error = F.expr("case user_id % 5 when 0 then 'upstream table ods.x' || user_id || ' not found' when 1 then 'java.lang.OutOfMemoryError at 10.0.0.' || user_id when 2 then 'connection refused: host-' || user_id when 3 then 'query time-out after ' || user_id || ' s' else 'strange thing ' || user_id end")
    return T.failure_clusters(e.select(error.alias("error"), (F.col("event_id") % 3).alias("retries"), F.when(F.col("event_id") % 2 == 0, "success").otherwise("failed").alias("final_status")))


_INC = f"inc AS (SELECT user_id AS incident, {SEC} AS s, CASE event_type WHEN 'click' THEN 'impact' WHEN 'view' THEN 'alert' WHEN 'purchase' THEN 'action' WHEN 'error' THEN 'comm' ELSE 'recovery' END AS kind FROM events)"


@query("inc_review", f"""WITH {_INC}, g AS (SELECT incident, min(s) FILTER (kind = 'impact') AS i, min(s) FILTER (kind = 'alert') AS a, min(s) FILTER (kind = 'action') AS x, max(s) FILTER (kind = 'recovery') AS r FROM inc GROUP BY 1),
l AS (SELECT incident, lead(s) OVER (PARTITION BY incident ORDER BY s) - s AS gap FROM inc JOIN g USING (incident) WHERE s BETWEEN i AND r), m AS (SELECT incident, max(gap) AS gap FROM l GROUP BY 1)
SELECT incident, CAST(a - i AS DOUBLE) / 60 AS mttd, CAST(x - a AS DOUBLE) / 60 AS mtta, CAST(r - i AS DOUBLE) / 60 AS mttr, CAST(gap AS DOUBLE) / 60 AS silent FROM g LEFT JOIN m USING (incident)""")
def inc_review(spark, d):
    kind = F.when(F.col("event_type") == "click", "impact").when(F.col("event_type") == "view", "alert").when(F.col("event_type") == "purchase", "action").when(F.col("event_type") == "error", "comm").otherwise("recovery")
    return T.incident_times(events(spark, d).select(F.col("user_id").alias("incident"), "s", kind.alias("kind")))


_PARTS = "pt AS (SELECT l_returnflag || l_linestatus AS table_name, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, count(*) * CASE WHEN month(l_shipdate) = 7 THEN 30 WHEN month(l_shipdate) = 2 THEN 0 ELSE 1 END AS size FROM lineitem GROUP BY 1, 2, month(l_shipdate))"


def parts(spark, d):
    m = F.month("l_shipdate")
    return S.table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("table_name"), F.trunc("l_shipdate", "month").alias("day"), m.alias("m")).agg(F.count(F.lit(1)).alias("n")).select("table_name", "day", (F.col("n") * F.when(F.col("m") == 7, 30).when(F.col("m") == 2, 0).otherwise(1)).alias("size"))


@query("prt_health", f"""WITH {_PARTS}, m AS (SELECT table_name, median(size) AS mid, count(*) AS k, max(day) AS last FROM pt GROUP BY 1), e AS (SELECT table_name, median(size) AS before FROM pt JOIN m USING (table_name) WHERE day < last GROUP BY 1)
SELECT * FROM (SELECT table_name, CAST(day AS VARCHAR) AS day, CASE WHEN size = 0 THEN 'empty' WHEN k >= 4 AND size >= 20 * mid THEN 'skew high' WHEN k >= 4 AND size >= 5 * mid THEN 'skew mid' WHEN day = last AND size >= 3 * before THEN 'surge' WHEN day = last AND size <= 0.3 * before THEN 'shrink' END AS code FROM pt JOIN m USING (table_name) LEFT JOIN e USING (table_name)) WHERE code IS NOT NULL""")
def prt_health(spark, d):
    return T.partition_health(parts(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("prt_compact", """WITH f AS (SELECT l_returnflag AS table_name, strftime(l_shipdate, '%Y-%m') AS part, count(*) AS file_count, CAST(CAST(sum(CAST(l_quantity AS DECIMAL(20, 2))) AS DOUBLE) AS BIGINT) AS total_mb FROM lineitem GROUP BY 1, 2), s AS (SELECT table_name, part, file_count AS files, file_count - CAST(greatest(1, ceil(total_mb / 256.0)) AS BIGINT) AS freed FROM f WHERE total_mb / CAST(file_count AS DOUBLE) < 32 AND file_count > 10)
SELECT *, freed / CAST((SELECT sum(freed) FROM s) AS DOUBLE) AS share FROM s""")
def prt_compact(spark, d):
    f = S.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("table_name"), F.date_format("l_shipdate", "yyyy-MM").alias("part")).agg(F.count(F.lit(1)).alias("file_count"), F.sum(exact("l_quantity")).cast("double").cast("long").alias("total_mb"))
    return T.compaction(f)


_INV = "iv AS (SELECT p_brand AS table_name, CAST(sum(p_size) AS DOUBLE) AS size_gb, count(*) FILTER (p_size > 40) AS access_cnt, CAST(min(p_size) * 60 AS BIGINT) AS idle_days, count(DISTINCT p_type) AS downstream_cnt, CAST(avg(p_size) AS DOUBLE) AS avg_file_mb FROM part GROUP BY 1)"


def inventory(spark, d):
    p = S.table(spark, d, "part")
    return p.groupBy(F.col("p_brand").alias("table_name")).agg(F.sum("p_size").cast("double").alias("size_gb"), F.count_if(F.col("p_size") > 40).alias("access_cnt"), (F.min("p_size") * 60).cast("long").alias("idle_days"), F.count_distinct("p_type").alias("downstream_cnt"), F.avg("p_size").alias("avg_file_mb"))


@query("ast_value", f"""WITH {_INV}, s AS (SELECT table_name, size_gb, round(least(50.0, 8 * log2(1 + access_cnt)) + least(30.0, 6.0 * downstream_cnt) + CASE WHEN idle_days <= 7 THEN 20 WHEN idle_days <= 30 THEN 10 WHEN idle_days <= 90 THEN 5 ELSE 0 END, 4) AS score FROM iv)
SELECT table_name, score, CASE WHEN score >= 60 THEN 'core' WHEN score >= 35 THEN 'important' WHEN score >= 15 THEN 'normal' ELSE 'low' END AS tier, CASE WHEN score >= 35 THEN 'valued' ELSE 'plain' END || '-' || CASE WHEN size_gb > (SELECT median(size_gb) FROM s) THEN 'heavy' ELSE 'light' END AS quadrant FROM s""")
def ast_value(spark, d):
    return T.asset_value(inventory(spark, d))


@query("cst_alloc", """WITH b AS (SELECT CASE WHEN c_custkey % 13 = 0 THEN 'unallocated' ELSE c_mktsegment END AS owner, 'i' || o_orderkey % 20 AS item, CAST(o_totalprice AS DECIMAL(20, 2)) AS cost FROM orders JOIN customer ON o_custkey = c_custkey), i AS (SELECT owner, item, sum(cost) AS c FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY c DESC, item) AS r FROM i)
SELECT owner, CAST(sum(c) AS DOUBLE) AS cost, CAST(sum(c) AS DOUBLE) / (SELECT CAST(sum(c) AS DOUBLE) FROM i) AS share, string_agg(item, ',' ORDER BY r) FILTER (r <= 3) AS top_items FROM r GROUP BY 1""")
def cst_alloc(spark, d):
    o, c = S.table(spark, d, "orders"), S.table(spark, d, "customer")
    b = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.when(F.col("c_custkey") % 13 == 0, " ").otherwise(F.col("c_mktsegment")).alias("owner"), F.concat(F.lit("i"), (F.col("o_orderkey") % 20).cast("string")).alias("item"), F.col("o_totalprice").alias("cost"))
    return T.cost_allocation(b)


@query("ing_strategy", """WITH i AS (SELECT 's' || s_suppkey AS table_name, s_suppkey * 3000 AS rows, s_suppkey * 1000 AS daily_change, s_suppkey % 2 = 0 AS has_deletes, s_suppkey % 3 = 0 AS has_update_ts, s_suppkey % 5 <> 0 AS has_pk, s_suppkey % 4 = 0 AS cdc, CASE WHEN s_nationkey % 2 = 0 THEN 'minutes' ELSE 'daily' END AS latency FROM supplier),
s AS (SELECT *, CASE WHEN rows <= 100000 THEN 'full' WHEN (has_deletes OR latency = 'minutes') AND cdc THEN 'cdc' WHEN has_update_ts THEN 'incr_timestamp' WHEN has_pk THEN 'incr_pk' ELSE 'full' END AS strategy FROM i)
SELECT table_name, strategy, CASE WHEN strategy <> 'cdc' AND strategy <> 'full' AND has_deletes THEN 'deletes are missed' WHEN strategy = 'full' AND rows > 10000000 THEN 'a full copy of a large table' WHEN daily_change / CAST(nullif(rows, 0) AS DOUBLE) > 0.3 THEN 'most rows change' END AS risk FROM s""")
def ing_strategy(spark, d):
    k = F.col("s_suppkey")
    return T.ingest_strategy(S.table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("table_name"), (k * 3000).alias("rows"), (k * 1000).alias("daily_change"), (k % 2 == 0).alias("has_deletes"), (k % 3 == 0).alias("has_update_ts"), (k % 5 != 0).alias("has_pk"), (k % 4 == 0).alias("cdc"), F.when(F.col("s_nationkey") % 2 == 0, "minutes").otherwise("daily").alias("latency")))


@query("qlg_insights", "SELECT 'sales of ' || event_type || ' by day' AS question, count(*) AS n, count(*) FILTER (user_id % 7 = 0) AS failures, max(value) AS slowest_ms FROM events GROUP BY 1 ORDER BY n DESC, question LIMIT 3")
def qlg_insights(spark, d):
    q = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sales of  "), "event_type", F.lit(" by day "))).otherwise(F.concat(F.lit("sales of "), "event_type", F.lit(" BY day")))
    log = S.table(spark, d, "events").select(q.alias("question"), F.when(F.col("user_id") % 7 == 0, "error").otherwise("ok").alias("status"), F.col("value").alias("elapsed_ms"))
    return T.query_insights(log, 3)


@query("acc_review", """WITH r AS (SELECT c_custkey AS request, c_custkey % 4 AS s3, c_custkey % 3 AS s2, c_custkey % 9 = 0 AS star, c_nationkey % 2 = 0 AS w, CASE WHEN c_nationkey < 5 THEN 'owner' ELSE 'guest' END AS role, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 250 END AS days, c_mktsegment AS purpose FROM customer),
x AS (SELECT request, least(100, 25 * least(s3, 2) + 5 * least(s2, 3) + CASE WHEN star THEN 20 ELSE 0 END + CASE WHEN w THEN CASE WHEN role = 'owner' THEN 10 ELSE 30 END ELSE 0 END + CASE WHEN days IS NULL OR days > 180 THEN 15 WHEN days > 90 THEN 8 ELSE 0 END + CASE WHEN length(purpose) < 8 THEN 15 ELSE 0 END) AS risk FROM r)
SELECT request, CAST(risk AS INTEGER) AS risk, CASE WHEN risk >= 60 THEN 'reject' WHEN risk >= 30 THEN 'review' ELSE 'approve' END AS decision FROM x""")
def acc_review(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    some = lambda count, level: F.transform(F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct(i.cast("string").alias("name"), F.lit(level).alias("level")))
    star = F.when(k % 9 == 0, F.array(F.struct(F.lit("*").alias("name"), F.lit("S1").alias("level")))).otherwise(F.array().cast("array<struct<name:string,level:string>>"))
    r = S.table(spark, d, "customer").select(k.alias("request"), F.concat(some(k % 4, "S3"), some(k % 3, "S2"), star).alias("columns"), (n % 2 == 0).alias("write"), F.when(n < 5, "owner").otherwise("guest").alias("role"), F.when(k % 6 == 0, None).otherwise(k % 250).alias("days"), F.col("c_mktsegment").alias("purpose"))
    return T.access_review(r)


@query("acc_surface", f"""WITH g AS (SELECT 'db' || user_id % 8 || CASE WHEN user_id % 5 = 0 THEN '.*' ELSE '.t' END AS target, CASE WHEN user_id % 11 = 0 THEN 'public' ELSE 'u' || user_id END AS principal, CASE WHEN user_id % 3 = 0 THEN 'ALL' ELSE 'SELECT' END AS privilege, CASE WHEN event_type IN ('error', 'signup') THEN 'revoke' ELSE 'grant' END AS op, event_id AS s FROM events),
l AS (SELECT target, principal, privilege, arg_max(op, s) AS op FROM g GROUP BY 1, 2, 3) SELECT target, principal, privilege, CASE WHEN principal = 'public' THEN 'high' WHEN privilege = 'ALL' OR contains(target, '*') THEN 'medium' ELSE 'low' END AS severity FROM l WHERE op = 'grant'""")
def acc_surface(spark, d):
    u = F.col("user_id")
    g = S.table(spark, d, "events").select(F.concat(F.lit("db"), (u % 8).cast("string"), F.when(u % 5 == 0, ".*").otherwise(".t")).alias("target"), F.when(u % 11 == 0, "public").otherwise(F.concat(F.lit("u"), u.cast("string"))).alias("principal"), F.when(u % 3 == 0, "ALL").otherwise("SELECT").alias("privilege"), F.when(F.col("event_type").isin("error", "signup"), "revoke").otherwise("grant").alias("op"), F.col("event_id").alias("s"))
    return T.grant_surface(g)
