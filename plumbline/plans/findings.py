"""Queries of findings: run boards, incidents, files, partitions, bills, jobs, alerts, logs, schemas, over the sales and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import findings as N
from plumbline.operators import telemetry as T
from plumbline.plans import telemetry as P
from plumbline.sources import tables as S

from .registry import oracle_of, query

NO_CODES = "CAST(NULL AS DOUBLE)"


@query("sla_findings", lambda: f"""WITH b AS ({oracle_of("sla_board")}) SELECT 'SL001' AS code, CASE WHEN attainment < 0.8 THEN 'high' ELSE 'medium' END AS severity, task AS subject, attainment AS value FROM b WHERE attainment < 0.95
UNION ALL SELECT 'SL002', 'high', task, CAST(live AS DOUBLE) FROM b WHERE live >= 3 UNION ALL SELECT 'SL003', 'medium', task, CAST(late_p90 AS DOUBLE) FROM b WHERE late_p90 > 60""")
def sla_findings(spark, d):
    return N.sla_findings(P.sla_board(spark, d))


@query("inc_findings", lambda: f"""WITH b AS ({oracle_of("inc_review")}), r AS (SELECT 'IR001' AS code, incident, mttd AS value, 15 AS least FROM b UNION ALL SELECT 'IR002', incident, mtta, 15 FROM b UNION ALL SELECT 'IR003', incident, silent, 30 FROM b)
SELECT code, CASE WHEN value >= 4 * least THEN 'high' ELSE 'medium' END AS severity, CAST(incident AS VARCHAR) AS subject, value FROM r WHERE value >= least UNION ALL SELECT 'IR004', 'high', CAST(incident AS VARCHAR), NULL FROM b WHERE mttr IS NULL""")
def inc_findings(spark, d):
    return N.incident_findings(P.inc_review(spark, d))


_FILES = "f AS (SELECT 's' || l_suppkey % 7 AS table_name, CAST(l_suppkey AS VARCHAR) AS part, count(*) AS file_count, CAST(sum(CAST(l_quantity AS DECIMAL(20, 2))) AS DOUBLE) * CASE WHEN l_suppkey % 7 < 3 THEN 2 ELSE 1 END AS total_mb FROM lineitem GROUP BY l_suppkey)"


@query("cp_findings", f"""WITH {_FILES}, t AS (SELECT table_name, sum(CASE WHEN file_count > 10 AND total_mb / file_count < 32 THEN file_count ELSE 0 END) / CAST(sum(file_count) AS DOUBLE) AS s FROM f GROUP BY 1)
SELECT 'CP001' AS code, CASE WHEN s >= 0.5 THEN 'high' ELSE 'medium' END AS severity, table_name AS subject, s AS value FROM t WHERE s >= 0.25 UNION ALL SELECT 'CP002', 'high', table_name || '/' || part, CAST(file_count AS DOUBLE) FROM f WHERE file_count >= 1000""")
def cp_findings(spark, d):
    k = F.col("l_suppkey")
    files = S.table(spark, d, "lineitem").groupBy(k).agg(F.count(F.lit(1)).alias("file_count"), F.sum(F.col("l_quantity").cast("decimal(20,2)")).cast("double").alias("mb"))
    return N.compaction_findings(files.select(F.concat(F.lit("s"), (k % 7).cast("string")).alias("table_name"), k.cast("string").alias("part"), "file_count", (F.col("mb") * F.when(k % 7 < 3, 2).otherwise(1)).alias("total_mb")))


#: A partition for each supplier and month of its orders; some were read in the last weeks, some never, some have no date.
_SLICES = """sl AS (SELECT 't' || l_suppkey AS table_name, CASE WHEN l_suppkey % 10 = 3 AND month(l_shipdate) = 1 THEN NULL ELSE CAST(date_trunc('month', l_shipdate) AS DATE) END AS day, count(*) AS size,
CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN DATE '1999-01-01' ELSE CAST(max(l_shipdate) AS DATE) END AS last_access FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate), month(l_shipdate))"""
_PLAN = f"""{_SLICES}, n AS (SELECT max(greatest(day, coalesce(last_access, day))) AS today FROM sl), x AS (SELECT sl.*, today - day AS age, coalesce(today - last_access <= 90, false) AS warm FROM sl, n), w AS (SELECT table_name, coalesce(greatest(30, CAST(ceil((max(age) FILTER (warm) + 30) / 30.0) * 30 AS BIGINT)), 30) AS ttl_days FROM x GROUP BY 1),
pl AS (SELECT table_name, ttl_days, CAST(sum(size) FILTER (day IS NOT NULL) AS BIGINT) AS total, CAST(coalesce(sum(size) FILTER (age > ttl_days AND NOT warm), 0) AS BIGINT) AS cold, count(*) FILTER (age > ttl_days AND NOT warm) AS archive, count(*) FILTER (age > ttl_days AND NOT warm AND last_access IS NULL) AS purge, count(*) FILTER (day IS NULL) AS undated FROM x JOIN w USING (table_name) GROUP BY 1, 2)"""


def slices(spark, d):
    k, month = F.col("l_suppkey"), F.trunc("l_shipdate", "month").alias("m")
    g = S.table(spark, d, "lineitem").groupBy("l_suppkey", month).agg(F.count(F.lit(1)).alias("size"), F.to_date(F.max("l_shipdate")).alias("last"))
    read = F.when(k % 3 == 0, None).when(k % 3 == 1, F.lit("1999-01-01").cast("date")).otherwise(F.col("last"))
    return g.select(F.concat(F.lit("t"), k.cast("string")).alias("table_name"), F.when((k % 10 == 3) & (F.month("m") == 1), None).otherwise(F.col("m")).alias("day"), "size", read.alias("last_access"))


@query("prt_retention", f"WITH {_PLAN} SELECT * FROM pl")
def prt_retention(spark, d):
    return N.retention_plan(slices(spark, d))


@query("rp_findings", f"""WITH {_PLAN}, c AS (SELECT table_name, cold / CAST(nullif(total, 0) AS DOUBLE) AS s, purge, undated FROM pl) SELECT 'RP001' AS code, CASE WHEN s >= 0.5 THEN 'high' ELSE 'medium' END AS severity, table_name AS subject, s AS value FROM c WHERE s >= 0.25
UNION ALL SELECT 'RP002', 'medium', table_name, CAST(purge AS DOUBLE) FROM c WHERE purge > 0 UNION ALL SELECT 'RP003', 'low', table_name, CAST(undated AS DOUBLE) FROM c WHERE undated > 0""")
def rp_findings(spark, d):
    return N.retention_findings(N.retention_plan(slices(spark, d)))


@query("cst_findings", """WITH b AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'unallocated' WHEN c_custkey % 10 < 8 THEN 'sales' ELSE c_mktsegment END AS owner, CAST(o_totalprice AS DECIMAL(20, 2)) AS cost FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT owner, CAST(sum(cost) AS DOUBLE) / (SELECT CAST(sum(cost) AS DOUBLE) FROM b) AS share FROM b GROUP BY 1)
SELECT CASE WHEN owner = 'unallocated' THEN 'CA001' ELSE 'CA002' END AS code, CASE WHEN owner <> 'unallocated' THEN 'low' WHEN share >= 0.3 THEN 'high' ELSE 'medium' END AS severity, owner AS subject, share AS value FROM g WHERE owner = 'unallocated' AND share >= 0.1 OR owner <> 'unallocated' AND share >= 0.5""")
def cst_findings(spark, d):
    o, c, k = S.table(spark, d, "orders"), S.table(spark, d, "customer"), F.col("c_custkey")
    b = o.join(c, F.col("o_custkey") == k).select(F.when(k % 3 == 0, " ").when(k % 10 < 8, "sales").otherwise(F.col("c_mktsegment")).alias("owner"), F.lit("i").alias("item"), F.col("o_totalprice").alias("cost"))
    return N.cost_findings(T.cost_allocation(b))


@query("flk_findings", """WITH o AS (SELECT 'j' || user_id AS job, max(value / 100) AS b, max(value * 1000) AS w, count(*) FILTER (event_type = 'error') AS r FROM events GROUP BY 1), x AS (SELECT 'FD004' AS code, job, CAST(b AS DOUBLE) AS v, 0.5 AS m, 0.8 AS h FROM o UNION ALL SELECT 'FD005', job, w, 60000, 300000 FROM o UNION ALL SELECT 'FD006', job, r, 1, 3 FROM o)
SELECT code, CASE WHEN v >= h THEN 'high' ELSE 'mid' END AS severity, job AS subject, v AS value FROM x WHERE v >= m""")
def flk_findings(spark, d):
    e, job = S.table(spark, d, "events"), F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job")
    ops = e.select(job, F.col("event_type").alias("operator"), (F.col("value") / 100).alias("backpressure"), (F.col("value") * 1000).alias("watermark_lag_ms"))
    return N.job_findings(ops, e.groupBy(job).agg(F.count_if(F.col("event_type") == "error").alias("count_1h")))


_CDC = "CASE event_id % 4 WHEN 0 THEN 'ALTER TABLE t' || event_id WHEN 1 THEN 'Duplicate entry ' || event_id WHEN 2 THEN 'Connection reset' ELSE 'strange ' || event_id END"


@query("cdc_errors", """SELECT 'p' || user_id AS pipeline, CASE event_id % 4 WHEN 0 THEN 'schema_change' WHEN 1 THEN 'duplicate_key' WHEN 2 THEN 'connection' ELSE 'other' END AS kind, count(*) AS n, CASE event_id % 4 WHEN 0 THEN 'high' ELSE 'mid' END AS severity FROM events WHERE event_type = 'error' GROUP BY ALL""")
def cdc_errors(spark, d):
    return N.capture_errors(S.table(spark, d, "events").filter("event_type = 'error'").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("pipeline"), F.expr(_CDC.lower()).alias("error")))


_NOW = 1706745600  # 2024-02-01
_CAD = "CASE user_id % 4 WHEN 0 THEN 1800 WHEN 1 THEN 10000 WHEN 2 THEN 86400 ELSE 200000 END"


@query("bf_slots", f"""WITH u AS (SELECT 't' || user_id AS table_name, {P.SEC} AS s, {_CAD} AS i FROM events), x AS (SELECT *, CASE WHEN i >= 64800 THEN 86400 ELSE 3600 END AS unit, CASE WHEN i >= 151200 THEN round_even(i / 86400.0, 0) * 86400 WHEN i >= 64800 THEN 86400 ELSE round_even(i / 3600.0, 0) * 3600 END AS step FROM u WHERE i >= 2700), y AS (SELECT *, s - s % unit AS slot FROM x),
g AS (SELECT table_name, unit, step, i, min(slot) AS first, median(s - slot) AS off FROM y GROUP BY 1, 2, 3, 4), z AS (SELECT table_name, unit, i, off, unnest(range(first, {_NOW} + 1, CAST(step AS BIGINT))) AS slot_s FROM g)
SELECT z.table_name, CAST(slot_s AS BIGINT) AS slot_s, CASE WHEN z.unit = 86400 THEN 'day' ELSE 'hour' END AS grid FROM z LEFT JOIN (SELECT DISTINCT table_name, slot FROM y) h ON h.table_name = z.table_name AND h.slot = slot_s WHERE h.slot IS NULL AND slot_s + off + 0.25 * i <= {_NOW}""")
def bf_slots(spark, d):
    u = P.events(spark, d).select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table_name"), "s", "user_id")
    cadence = u.select("table_name", F.expr(_CAD.lower()).alias("interval_s")).distinct()
    return N.due_slots(u.select("table_name", "s"), cadence, _NOW)


@query("alert_findings", lambda: f"""WITH a AS (SELECT {P._SIG.format("event_type || ': lag=' || event_id % 9 || ' of job ' || chr(97 + CAST(user_id % 20 AS INTEGER))", 70)} AS signature, {P.SEC} AS s, CASE WHEN user_id % 3 = 0 THEN 'db' ELSE 'etl' END AS source FROM events), t AS (SELECT count(*) AS n, count(DISTINCT signature) AS k FROM a),
b AS (SELECT s // 300 AS b, count(*) AS n FROM a GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM b), mid AS (SELECT min(n) AS mid FROM r WHERE i = m // 2), sp AS (SELECT signature, lead(s, 4) OVER (PARTITION BY signature ORDER BY s) - s AS span FROM a), f AS (SELECT signature, min(span) AS span FROM sp GROUP BY 1), so AS (SELECT source, count(*) AS c FROM a GROUP BY 1)
SELECT 'AS001' AS code, 'low' AS severity, 'all' AS subject, n / CAST(k AS DOUBLE) AS value FROM t UNION ALL SELECT 'AS002', 'high', CAST(b * 300 AS VARCHAR), CAST(b.n AS DOUBLE) FROM b, mid, t WHERE t.n >= 8 AND b.n >= 3 * mid AND b.n >= 5
UNION ALL SELECT 'AS003', 'mid', signature, span / 60 FROM f WHERE span <= 3600 UNION ALL SELECT 'AS004', 'mid', source, c / CAST(n AS DOUBLE) FROM so, t WHERE c >= 0.5 * n AND (SELECT count(*) FROM so) > 1""")
def alert_findings(spark, d):
    title = F.concat("event_type", F.lit(": lag="), (F.col("event_id") % 9).cast("string"), F.lit(" of job "), F.char(97 + F.col("user_id") % 20))
    return N.alert_findings(P.events(spark, d).withColumn("source", F.when(F.col("user_id") % 3 == 0, "db").otherwise("etl")), title)


_INV = "iv AS (SELECT p_brand || p_size AS table_name, CAST(sum(p_retailprice) AS DOUBLE) AS size_gb, count(*) FILTER (p_partkey % 3 = 0) AS access_cnt, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size * 4 AS BIGINT) END AS idle_days, CAST(p_size AS DOUBLE) AS avg_file_mb FROM part GROUP BY p_brand, p_size)"


@query("sto_actions", f"""WITH {_INV}, {_SLICES} SELECT 'cold_tier' AS action, table_name, round(size_gb, 4) AS freed_gb, CASE WHEN size_gb >= 1000 THEN 'high' ELSE 'mid' END AS severity FROM iv WHERE size_gb >= 100 AND access_cnt = 0 AND (idle_days IS NULL OR idle_days > 90)
UNION ALL SELECT 'drop_partitions', table_name, CAST(sum(size) AS DOUBLE), CASE WHEN sum(size) >= 500 THEN 'high' ELSE 'mid' END FROM sl WHERE DATE '1999-01-01' - day > 365 GROUP BY table_name UNION ALL SELECT 'compact', table_name, 0.0, 'low' FROM iv WHERE avg_file_mb > 0 AND avg_file_mb < 16""")
def sto_actions(spark, d):
    size = F.col("p_size")
    inv = S.table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.sum("p_retailprice").alias("size_gb"), F.count_if(F.col("p_partkey") % 3 == 0).alias("access_cnt"))
    inv = inv.select(F.concat("p_brand", size.cast("string")).alias("table_name"), "size_gb", "access_cnt", F.when(size % 5 == 0, None).otherwise(size * 4).cast("long").alias("idle_days"), size.cast("double").alias("avg_file_mb"))
    return N.storage_findings(inv, slices(spark, d), F.lit("1999-01-01").cast("date")).withColumn("freed_gb", F.round("freed_gb", 4))


@query("gov_tables", """WITH l AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'DB.T' ELSE 'db.t' END || user_id AS t, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'cache_hit' WHEN 'view' THEN 'success' ELSE 'error' END AS status, CASE WHEN event_id % 3 = 0 THEN 'no Partition filter' ELSE 'syntax' END AS e FROM events), x AS (SELECT t, status, e FROM l UNION ALL SELECT 'base', status, e FROM l)
SELECT lower(t) AS table_name, count(*) FILTER (status IN ('success', 'cache_hit')) AS ok, count(*) FILTER (status IN ('rejected', 'error')) AS rejected, count(*) FILTER (status IN ('rejected', 'error') AND e LIKE '%Partition%') AS no_partition FROM x GROUP BY 1""")
def gov_tables(spark, d):
    e, k = S.table(spark, d, "events"), F.col("event_id")
    t = F.concat(F.when(k % 2 == 0, "DB.T").otherwise("db.t"), F.col("user_id").cast("string"))
    status = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "click", "cache_hit").when(F.col("event_type") == "view", "success").otherwise("error")
    return N.table_usage(e.select(F.array(t, F.lit("base")).alias("tables"), status.alias("status"), F.when(k % 3 == 0, "no Partition filter").otherwise("syntax").alias("error")))


@query("qlg_failures", """WITH l AS (SELECT 'sales of ' || event_type || ' for ' || user_id AS question, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'web' END AS source, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, 'e' || event_id AS error, event_id AS ts FROM events WHERE event_id % 11 <> 0)
SELECT question, source, count(*) AS n, count(*) FILTER (status <> 'success') AS failures, arg_max(error, ts) FILTER (status <> 'success') AS last_error FROM l GROUP BY 1, 2""")
def qlg_failures(spark, d):
    k = F.col("event_id")
    q = F.concat(F.when(k % 11 == 0, "[daily] ").otherwise(" Sales  of "), "event_type", F.lit(" for "), F.col("user_id").cast("string"))
    log = S.table(spark, d, "events").select(q.alias("question"), F.when(k % 5 == 0, "").otherwise("web").alias("source"), F.when(k % 7 == 0, "error").otherwise("success").alias("status"), F.concat(F.lit("e"), k.cast("string")).alias("error"), k.alias("ts"))
    return N.question_failures(log)


@query("drift_values", """WITH a AS (SELECT 'l_shipdate' AS column_name, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS v FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem WHERE l_linenumber = 1),
b AS (SELECT 'l_shipdate' AS column_name, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS v FROM lineitem WHERE l_linenumber = 3 UNION ALL SELECT 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 3 UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem WHERE l_linenumber = 3),
few AS (SELECT column_name FROM a GROUP BY 1 HAVING count(DISTINCT v) <= 0.5 * count(*)) SELECT * FROM (SELECT DISTINCT column_name, v, CASE WHEN a.n IS NULL THEN 'appeared' WHEN b.n IS NULL THEN 'vanished' END AS change FROM (SELECT column_name, v, count(*) AS n FROM a GROUP BY 1, 2) a FULL JOIN (SELECT column_name, v, count(*) AS n FROM b GROUP BY 1, 2) b USING (column_name, v)) WHERE change IS NOT NULL AND column_name IN (SELECT column_name FROM few)""")
def drift_values(spark, d):
    li = S.table(spark, d, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    return N.value_changes(li.filter("l_linenumber = 1"), li.filter("l_linenumber = 3"), ["l_shipdate", "l_partkey", "l_returnflag"])


@query("cap_growers", """WITH t AS (SELECT 'm' || s_suppkey AS metric, round(s_acctbal, 2) AS per_day FROM supplier UNION ALL SELECT 'total', 1e9), x AS (SELECT * FROM t WHERE metric <> 'total' AND per_day > 0), s AS (SELECT CAST(sum(CAST(per_day AS DECIMAL(20, 2))) AS DOUBLE) AS t FROM t WHERE metric <> 'total') SELECT metric, CAST(per_day AS DOUBLE) AS per_day, round(per_day / t, 9) AS share FROM x, s WHERE t > 0 ORDER BY per_day DESC, metric LIMIT 5""")
def cap_growers(spark, d):
    t = S.table(spark, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("metric"), F.round("s_acctbal", 2).alias("per_day"))
    return N.top_growers(t.unionByName(spark.createDataFrame([("total", 1e9)], "metric string, per_day double")), "metric").withColumn("share", F.round("share", 9))


@query("log_ci_templates", """WITH l AS (SELECT 'job' || user_id AS job, event_type AS kind FROM events WHERE event_type IN ('error', 'click', 'view')) SELECT CASE kind WHEN 'error' THEN 'ValueError: bad value <n> in <path> at <ver>' WHEN 'click' THEN 'FATAL ''<s>'' of <hash>' END AS template, count(*) AS n, count(DISTINCT job) AS jobs FROM l WHERE kind <> 'view' GROUP BY 1 ORDER BY n DESC, template LIMIT 10""")
def log_ci_templates(spark, d):
    e, k = S.table(spark, d, "events"), F.col("event_id").cast("string")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z "))
    bad = F.concat(stamp, F.lit("##[error]ValueError: bad value "), k, F.lit(" in /data/in/x"), k, F.lit(".csv at 1."), k)
    worse = F.concat(stamp, F.lit("FATAL 'user "), k, F.lit("' of abcdef0123"))
    line = F.when(F.col("event_type") == "error", bad).when(F.col("event_type") == "click", worse).otherwise(F.concat(stamp, F.lit("all is well")))
    return N.log_error_templates(e.select(F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("job"), line.alias("line")))


_SOURCE = [("order_id", "bigint", False), ("amount", "decimal(20,4)", True), ("rate", "double", True), ("name", "varchar(50)", True), ("qty", "string", True), ("created", "timestamp", False), ("note", "string", True), ("batch_no", "int", True)]
_SINK = [("order_id", "int", False, False), ("amount", "decimal(18,2)", True, False), ("rate", "int", True, False), ("name", "varchar(20)", True, False), ("qty", "int", True, False), ("created", "date", False, False), ("note", "string", False, False), ("must", "string", False, False), ("may", "string", False, True)]


@query("sch_align_findings", """SELECT code, severity, p_brand || '.' || c AS subject, CAST(NULL AS DOUBLE) AS value FROM (SELECT DISTINCT p_brand FROM part), (VALUES ('SA001', 'high', 'batch_no'), ('SA002', 'high', 'must'), ('SA003', 'high', 'order_id'), ('SA003', 'high', 'amount'), ('SA003', 'high', 'rate'), ('SA003', 'mid', 'name'), ('SA004', 'high', 'qty'), ('SA005', 'mid', 'created'), ('SA006', 'high', 'note')) v(code, severity, c)""")
def sch_align_findings(spark, d):
    """One table of nine columns for each brand."""
    brands = S.table(spark, d, "part").select("p_brand").distinct()
    cells = lambda rows: F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("c", "data_type", "nullable", "has_default"), r)]) for r in rows])).alias("x")
    a, b = (brands.select("p_brand", cells(rows)).select(F.concat_ws(".", "p_brand", "x.c").alias("column_name"), "x.*") for rows in (_SOURCE, _SINK))
    return N.align_findings(a, b)


@query("sch_coverage_findings", """WITH t AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'ods_' WHEN 1 THEN 'dwd.' WHEN 2 THEN 'dws_' ELSE 'tmp_' END || s_suppkey AS n, s_suppkey AS k FROM supplier)
SELECT 'CM001' AS code, CASE WHEN k % 4 IN (1, 2) THEN 'high' ELSE 'medium' END AS severity, n AS subject, CAST(NULL AS DOUBLE) AS value FROM t WHERE k % 3 <> 0 UNION ALL SELECT 'CM002', 'medium', 'dqc:gone_' || k, NULL FROM t WHERE k % 5 = 0""")
def sch_coverage_findings(spark, d):
    k = F.col("s_suppkey")
    s = S.table(spark, d, "supplier")
    name = F.concat(F.when(k % 4 == 0, "ods_").when(k % 4 == 1, "dwd.").when(k % 4 == 2, "dws_").otherwise("tmp_"), k.cast("string"))
    checks = s.filter(k % 3 == 0).select(F.upper(name).alias("table_name"), F.lit("dqc").alias("artifact")).unionByName(s.filter(k % 5 == 0).select(F.concat(F.lit("gone_"), k.cast("string")).alias("table_name"), F.lit("dqc").alias("artifact")))
    return N.coverage_findings(s.select(name.alias("table_name")), checks)


_BUSY = "rn AS (SELECT 'n' || o_custkey % 50 AS pool, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS start, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 1 + o_orderkey % 9 AS finish, CAST(1 + o_orderkey % 2 AS BIGINT) AS slots, CAST(o_orderkey % 4 AS BIGINT) AS memory FROM orders)"


@query("dag_capacity", f"""WITH {_BUSY}, e AS (SELECT pool, start AS t, slots AS ds, memory AS dm FROM rn UNION ALL SELECT pool, finish, -slots, -memory FROM rn), s AS (SELECT pool, t, sum(ds) AS ds, sum(dm) AS dm FROM e GROUP BY 1, 2), x AS (SELECT pool, t, sum(ds) OVER w AS s, sum(dm) OVER w AS m, lead(t) OVER (PARTITION BY pool ORDER BY t) AS nxt FROM s WINDOW w AS (PARTITION BY pool ORDER BY t)),
y AS (SELECT *, s > 4 OR m > 6 AS over FROM x WHERE nxt IS NOT NULL), z AS (SELECT *, sum(CASE WHEN over THEN 0 ELSE 1 END) OVER (PARTITION BY pool ORDER BY t) AS run FROM y) SELECT pool, min(t) AS start, max(nxt) AS finish, CAST(max(s) AS BIGINT) AS peak_slots, CAST(max(m) AS BIGINT) AS peak_memory FROM z WHERE over GROUP BY pool, run""")
def dag_capacity(spark, d):
    day, k = F.unix_date(F.to_date("o_orderdate")).cast("long"), F.col("o_orderkey")
    runs = S.table(spark, d, "orders").select(F.concat(F.lit("n"), (F.col("o_custkey") % 50).cast("string")).alias("pool"), day.alias("start"), (day + 1 + k % 9).alias("finish"), (1 + k % 2).cast("long").alias("slots"), (k % 4).cast("long").alias("memory"))
    return N.busy_windows(runs, ["pool"], 4, 6)


@query("ln_columns", """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS st, 'a' || l_linenumber AS sc, 'p' || l_partkey AS dt, 'b' || l_returnflag AS dc, CASE WHEN l_linenumber % 2 = 0 THEN 'sum(x)' ELSE 'x' END AS ex, l_linenumber % 2 = 0 AS ag FROM lineitem),
m AS (SELECT dt, dc, string_agg(DISTINCT st || '.' || sc, ',' ORDER BY st || '.' || sc) AS sources, max(ex) AS expression, bool_or(ag) AS aggregates FROM e GROUP BY 1, 2) SELECT dt AS table_name, dc AS column_name, sources, expression, aggregates FROM m UNION ALL SELECT DISTINCT st, sc, '', NULL, false FROM e""")
def ln_columns(spark, d):
    n = F.col("l_linenumber")
    e = S.table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_table"), F.concat(F.lit("a"), n.cast("string")).alias("src_column"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst_table"), F.concat(F.lit("b"), "l_returnflag").alias("dst_column"), F.when(n % 2 == 0, "sum(x)").otherwise("x").alias("expression"), (n % 2 == 0).alias("is_aggregation"))
    return N.column_dictionary(e)
