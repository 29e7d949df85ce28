"""Queries of the data quality operators: a customer table with planted nulls, variants and formats, orders, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.values import exact
from plumbline.operators import quality as Q
from plumbline.operators import schemas as H
from plumbline.operators.compare import stringify
from plumbline.sources import tables as S

from .registry import query

COLS = ["c_custkey", "segment", "amount", "joined"]
DIRTY = """dirty AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ' ' || lower(c_mktsegment) ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 10 = 0 THEN '$' || c_custkey || '.50' WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || '.25' END AS amount,
  CASE WHEN c_custkey % 20 = 0 THEN '01/02/2020' ELSE '2020-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END AS joined FROM customer)"""


def dirty(spark, d):
    k = F.col("c_custkey")
    seg, text = F.col("c_mktsegment"), k.cast("string")
    return S.table(spark, d, "customer").select(
        "c_custkey",
        F.when(k % 7 == 0, None).when(k % 11 == 0, F.concat(F.lit(" "), F.lower(seg))).otherwise(seg).alias("segment"),
        F.when(k % 10 == 0, F.concat(F.lit("$"), text, F.lit(".50"))).when(k % 3 == 0, text).otherwise(F.concat(text, F.lit(".25"))).alias("amount"),
        F.when(k % 20 == 0, F.lit("01/02/2020")).otherwise(F.concat(F.lit("2020-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("joined"),
    )


_KIND = r"""CASE WHEN regexp_matches(v, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN 'uuid' WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?') THEN 'datetime'
 WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') THEN 'date' WHEN regexp_matches(v, '^\d{1,4}/\d{1,2}/\d{1,4}$') THEN 'date_slash' WHEN regexp_matches(v, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email'
 WHEN regexp_matches(v, '^\+?\d[\d\- ]{6,18}\d$') THEN 'phone' WHEN regexp_matches(v, '^-?\d+$') THEN 'integer' WHEN regexp_matches(v, '^-?\d+\.\d+$') THEN 'decimal' WHEN regexp_matches(v, '(?i)^(true|false|yes|no|0|1)$') THEN 'bool' ELSE 'text' END"""


def _counts(name, table, columns):
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM {table}" for c in columns)
    return f"{name}_c AS (SELECT column_name, v, count(*) AS n, {_KIND} AS kind FROM ({parts}) GROUP BY 1, 2)"


def _profile(name, table, columns):
    return f"""{_counts(name, table, columns)},
{name}_k AS (SELECT column_name, kind, sum(n) AS k FROM {name}_c WHERE v IS NOT NULL GROUP BY 1, 2),
{name}_d AS (SELECT column_name, CASE WHEN max(k) >= 0.9 * sum(k) THEN arg_max(kind, k) ELSE 'mixed' END AS kind, sum(k) AS total, max(k) AS most, count(*) AS kinds FROM {name}_k GROUP BY 1),
{name} AS (SELECT column_name, coalesce(d.kind, 'empty') AS kind, CAST(rows AS BIGINT) AS rows, CAST(non_null AS BIGINT) AS non_null, round((rows - non_null) * 100.0 / rows, 4) AS null_pct, ndv,
  round(coalesce(ndv * 100.0 / nullif(non_null, 0), 0), 4) AS unique_pct, round(coalesce(top_n * 100.0 / nullif(non_null, 0), 0), 4) AS top_pct, min_num, max_num, round(mean_num, 4) AS mean_num
  FROM (SELECT column_name, sum(n) AS rows, coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS non_null, count(v) AS ndv, max(n) FILTER (v IS NOT NULL) AS top_n, min(TRY_CAST(v AS DOUBLE)) AS min_num, max(TRY_CAST(v AS DOUBLE)) AS max_num,
    CAST(sum(TRY_CAST(v AS DECIMAL(20, 4)) * n) FILTER (TRY_CAST(v AS DOUBLE) IS NOT NULL) AS DOUBLE) / sum(n) FILTER (TRY_CAST(v AS DOUBLE) IS NOT NULL) AS mean_num FROM {name}_c GROUP BY 1) t LEFT JOIN {name}_d d USING (column_name))"""


def filled(spark, rows, df, key="column_name"):
    """``rows`` with the number of values that the table holds in each named column (null if it has no such column)."""
    counts = stringify(df, df.columns).agg(*[F.count(c).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias(key), F.col(c).alias("values_held")) for c in df.columns])
    return rows.join(counts.select(F.explode(cells).alias("r")).select("r.*"), key, "left")


@query("dq_run", f"""WITH {DIRTY} SELECT 'rows' AS check_name, 'row_count' AS kind, CAST(count(*) AS DOUBLE) AS actual, count(*) >= 10 AND count(*) <= 1000000 AS passed FROM dirty
UNION ALL SELECT 'segment nulls', 'null_rate', count(*) FILTER (segment IS NULL) * 100.0 / count(*), count(*) FILTER (segment IS NULL) * 100.0 / count(*) <= 10 FROM dirty
UNION ALL SELECT 'segment domain', 'enum_domain', CAST(count(*) FILTER (segment IS NOT NULL AND segment NOT IN ('BUILDING', 'MACHINERY')) AS DOUBLE), count(*) FILTER (segment IS NOT NULL AND segment NOT IN ('BUILDING', 'MACHINERY')) = 0 FROM dirty
UNION ALL SELECT 'key', 'unique', CAST(count(*) FILTER (n > 1) AS DOUBLE), count(*) FILTER (n > 1) = 0 FROM (SELECT c_custkey, count(*) AS n FROM dirty GROUP BY 1)
UNION ALL SELECT 'segment and day', 'unique', CAST(count(*) FILTER (n > 1) AS DOUBLE), count(*) FILTER (n > 1) = 0 FROM (SELECT segment, joined, count(*) AS n FROM dirty GROUP BY 1, 2)""")
def dq_run(spark, d):
    checks = [
        Q.Check("rows", "row_count", least=10, most=1_000_000),
        Q.Check("segment nulls", "null_rate", ("segment",), most=10),
        Q.Check("segment domain", "enum_domain", ("segment",), values=("BUILDING", "MACHINERY")),
        Q.Check("key", "unique", ("c_custkey",)),
        Q.Check("segment and day", "unique", ("segment", "joined")),
    ]
    return Q.run_checks(dirty(spark, d), checks)


@query("dq_row_count", """WITH runs AS (SELECT o_orderpriority AS table_name, strftime(o_orderdate, '%Y') AS run, count(*) AS rows FROM orders GROUP BY 1, 2), cur AS (SELECT table_name, rows FROM runs WHERE run = '1999'), last AS (SELECT table_name, arg_max(rows, run) AS previous FROM runs WHERE run < '1999' GROUP BY 1)
SELECT table_name, rows, previous, (rows - previous) * 100.0 / nullif(previous, 0) AS change_pct FROM cur LEFT JOIN last USING (table_name)""")
def dq_row_count(spark, d):
    runs = S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("table_name"), F.date_format("o_orderdate", "yyyy").alias("run")).agg(F.count(F.lit(1)).alias("rows"))
    out = Q.row_count_change(runs.filter("run = '1999'").select("table_name", "rows"), runs.filter("run < '1999'"))
    return out.withColumn("change_pct", F.col("change_pct").cast("double"))


@query("dq_null_rate", f"WITH {DIRTY} SELECT 'segment' AS check_name, 'null_rate' AS kind, count(*) FILTER (segment IS NULL) * 100.0 / count(*) AS actual, count(*) FILTER (segment IS NULL) * 100.0 / count(*) <= 20 AS passed FROM dirty")
def dq_null_rate(spark, d):
    return Q.run_checks(dirty(spark, d), [Q.Check("segment", "null_rate", ("segment",), most=20)])


@query("dq_unique", "SELECT 'line' AS check_name, 'unique' AS kind, CAST(count(*) FILTER (n > 1) AS DOUBLE) AS actual, count(*) FILTER (n > 1) = 0 AS passed FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def dq_unique(spark, d):
    return Q.run_checks(S.table(spark, d, "lineitem"), [Q.Check("line", "unique", ("l_orderkey", "l_linenumber"))])


@query("dq_enum_domain", "SELECT 'type' AS check_name, 'enum_domain' AS kind, CAST(count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS DOUBLE) AS actual, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) = 0 AS passed FROM events")
def dq_enum_domain(spark, d):
    return Q.run_checks(S.table(spark, d, "events"), [Q.Check("type", "enum_domain", ("event_type",), values=("click", "view", "purchase"))])


@query("prof_columns", f"WITH {DIRTY}, {_profile('p', 'dirty', COLS)} SELECT * FROM p")
def prof_columns(spark, d):
    return Q.profile(dirty(spark, d), COLS)


@query("prof_findings", rf"""WITH {DIRTY}, {_profile('p', 'dirty', COLS)}, x AS (
SELECT 'SP001' AS code, 'high' AS severity, column_name AS subject, top_pct AS value FROM p WHERE kind = 'mixed' UNION ALL SELECT 'SP002', 'mid', column_name, null_pct FROM p WHERE null_pct >= 50
UNION ALL SELECT 'SP003', 'low', column_name, CAST(ndv AS DOUBLE) FROM p WHERE ndv <= 1 UNION ALL SELECT 'SP004', 'mid', column_name, CAST(total - most AS DOUBLE) FROM p_d WHERE most >= 0.9 * total AND kinds > 1
UNION ALL SELECT 'SP005', 'mid', column_name, CAST(sum(n) AS DOUBLE) FROM p_c WHERE regexp_matches(v, '^[¥$€]?\s*-?\d{{1,3}}(,\d{{3}})+(\.\d+)?%?$|^[¥$€]\s*-?\d+(\.\d+)?$|^-?\d+(\.\d+)?%$') GROUP BY column_name
UNION ALL SELECT 'SP006', 'mid', column_name, CAST(count(*) AS DOUBLE) FROM (SELECT column_name, lower(trim(v)) AS f, count(*) AS forms FROM p_c WHERE v IS NOT NULL GROUP BY 1, 2) WHERE forms > 1 GROUP BY column_name) SELECT * FROM x""")
def prof_findings(spark, d):
    return Q.profile_findings(dirty(spark, d), COLS)


@query("prof_table", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS buyers, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def prof_table(spark, d):
    return S.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("buyers"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("prof_result_quality", """WITH v AS (SELECT CASE WHEN event_id % 500 = 0 THEN value * 100 ELSE value END AS value, CAST(user_id AS DOUBLE) AS user_id FROM events), s AS (SELECT avg(value) AS m, stddev_samp(value) AS d, avg(user_id) AS um, stddev_samp(user_id) AS ud FROM v)
SELECT 'value' AS column_name, count(*) AS n, round(count(*) FILTER (value IS NULL) * 100.0 / count(*), 4) AS null_pct, count(DISTINCT value) AS distinct_n, count(*) FILTER (abs(value - m) > 3 * d) AS outside FROM v, s
UNION ALL SELECT 'user_id', count(*), round(count(*) FILTER (user_id IS NULL) * 100.0 / count(*), 4), count(DISTINCT user_id), count(*) FILTER (abs(user_id - um) > 3 * ud) FROM v, s""")
def prof_result_quality(spark, d):
    v = S.table(spark, d, "events").select(F.when(F.col("event_id") % 500 == 0, F.col("value") * 100).otherwise(F.col("value")).alias("value"), F.col("user_id").cast("double").alias("user_id"))
    return Q.outliers(v, ["value", "user_id"])


_DRIFT = ["o_custkey", "o_orderstatus", "o_totalprice"]
_BEFORE, _AFTER = "o_orderkey % 2 = 0", "o_orderkey % 2 = 1 AND o_orderstatus <> 'F'"


@query("drift_profiles", f"""WITH b AS (SELECT o_custkey, o_orderstatus, o_totalprice FROM orders WHERE {_BEFORE}), a AS (SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE {_AFTER}),
{_profile('pb', 'b', _DRIFT)}, {_profile('pc', 'a', _DRIFT)},
m AS (SELECT column_name, pb.kind AS kb, pc.kind AS kc, abs(pc.mean_num - pb.mean_num) / greatest(abs(pb.mean_num), 1e-9) AS shift, abs(pc.null_pct - pb.null_pct) AS nulls, abs(pc.unique_pct - pb.unique_pct) AS uniq FROM pb FULL JOIN pc USING (column_name)),
f AS (SELECT 'DA002' AS code, CASE WHEN shift >= 0.5 THEN 'high' WHEN shift >= 0.2 THEN 'mid' END AS severity, column_name AS subject, round(shift, 4) AS value FROM m UNION ALL SELECT 'DA003', CASE WHEN nulls >= 25 THEN 'high' WHEN nulls >= 10 THEN 'mid' END, column_name, round(nulls, 4) FROM m
UNION ALL SELECT 'DA006', CASE WHEN uniq >= 40 THEN 'high' WHEN uniq >= 20 THEN 'mid' END, column_name, round(uniq, 4) FROM m UNION ALL SELECT 'DA007', CASE WHEN kb <> kc THEN 'high' END, column_name, 1.0 FROM m),
tb AS (SELECT column_name, v, n / sum(n) OVER (PARTITION BY column_name) AS s, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS r FROM pb_c WHERE v IS NOT NULL), tc AS (SELECT column_name, v, n / sum(n) OVER (PARTITION BY column_name) AS s, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS r FROM pc_c WHERE v IS NOT NULL),
l AS (SELECT column_name, sum(abs(coalesce(x.s, 0) - coalesce(y.s, 0))) AS l1 FROM (SELECT * FROM tb WHERE r <= 5) x FULL JOIN (SELECT * FROM tc WHERE r <= 5) y USING (column_name, v) WHERE column_name IN (SELECT column_name FROM pb WHERE unique_pct <= 50) GROUP BY 1)
SELECT * FROM f WHERE severity IS NOT NULL UNION ALL SELECT 'DA004', CASE WHEN l1 >= 0.4 THEN 'high' ELSE 'mid' END, column_name, round(l1, 4) FROM l WHERE l1 >= 0.2""")
def drift_profiles(spark, d):
    o = S.table(spark, d, "orders")
    before = o.filter("o_orderkey % 2 = 0").select(*_DRIFT)
    after = o.filter("o_orderkey % 2 = 1 and o_orderstatus <> 'F'").select("o_custkey", F.when(F.col("o_custkey") % 3 == 0, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return Q.profile_drift(before, after, _DRIFT)


@query("drift_split_key", """WITH c AS (SELECT o_orderpriority AS key_name, strftime(o_orderdate, '%Y') AS run, o_custkey, count(*) AS c FROM orders GROUP BY 1, 2, 3), led AS (SELECT key_name, run, max(c) * 100.0 / sum(c) AS top1_pct, CAST(0.0 AS DOUBLE) AS null_pct, CAST(count(*) AS DOUBLE) AS ndv FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key_name ORDER BY run DESC) AS r FROM led), g AS (SELECT key_name, count(*) AS runs, max(top1_pct) FILTER (r = 1) AS top1_pct_now, median(top1_pct) FILTER (r > 1) AS top1_pct_before, max(null_pct) FILTER (r = 1) AS null_pct_now, median(null_pct) FILTER (r > 1) AS null_pct_before, max(ndv) FILTER (r = 1) AS ndv_now, median(ndv) FILTER (r > 1) AS ndv_before FROM r GROUP BY 1)
SELECT *, top1_pct_now - top1_pct_before >= 10 OR null_pct_now - null_pct_before >= 5 OR ndv_now < 0.7 * ndv_before AS drifted FROM g WHERE runs >= 3""")
def drift_split_key(spark, d):
    c = S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key_name"), F.date_format("o_orderdate", "yyyy").alias("run"), "o_custkey").agg(F.count(F.lit(1)).alias("c"))
    ledger = c.groupBy("key_name", "run").agg((F.max("c").cast("double") * 100.0 / F.sum("c")).alias("top1_pct"), F.lit(0.0).alias("null_pct"), F.count(F.lit(1)).cast("double").alias("ndv"))
    return Q.key_drift(ledger, ["key_name"], "run")


@query("dup_layers", """SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS size, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row,
concat_ws(',', CASE WHEN min(o_orderstatus) <> max(o_orderstatus) THEN 'o_orderstatus' END, CASE WHEN min(o_orderpriority) <> max(o_orderpriority) THEN 'o_orderpriority' END) AS differing FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_layers(spark, d):
    o = S.table(spark, d, "orders").withColumn("ym", F.date_format("o_orderdate", "yyyy-MM"))
    return Q.duplicate_groups(o, ["o_custkey", "ym"], "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("rep_plan", f"""WITH {DIRTY}, x AS (SELECT coalesce(lower(trim(segment)), 'unknown') AS segment, CASE WHEN amount LIKE '$%' THEN TRY_CAST(substr(amount, 2) AS DOUBLE) ELSE TRY_CAST(amount AS DOUBLE) END AS amount, c_custkey, joined FROM dirty)
SELECT segment, joined, max(c_custkey) AS c_custkey, arg_max(amount, c_custkey) AS amount FROM x GROUP BY 1, 2""")
def rep_plan(spark, d):
    x = Q.fill_nulls(Q.standardize_case(dirty(spark, d), ["segment"]), {"segment": "unknown"})
    x = x.withColumn("amount", Q.clean_number(F.col("amount")))
    return Q.dedup_keep_latest(x, ["segment", "joined"], ["c_custkey"])


@query("rep_forward_fill", """SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM orders""")
def rep_forward_fill(spark, d):
    o = S.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderpriority")).alias("p"))
    return Q.forward_fill(o, ["o_custkey"], "o_orderkey", "p")


@query("col_null_numeric_clean", f"""WITH {DIRTY} SELECT c_custkey, CASE WHEN amount LIKE '$%' THEN TRY_CAST(substr(amount, 2) AS DOUBLE) ELSE TRY_CAST(amount AS DOUBLE) END AS amount FROM dirty""")
def col_null_numeric_clean(spark, d):
    return dirty(spark, d).select("c_custkey", Q.clean_number(F.col("amount")).alias("amount"))


@query("dq_rulegen", f"""WITH {DIRTY}, {_profile('p', 'dirty', COLS)} SELECT column_name, 'null_rate' AS rule, CAST(CAST(least(ceil(null_pct) + 5, 100) AS BIGINT) AS VARCHAR) AS argument FROM p WHERE null_pct <= 50
UNION ALL SELECT column_name, 'unique', '' FROM p WHERE null_pct <= 50 AND unique_pct = 100 AND (kind = 'integer' OR regexp_matches(lower(column_name), '(^|_)(id|key|no|code)$|key$'))
UNION ALL SELECT column_name, 'enum_domain', string_agg(v, '|' ORDER BY v) FROM p_c JOIN p USING (column_name) WHERE v IS NOT NULL AND null_pct <= 50 AND ndv <= 12 AND ndv > 1 AND p.kind NOT IN ('integer', 'decimal') GROUP BY 1""")
def dq_rulegen(spark, d):
    counts = Q.value_counts(dirty(spark, d), COLS)
    return Q.draft_rules(Q.profile(None, [], counts), counts)


_MEASURE = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]
_MEASURES = f"""{_counts('k', 'lineitem', _MEASURE)}, m AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS total, count(v) AS ndv, coalesce(sum(n) FILTER (v IS NULL), 0) / CAST(sum(n) AS DOUBLE) AS null_share, coalesce(max(n) FILTER (v IS NOT NULL), 0) / CAST(sum(n) AS DOUBLE) AS top1_share FROM k_c GROUP BY 1),
w AS (SELECT *, CASE WHEN null_share >= 0.1 THEN 'null' WHEN ndv < 64 THEN 'low_ndv' WHEN top1_share >= 0.2 THEN 'bad' WHEN top1_share >= 0.05 THEN 'suspect' ELSE 'good' END AS verdict FROM m)"""


@query("key_split_measure", f"WITH {_MEASURES} SELECT *, CAST(row_number() OVER (ORDER BY CASE verdict WHEN 'good' THEN 0 WHEN 'suspect' THEN 1 WHEN 'bad' THEN 2 ELSE 3 END, top1_share, column_name) AS INTEGER) AS rank FROM w")
def key_split_measure(spark, d):
    return Q.key_measures(S.table(spark, d, "lineitem"), _MEASURE)


@query("key_hot_probe", "SELECT CAST(l_returnflag AS VARCHAR) AS value, count(*) AS n, count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS share, CASE WHEN count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) >= 0.2 THEN 'confirmed' WHEN count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) >= 0.05 THEN 'suspect' ELSE 'ok' END AS verdict FROM lineitem GROUP BY 1")
def key_hot_probe(spark, d):
    return Q.hot_keys(S.table(spark, d, "lineitem"), "l_returnflag")


@query("key_partition_candidate", f"""WITH {_profile('p', 'orders', ['o_orderstatus', 'o_orderpriority', 'o_orderkey'])}, u AS (SELECT * FROM (VALUES ('o_orderstatus', 6), ('o_orderkey', 4)) t(column_name, hits)), s AS (SELECT sum(hits) AS total FROM u)
SELECT column_name, ndv, round(3.0 * coalesce(hits / CAST(total AS DOUBLE), 0) + CASE WHEN ndv BETWEEN 2 AND 5000 THEN 1 ELSE -1 END, 4) AS score, CASE WHEN ndv NOT BETWEEN 2 AND 5000 THEN 'unsuitable' ELSE 'possible' END AS verdict FROM p LEFT JOIN u USING (column_name), s""")
def key_partition_candidate(spark, d):
    usage = spark.createDataFrame([("o_orderstatus", 6), ("o_orderkey", 4)], "column_name string, hits long")
    return Q.partition_candidates(Q.profile(S.table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_orderkey"]), usage)


@query("agg_salted", "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1")
def agg_salted(spark, d):
    return Q.salted_sum(S.table(spark, d, "lineitem"), "l_returnflag", exact("l_extendedprice"), "l_orderkey", Q.salt_count(0.4))


@query("syn_mock")
def syn_mock(spark, d):
    """As many made-up orders as there are orders, in their shape."""
    o = S.table(spark, d, "orders")
    return Q.mock_rows(spark, Q.plan_mock(o, o.columns), o.count())


@query("val_index", """WITH c AS (SELECT 'c_name' AS column_name, c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer), n AS (SELECT column_name, v, count(*) AS n FROM c GROUP BY 1, 2)
SELECT * FROM n WHERE column_name IN (SELECT column_name FROM n GROUP BY 1 HAVING count(*) <= 50 AND max(length(v)) <= 64)""")
def val_index(spark, d):
    return Q.domain_index(S.table(spark, d, "customer"))


_STAMPS = """st AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '+08:00' WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || 'Z' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS a,
CAST(CASE WHEN event_id % 5 = 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS VARCHAR) AS b FROM events)"""


@query("tz_audit", f"""WITH {_STAMPS}, v AS (SELECT 'a' AS column_name, a AS v FROM st UNION ALL SELECT 'b', b FROM st), c AS (SELECT column_name, CASE WHEN regexp_matches(v, '^\\d{{10}}$') THEN 'epoch_s' WHEN regexp_matches(v, '^\\d{{13}}$') THEN 'epoch_ms' WHEN regexp_matches(v, '^\\d{{16}}$') THEN 'epoch_us'
  WHEN regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[ T].*(Z|[+-]\\d{{2}}:?\\d{{2}})$') THEN 'offset ' || regexp_extract(v, '(Z|[+-]\\d{{2}}:?\\d{{2}})$', 1) WHEN regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'no offset' ELSE 'other' END AS class FROM v)
SELECT column_name, class, count(*) AS n FROM c GROUP BY 1, 2""")
def tz_audit(spark, d):
    e = S.table(spark, d, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    s = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    a = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("+08:00"))).when(F.col("event_id") % 3 == 1, F.concat(text, F.lit("Z"))).otherwise(text)
    return H.time_classes(e.select(a.alias("a"), F.when(F.col("event_id") % 5 == 0, s * 1000).otherwise(s).cast("string").alias("b")), ["a", "b"])


@query("tz_findings", f"""WITH {_STAMPS}, h AS (SELECT hour(CAST(substr(a, 1, 19) AS TIMESTAMP)) AS hour, count(*) AS n FROM st GROUP BY 1)
SELECT 'TZ001' AS code, 'high' AS severity, 'a' AS subject, CAST(3 AS DOUBLE) AS value FROM (SELECT count(*) AS n FROM st) WHERE n >= 3 UNION ALL SELECT 'TZ002', 'high', 'b', CAST(2 AS DOUBLE) FROM (SELECT count(*) AS n FROM st) WHERE n >= 5""")
def tz_findings(spark, d):
    e = S.table(spark, d, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    s = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    a = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("+08:00"))).when(F.col("event_id") % 3 == 1, F.concat(text, F.lit("Z"))).otherwise(text)
    return H.time_findings(e.select(a.alias("a"), F.when(F.col("event_id") % 5 == 0, s * 1000).otherwise(s).cast("string").alias("b")), ["a", "b"])


@query("sch_align", f"""WITH {DIRTY} SELECT 'amount' AS column_name, 'double' AS target, count(*) FILTER (amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) AS failures FROM dirty
UNION ALL SELECT 'joined', 'date', count(*) FILTER (NOT regexp_matches(joined, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')) FROM dirty UNION ALL SELECT 'c_custkey', 'int', 0""")
def sch_align(spark, d):
    return H.cast_failures(dirty(spark, d), {"amount": "double", "joined": "date", "c_custkey": "int"})


@query("sch_drift", """SELECT * FROM (VALUES ('o_comment', 'added', 'info', NULL), ('o_custkey', 'narrowed', 'breaking', (SELECT count(*) FROM orders)), ('o_orderpriority', 'removed', 'breaking', (SELECT count(*) FROM orders)), ('o_totalprice', 'widened', 'risk', (SELECT count(*) FROM orders))) t(column_name, change, severity, values_held)""")
def sch_drift(spark, d):
    o = S.table(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("float"))
    new = S.table(spark, d, "orders").drop("o_orderpriority").withColumn("o_custkey", F.col("o_custkey").cast("int")).withColumn("o_comment", F.lit(1))
    return filled(spark, H.schema_drift(spark, o.schema, new.schema), o)


@query("sch_contract", """SELECT * FROM (VALUES ('o_orderkey', 'ok', (SELECT count(*) FROM orders)), ('o_custkey', 'type_mismatch', (SELECT count(*) FROM orders)), ('o_clerk', 'missing', NULL), ('o_orderpriority', 'undeclared', (SELECT count(*) FROM orders)), ('o_orderdate', 'undeclared', (SELECT count(*) FROM orders)), ('o_orderstatus', 'ok', (SELECT count(*) FROM orders)), ('o_totalprice', 'ok', (SELECT count(*) FROM orders))) t(column_name, status, values_held)""")
def sch_contract(spark, d):
    contract = H.Contract("orders", {"o_orderkey": "bigint", "o_custkey": "int", "o_clerk": "string", "o_orderstatus": "string", "o_totalprice": "double"})
    return filled(spark, H.check_contract(S.table(spark, d, "orders"), contract), S.table(spark, d, "orders"))


@query("sch_contract_gen", """SELECT * FROM (VALUES ('c_custkey', 'bigint', (SELECT count(*) FROM customer)), ('c_name', 'string', (SELECT count(*) FROM customer)), ('c_nationkey', 'int', (SELECT count(*) FROM customer)), ('c_acctbal', 'double', (SELECT count(*) FROM customer)), ('c_mktsegment', 'string', (SELECT count(*) FROM customer))) t(column_name, data_type, values_held)""")
def sch_contract_gen(spark, d):
    return filled(spark, H.contract_rows(spark, H.draft_contract("customer", S.table(spark, d, "customer"))), S.table(spark, d, "customer"))


@query("sch_topic_compat", """SELECT * FROM (VALUES ('user_id', 'type_changed', 'both', 'breaking', (SELECT count(*) FROM events)), ('channel', 'added_required', 'backward', 'breaking', NULL), ('props', 'removed_required', 'forward', 'risk', (SELECT count(*) FROM events))) t(field, change, breaks, severity, values_held)""")
def sch_topic_compat(spark, d):
    e = S.table(spark, d, "events")
    old = H.required(e.schema, ["event_id", "user_id", "props"])
    new = H.required(e.withColumn("user_id", F.col("user_id").cast("string")).withColumn("channel", F.lit("web")).drop("props").schema, ["event_id", "user_id", "channel"])
    return filled(spark, H.topic_compatibility(spark, old, new, "backward"), e, "field")


@query("sch_message_to_table", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def sch_message_to_table(spark, d):
    schema = H.json_schema_type({"type": "object", "properties": {"k": {"type": ["null", "integer"]}, "extra": {"type": "array", "items": {"type": "string"}}}})
    return S.table(spark, d, "events").select("event_id", F.from_json("props", schema).alias("p")).select("event_id", F.col("p.k").alias("k"))


@query("sch_coverage", """SELECT * FROM (VALUES ('orders', 6, 2, CAST(2 AS DOUBLE) / 6, (SELECT count(*) FROM orders)), ('customer', 5, 0, CAST(0 AS DOUBLE), (SELECT count(*) FROM customer))) t(table_name, columns, covered, share, rows)""")
def sch_coverage(spark, d):
    rules = spark.createDataFrame([("orders", "o_orderkey"), ("orders", "o_custkey"), ("orders", "o_custkey")], "table_name string, column_name string")
    rows = S.table(spark, d, "orders").agg(F.lit("orders").alias("table_name"), F.count(F.lit(1)).alias("rows")).unionByName(S.table(spark, d, "customer").agg(F.lit("customer").alias("table_name"), F.count(F.lit(1)).alias("rows")))
    return H.coverage(S.catalog(spark, d, ["orders", "customer"]), rules).join(rows, "table_name")
