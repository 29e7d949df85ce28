"""Queries of the comparison and join operators: orders against a changed copy, customers against orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.values import exact_sum
from plumbline.operators import compare as C
from plumbline.operators import joins as J
from plumbline.sources import tables as S

from .inputs import ORDERS_B, orders_b
from .registry import query

COLUMNS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


def sides(spark, d):
    return S.table(spark, d, "orders"), orders_b(spark, d)


@query("cmp_row_count", f"""WITH {ORDERS_B}, n AS (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM orders_b) AS b)
SELECT a AS rows_a, b AS rows_b, a - b AS delta, (a - b) / CAST(greatest(a, b, 1) AS DOUBLE) * 100 AS pct, abs((a - b) / CAST(greatest(a, b, 1) AS DOUBLE) * 100) <= 1 AS within FROM n""")
def cmp_row_count(spark, d):
    return C.row_count_diff(*sides(spark, d), threshold=1.0, percent=True)


_AGG = """
SELECT 'o_totalprice' AS column_name, unnest(['sum', 'avg', 'min', 'max', 'nulls']) AS metric,
  unnest([s, s / n, lo, hi, nulls]) AS value FROM (
  SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(20, 4))) AS DOUBLE) AS s, CAST(count(o_totalprice) AS DOUBLE) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(count(*) FILTER (o_totalprice IS NULL) AS DOUBLE) AS nulls FROM {t})
"""


@query("cmp_aggregate", f"""WITH {ORDERS_B}, a AS ({_AGG.format(t="orders")}), b AS ({_AGG.format(t="orders_b")})
SELECT column_name, metric, a.value AS value_a, b.value AS value_b, a.value = b.value OR abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1e-9) < 1e-6 AS same FROM a JOIN b USING (column_name, metric)""")
def cmp_aggregate(spark, d):
    return C.aggregate_diff(*sides(spark, d), ["o_totalprice"])




def _profile_sql(t):
    parts = []
    for c in ("o_custkey", "o_orderstatus"):
        parts += [
            f"SELECT '{c}' AS column_name, 'ndv' AS metric, CAST(count(DISTINCT {c}) AS VARCHAR) AS value FROM {t}",
            f"SELECT '{c}', 'min', CAST(min({c}) AS VARCHAR) FROM {t}",
            f"SELECT '{c}', 'max', CAST(max({c}) AS VARCHAR) FROM {t}",
        ]
    return " UNION ALL ".join(parts)


@query("cmp_profile", f"""WITH {ORDERS_B}, a AS ({_profile_sql("orders")}), b AS ({_profile_sql("orders_b")})
SELECT column_name, metric, a.value AS value_a, b.value AS value_b, a.value = b.value AS same FROM a JOIN b USING (column_name, metric)""")
def cmp_profile(spark, d):
    return C.profile_diff(*sides(spark, d), ["o_custkey", "o_orderstatus"]).filter("metric <> 'null_pct'")


@query("cmp_keyed_diff", f"""WITH {ORDERS_B}
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN 0 ELSE 1 END AS n_changed,
  CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE 'o_totalprice' END AS columns
FROM orders a FULL JOIN orders_b b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR abs(a.o_totalprice - b.o_totalprice) / greatest(abs(a.o_totalprice), abs(b.o_totalprice), 1e-9) >= 1e-6""")
def cmp_keyed_diff(spark, d):
    diff = C.keyed_diff(*sides(spark, d), ["o_orderkey"])
    return diff.select("o_orderkey", "change", F.size("changed").alias("n_changed"), F.array_join(F.transform("changed", lambda x: x["column_name"]), ",").alias("columns"))


@query("cmp_result_diff", f"""WITH {ORDERS_B}, a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, o_orderstatus FROM orders_b)
SELECT *, 'only_a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'only_b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def cmp_result_diff(spark, d):
    a, b = sides(spark, d)
    return C.result_diff(a.select("o_orderkey", "o_orderstatus"), b.select("o_orderkey", "o_orderstatus"))


_DIGEST = "CAST(('0x' || substr(md5(concat_ws(chr(31), {cols})), 1, 8)) AS BIGINT)"
_ROW = _DIGEST.format(cols="coalesce(CAST(o_orderkey AS VARCHAR), chr(30)), coalesce(CAST(o_custkey AS VARCHAR), chr(30)), coalesce(o_orderstatus, chr(30)), coalesce(o_orderpriority, chr(30))")
_SEG = "SELECT h % 10 AS segment, count(*) AS n, CAST(sum(h) AS BIGINT) AS checksum FROM (SELECT {row} AS h FROM {t}) GROUP BY 1"


@query("cmp_checksum", f"""WITH {ORDERS_B}, a AS ({_SEG.format(row=_ROW, t="orders")}), b AS ({_SEG.format(row=_ROW, t="orders_b")})
SELECT segment, a.n AS n_a, a.checksum AS checksum_a, b.n AS n_b, b.checksum AS checksum_b, a.n = b.n AND a.checksum = b.checksum AS same FROM a FULL JOIN b USING (segment)""")
def cmp_checksum(spark, d):
    return C.checksum_diff(*sides(spark, d), ["o_orderkey", *COLUMNS])


@query("cmp_chunked", f"""WITH {ORDERS_B}
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS key, CASE WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.o_orderkey IS NULL THEN 'only_b' ELSE 'changed' END AS change
FROM orders a FULL JOIN orders_b b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice""")
def cmp_chunked(spark, d):
    return C.chunked_diff(*sides(spark, d), "o_orderkey", [*COLUMNS, "o_totalprice"], rows=500).select("key", "change")


@query("cmp_partitions", f"""WITH {ORDERS_B}, a AS (SELECT strftime(o_orderdate, '%Y-%m') AS part, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT strftime(o_orderdate, '%Y-%m') AS part, count(*) AS n FROM orders_b GROUP BY 1)
SELECT part, coalesce(a.n, 0) AS rows_a, coalesce(b.n, 0) AS rows_b, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta, (coalesce(a.n, 0) - coalesce(b.n, 0)) / CAST(greatest(coalesce(a.n, 0), coalesce(b.n, 0), 1) AS DOUBLE) * 100 AS pct FROM a FULL JOIN b USING (part)""")
def cmp_partitions(spark, d):
    return C.partition_diff(*sides(spark, d), F.date_format("o_orderdate", "yyyy-MM"))


@query("cmp_custom_agg", f"""WITH {ORDERS_B}, a AS (SELECT CAST(count(DISTINCT o_custkey) AS DOUBLE) AS buyers, CAST(max(o_orderkey) AS DOUBLE) AS last_key, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS done FROM orders),
b AS (SELECT CAST(count(DISTINCT o_custkey) AS DOUBLE) AS buyers, CAST(max(o_orderkey) AS DOUBLE) AS last_key, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS done FROM orders_b),
m AS (SELECT unnest(['buyers', 'last_key', 'done']) AS column_name, unnest([a.buyers, a.last_key, a.done]) AS value_a, unnest([b.buyers, b.last_key, b.done]) AS value_b FROM a, b)
SELECT column_name, 'value' AS metric, value_a, value_b, value_a = value_b OR abs(value_a - value_b) / greatest(abs(value_a), abs(value_b), 1e-9) < 1e-6 AS same FROM m""")
def cmp_custom_agg(spark, d):
    return C.custom_agg_diff(*sides(spark, d), ["buyers=count(distinct o_custkey)", "last_key=max(o_orderkey)", "done=count_if(o_orderstatus = 'F')"])


def _skew_sql(t, s):
    return f"""
{s}_c AS (SELECT column_name, v, count(*) AS n FROM (SELECT 'o_orderpriority' AS column_name, o_orderpriority AS v FROM {t} UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM {t}) GROUP BY 1, 2),
{s}_k AS (SELECT *, count(*) OVER (PARTITION BY column_name) AS ndv, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS r FROM {s}_c),
{s}_i AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n, v DESC) AS i, count(*) OVER (PARTITION BY column_name) AS m FROM {s}_k WHERE r <= 20),
{s} AS (SELECT column_name, max(ndv) AS ndv, round(max(n) * 100.0 / sum(n), 6) AS top1_pct, round(sum((2 * i - m - 1) * n) / CAST(max(m) * sum(n) AS DOUBLE), 6) AS gini, round(stddev_pop(n) / avg(n), 6) AS cv FROM {s}_i GROUP BY 1)"""


@query("cmp_skew", f"""WITH {ORDERS_B}, {_skew_sql("orders", "a")}, {_skew_sql("orders_b", "b")}
SELECT column_name, a.ndv AS ndv_a, a.top1_pct AS top1_pct_a, a.gini AS gini_a, a.cv AS cv_a, b.ndv AS ndv_b, b.top1_pct AS top1_pct_b, b.gini AS gini_b, b.cv AS cv_b,
  CASE WHEN abs(a.gini - b.gini) > 0.2 OR abs(a.top1_pct - b.top1_pct) > 20 THEN 'mismatch' WHEN (a.gini > 0.6 OR a.top1_pct > 50) AND (b.gini > 0.6 OR b.top1_pct > 50) THEN 'both_skewed' ELSE 'ok' END AS verdict
FROM a JOIN b USING (column_name)""")
def cmp_skew(spark, d):
    return C.skew_diff(*sides(spark, d), ["o_orderpriority", "o_custkey"])


@query("cmp_quality_rules", """SELECT 'o_custkey:not_null>99' AS rule, round(count(o_custkey) * 100.0 / count(*), 4) AS actual, count(o_custkey) * 100.0 / count(*) > 99 AS passed FROM orders
UNION ALL SELECT 'o_orderkey:unique>99', round(count(DISTINCT o_orderkey) * 100.0 / count(*), 4), count(DISTINCT o_orderkey) * 100.0 / count(*) > 99 FROM orders
UNION ALL SELECT 'o_totalprice:min>1000', round(min(o_totalprice), 4), min(o_totalprice) > 1000 FROM orders
UNION ALL SELECT 'o_totalprice:max<400000', round(max(o_totalprice), 4), max(o_totalprice) < 400000 FROM orders
UNION ALL SELECT 'o_totalprice:range:1000-450000', CAST(count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 450000) AS DOUBLE), count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 450000) = 0 FROM orders
UNION ALL SELECT 'o_orderstatus:expr:o_orderstatus in (''F'', ''O'')', CAST(count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS DOUBLE), count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 FROM orders
UNION ALL SELECT 'missing:min>0', NULL, FALSE""")
def cmp_quality_rules(spark, d):
    rules = ["o_custkey:not_null>99", "o_orderkey:unique>99", "o_totalprice:min>1000", "o_totalprice:max<400000", "o_totalprice:range:1000-450000", "o_orderstatus:expr:o_orderstatus in ('F', 'O')", "missing:min>0"]
    return C.quality_rules(S.table(spark, d, "orders"), rules)


@query("cmp_incremental", f"""WITH {ORDERS_B}, a AS (SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'), b AS (SELECT * FROM orders_b WHERE o_orderdate > TIMESTAMP '1998-01-01')
SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR abs(a.o_totalprice - b.o_totalprice) / greatest(a.o_totalprice, b.o_totalprice) >= 1e-6) GROUP BY 1""")
def cmp_incremental(spark, d):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    a, b = (x.withColumn("fresh", F.col("o_orderdate") > cut) for x in sides(spark, d))
    return C.keyed_diff(a.filter("fresh"), b.filter("fresh"), ["o_orderkey"], ["o_totalprice"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("cmp_sql", f"""WITH {ORDERS_B}, a AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders_b GROUP BY 1)
SELECT *, 'only_a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'only_b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def cmp_sql(spark, d):
    a, b = sides(spark, d)
    text = "select o_orderpriority as p, count(*) as n from {t} group by 1"
    return C.result_diff(spark.sql(text, t=a), spark.sql(text, t=b))


@query("cmp_multiset_equal", f"""WITH {ORDERS_B}, x AS (SELECT o_custkey, o_orderstatus FROM orders), y AS (SELECT o_custkey, o_orderstatus FROM orders_b), n AS (
SELECT (SELECT count(*) FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)) AS only_a, (SELECT count(*) FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)) AS only_b) SELECT only_a, only_b, only_a = 0 AND only_b = 0 AS equal FROM n""")
def cmp_multiset_equal(spark, d):
    a, b = sides(spark, d)
    return C.multiset_diff(a.select("o_custkey", "o_orderstatus"), b.select("o_custkey", "o_orderstatus"))


@query("cmp_eval_match", """WITH x AS (SELECT o_custkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE), 6) AS s FROM orders GROUP BY 1),
y AS (SELECT l_orderkey, round(CAST(sum(CAST(l_quantity AS DECIMAL(20, 2))) AS DOUBLE), 6) AS s FROM lineitem GROUP BY 1), n AS (
SELECT (SELECT count(*) FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)) AS only_a, (SELECT count(*) FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)) AS only_b) SELECT only_a, only_b, only_a = 0 AND only_b = 0 AS equal FROM n""")
def cmp_eval_match(spark, d):
    a = S.table(spark, d, "orders").groupBy("o_custkey").agg(exact_sum("o_totalprice").alias("total"))
    b = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(exact_sum("l_quantity").alias("other_name"))
    return C.eval_match(a, b)


@query("cmp_schema", """SELECT * FROM (VALUES ('o_comment', 'added', CAST(NULL AS VARCHAR), 'string', NULL), ('o_custkey', 'type_changed', 'bigint', 'string', (SELECT count(*) FROM orders)), ('o_orderpriority', 'removed', 'string', CAST(NULL AS VARCHAR), (SELECT count(*) FROM orders))) t(column_name, change, old_type, new_type, values_held)""")
def cmp_schema(spark, d):
    o = S.table(spark, d, "orders")
    changed = o.drop("o_orderpriority").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("O_COMMENT", F.lit("")).withColumnRenamed("o_orderstatus", "O_ORDERSTATUS")
    counts = C.unpivoted(o.agg(*[F.count(c).alias(f"{c}|values") for c in o.columns])).select("column_name", F.col("value").alias("values_held"))
    return C.schema_diff(spark, o.schema, changed.schema).join(counts, "column_name", "left")


@query("cmp_common_tables", """SELECT lower(a) AS name, a AS name_a, b AS name_b, rows FROM (VALUES ('orders', 'ORDERS', (SELECT count(*) FROM orders)), ('part', 'PART', (SELECT count(*) FROM part))) t(a, b, rows)""")
def cmp_common_tables(spark, d):
    a = S.catalog(spark, d, ["orders", "part", "region"]).select("table_name")
    b = S.catalog(spark, d, ["orders", "part", "nation"]).select(F.upper("table_name").alias("table_name"))
    rows = None
    for n in ("orders", "part", "region", "nation"):
        one = S.table(spark, d, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"))
        rows = one if rows is None else rows.unionByName(one)
    return C.common_tables(a, b).join(rows, "name")


_MONTHS = "m AS (SELECT o_orderpriority AS p, strftime(o_orderdate, '%Y-%m') AS ym, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE count(*) END AS n FROM orders GROUP BY 1, 2)"


def months(spark, d):
    n = F.count(F.lit(1))
    return S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.when(n % 7 == 0, None).otherwise(n).alias("n"))


@query("cmp_trend", f"""WITH {_MONTHS} SELECT p, ym, n, last_value(n IGNORE NULLS) OVER (PARTITION BY p ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
n - last_value(n IGNORE NULLS) OVER (PARTITION BY p ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS jump FROM m""")
def cmp_trend(spark, d):
    return C.trend(months(spark, d), ["p"], "ym", "n")


@query("cmp_trend_alert", f"""WITH {_MONTHS}, r AS (SELECT p, min(CASE WHEN coalesce(abs(n) > 20, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY ym DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM m)
SELECT p, CAST(sum(ok) AS BIGINT) AS run, sum(ok) >= 2 AS fired FROM r GROUP BY p""")
def cmp_trend_alert(spark, d):
    return C.trend_alert(months(spark, d), ["p"], "ym", "n", 20, 2)


@query("cmp_report_diff", f"""WITH {ORDERS_B}, r AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS buyers FROM orders), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS buyers FROM orders_b)
SELECT 'n' AS counter, r.n AS old, s.n AS new, s.n - r.n AS delta FROM r, s UNION ALL SELECT 'buyers', r.buyers, s.buyers, s.buyers - r.buyers FROM r, s""")
def cmp_report_diff(spark, d):
    old, new = (x.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("buyers")) for x in sides(spark, d))
    return C.report_diff(old, new, ["n", "buyers"])


def _values_sql(t, columns):
    """The profile of ``t``, as texts."""
    parts = []
    for c in columns:
        values = {"ndv": f"count(DISTINCT {c})", "null_pct": f"round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 4)", "min": f"min({c})", "max": f"max({c})"}
        parts += [f"SELECT '{c}' AS column_name, '{m}' AS metric, CAST({v} AS VARCHAR) AS value FROM {t}" for m, v in values.items()]
    return " UNION ALL ".join(parts)


_APART = "NOT coalesce(a.value = b.value OR abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1e-9) < 1e-6, a.value IS NULL AND b.value IS NULL)"


@query("cmp_report", f"""WITH {ORDERS_B}, aa AS ({_AGG.format(t="orders")}), ab AS ({_AGG.format(t="orders_b")}),
pa AS ({_values_sql("orders", ["o_orderkey", *COLUMNS])}), pb AS ({_values_sql("orders_b", ["o_orderkey", *COLUMNS])}),
sa AS ({_SEG.format(row=_ROW, t="orders")}), sb AS ({_SEG.format(row=_ROW, t="orders_b")})
SELECT 'schema' AS stage, CAST(0 AS BIGINT) AS findings UNION ALL
SELECT 'count', abs((SELECT count(*) FROM orders) - (SELECT count(*) FROM orders_b)) UNION ALL
SELECT 'keyed', count(*) FROM orders a FULL JOIN orders_b b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR abs(a.o_totalprice - b.o_totalprice) / greatest(a.o_totalprice, b.o_totalprice) >= 1e-6 UNION ALL
SELECT 'aggregate', count(*) FROM aa a JOIN ab b USING (column_name, metric) WHERE {_APART} UNION ALL
SELECT 'profile', count(*) FROM pa a JOIN pb b USING (column_name, metric) WHERE a.value IS DISTINCT FROM b.value UNION ALL
SELECT 'checksum', count(*) FROM sa a FULL JOIN sb b USING (segment) WHERE a.n IS DISTINCT FROM b.n OR a.checksum IS DISTINCT FROM b.checksum""")
def cmp_report(spark, d):
    """All six stages."""
    return C.stage_findings(C.compare(*sides(spark, d), ["o_orderkey"], ["o_totalprice"], ["o_orderkey", *COLUMNS]))


def _batch_sql(name, a, b, columns, changes):
    side = lambda t: " UNION ALL ".join(_AGG.replace("o_totalprice", c).format(t=t) for c in columns)
    return f"""SELECT '{name}' AS table_name, CAST({changes} AS BIGINT) AS schema_changes, (SELECT count(*) FROM {a}) AS rows_a, (SELECT count(*) FROM {b}) AS rows_b, (SELECT count(*) FROM ({side(a)}) a JOIN ({side(b)}) b USING (column_name, metric) WHERE {_APART}) AS mismatches"""


@query("cmp_batch", f"""WITH {ORDERS_B}, part_b AS (SELECT * FROM part WHERE p_partkey % 50 <> 0), r AS (
{_batch_sql("orders", "orders", "orders_b", ["o_orderkey", "o_custkey", "o_totalprice"], 0)} UNION ALL
{_batch_sql("part", "part", "part_b", ["p_partkey", "p_retailprice"], 2)} UNION ALL
{_batch_sql("supplier", "supplier", "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"], 0)})
SELECT table_name, schema_changes, rows_a, rows_b, rows_a - rows_b AS delta, mismatches, schema_changes > 0 OR rows_a <> rows_b OR mismatches > 0 AS has_diffs FROM r""")
def cmp_batch(spark, d):
    """The tables that two sides have in common: changed orders, parts with a column more and one of another type, suppliers as they were."""
    a = {n: S.table(spark, d, n) for n in ("orders", "part", "region", "supplier")}
    parts = a["part"].filter("p_partkey % 50 <> 0").withColumn("p_size", F.col("p_size").cast("string")).withColumn("p_note", F.lit(""))
    return C.batch_report(a, {"ORDERS": orders_b(spark, d), "Part": parts, "nation": S.table(spark, d, "nation"), "SUPPLIER": a["supplier"]})


_REC = f"""WITH {ORDERS_B}, a AS (SELECT o_orderpriority AS p, strftime(o_orderdate, '%Y-%m') AS ym, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE) AS gmv, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
b AS (SELECT o_orderpriority AS p, strftime(o_orderdate, '%Y-%m') AS ym, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE) AS gmv, CAST(count(*) AS DOUBLE) AS n FROM orders_b GROUP BY 1, 2),
newest AS (SELECT max(ym) AS ym FROM a), newest_b AS (SELECT max(ym) AS ym FROM b),
am AS (SELECT p, ym, 'gmv' AS metric, gmv AS value FROM a UNION ALL SELECT p, ym, 'n', n FROM a), bm AS (SELECT p, ym, 'gmv' AS metric, gmv AS value FROM b UNION ALL SELECT p, ym, 'n', n FROM b),
x AS (SELECT * FROM am WHERE ym <> (SELECT ym FROM newest)), y AS (SELECT * FROM bm WHERE ym <> (SELECT ym FROM newest_b)),
r AS (SELECT p, ym, metric, x.value AS value_a, y.value AS value_b, CASE WHEN y.value = 0 THEN CASE WHEN x.value = 0 THEN 0.0 ELSE 100.0 END ELSE abs(x.value - y.value) / abs(y.value) END AS rel,
  CASE WHEN x.p IS NULL THEN 'missing_a' WHEN y.p IS NULL THEN 'missing_b' END AS missing FROM x FULL JOIN y USING (p, ym, metric)),
diffs AS (SELECT p, ym, metric, value_a, value_b, rel, coalesce(missing, CASE WHEN rel > 0.01 THEN 'mismatch' END) AS status FROM r WHERE missing IS NOT NULL OR rel > 0.01)
"""


def reconciled(spark, d):
    def side(x):
        return x.groupBy(F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(exact_sum("o_totalprice").alias("gmv"), F.count(F.lit(1)).cast("double").alias("n"))

    a, b = sides(spark, d)
    return C.reconcile(side(a), side(b), ["p", "ym"], ["gmv", "n"], time_key="ym", grace=1)


@query("rec_rt_offline", _REC + "SELECT * FROM diffs")
def rec_rt_offline(spark, d):
    return reconciled(spark, d)


@query("rec_bias", _REC + """, g AS (SELECT metric, count(*) AS diffs, count(*) FILTER (value_a - value_b < 0) / CAST(count(*) AS DOUBLE) AS share_lower, round(median(value_a - value_b), 4) AS median_diff FROM diffs WHERE status = 'mismatch' GROUP BY 1)
SELECT *, diffs >= 3 AND greatest(share_lower, 1 - share_lower) >= 0.8 AS systematic FROM g""")
def rec_bias(spark, d):
    return C.reconcile_bias(reconciled(spark, d))


@query("snk_merge", f"""WITH {ORDERS_B} SELECT * FROM orders_b""")
def snk_merge(spark, d):
    a, b = sides(spark, d)
    exactly = C.change_table(a.withColumn("o_totalprice", F.col("o_totalprice")), b, ["o_orderkey"])
    return C.apply_changes(a, exactly, ["o_orderkey"])


_AUDIT = """l AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey % 2000 END AS k FROM orders), r AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 = 1),
lc AS (SELECT k, count(*) AS n_l FROM l WHERE k IS NOT NULL GROUP BY 1), rc AS (SELECT k, count(*) AS n_r FROM r GROUP BY 1), f AS (SELECT n_l, n_r FROM lc FULL JOIN rc USING (k)),
a AS (SELECT CAST(sum(n_l) AS BIGINT) AS keyed_left, CAST(sum(n_r) AS BIGINT) AS keyed_right, CAST(coalesce(sum(n_l) FILTER (n_r IS NOT NULL), 0) AS BIGINT) AS matched_left, CAST(coalesce(sum(n_r) FILTER (n_l IS NOT NULL), 0) AS BIGINT) AS matched_right,
  count(*) FILTER (n_r IS NULL) AS orphan_keys_left, count(*) FILTER (n_l IS NULL) AS orphan_keys_right, CAST(coalesce(sum(n_l * n_r), 0) AS BIGINT) AS joined_rows, count(*) FILTER (n_l > 1 AND n_r > 1) AS many_to_many_keys,
  (SELECT count(*) FROM l WHERE k IS NULL) AS null_left, CAST(0 AS BIGINT) AS null_right FROM f),
audit AS (SELECT *, matched_left / CAST(keyed_left AS DOUBLE) AS match_left, matched_right / CAST(keyed_right AS DOUBLE) AS match_right, joined_rows / CAST(nullif(matched_left, 0) AS DOUBLE) AS explosion FROM a)"""


def audited(spark, d):
    o, c = S.table(spark, d, "orders"), S.table(spark, d, "customer")
    left = o.select(F.when(F.col("o_orderkey") % 50 == 0, None).otherwise(F.col("o_custkey") % 2000).alias("k"))
    right = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("rk")).unionAll(c.filter("c_custkey % 10 = 1").select("c_custkey"))
    return J.join_audit(left, right, {"k": "rk"})


@query("jn_audit", f"WITH {_AUDIT} SELECT * FROM audit")
def jn_audit(spark, d):
    return audited(spark, d)


@query("jn_findings", f"""WITH {_AUDIT}, found AS (SELECT 'JA001' AS code, CASE WHEN many_to_many_keys > 0 THEN 'high' END AS severity, 'both' AS side, explosion AS value FROM audit
UNION ALL SELECT 'JA002', CASE WHEN match_left < 0.5 THEN 'high' WHEN match_left < 0.9 THEN 'medium' END, 'left', match_left FROM audit UNION ALL SELECT 'JA003', CASE WHEN match_right < 0.5 THEN 'high' WHEN match_right < 0.9 THEN 'medium' END, 'right', match_right FROM audit
UNION ALL SELECT 'JA004', CASE WHEN null_left = 0 THEN NULL WHEN null_left / CAST(null_left + keyed_left AS DOUBLE) >= 0.01 THEN 'medium' ELSE 'low' END, 'left', null_left / CAST(null_left + keyed_left AS DOUBLE) FROM audit)
SELECT * FROM found WHERE severity IS NOT NULL""")
def jn_findings(spark, d):
    return J.join_findings(audited(spark, d))


@query("jn_suggest", """SELECT 'customer' AS table_a, 'custkey' AS column_a, 'orders' AS table_b, 'custkey' AS column_b, CAST(0.9 AS DOUBLE) AS confidence, (SELECT count(DISTINCT c_custkey) FROM customer) AS ndv_a, (SELECT count(DISTINCT o_custkey) FROM orders) AS ndv_b, (SELECT count(*) FROM (SELECT DISTINCT c_custkey FROM customer INTERSECT SELECT DISTINCT o_custkey FROM orders)) AS shared UNION ALL SELECT 'customer' AS table_a, 'nationkey' AS column_a, 'nation' AS table_b, 'nationkey' AS column_b, CAST(0.9 AS DOUBLE) AS confidence, (SELECT count(DISTINCT c_nationkey) FROM customer) AS ndv_a, (SELECT count(DISTINCT n_nationkey) FROM nation) AS ndv_b, (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer INTERSECT SELECT DISTINCT n_nationkey FROM nation)) AS shared UNION ALL SELECT 'customer' AS table_a, 'nationkey' AS column_a, 'supplier' AS table_b, 'nationkey' AS column_b, CAST(0.9 AS DOUBLE) AS confidence, (SELECT count(DISTINCT c_nationkey) FROM customer) AS ndv_a, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS ndv_b, (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer INTERSECT SELECT DISTINCT s_nationkey FROM supplier)) AS shared UNION ALL SELECT 'nation' AS table_a, 'nationkey' AS column_a, 'supplier' AS table_b, 'nationkey' AS column_b, CAST(0.9 AS DOUBLE) AS confidence, (SELECT count(DISTINCT n_nationkey) FROM nation) AS ndv_a, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS ndv_b, (SELECT count(*) FROM (SELECT DISTINCT n_nationkey FROM nation INTERSECT SELECT DISTINCT s_nationkey FROM supplier)) AS shared UNION ALL SELECT 'nation' AS table_a, 'regionkey' AS column_a, 'region' AS table_b, 'regionkey' AS column_b, CAST(0.9 AS DOUBLE) AS confidence, (SELECT count(DISTINCT n_regionkey) FROM nation) AS ndv_a, (SELECT count(DISTINCT r_regionkey) FROM region) AS ndv_b, (SELECT count(*) FROM (SELECT DISTINCT n_regionkey FROM nation INTERSECT SELECT DISTINCT r_regionkey FROM region)) AS shared UNION ALL SELECT 'lineitem' AS table_a, 'orderkey' AS column_a, 'orders' AS table_b, 'orderkey' AS column_b, CAST(0.9 AS DOUBLE) AS confidence, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS ndv_a, (SELECT count(DISTINCT o_orderkey) FROM orders) AS ndv_b, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem INTERSECT SELECT DISTINCT o_orderkey FROM orders)) AS shared UNION ALL SELECT 'lineitem' AS table_a, 'partkey' AS column_a, 'part' AS table_b, 'partkey' AS column_b, CAST(0.9 AS DOUBLE) AS confidence, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS ndv_a, (SELECT count(DISTINCT p_partkey) FROM part) AS ndv_b, (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem INTERSECT SELECT DISTINCT p_partkey FROM part)) AS shared UNION ALL SELECT 'lineitem' AS table_a, 'suppkey' AS column_a, 'supplier' AS table_b, 'suppkey' AS column_b, CAST(0.9 AS DOUBLE) AS confidence, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS ndv_a, (SELECT count(DISTINCT s_suppkey) FROM supplier) AS ndv_b, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem INTERSECT SELECT DISTINCT s_suppkey FROM supplier)) AS shared""")
def jn_suggest(spark, d):
    names = ["orders", "customer", "nation", "region", "lineitem", "part", "supplier"]
    tables = {n: S.table(spark, d, n) for n in names}
    tables = {n: t.toDF(*[c.partition("_")[2] for c in t.columns]) for n, t in tables.items()}
    catalog = spark.createDataFrame([(n, c) for n, t in tables.items() for c in t.columns], "table_name string, column_name string")
    return J.with_overlap(J.suggest_joins(catalog), tables)


@query("jn_star", """SELECT n_name, r_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE) AS gmv FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY 1, 2""")
def jn_star(spark, d):
    t = lambda n: S.table(spark, d, n)
    j = J.star_join(t("orders"), [(t("customer"), "o_custkey", "c_custkey", None), (t("nation"), "c_nationkey", "n_nationkey", None), (t("region"), "n_regionkey", "r_regionkey", "r_name <> 'ASIA'")])
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice").alias("gmv"))


@query("jn_ratio", """WITH den AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p, CAST(count(*) AS DOUBLE) AS den FROM orders GROUP BY 1),
num AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p, CAST(count(*) AS DOUBLE) AS num FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT den.p AS p, num, den, num / nullif(den, 0) AS ratio FROM den LEFT JOIN num ON den.p = num.p""")
def jn_ratio(spark, d):
    o = S.table(spark, d, "orders").withColumn("p", F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_orderpriority")))
    den = o.groupBy("p").agg(F.count(F.lit(1)).cast("double").alias("den"))
    num = o.filter("o_orderstatus = 'F'").groupBy("p").agg(F.count(F.lit(1)).cast("double").alias("num"))
    return J.ratio_join(den, num, ["p"])


@query("jn_hot_key_split", """SELECT s_nationkey AS k, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(20, 2))) AS DOUBLE) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def jn_hot_key_split(spark, d):
    li, s = S.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "k"), S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    hot = [r.k for r in li.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(3).collect()]
    return J.hot_key_join(li.select("k", "l_quantity"), s, "k", hot).groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), exact_sum("l_quantity").alias("q"))


@query("jn_salted", """SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def jn_salted(spark, d):
    li, p = S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey"), S.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    return J.salted_join(li, p, "k", 8, "l_orderkey").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("prj_column_map", "SELECT o_orderkey, o_custkey AS buyer FROM orders")
def prj_column_map(spark, d):
    return C.rename_map(S.table(spark, d, "orders"), {"buyer": "O_CUSTKEY"}).select("o_orderkey", "buyer")


@query("prj_stringify", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def prj_stringify(spark, d):
    return C.stringify(S.table(spark, d, "orders"), ["o_orderkey", "o_custkey"]).select("o_orderkey", "o_custkey")
