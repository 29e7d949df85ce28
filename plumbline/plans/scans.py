"""Queries of scans, filters, samples, plain aggregates and windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions.values import exact, exact_sum, nearest_rank
from plumbline.operators import samples as M
from plumbline.operators import windows as W
from plumbline.sources import tables as S

from .inputs import ARRIVALS, DAILY, ORDERS_B, arrivals, daily, orders_b
from .registry import query

DEC = "CAST(sum(CAST({} AS DECIMAL(20, 2))) AS DOUBLE)"


@query("src_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def src_parquet(spark, d):
    return S.table(spark, d, "orders", "o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("src_catalog")
def src_catalog(spark, d):
    names = ["orders", "lineitem", "customer", "part", "supplier", "events"]
    rows = None
    for n in names:  # each table's rows beside its columns, so that the listing says what is there
        one = S.table(spark, d, n).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    return S.catalog(spark, d, names).join(rows, "table_name")


@query("flt_where_guard", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000")
def flt_where_guard(spark, d):
    return S.table(spark, d, "orders", "o_orderstatus = 'F' and o_totalprice between 1000 and 50000").select("o_orderkey")


@query("flt_partition_clause", """SELECT 'range' AS kind, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19970101' AND '19970131'
UNION ALL SELECT 'last', count(*) FROM orders WHERE strftime(o_orderdate, '%Y%m%d') = '19970131' UNION ALL SELECT 'newest', count(*) FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""")
def flt_partition_clause(spark, d):
    o = S.table(spark, d, "orders").withColumn("pt", F.date_format("o_orderdate", "yyyyMMdd"))
    made = [("range", "orders_di"), ("last", "orders_df"), ("newest", "orders")]
    out = None
    for kind, name in made:
        one = S.by_partition(o, name, "pt", "19970101", "19970131").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("flt_time_range", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-10-01' AND DATE '1996-12-31' GROUP BY 1")
def flt_time_range(spark, d):
    a, b = W.named_range("last quarter", dt.date(1997, 2, 15))
    day = F.to_date("o_orderdate")
    return S.table(spark, d, "orders").filter(day.between(F.lit(a), F.lit(b))).groupBy(day.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_incremental", "SELECT event_id, user_id FROM events WHERE event_id > 500")
def flt_incremental(spark, d):
    return S.newer_than(S.table(spark, d, "events"), "event_id", 500).select("event_id", "user_id")


@query("flt_row_policy", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey < 10 GROUP BY 1")
def flt_row_policy(spark, d):
    return S.secured(S.table(spark, d, "customer"), "customer", {"CUSTOMER": "c_nationkey < 10", "orders": None}).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("smp_head")
def smp_head(spark, d):
    return M.head(S.table(spark, d, "orders"), 100)


@query("smp_random")
def smp_random(spark, d):
    return M.random_rows(S.table(spark, d, "orders"), 100, ["o_orderkey"])


@query("smp_stratified", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 10")
def smp_stratified(spark, d):
    return M.stratified(S.table(spark, d, "orders"), "o_orderpriority", 10, [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("smp_stride", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE rn IN (SELECT CAST(floor(i * (SELECT max(n) FROM r) / 150.0) AS BIGINT) FROM range(150) t(i))")
def smp_stride(spark, d):
    return M.stride(S.table(spark, d, "orders"), 150, ["o_orderkey"]).select("o_orderkey")


@query("smp_percent")
def smp_percent(spark, d):
    return M.percent(S.table(spark, d, "lineitem"), 10)


@query("smp_percent_by_key")
def smp_percent_by_key(spark, d):
    return M.percent_by_key(S.table(spark, d, "orders"), 10, ["o_orderkey"])


@query("agg_group_sum", f"SELECT l_returnflag, l_linestatus, {DEC.format('l_quantity')} AS qty, {DEC.format('l_extendedprice')} AS price, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_group_sum(spark, d):
    return S.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(exact_sum("l_quantity").alias("qty"), exact_sum("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("n"))


@query("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_count_distinct(spark, d):
    return S.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg_approx_ndv")
def agg_approx_ndv(spark, d):
    """Sketches by flag, merged over flags: what a daily rollup of distinct counts keeps."""
    sketches = S.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey").alias("s"), F.approx_count_distinct("l_partkey").alias("parts"))
    every = sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("parts")).withColumn("l_returnflag", F.lit("all"))
    return sketches.select("l_returnflag", "parts").unionByName(every)


@query("agg_topk_freq", "SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n, count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS share FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def agg_topk_freq(spark, d):
    return W.topk_frequencies(S.table(spark, d, "events"), "user_id", 10)


@query("agg_null_rate", "SELECT count(*) AS total, count(*) FILTER (value > 50) AS nulls FROM events")
def agg_null_rate(spark, d):
    v = S.table(spark, d, "events").select(F.when(F.col("value") > 50, None).otherwise(F.col("value")).alias("v"))
    return v.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("v").isNull()).alias("nulls"))


def _rank_sql(value, group, table, picks):
    cols = ", ".join(f"min({value}) FILTER (rn = {index}) AS {name}" for name, index in picks.items())
    return f"WITH r AS (SELECT {group} AS g, {value}, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS rn, count(*) OVER (PARTITION BY {group}) AS n FROM {table}) SELECT g AS {group}, {cols} FROM r GROUP BY 1"


@query("agg_percentile_nearest", _rank_sql("value", "event_type", "events", {"p50": "round_even(0.5 * (n - 1), 0)", "p95": "round_even(0.95 * (n - 1), 0)"}))
def agg_percentile_nearest(spark, d):
    return nearest_rank(S.table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("agg_p99_floor", _rank_sql("l_extendedprice", "l_returnflag", "lineitem", {"p99": "least(floor(n * 0.99), n - 1)"}))
def agg_p99_floor(spark, d):
    return nearest_rank(S.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p99": 0.99}, rule="floor")


@query("agg_median", "SELECT o_orderpriority, median(o_totalprice) AS med FROM orders GROUP BY 1")
def agg_median(spark, d):
    return S.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("med"))


@query("agg_median_high", _rank_sql("o_totalprice", "o_orderpriority", "orders", {"med": "floor(n * 0.5)"}))
def agg_median_high(spark, d):
    return nearest_rank(S.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", {"med": 0.5}, rule="floor")


@query("agg_mad", "WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1) SELECT event_type, round(median(abs(value - med)), 6) AS mad FROM events JOIN m USING (event_type) GROUP BY 1")
def agg_mad(spark, d):
    e = S.table(spark, d, "events").select("event_type", "value")
    med = e.groupBy("event_type").agg(F.median("value").alias("med"))
    return e.join(med, "event_type").groupBy("event_type").agg(F.round(F.median(F.abs(F.col("value") - F.col("med"))), 6).alias("mad"))


_TWO = "two AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS x, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS y FROM events GROUP BY 1)"


@query("agg_pearson_lag", f"""WITH {_TWO}, p AS (SELECT lag, a.x, b.y FROM two a, (SELECT unnest(range(-7, 8)) AS lag) JOIN two b ON b.day = a.day + CAST(lag AS INTEGER))
SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, CASE WHEN count(*) >= 7 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS r FROM p GROUP BY 1""")
def agg_pearson_lag(spark, d):
    two = S.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.count_if(F.col("event_type") == "error").cast("double").alias("y"))
    return W.lagged_correlation(two, "day", "x", "y")


@query("agg_ols", f"WITH {DAILY} SELECT metric, round(regr_slope(value, CAST(day - DATE '1995-01-01' AS DOUBLE)), 4) AS slope, round(regr_intercept(value, CAST(day - DATE '1995-01-01' AS DOUBLE)), 2) AS intercept FROM daily GROUP BY 1")
def agg_ols(spark, d):
    x = F.datediff("day", F.lit("1995-01-01")).cast("double")
    return daily(spark, d).groupBy("metric").agg(F.round(F.regr_slope("value", x), 4).alias("slope"), F.round(F.regr_intercept("value", x), 2).alias("intercept"))


@query("agg_gini", """WITH c AS (SELECT l_suppkey AS v, count(*) AS n FROM lineitem GROUP BY 1), i AS (SELECT n, row_number() OVER (ORDER BY n, v DESC) AS i, count(*) OVER () AS m FROM c)
SELECT round(sum((2 * i - m - 1) * n) / CAST(max(m) * sum(n) AS DOUBLE), 6) AS gini FROM i""")
def agg_gini(spark, d):
    from plumbline.operators.compare import skew_metrics

    return skew_metrics(S.table(spark, d, "lineitem"), ["l_suppkey"], exact_all=True).select("gini")


@query("win_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def win_topn(spark, d):
    return W.top_n(S.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, ["o_orderkey"])


@query("win_ranked_groups", f"WITH s AS (SELECT o_orderpriority, o_custkey, {DEC.format('o_totalprice')} AS gmv FROM orders GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY gmv DESC, o_custkey) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 3")
def win_ranked_groups(spark, d):
    s = S.table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(exact_sum("o_totalprice").alias("gmv"))
    return W.ranked_groups(s, ["o_orderpriority"], "gmv", 3, ["o_custkey"])


@query("win_daily_trend", f"SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, {DEC.format('o_totalprice')} AS gmv FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY 1")
def win_daily_trend(spark, d):
    day = F.to_date("o_orderdate")
    return S.table(spark, d, "orders").filter(day.between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))).groupBy(day.cast("string").alias("day")).agg(exact_sum("o_totalprice").alias("gmv"))


@query("win_proportion", f"WITH s AS (SELECT o_orderpriority, {DEC.format('o_totalprice')} AS gmv FROM orders GROUP BY 1) SELECT o_orderpriority, gmv, round(gmv * 100.0 / sum(gmv) OVER (), 6) AS pct FROM s")
def win_proportion(spark, d):
    s = S.table(spark, d, "orders").groupBy("o_orderpriority").agg(exact_sum("o_totalprice").alias("gmv"))
    return W.proportion(s, "gmv").withColumn("pct", F.round("pct", 6))


@query("win_moving_avg", f"WITH {DAILY} SELECT metric, CAST(day AS VARCHAR) AS day, round(avg(value) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS ma FROM daily")
def win_moving_avg(spark, d):
    x = daily(spark, d)
    return x.select("metric", F.col("day").cast("string").alias("day"), F.round(W.moving_average(x, ["metric"], "day", "value", 7), 4).alias("ma"))


@query("win_cumulative", f"WITH {DAILY} SELECT metric, CAST(day AS VARCHAR) AS day, CAST(sum(CAST(value AS DECIMAL(20, 2))) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS total FROM daily")
def win_cumulative(spark, d):
    x = daily(spark, d)
    return x.select("metric", F.col("day").cast("string").alias("day"), W.running_sum(["metric"], "day", exact("value")).cast("double").alias("total"))


def _pair_sql(c, p):
    return f"""WITH s AS (SELECT o_orderpriority, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(20, 2))) FILTER (CAST(o_orderdate AS DATE) BETWEEN DATE '{c[0]}' AND DATE '{c[1]}'), 0) AS DOUBLE) AS curr,
CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(20, 2))) FILTER (CAST(o_orderdate AS DATE) BETWEEN DATE '{p[0]}' AND DATE '{p[1]}'), 0) AS DOUBLE) AS prev FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{c[0]}' AND DATE '{c[1]}' OR CAST(o_orderdate AS DATE) BETWEEN DATE '{p[0]}' AND DATE '{p[1]}' GROUP BY 1) SELECT *, (curr - prev) / nullif(prev, 0) * 100 AS pct FROM s"""


def _pair(spark, d, how):
    a, b = dt.date(1997, 3, 1), dt.date(1997, 3, 31)
    p, q = W.shift_range(a, b, how)
    return W.period_pair(S.table(spark, d, "orders"), ["o_orderpriority"], F.to_date("o_orderdate"), (str(a), str(b)), (str(p), str(q)), exact("o_totalprice"))


@query("win_mom", _pair_sql(("1997-03-01", "1997-03-31"), ("1997-01-29", "1997-02-28")))
def win_mom(spark, d):
    return _pair(spark, d, "mom")


@query("win_yoy", _pair_sql(("1997-03-01", "1997-03-31"), ("1996-03-01", "1996-03-31")))
def win_yoy(spark, d):
    return _pair(spark, d, "yoy")


@query("win_period_shift", _pair_sql(("1997-03-01", "1997-03-31"), ("1997-02-22", "1997-03-24")))
def win_period_shift(spark, d):
    return _pair(spark, d, "wow")


@query("win_streaks", f"""WITH {DAILY}, f AS (SELECT metric, day, value < 1000000 AS f FROM daily), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM f),
r AS (SELECT metric, g, count(*) FILTER (f) AS n FROM g GROUP BY 1, 2) SELECT metric, max(n) AS longest, arg_max(n, g) AS live FROM r GROUP BY 1""")
def win_streaks(spark, d):
    return W.streaks(daily(spark, d), ["metric"], "day", F.col("value") < 1000000)


@query("win_gaps", f"WITH {DAILY}, n AS (SELECT metric, day, lead(day) OVER (PARTITION BY metric ORDER BY day) AS nxt FROM daily) SELECT metric, CAST(day + 1 AS VARCHAR) AS first_missing, CAST(nxt - day - 1 AS INTEGER) AS missing_days FROM n WHERE nxt - day > 1")
def win_gaps(spark, d):
    return W.date_gaps(daily(spark, d), ["metric"], "day").withColumn("first_missing", F.col("first_missing").cast("string"))


@query("win_mad", f"""WITH {DAILY}, p AS (SELECT metric, day, value, array_agg(value) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS prior FROM daily),
m AS (SELECT *, CASE WHEN len(prior) >= 3 THEN list_aggregate(prior, 'median') END AS median FROM p)
SELECT metric, CAST(day AS VARCHAR) AS day, round(median, 4) AS median, round(CASE WHEN median IS NOT NULL THEN list_aggregate(list_transform(prior, lambda x: abs(x - median)), 'median') END, 4) AS mad FROM m""")
def win_mad(spark, d):
    m = W.rolling_mad(daily(spark, d), ["metric"], "day", "value")
    return m.select("metric", F.col("day").cast("string").alias("day"), F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


@query("win_out_of_order", f"""WITH {ARRIVALS}, o AS (SELECT *, event_s < max(event_s) OVER (ORDER BY arrival_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM arrivals)
SELECT event_type, count(*) AS n, count(*) FILTER (late) AS late FROM o GROUP BY 1""")
def win_out_of_order(spark, d):
    o = W.out_of_order(arrivals(spark, d), "event_s", ["arrival_s", "event_id"], F.floor(F.col("arrival_s") / 3600))
    return o.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))


@query("win_flapping", """WITH e AS (SELECT user_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, event_id FROM events), l AS (SELECT *, lead(s, 4) OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) - s <= 86400 AS hit FROM e)
SELECT user_id, event_type, count(*) AS firings, coalesce(bool_or(hit), FALSE) AS flapping FROM l GROUP BY 1, 2""")
def win_flapping(spark, d):
    e = arrivals(spark, d)
    return W.flapping(e, ["user_id", "event_type"], "event_s", 5, 86400)


@query("win_monotone_trend", f"""WITH {DAILY}, l AS (SELECT metric, day, value - lag(value) OVER (PARTITION BY metric ORDER BY day) AS d, row_number() OVER (PARTITION BY metric ORDER BY day DESC) AS r FROM daily)
SELECT metric, count(*) >= 3 AND bool_and(d > 0) FILTER (r < 3) AS rising FROM l WHERE r <= 3 GROUP BY 1""")
def win_monotone_trend(spark, d):
    return W.rising(daily(spark, d), ["metric"], "day", "value", 3)


@query("set_ops", f"""WITH {ORDERS_B}, a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT o_custkey, o_orderstatus FROM orders_b)
SELECT 'intersect' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'except_all', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def set_ops(spark, d):
    a, b = (x.select("o_custkey", "o_orderstatus") for x in (S.table(spark, d, "orders"), orders_b(spark, d)))
    made = {"intersect": a.intersect(b), "except": a.subtract(b), "except_all": a.exceptAll(b), "union": a.unionByName(b).distinct()}
    out = None
    for op, rows in made.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(op))
        out = one if out is None else out.unionByName(one)
    return out
