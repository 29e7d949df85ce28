"""Queries of the metric layer and of time series: orders by day, priority and segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.operators import timeseries as T
from plumbline.operators import windows as W
from plumbline.functions.values import exact
from plumbline.sources import tables as S

from .inputs import DAILY, daily
from .registry import query

DAY = "CAST(o_orderdate AS DATE)"
GMV = M.Metric("gmv", "sum(cast(o_totalprice as decimal(20,2)))", "to_date(o_orderdate)", ("o_orderpriority", "o_orderstatus"), "o_totalprice > 0")
AOV = M.Metric("aov", "sum(cast(o_totalprice as decimal(20,2)))", "to_date(o_orderdate)", ("o_orderpriority",), None, "count(*)")
DEC = "CAST(sum(CAST({} AS DECIMAL(20, 2))) AS DOUBLE)"
IN_JAN, IN_FEB = f"{DAY} BETWEEN DATE '1997-01-01' AND DATE '1997-01-31'", f"{DAY} BETWEEN DATE '1997-02-01' AND DATE '1997-02-28'"


def jan_feb():
    day = F.to_date("o_orderdate")
    inside = lambda a, b: day.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return inside("1997-01-01", "1997-01-31"), inside("1997-02-01", "1997-02-28")


def text_day(df, *names):
    return df.withColumns({n: F.col(n).cast("string") for n in names or ("day",)})


@query("met_additive", f"SELECT o_orderpriority, o_orderstatus, {DEC.format('o_totalprice')} AS value FROM orders WHERE o_totalprice > 0 AND o_custkey % 2 = 0 AND {IN_JAN} GROUP BY 1, 2")
def met_additive(spark, d):
    return M.build(S.table(spark, d, "orders"), GMV, ["o_orderpriority", "o_orderstatus"], "1997-01-01", "1997-01-31", "o_custkey % 2 = 0")


@query("met_ratio", f"SELECT o_orderpriority, {DEC.format('o_totalprice')} / CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1")
def met_ratio(spark, d):
    return M.build(S.table(spark, d, "orders"), AOV, ["o_orderpriority"])


@query("met_series", f"SELECT CAST({DAY} AS VARCHAR) AS day, {DEC.format('o_totalprice')} / CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1")
def met_series(spark, d):
    return text_day(M.series(S.table(spark, d, "orders"), AOV))


@query("met_fill_spine", f"""WITH {DAILY}, e AS (SELECT metric, min(day) AS a, max(day) AS b FROM daily GROUP BY 1), s AS (SELECT metric, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e)
SELECT s.metric, CAST(s.day AS VARCHAR) AS day, coalesce(value, 0) AS value FROM s LEFT JOIN daily USING (metric, day)""")
def met_fill_spine(spark, d):
    return text_day(M.on_spine(daily(spark, d), ["metric"]))


@query("met_fill_forward", f"""WITH {DAILY}, e AS (SELECT metric, min(day) AS a, max(day) AS b FROM daily GROUP BY 1), s AS (SELECT metric, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e)
SELECT s.metric, CAST(s.day AS VARCHAR) AS day, last_value(value IGNORE NULLS) OVER (PARTITION BY s.metric ORDER BY s.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM s LEFT JOIN daily USING (metric, day)""")
def met_fill_forward(spark, d):
    return text_day(M.on_spine(daily(spark, d), ["metric"], additive=False))


@query("met_target", f"""WITH {DAILY}, a AS (SELECT metric, CAST(sum(CAST(value AS DECIMAL(20, 2))) AS DOUBLE) AS actual FROM daily WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-03-10' GROUP BY 1), t AS (SELECT DISTINCT metric, CAST(length(metric) * 4000000 AS DOUBLE) AS target FROM daily)
SELECT metric, target, coalesce(actual, 0) AS actual, coalesce(actual, 0) * 100.0 / target AS reached_pct, coalesce(actual, 0) / 69 * 90 AS pace, coalesce(actual, 0) / 69 * 90 >= target AS on_track FROM t LEFT JOIN a USING (metric)""")
def met_target(spark, d):
    s = daily(spark, d)
    targets = s.select("metric", (F.length("metric") * 4000000).cast("double").alias("target")).distinct()
    return M.target_progress(s, ["metric"], "1997-01-01", "1997-03-31", "1997-03-10", targets)


@query("met_digest", f"""WITH o AS (SELECT *, {DAY} AS day FROM orders), v AS (SELECT 'gmv' AS metric, CAST(o_totalprice AS DECIMAL(20, 2)) AS v, day FROM o UNION ALL SELECT 'orders', 1, day FROM o),
g AS (SELECT metric, CAST(coalesce(sum(v) FILTER (day = DATE '1997-03-10'), 0) AS DOUBLE) AS yesterday, CAST(coalesce(sum(v) FILTER (day = DATE '1997-03-09'), 0) AS DOUBLE) AS before, CAST(coalesce(sum(v) FILTER (day BETWEEN DATE '1997-03-01' AND DATE '1997-03-10'), 0) AS DOUBLE) AS month_to_date FROM v GROUP BY 1)
SELECT *, (yesterday - before) * 100.0 / nullif(before, 0) AS dod_pct FROM g""")
def met_digest(spark, d):
    return M.digest(S.table(spark, d, "orders"), F.to_date("o_orderdate"), "1997-03-10", "1997-03-01", {"gmv": "cast(o_totalprice as decimal(20,2))", "orders": "1"})


@query("met_freshness", f"""SELECT 'orders' AS table_name, CAST(max({DAY}) AS VARCHAR) AS latest, CAST(DATE '2001-08-05' - max({DAY}) AS INTEGER) AS lag_days, DATE '2001-08-05' - max({DAY}) > 2 AS late FROM orders
UNION ALL SELECT 'lineitem', CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR), CAST(DATE '2001-08-05' - max(CAST(l_shipdate AS DATE)) AS INTEGER), DATE '2001-08-05' - max(CAST(l_shipdate AS DATE)) > 30 FROM lineitem""")
def met_freshness(spark, d):
    tables = {"orders": (S.table(spark, d, "orders"), F.to_date("o_orderdate")), "lineitem": (S.table(spark, d, "lineitem"), F.to_date("l_shipdate"))}
    return M.freshness(tables, "2001-08-05", {"orders": 2, "lineitem": 30})


def _watch_sql(lag):
    return f"""WITH {DAILY}, b AS (SELECT metric, CAST(day + {lag} AS DATE) AS day, value AS base FROM daily), x AS (SELECT metric, day, value, base, (value - base) * 100.0 / nullif(abs(base), 0) AS change_pct FROM daily LEFT JOIN b USING (metric, day)),
s AS (SELECT *, coalesce(CASE WHEN abs(change_pct) >= 50 THEN sign(change_pct) ELSE 0 END, 0) AS side FROM x), a AS (SELECT *, side <> 0 AND side <> coalesce(lag(side) OVER (PARTITION BY metric ORDER BY day), 0) AS alert FROM s)"""


@query("met_watch", _watch_sql(1) + " SELECT metric, CAST(day AS VARCHAR) AS day, value, base, change_pct, alert FROM a")
def met_watch(spark, d):
    return text_day(M.watch(daily(spark, d), ["metric"], 1, 50.0))


@query("met_backtest", _watch_sql(7) + " SELECT metric, count(*) AS days, count(base) AS comparable, count(*) FILTER (alert) AS alerts FROM a GROUP BY 1")
def met_backtest(spark, d):
    return M.backtest(M.watch(daily(spark, d), ["metric"], 7, 50.0), ["metric"])


@query("met_backtest_model")
def met_backtest_model(spark, d):
    """Model mode: the last 60 days of each series against the band fitted before them."""
    return T.model_backtest(daily(spark, d), "metric", 60)


@query("fc_ols")
def fc_ols(spark, d):
    return T.forecast(M.on_spine(daily(spark, d), ["metric"]), "metric", 7)


@query("cal_holiday", f"""WITH s AS (SELECT {DAY} AS day, {DEC.format('o_totalprice')} AS value FROM orders GROUP BY 1), c AS (SELECT * FROM (VALUES (DATE '1997-01-01', 'holiday'), (DATE '1997-05-01', 'holiday'), (DATE '1997-05-03', 'workday')) t(day, kind))
SELECT CAST(day AS VARCHAR) AS day, value, coalesce(kind, CASE WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'workday' END) AS kind FROM s LEFT JOIN c USING (day)""")
def cal_holiday(spark, d):
    s = M.series(S.table(spark, d, "orders"), M.Metric("gmv", GMV.value, GMV.day))
    cal = spark.createDataFrame([("1997-01-01", "holiday"), ("1997-05-01", "holiday"), ("1997-05-03", "workday")], "d string, kind string").select(F.to_date("d").alias("day"), "kind")
    weekend = F.when(F.weekday("day") >= 5, "weekend").otherwise("workday")
    return text_day(s.join(F.broadcast(cal), "day", "left").select("day", "value", F.coalesce("kind", weekend).alias("kind")))  # a calendar of a few hundred days


@query("cap_forecast", f"""WITH {DAILY}, c AS (SELECT metric, day, CAST(sum(CAST(value AS DECIMAL(20, 2))) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value FROM daily), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day DESC) AS r FROM c),
g AS (SELECT metric, arg_max(value, day) AS latest, round(regr_slope(value, CAST(day - DATE '1970-01-01' AS DOUBLE)), 4) AS per_day FROM r WHERE r <= 14 GROUP BY 1), q AS (SELECT *, round(latest * 1.02, 0) AS quota FROM g),
l AS (SELECT *, CASE WHEN per_day > 0 THEN greatest(0.0, ceil((quota - latest) / per_day)) END AS days_left FROM q)
SELECT *, CASE WHEN days_left <= 30 THEN 'CF001 high' WHEN days_left <= 90 THEN 'CF001 mid' WHEN per_day < 0 THEN 'CF003' END AS code FROM l""")
def cap_forecast(spark, d):
    x = daily(spark, d)
    s = x.select("metric", "day", W.running_sum(["metric"], "day", exact("value")).cast("double").alias("value"))
    quotas = s.groupBy("metric").agg(F.round(F.max_by("value", "day") * 1.02, 0).alias("quota"))
    return T.capacity(s, ["metric"], quotas)


_MAD = f"""{DAILY}, p AS (SELECT metric, day, value, array_agg(value) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS prior FROM daily),
md AS (SELECT *, CASE WHEN len(prior) >= 3 THEN list_aggregate(prior, 'median') END AS median FROM p), m AS (SELECT *, CASE WHEN median IS NOT NULL THEN list_aggregate(list_transform(prior, lambda x: abs(x - median)), 'median') END AS mad FROM md)"""


@query("vol_points", f"""WITH {_MAD}, c AS (SELECT *, (value - median) / nullif(abs(median), 0) AS rel, mad = 0 OR abs(value - median) > 5 * mad AS far FROM m), k AS (SELECT *, CASE WHEN far AND rel >= 0.5 THEN 'VA001' WHEN far AND rel <= -0.3 THEN 'VA002' END AS code, CASE WHEN rel >= 1.0 OR rel <= -0.6 THEN 'high' ELSE 'mid' END AS severity FROM c),
l AS (SELECT *, lag(code) OVER (PARTITION BY metric ORDER BY day) AS before FROM k) SELECT metric, CAST(day AS VARCHAR) AS day, code, severity, value, round(median, 4) AS base FROM l WHERE code IS NOT NULL AND (before IS NULL OR before <> code)""")
def vol_points(spark, d):
    return text_day(T.volatility(daily(spark, d), ["metric"])).withColumn("base", F.round("base", 4))


@query("vol_shift", f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day DESC) AS r FROM daily), g AS (SELECT metric, median(value) FILTER (r <= 3) AS recent_median, median(value) FILTER (r > 3) AS prior_median, count(*) AS n FROM r GROUP BY 1),
x AS (SELECT metric, recent_median, prior_median, (recent_median - prior_median) / nullif(abs(prior_median), 0) AS rel, n FROM g) SELECT metric, round(recent_median, 4) AS recent_median, round(prior_median, 4) AS prior_median, round(rel, 6) AS rel, CASE WHEN n >= 6 AND abs(rel) >= 0.3 THEN 'VA003' END AS code FROM x""")
def vol_shift(spark, d):
    x = T.level_shift(daily(spark, d), ["metric"])
    return x.withColumns({"recent_median": F.round("recent_median", 4), "prior_median": F.round("prior_median", 4), "rel": F.round("rel", 6)})


_FLAT = "s AS (SELECT metric, day, CASE WHEN metric < '3' AND r <= 3 THEN 1.0 ELSE value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day DESC) AS r FROM daily))"


@query("vol_flat", f"""WITH {DAILY}, {_FLAT}, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day DESC) AS r FROM s) SELECT metric, count(*) FILTER (r <= 3) = 3 AND min(value) FILTER (r <= 3) = max(value) FILTER (r <= 3) AND count(*) FILTER (r > 3) > 0 AND min(value) FILTER (r > 3) <> max(value) FILTER (r > 3) AS flat FROM r GROUP BY 1""")
def vol_flat(spark, d):
    from pyspark.sql.window import Window

    r = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("day")))
    s = daily(spark, d).withColumn("r", r).withColumn("value", F.when((F.col("metric") < "3") & (F.col("r") <= 3), 1.0).otherwise(F.col("value"))).drop("r")
    return T.flat_tail(s, ["metric"])


@query("vol_gap", f"WITH {DAILY}, n AS (SELECT metric, day, lead(day) OVER (PARTITION BY metric ORDER BY day) AS nxt FROM daily) SELECT metric, count(*) AS gaps, CAST(sum(nxt - day - 1) AS BIGINT) AS missing FROM n WHERE nxt - day > 1 GROUP BY 1")
def vol_gap(spark, d):
    return W.date_gaps(daily(spark, d), ["metric"], "day").groupBy("metric").agg(F.count(F.lit(1)).alias("gaps"), F.sum("missing_days").alias("missing"))


def _against(steps):
    return f"WITH {DAILY}, b AS (SELECT metric, day, value, lag(value, {steps}) OVER (PARTITION BY metric ORDER BY day) AS base FROM daily) SELECT metric, CAST(day AS VARCHAR) AS day, value, base, (value - base) / nullif(abs(base), 0) AS rel FROM b WHERE base IS NOT NULL"


@query("vol_mom", _against(1))
def vol_mom(spark, d):
    return text_day(T.against(daily(spark, d), ["metric"], 1))


@query("vol_yoy", _against(7))
def vol_yoy(spark, d):
    return text_day(T.against(daily(spark, d), ["metric"], 7))


_JOINED = f"j AS (SELECT o_orderpriority, o_orderstatus, c_mktsegment, CAST(CASE WHEN {IN_JAN} THEN o_totalprice ELSE 0 END AS DECIMAL(20, 2)) AS p, CAST(CASE WHEN {IN_FEB} THEN o_totalprice ELSE 0 END AS DECIMAL(20, 2)) AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE {IN_JAN} OR {IN_FEB})"
_SUMS = "CAST(sum(p) AS DOUBLE) AS prev, CAST(sum(c) AS DOUBLE) AS curr FROM j GROUP BY ALL"
_ATTR = f"""{_JOINED}, g AS (SELECT 'o_orderpriority' AS dimension, o_orderpriority AS member, {_SUMS} UNION ALL SELECT 'o_orderstatus', o_orderstatus, {_SUMS} UNION ALL SELECT 'c_mktsegment', c_mktsegment, {_SUMS}
UNION ALL SELECT 'o_orderstatusxc_mktsegment', o_orderstatus || '|' || c_mktsegment, {_SUMS} UNION ALL SELECT 'total', '', CAST(sum(p) AS DOUBLE), CAST(sum(c) AS DOUBLE) FROM j),
a AS (SELECT dimension, member, prev, curr, curr - prev AS delta, (curr - prev) / nullif(abs((SELECT prev FROM g WHERE dimension = 'total')), 0) AS contribution, CASE WHEN prev = 0 THEN 'new' WHEN curr = 0 THEN 'gone' ELSE 'both' END AS status FROM g)"""


def attributed(spark, d):
    o, c = S.table(spark, d, "orders"), S.table(spark, d, "customer")
    jan, feb = jan_feb()
    j = o.filter(jan | feb).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return M.attribute(j, ["o_orderpriority", "o_orderstatus", "c_mktsegment"], feb, jan, exact("o_totalprice"), [("o_orderstatus", "c_mktsegment")])


@query("attr_dims", f"WITH {_ATTR} SELECT * FROM a WHERE dimension NOT LIKE '%x%'")
def attr_dims(spark, d):
    return attributed(spark, d).filter("dimension not like '%x%'")


@query("attr_cross", f"WITH {_ATTR} SELECT * FROM a WHERE dimension LIKE '%x%'")
def attr_cross(spark, d):
    return attributed(spark, d).filter("dimension like '%x%'")


@query("attr_concentration", f"""WITH {_ATTR}, r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY abs(contribution) DESC, member) AS r FROM a WHERE dimension <> 'total'),
k AS (SELECT dimension, count(*) AS members, round(sum(abs(contribution)) FILTER (r <= 3), 6) AS concentration, round(abs(CAST(sum(CAST(delta AS DECIMAL(24, 2))) AS DOUBLE) - (SELECT delta FROM a WHERE dimension = 'total')), 2) AS identity_gap FROM r GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY concentration DESC, dimension) AS INTEGER) AS rank FROM k""")
def attr_concentration(spark, d):
    return M.concentration(attributed(spark, d))


@query("attr_ratio_split", f"""WITH s AS (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) FILTER ({IN_JAN}) AS DOUBLE) AS n0, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) FILTER ({IN_FEB}) AS DOUBLE) AS n1, CAST(count(*) FILTER ({IN_JAN}) AS DOUBLE) AS d0, CAST(count(*) FILTER ({IN_FEB}) AS DOUBLE) AS d1 FROM orders)
SELECT round(n0 / d0, 4) AS ratio_prev, round(n1 / d1, 4) AS ratio_curr, round(((n1 / d0 - n0 / d0) + (n1 / d1 - n0 / d1)) / 2, 4) AS numerator_effect, round(((n0 / d1 - n0 / d0) + (n1 / d1 - n1 / d0)) / 2, 4) AS denominator_effect FROM s""")
def attr_ratio_split(spark, d):
    jan, feb = jan_feb()
    r = M.ratio_split(S.table(spark, d, "orders"), feb, jan, exact("o_totalprice"), F.lit(1))
    return r.select(*[F.round(c, 4).alias(c) for c in r.columns])


@query("attr_tree", f"""WITH t AS (SELECT CAST(count(DISTINCT o_custkey) FILTER ({IN_JAN}) AS DOUBLE) AS b0, CAST(count(DISTINCT o_custkey) FILTER ({IN_FEB}) AS DOUBLE) AS b1, CAST(count(*) FILTER ({IN_JAN}) AS DOUBLE) AS n0, CAST(count(*) FILTER ({IN_FEB}) AS DOUBLE) AS n1,
CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) FILTER ({IN_JAN}) AS DOUBLE) AS g0, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) FILTER ({IN_FEB}) AS DOUBLE) AS g1 FROM orders), m AS (SELECT *, (g1 - g0) / (ln(g1) - ln(g0)) AS l FROM t)
SELECT 'buyers' AS factor, round(l * ln(b1 / b0), 2) AS effect, CAST(0.0 AS DOUBLE) AS residual FROM m UNION ALL SELECT 'orders_per_buyer', round(l * ln((n1 / b1) / (n0 / b0)), 2), 0.0 FROM m UNION ALL SELECT 'order_value', round(l * ln((g1 / n1) / (g0 / n0)), 2), 0.0 FROM m""")
def attr_tree(spark, d):
    jan, feb = jan_feb()
    o = S.table(spark, d, "orders").filter(jan | feb)
    sums = []
    for s, w in (("prev", jan), ("curr", feb)):
        sums += [F.count_distinct(F.when(w, F.col("o_custkey"))).cast("double").alias(f"b_{s}"), F.count_if(w).cast("double").alias(f"n_{s}"), F.sum(F.when(w, exact("o_totalprice"))).cast("double").alias(f"g_{s}")]
    row = o.agg(*sums)
    made = {f"{n}_{s}": e for s in ("prev", "curr") for n, e in (("buyers", F.col(f"b_{s}")), ("orders_per_buyer", F.col(f"n_{s}") / F.col(f"b_{s}")), ("order_value", F.col(f"g_{s}") / F.col(f"n_{s}")))}
    shares = M.tree_shares(row.select(*[e.alias(n) for n, e in made.items()]), ["buyers", "orders_per_buyer", "order_value"])
    return shares.withColumns({"effect": F.round("effect", 2), "residual": F.round("residual", 2)})


_ROWS = f"""j AS (SELECT o_orderpriority AS member, CAST(sum(CAST(CASE WHEN {IN_JAN} THEN o_totalprice ELSE 0 END AS DECIMAL(20, 2))) AS DOUBLE) AS prev, CAST(sum(CAST(CASE WHEN {IN_FEB} THEN o_totalprice ELSE 0 END AS DECIMAL(20, 2))) AS DOUBLE) AS curr,
max(CASE WHEN {IN_JAN} THEN 1 ELSE 0 END) AS hp, max(CASE WHEN {IN_FEB} THEN 1 ELSE 0 END) AS hc FROM orders WHERE {IN_JAN} OR {IN_FEB} GROUP BY 1), g AS (SELECT CAST(sum(abs(CAST(curr - prev AS DECIMAL(24, 2)))) AS DOUBLE) AS gross FROM j),
r AS (SELECT member, prev, curr, curr - prev AS delta, (curr - prev) / nullif(gross, 0) AS share, CASE WHEN hp = 0 THEN 'appeared' WHEN hc = 0 THEN 'vanished' ELSE 'both' END AS status FROM j, g)"""


def rows_of(spark, d):
    jan, feb = jan_feb()
    o = S.table(spark, d, "orders")
    return M.attribute_rows(o.filter(jan), o.filter(feb), "o_orderpriority", "o_totalprice")


@query("attr_rows", f"WITH {_ROWS} SELECT * FROM r")
def attr_rows(spark, d):
    return rows_of(spark, d)


@query("attr_findings", f"""WITH {_ROWS} SELECT * FROM (SELECT 'MA001' AS code, member AS subject, delta AS value FROM r ORDER BY abs(delta) DESC, member LIMIT 1) UNION ALL SELECT 'MA002', member, share FROM r WHERE abs(share) >= 0.5
UNION ALL SELECT 'MA003', 'all', net FROM (SELECT abs(CAST(sum(CAST(delta AS DECIMAL(24, 2))) AS DOUBLE)) AS net, CAST(sum(abs(CAST(delta AS DECIMAL(24, 2)))) AS DOUBLE) AS gross FROM r) WHERE net < gross / 1.5""")
def attr_findings(spark, d):
    return M.attribution_findings(rows_of(spark, d))


_CORR = f"c AS (SELECT {DAY} AS day, CAST(count(*) AS DOUBLE) AS x, {DEC.format('o_totalprice')} AS y FROM orders GROUP BY 1)"


@query("corr_metrics", f"""WITH {_CORR}, p AS (SELECT lag, a.x, b.y FROM c a, (SELECT unnest(range(-7, 8)) AS lag) JOIN c b ON b.day = a.day + CAST(lag AS INTEGER)), g AS (SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, CASE WHEN count(*) >= 7 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS r FROM p GROUP BY 1)
SELECT (SELECT r FROM g WHERE lag = 0) AS r0, arg_max(lag, abs(r)) AS best_lag, arg_max(r, abs(r)) AS best_r FROM g""")
def corr_metrics(spark, d):
    c = S.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), ).agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum(exact("o_totalprice")).cast("double").alias("y"))
    g = W.lagged_correlation(c, "day", "x", "y")
    return g.agg(F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("r0"), F.max_by("lag", F.abs("r")).alias("best_lag"), F.max_by("r", F.abs("r")).alias("best_r"))


_USE = """pr AS (SELECT * FROM (VALUES ('click', 0.0010), ('view', 0.0020), ('purchase', 0.0500), ('error', 0.0001)) t(item, price)),
dc AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(CAST(value AS DECIMAL(20, 2)) * CAST(price AS DECIMAL(10, 4)) AS DECIMAL(20, 4))) AS DOUBLE) AS cost FROM events LEFT JOIN pr ON event_type = item GROUP BY 1, 2)"""


def usage(spark, d):
    prices = spark.createDataFrame([("click", "0.0010"), ("view", "0.0020"), ("purchase", "0.0500"), ("error", "0.0001")], "item string, price string").withColumn("price", F.col("price").cast("decimal(10,4)"))
    log = S.table(spark, d, "events").select("user_id", F.col("event_type").alias("item"), exact("value").alias("quantity"), "ts")
    return M.priced_usage(log, F.broadcast(prices), F.to_date("ts"), ["user_id"])


@query("cost_llm_usage", f"WITH {_USE} SELECT user_id, CAST(day AS VARCHAR) AS day, cost FROM dc")
def cost_llm_usage(spark, d):
    return text_day(usage(spark, d))


@query("cost_anomalies", f"""WITH {_USE}, w AS (SELECT user_id, day, cost, CAST(sum(CASE WHEN cost > 0 THEN CAST(cost AS DECIMAL(20, 4)) END) OVER w AS DOUBLE) / CAST(nullif(count(CASE WHEN cost > 0 THEN cost END) OVER w, 0) AS DOUBLE) AS typical, count(CASE WHEN cost > 0 THEN cost END) OVER w AS spend_days FROM dc WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT user_id, CAST(day AS VARCHAR) AS day, cost, typical, spend_days FROM w WHERE spend_days >= 3 AND cost > 2 * typical""")
def cost_anomalies(spark, d):
    x = M.cost_anomalies(usage(spark, d), ["user_id"]).filter("anomaly")
    return text_day(x.select("user_id", "day", "cost", F.col("trailing").alias("typical"), "spend_days"))
