"""The metric layer: definitions, grouped values, ratios, series, targets, watches, attribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Metric:
    """An additive metric (an aggregate expression), or a ratio of two of them over the same table.

    ``value`` and ``denominator`` are SQL aggregate expressions; ``day`` is the date expression
    of a row; ``dims`` are the dimensions that may be asked for; ``where`` always holds.
    """

    name: str
    value: str
    day: str
    dims: tuple[str, ...] = ()
    where: str | None = None
    denominator: str | None = None


def build(df: DataFrame, m: Metric, dims: Sequence[str] = (), start: str | None = None, end: str | None = None, where: str | None = None) -> DataFrame:
    """``dims, value`` of a metric in a date range; both sides of a ratio come from one scan, null where the denominator is zero."""
    if unknown := set(dims) - set(m.dims):
        raise ValueError(f"{m.name} has no dimension {sorted(unknown)}")
    rows = df
    for w in (m.where, where):
        rows = rows if w is None else rows.filter(F.expr(w))
    if start is not None:
        rows = rows.filter(F.expr(m.day).between(F.lit(start).cast("date"), F.lit(end or start).cast("date")))
    num = F.expr(m.value).cast("double")
    value = num if m.denominator is None else num / F.nullif(F.expr(m.denominator).cast("double"), F.lit(0.0))
    return rows.groupBy(*dims).agg(value.alias("value")) if dims else rows.agg(value.alias("value"))


def series(df: DataFrame, m: Metric, by: Sequence[str] = ()) -> DataFrame:
    """``by, day, value``: one row for each day that has rows."""
    num = F.coalesce(F.expr(m.value).cast("double"), F.lit(0.0))
    value = num if m.denominator is None else num / F.nullif(F.expr(m.denominator).cast("double"), F.lit(0.0))
    rows = df if m.where is None else df.filter(F.expr(m.where))
    return rows.groupBy(*by, F.expr(m.day).alias("day")).agg(value.alias("value"))


def on_spine(s: DataFrame, by: Sequence[str] = (), step: str = "interval 1 day", additive: bool = True) -> DataFrame:
    """The series on every step between its first and last day: zeros between (additive) or the last known value."""
    ends = s.groupBy(*by).agg(F.min("day").alias("__a"), F.max("day").alias("__b")) if by else s.agg(F.min("day").alias("__a"), F.max("day").alias("__b"))
    spine = ends.select(*by, F.explode(F.sequence("__a", "__b", F.expr(step))).alias("day"))
    full = spine.join(s, [*by, "day"], "left")
    if additive:
        return full.fillna({"value": 0.0})
    w = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("value", F.last("value", ignorenulls=True).over(w))


def target_progress(s: DataFrame, by: Sequence[str], start: str, end: str, today: str, targets: DataFrame) -> DataFrame:
    """``by, actual, target, reached_pct, pace, on_track``: period to date against a target, projected at a steady pace."""
    day = lambda x: F.lit(x).cast("date")
    to_date = s.filter(F.col("day").between(day(start), day(today))).groupBy(*by).agg(F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("actual"))
    elapsed, total = F.datediff(day(today), day(start)) + 1, F.datediff(day(end), day(start)) + 1
    out = targets.join(to_date, list(by), "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    out = out.withColumn("reached_pct", F.col("actual") * 100.0 / F.nullif(F.col("target"), F.lit(0.0))).withColumn("pace", F.col("actual") / elapsed * total)
    return out.withColumn("on_track", F.col("pace") >= F.col("target"))


def digest(df: DataFrame, day: Column, yesterday: str, month_start: str, values: Mapping[str, str]) -> DataFrame:
    """``metric, yesterday, before, dod_pct, month_to_date`` of many aggregates ``{name: summed expression}`` in one scan."""
    y = F.lit(yesterday).cast("date")
    rows = df.filter(day.between(F.least(F.lit(month_start).cast("date"), F.date_sub(y, 1)), y)).withColumn("__day", day)
    aggs = []
    for name, e in values.items():
        v = F.expr(e)
        for part, when in (("y", F.col("__day") == y), ("b", F.col("__day") == F.date_sub(y, 1)), ("m", F.col("__day") >= F.lit(month_start).cast("date"))):
            aggs.append(F.coalesce(F.sum(F.when(when, v)).cast("double"), F.lit(0.0)).alias(f"{name}|{part}"))
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}|y`").alias("yesterday"), F.col(f"`{n}|b`").alias("before"), F.col(f"`{n}|m`").alias("month_to_date")) for n in values])
    out = rows.agg(*aggs).select(F.explode(cells).alias("r")).select("r.*")
    return out.withColumn("dod_pct", (F.col("yesterday") - F.col("before")) * 100.0 / F.nullif(F.col("before"), F.lit(0.0)))


def freshness(tables: Mapping[str, tuple[DataFrame, Column]], today: str, allowed: Mapping[str, int]) -> DataFrame:
    """``table_name, latest, lag_days, late`` of each table's largest date."""
    out = None
    for name, (df, day) in tables.items():
        one = df.agg(F.max(day).alias("latest")).select(F.lit(name).alias("table_name"), "latest", F.datediff(F.lit(today).cast("date"), "latest").alias("lag_days"), F.lit(allowed[name]).alias("allowed"))
        out = one if out is None else out.unionByName(one)
    return out.select("table_name", F.col("latest").cast("string").alias("latest"), "lag_days", (F.col("lag_days") > F.col("allowed")).alias("late"))


def watch(s: DataFrame, by: Sequence[str], lag_days: int, threshold: float) -> DataFrame:
    """``by, day, value, base, change_pct, alert``: every day against the one ``lag_days`` before; null without that day.

    An alert is raised when the threshold is crossed and the day before, compared the same
    way, was not over it in the same direction: an alert that lasts is raised once.
    """
    base = s.select(*by, F.date_add(F.col("day"), lag_days).alias("day"), F.col("value").alias("base"))
    x = s.join(base, [*by, "day"], "left")
    x = x.withColumn("change_pct", (F.col("value") - F.col("base")) * 100.0 / F.nullif(F.abs("base"), F.lit(0.0)))
    side = F.when(F.abs("change_pct") >= threshold, F.signum("change_pct")).otherwise(0.0)
    before = F.lag(F.coalesce(side, F.lit(0.0))).over(Window.partitionBy(*by).orderBy("day"))
    return x.withColumn("alert", F.coalesce((side != 0) & (side != F.coalesce(before, F.lit(0.0))), F.lit(False)))


def backtest(watched: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, days, comparable, alerts`` of a watch over its history."""
    return watched.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.count("base").alias("comparable"), F.count_if("alert").alias("alerts"))


def attribute(df: DataFrame, dims: Sequence[str], current: Column, previous: Column, value: Column, crossed: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """``dimension, member, prev, curr, delta, contribution, status``: the change of a total by the members of each dimension.

    One scan with grouping sets for all dimensions, crossed pairs and the total; contributions
    are of the absolute previous total, so those of a dimension sum to the total's change.
    """
    zero = F.lit(0).cast("decimal(20,2)")
    rows = df.filter(current | previous).select(*[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in dims], F.when(previous, value).otherwise(zero).alias("__p"), F.when(current, value).otherwise(zero).alias("__c"))
    sets = [[F.col(c) for c in s] for s in [*[(c,) for c in dims], *crossed, ()]]
    g = rows.groupingSets(sets, *dims).agg(F.sum("__p").cast("double").alias("prev"), F.sum("__c").cast("double").alias("curr"), F.grouping_id().alias("__g"))
    bit = {c: 1 << (len(dims) - 1 - i) for i, c in enumerate(dims)}
    every = (1 << len(dims)) - 1
    name, member = F.lit("total"), F.lit("")
    for s in [*[(c,) for c in dims], *crossed]:
        here = F.col("__g") == every - sum(bit[c] for c in s)
        name, member = F.when(here, "x".join(s)).otherwise(name), F.when(here, F.concat_ws("|", *s)).otherwise(member)
    g = g.select(name.alias("dimension"), member.alias("member"), "prev", "curr")
    total = g.filter("dimension = 'total'").select(F.col("prev").alias("__total"))
    out = g.join(F.broadcast(total)).withColumn("delta", F.col("curr") - F.col("prev"))
    status = F.when(F.col("prev") == 0, "new").when(F.col("curr") == 0, "gone").otherwise("both")
    return out.select("dimension", "member", "prev", "curr", "delta", (F.col("delta") / F.nullif(F.abs("__total"), F.lit(0.0))).alias("contribution"), status.alias("status"))


def concentration(attributed: DataFrame, top: int = 3) -> DataFrame:
    """``dimension, members, concentration, identity_gap, rank``: the share that the largest members explain, and whether members sum to the total."""
    total = attributed.filter("dimension = 'total'").select(F.col("delta").alias("__d"), F.col("contribution").alias("__c"))
    w = Window.partitionBy("dimension").orderBy(F.desc(F.abs("contribution")), "member")
    r = attributed.filter("dimension <> 'total'").withColumn("__r", F.row_number().over(w))
    g = r.groupBy("dimension").agg(F.count(F.lit(1)).alias("members"), F.round(F.sum(F.when(F.col("__r") <= top, F.abs("contribution"))), 6).alias("concentration"), F.sum(F.col("delta").cast("decimal(24,2)")).cast("double").alias("__sum"))
    out = g.join(F.broadcast(total)).withColumn("identity_gap", F.round(F.abs(F.col("__sum") - F.col("__d")), 2))
    return out.select("dimension", "members", "concentration", "identity_gap", F.row_number().over(Window.orderBy(F.desc("concentration"), "dimension")).alias("rank"))  # one row for each dimension


def ratio_split(df: DataFrame, current: Column, previous: Column, num: Column, den: Column) -> DataFrame:
    """``ratio_prev, ratio_curr, numerator_effect, denominator_effect``: what each side did to a ratio, half of the joint part to each."""
    sums = df.filter(current | previous).agg(*[F.sum(F.when(p, v)).cast("double").alias(n) for p, v, n in ((previous, num, "n0"), (current, num, "n1"), (previous, den, "d0"), (current, den, "d1"))])
    r = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    n_first, d_first = r("n1", "d0") - r("n0", "d0"), r("n0", "d1") - r("n0", "d0")
    n_last, d_last = r("n1", "d1") - r("n0", "d1"), r("n1", "d1") - r("n1", "d0")
    return sums.select(r("n0", "d0").alias("ratio_prev"), r("n1", "d1").alias("ratio_curr"), ((n_first + n_last) / 2).alias("numerator_effect"), ((d_first + d_last) / 2).alias("denominator_effect"))


def tree_shares(row: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``factor, share, residual`` of one row with columns ``f_prev`` and ``f_curr`` whose products are the metric: logarithmic mean shares."""
    a, b = F.lit(1.0), F.lit(1.0)
    for f in factors:
        a, b = a * F.col(f"{f}_prev"), b * F.col(f"{f}_curr")
    same = F.abs(b - a) < 1e-12
    mean = F.when(same, a).otherwise((b - a) / (F.ln(b) - F.ln(a)))
    parts = [(mean * F.ln(F.col(f"{f}_curr") / F.col(f"{f}_prev"))) for f in factors]
    residual = (b - a) - sum(parts[1:], parts[0])
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.round(p, 4).alias("effect"), F.round(F.abs(residual), 4).alias("residual")) for f, p in zip(factors, parts)])
    return row.select(F.explode(cells).alias("r")).select("r.*")


def attribute_rows(base: DataFrame, current: DataFrame, dim: str, value: str) -> DataFrame:
    """``member, prev, curr, delta, share, status`` of two row sets by one dimension, largest changes first by |share| of the gross change."""
    x = base.select(F.col(dim).cast("string").alias("member"), F.col(value).cast("decimal(20,2)").alias("p"), F.lit(0).cast("decimal(20,2)").alias("c"), F.lit(1).alias("hp"), F.lit(0).alias("hc"))
    y = current.select(F.col(dim).cast("string").alias("member"), F.lit(0).cast("decimal(20,2)").alias("p"), F.col(value).cast("decimal(20,2)").alias("c"), F.lit(0).alias("hp"), F.lit(1).alias("hc"))
    g = x.unionByName(y).groupBy("member").agg(F.sum("p").cast("double").alias("prev"), F.sum("c").cast("double").alias("curr"), F.max("hp").alias("hp"), F.max("hc").alias("hc")).withColumn("delta", F.col("curr") - F.col("prev"))
    gross = g.agg(F.sum(F.abs("delta").cast("decimal(24,2)")).cast("double").alias("__gross"))
    status = F.when(F.col("hp") == 0, "appeared").when(F.col("hc") == 0, "vanished").otherwise("both")
    return g.join(F.broadcast(gross)).select("member", "prev", "curr", "delta", (F.col("delta") / F.nullif(F.col("__gross"), F.lit(0.0))).alias("share"), status.alias("status"))


def attribution_findings(rows: DataFrame) -> DataFrame:
    """``code, subject, value``: MA001 the top member, MA002 a member with half of the gross change, MA003 changes that cancel out."""
    top = rows.orderBy(F.desc(F.abs("delta")), "member").limit(1).select(F.lit("MA001").alias("code"), F.col("member").alias("subject"), F.col("delta").alias("value"))
    half = rows.filter("abs(share) >= 0.5").select(F.lit("MA002").alias("code"), F.col("member").alias("subject"), F.col("share").alias("value"))
    sums = rows.agg(F.abs(F.sum(F.col("delta").cast("decimal(24,2)"))).cast("double").alias("net"), F.sum(F.abs("delta").cast("decimal(24,2)")).cast("double").alias("gross"))
    off = sums.filter("net < gross / 1.5").select(F.lit("MA003").alias("code"), F.lit("all").alias("subject"), F.col("net").alias("value"))
    return top.unionByName(half).unionByName(off)


def priced_usage(log: DataFrame, prices: DataFrame, day: Column, by: Sequence[str]) -> DataFrame:
    """``by, day, cost``: a usage log (``item, quantity``) priced by item; items without a price cost null."""
    p = log.withColumn("day", day).join(prices, "item", "left")
    return p.groupBy(*by, "day").agg(F.sum((F.col("quantity") * F.col("price")).cast("decimal(20,4)")).cast("double").alias("cost"))


def cost_anomalies(daily: DataFrame, by: Sequence[str], factor: float = 2.0, least: int = 3) -> DataFrame:
    """Days that cost over ``factor`` times the mean of the days with cost in the seven before, if there are ``least`` of them."""
    d = F.unix_date("day")
    w = Window.partitionBy(*by).orderBy(d).rangeBetween(-7, -1)
    spent = F.when(F.col("cost") > 0, F.col("cost"))
    x = daily.withColumn("trailing", F.sum(spent.cast("decimal(20,4)")).over(w).cast("double") / F.nullif(F.count(spent).over(w).cast("double"), F.lit(0.0))).withColumn("spend_days", F.count(spent).over(w))
    return x.withColumn("anomaly", (F.col("spend_days") >= least) & (F.col("cost") > factor * F.col("trailing")))
