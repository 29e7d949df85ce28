"""Aggregates and windows of analysis: trends, shares, running values, streaks, gaps, spikes, flapping."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(df: DataFrame, metric: str, n: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(metric), *ties).limit(n)


def ranked_groups(df: DataFrame, group: Sequence[str], metric: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(metric), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def topk_frequencies(df: DataFrame, column: str, k: int) -> DataFrame:
    """``value, n, share`` of the k most frequent values."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k).join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def moving_average(df: DataFrame, by: Sequence[str], order: str, value: str, n: int) -> Column:
    return F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0))


def running_sum(by: Sequence[str], order: str, value: Column) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def proportion(df: DataFrame, value: str) -> DataFrame:
    """A column ``pct`` of the whole; the whole is one row sent to the tasks."""
    total = df.agg(F.sum(value).alias("__total"))
    return df.join(F.broadcast(total)).withColumn("pct", F.col(value) * 100.0 / F.nullif(F.col("__total"), F.lit(0))).drop("__total")


def period_pair(df: DataFrame, dims: Sequence[str], day: Column, current: tuple[str, str], previous: tuple[str, str], value: Column) -> DataFrame:
    """``dims, curr, prev, pct`` of two date ranges in one scan; pct is null where prev is zero."""
    inside = lambda r: day.between(F.lit(r[0]).cast("date"), F.lit(r[1]).cast("date"))
    sums = df.filter(inside(current) | inside(previous)).groupBy(*dims).agg(
        F.coalesce(F.sum(F.when(inside(current), value)), F.lit(0)).cast("double").alias("curr"), F.coalesce(F.sum(F.when(inside(previous), value)), F.lit(0)).cast("double").alias("prev")
    )
    return sums.withColumn("pct", (F.col("curr") - F.col("prev")) / F.nullif(F.col("prev"), F.lit(0.0)) * 100)


def shift_range(start: dt.date, end: dt.date, how: str) -> tuple[dt.date, dt.date]:
    """The range that a period is compared with: mom the same span before, wow a week, yoy a year (29 February: 365 days)."""
    if how == "mom":
        span = (end - start).days + 1
        return start - dt.timedelta(span), end - dt.timedelta(span)
    if how == "wow":
        return start - dt.timedelta(7), end - dt.timedelta(7)

    def year(d: dt.date) -> dt.date:
        return d - dt.timedelta(365) if (d.month, d.day) == (2, 29) else d.replace(year=d.year - 1)

    if how == "yoy":
        return year(start), year(end)
    raise ValueError(how)


def named_range(text: str, today: dt.date) -> tuple[dt.date, dt.date]:
    """The dates of a named period, or of 'last N days' (ending yesterday), or of 'YYYY-MM-DD..YYYY-MM-DD'."""
    t, day = text.strip().lower().replace("_", " "), dt.timedelta(1)
    if ".." in t:
        a, b = (dt.date.fromisoformat(x.strip()) for x in t.split(".."))
        return a, b
    words = t.split()
    if words[:1] == ["last"] and words[-1:] == ["days"]:
        return today - dt.timedelta(int(words[1])), today - day
    monday, first = today - dt.timedelta(today.weekday()), today.replace(day=1)
    quarter = dt.date(today.year, 3 * ((today.month - 1) // 3) + 1, 1)
    before_first, before_quarter = first - day, quarter - day
    ranges = {
        "today": (today, today),
        "yesterday": (today - day, today - day),
        "this week": (monday, today),
        "last week": (monday - 7 * day, monday - day),
        "this month": (first, today),
        "last month": (before_first.replace(day=1), before_first),
        "this quarter": (quarter, today),
        "last quarter": (dt.date(before_quarter.year, 3 * ((before_quarter.month - 1) // 3) + 1, 1), before_quarter),
        "this year": (today.replace(month=1, day=1), today),
        "last year": (dt.date(today.year - 1, 1, 1), dt.date(today.year - 1, 12, 31)),
    }
    if t not in ranges:
        raise ValueError(f"no such period: {text}")
    return ranges[t]


def streaks(df: DataFrame, by: Sequence[str], order: str, flag: Column) -> DataFrame:
    """``by, longest, live``: the longest run of flagged rows, and the one that is still running at the end."""
    w = Window.partitionBy(*by).orderBy(order)
    runs = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__g", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = runs.groupBy(*by, "__g").agg(F.count_if("__f").alias("n"), F.max(order).alias("__end"), F.max("__f").alias("any"))
    return sized.groupBy(*by).agg(F.max("n").alias("longest"), F.max_by("n", "__g").alias("live"))


def date_gaps(df: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """``by, first_missing, missing_days`` between dates that are more than a day apart."""
    w = Window.partitionBy(*by).orderBy(day)
    nxt = df.select(*by, day).distinct().withColumn("__next", F.lead(day).over(w))
    gap = F.datediff("__next", day)
    return nxt.filter(gap > 1).select(*by, F.date_add(F.col(day), 1).alias("first_missing"), (gap - 1).alias("missing_days"))


def _median(values: Column) -> Column:
    """Of an array that is short (window arrays only)."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n == 0, None).otherwise((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def rolling_mad(df: DataFrame, by: Sequence[str], order: str, value: str, width: int = 7, least: int = 3) -> DataFrame:
    """The prior ``width`` values' median and median absolute deviation; null with fewer than ``least`` values before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-width, -1)
    prior = df.withColumn("__prior", F.collect_list(value).over(w))
    out = prior.withColumn("median", F.when(F.size("__prior") >= least, _median(F.col("__prior"))))
    deviations = F.transform("__prior", lambda x: F.abs(x - F.col("median")))
    return out.withColumn("mad", F.when(F.col("median").isNotNull(), _median(deviations))).drop("__prior")


def flapping(df: DataFrame, by: Sequence[str], second: str, k: int = 5, within: int = 3600) -> DataFrame:
    """``by, firings, flapping``: whether k firings of one signature lie within so many seconds."""
    w = Window.partitionBy(*by).orderBy(second)
    marked = df.withColumn("__hit", F.coalesce(F.lead(second, k - 1).over(w) - F.col(second) <= within, F.lit(False)))
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("firings"), F.max("__hit").alias("flapping"))


def rising(df: DataFrame, by: Sequence[str], order: str, value: str, n: int) -> DataFrame:
    """``by, rising``: whether the last n values rise strictly (false with fewer)."""
    w = Window.partitionBy(*by).orderBy(order)
    last = df.withColumn("__d", F.col(value) - F.lag(value).over(w)).withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter(F.col("__r") <= n)
    ok = (F.count(F.lit(1)) >= n) & F.coalesce(F.min(F.when(F.col("__r") < n, (F.col("__d") > 0).cast("int"))) == 1, F.lit(False))
    return last.groupBy(*by).agg(ok.alias("rising"))


def out_of_order(df: DataFrame, event: str, arrival: Sequence[str], bucket: Column) -> DataFrame:
    """``df`` with ``late``: the event is older than an event that arrived before it.

    Two levels instead of one global window: the largest event of each arrival bucket, a prefix
    maximum over the buckets (small), then a window inside each bucket.
    """
    b = df.withColumn("__b", bucket)
    tops = b.groupBy("__b").agg(F.max(event).alias("__m"))
    before = tops.select(F.col("__b").alias("__k"), F.max("__m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = F.max(event).over(Window.partitionBy("__b").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    seen = b.withColumn("__in", inside).join(before, F.col("__b") == F.col("__k"))
    return seen.withColumn("late", F.coalesce(F.col(event) < F.greatest("__in", "__before"), F.lit(False))).drop("__b", "__k", "__in", "__before")


def lagged_correlation(df: DataFrame, day: str, x: str, y: str, lags: int = 7, least: int = 7) -> DataFrame:
    """``lag, n, r``: Pearson of x(day) and y(day + lag) for lags around zero; null without spread or enough pairs."""
    left = df.select(F.col(day).alias("__d"), F.col(x).alias("__x"), F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"))
    right = df.select(F.col(day).alias("__e"), F.col(y).alias("__y"))
    pairs = left.join(right, F.date_add(F.col("__d"), F.col("lag")) == F.col("__e")).filter("__x is not null and __y is not null")
    n, mx, my = F.count(F.lit(1)), F.stddev_pop("__x"), F.stddev_pop("__y")
    return pairs.groupBy("lag").agg(n.alias("n"), F.when((n >= least) & (mx > 0) & (my > 0), F.round(F.corr("__x", "__y"), 6)).alias("r"))
