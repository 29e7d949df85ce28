"""Series of metrics: volatility findings, capacity, and forecasts with weekday and holiday offsets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import rolling_mad


def volatility(s: DataFrame, by: Sequence[str], day: str = "day", value: str = "value") -> DataFrame:
    """``by, day, code, severity, value, base``: VA001 spikes and VA002 drops against the prior week; of a run only the first.

    A spike is 0.5 (high 1.0), a drop 0.3 (high 0.6) from the median of at least three prior
    values, and over five median absolute deviations away unless that is zero.
    """
    m = rolling_mad(s, by, day, value)
    rel = (F.col(value) - F.col("median")) / F.nullif(F.abs("median"), F.lit(0.0))
    far = (F.col("mad") == 0) | (F.abs(F.col(value) - F.col("median")) > 5 * F.col("mad"))
    code = F.when(far & (rel >= 0.5), "VA001").when(far & (rel <= -0.3), "VA002")
    severity = F.when((rel >= 1.0) | (rel <= -0.6), "high").otherwise("mid")
    w = Window.partitionBy(*by).orderBy(day)
    x = m.withColumn("code", code).withColumn("severity", severity).withColumn("__before", F.lag("code").over(w))
    return x.filter("code is not null and (__before is null or __before <> code)").select(*by, day, "code", "severity", value, F.col("median").alias("base"))


def level_shift(s: DataFrame, by: Sequence[str], day: str = "day", value: str = "value", recent: int = 3) -> DataFrame:
    """``by, recent_median, prior_median, rel, code``: VA003 the last three against all before (0.3)."""
    r = s.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(day))))
    g = r.groupBy(*by).agg(F.median(F.when(F.col("__r") <= recent, F.col(value))).alias("recent_median"), F.median(F.when(F.col("__r") > recent, F.col(value))).alias("prior_median"), F.count(F.lit(1)).alias("n"))
    rel = (F.col("recent_median") - F.col("prior_median")) / F.nullif(F.abs("prior_median"), F.lit(0.0))
    return g.withColumn("rel", rel).withColumn("code", F.when((F.col("n") >= recent + 3) & (F.abs("rel") >= 0.3), "VA003")).drop("n")


def flat_tail(s: DataFrame, by: Sequence[str], day: str = "day", value: str = "value", tail: int = 3) -> DataFrame:
    """``by, flat``: VA004, the last three values are equal and earlier ones were not."""
    r = s.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(day))))
    last, rest = (F.when(c, F.col(value)) for c in (F.col("__r") <= tail, F.col("__r") > tail))
    return r.groupBy(*by).agg(((F.count(last) == tail) & (F.min(last) == F.max(last)) & (F.count(rest) > 0) & (F.min(rest) != F.max(rest))).alias("flat"))


def against(s: DataFrame, by: Sequence[str], steps: int, day: str = "day", value: str = "value") -> DataFrame:
    """``by, day, value, base, rel`` against the value so many rows before (VA006 with 1, VA007 with 7)."""
    base = F.lag(value, steps).over(Window.partitionBy(*by).orderBy(day))
    return s.withColumn("base", base).filter("base is not null").withColumn("rel", (F.col(value) - F.col("base")) / F.nullif(F.abs("base"), F.lit(0.0)))


def capacity(s: DataFrame, by: Sequence[str], quotas: DataFrame, points: int = 14, day: str = "day", value: str = "value") -> DataFrame:
    """``by, latest, per_day, quota, days_left, code``: the slope of the last points to the quota; CF001 within 90 days (high 30), CF003 shrinking."""
    r = s.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(day)))).filter(F.col("__r") <= points)
    x = F.unix_date(day).cast("double")
    g = r.groupBy(*by).agg(F.max_by(value, day).alias("latest"), F.round(F.regr_slope(value, x), 4).alias("per_day")).join(quotas, list(by), "left")
    left = F.when(F.col("per_day") > 0, F.greatest(F.lit(0.0), F.ceil((F.col("quota") - F.col("latest")) / F.col("per_day")).cast("double")))
    code = F.when(left <= 30, "CF001 high").when(left <= 90, "CF001 mid").when(F.col("per_day") < 0, "CF003")
    return g.withColumn("days_left", left).withColumn("code", code)


def fit_ols(days: np.ndarray, values: np.ndarray, weekly: bool, special: np.ndarray | None = None, rounds: int = 20) -> tuple[float, float, np.ndarray, dict[int, float], float]:
    """Slope, intercept, weekday offsets, offsets of special day kinds, and the residuals' sample deviation, by backfitting."""
    x = days - days[0]
    weekday, extra = np.zeros(7), {}
    slope = intercept = 0.0
    kinds = special if special is not None else np.zeros(len(days), int)
    for _ in range(rounds):
        own = np.array([extra.get(k, 0.0) for k in kinds])
        rest = values - (weekday[(days + 3) % 7] if weekly else 0.0) - own  # day 0 of the epoch is a Thursday
        before = slope
        slope, intercept = (np.polyfit(x, rest, 1) if len(x) > 1 else (0.0, rest.mean()))
        left = values - slope * x - intercept
        if weekly:
            plain = kinds == 0
            for w in range(7):
                of = plain & ((days + 3) % 7 == w)
                weekday[w] = (left)[of].mean() if of.any() else 0.0
            weekday -= weekday.mean()
        for k in set(kinds) - {0}:
            of = kinds == k
            if of.sum() >= 2:
                extra[k] = (left - (weekday[(days + 3) % 7] if weekly else 0.0))[of].mean()
        if abs(slope - before) < 1e-9:
            break
    fitted = slope * x + intercept + (weekday[(days + 3) % 7] if weekly else 0.0) + np.array([extra.get(k, 0.0) for k in kinds])
    sigma = float(np.std(values - fitted, ddof=1)) if len(values) > 2 else 0.0
    return float(slope), float(intercept), weekday, extra, sigma


def forecast(s: DataFrame, by: str, horizon: int = 7, calendar: pd.DataFrame | None = None, day: str = "day", value: str = "value") -> DataFrame:
    """``by, day, forecast, low, high`` for the next days of each series with at least seven points.

    Trend by least squares; weekday offsets from 14 points on; ``calendar`` (day, kind: 1 a
    holiday, 2 a workday made up) adds offsets of kinds seen twice. A series is one group in
    one task, many series run side by side; a series is a few thousand days at most.
    """
    kinds = {} if calendar is None else {(pd.Timestamp(d) - pd.Timestamp(0)).days: int(k) for d, k in zip(calendar["day"], calendar["kind"])}

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("d")
        days, values = pdf["d"].to_numpy(np.int64), pdf["v"].to_numpy(float)
        if len(days) < 7:
            return pd.DataFrame({by: [], "day": [], "forecast": [], "low": [], "high": []})
        special = np.array([kinds.get(int(d), 0) for d in days])
        weekly = len(days) >= 14
        slope, intercept, weekday, extra, sigma = fit_ols(days, values, weekly, special)
        ahead = days[-1] + np.arange(1, horizon + 1)
        y = slope * (ahead - days[0]) + intercept + (weekday[(ahead + 3) % 7] if weekly else 0.0) + np.array([extra.get(kinds.get(int(d), 0), 0.0) for d in ahead])
        return pd.DataFrame({by: key[0], "day": (pd.Timestamp(0) + pd.to_timedelta(ahead, unit="D")).strftime("%Y-%m-%d"), "forecast": y, "low": y - 1.96 * sigma, "high": y + 1.96 * sigma})

    narrow = s.select(by, F.unix_date(day).alias("d"), F.col(value).cast("double").alias("v"))
    kind = narrow.schema[by].dataType.simpleString()
    return narrow.groupBy(by).applyInPandas(one, f"`{by}` {kind}, day string, forecast double, low double, high double")


def model_backtest(s: DataFrame, by: str, days: int = 365, day: str = "day", value: str = "value", history: int = 56) -> DataFrame:
    """``by, days, outside``: how many of the last days lie outside of the 95 % band of a model fitted on the ``history`` points before each."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("d")
        d, v = pdf["d"].to_numpy(np.int64), pdf["v"].to_numpy(float)
        seen = outside = 0
        for i in range(max(14, len(d) - days), len(d)):
            lo = max(0, i - history)
            slope, intercept, weekday, _, sigma = fit_ols(d[lo:i], v[lo:i], True)
            y = slope * (d[i] - d[lo]) + intercept + weekday[(d[i] + 3) % 7]
            seen += 1
            outside += abs(v[i] - y) > 1.96 * sigma
        return pd.DataFrame({by: [key[0]], "days": [seen], "outside": [int(outside)]})

    narrow = s.select(by, F.unix_date(day).alias("d"), F.col(value).cast("double").alias("v"))
    return narrow.groupBy(by).applyInPandas(one, f"`{by}` {narrow.schema[by].dataType.simpleString()}, days long, outside long")
