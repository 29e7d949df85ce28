"""Values: null tokens, tolerant equality, exact sums, kinds of text, percentiles by nearest rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .durable import settle

# Texts that stand for null, after trimming and lower case.
NULL_TOKENS = ("", "null", "none", "nan", "n/a", "na", "\\n")
# Kinds of text, the first that matches wins ('0' and '1' are integers).
KINDS = (
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("datetime", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("date_slash", r"^\d{1,4}/\d{1,2}/\d{1,4}$"),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("phone", r"^\+?\d[\d\- ]{6,18}\d$"),
    ("integer", r"^-?\d+$"),
    ("decimal", r"^-?\d+\.\d+$"),
    ("bool", r"(?i)^(true|false|yes|no|0|1)$"),
)
TOLERANCE = 1e-6


def col_of(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_nulls(x: Column | str) -> Column:
    """The trimmed text, null if it is a null token."""
    c = F.trim(col_of(x).cast("string"))
    return F.when(F.lower(c).isin(*NULL_TOKENS), None).otherwise(c)


def kind_of(x: Column | str) -> Column:
    """The kind of a text; 'text' if no other."""
    c, out = col_of(x), F.lit("text")
    for name, pattern in reversed(KINDS):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return F.when(c.isNull(), None).otherwise(out)


def close_enough(a: Column, b: Column, dtype: T.DataType, tolerance: float = TOLERANCE) -> Column:
    """Tolerant equality, never null: null equals null only; numbers within a relative tolerance; else trimmed texts or equal times."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return a.eqNullSafe(b)
    if isinstance(dtype, T.NumericType):
        x, y = a.cast("double"), b.cast("double")
        same = F.when(F.isnan(x) | F.isnan(y), F.isnan(x) & F.isnan(y)).otherwise((x == y) | (F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9)) < tolerance))
    else:
        s, t = F.trim(a.cast("string")), F.trim(b.cast("string"))
        x, y = s.try_cast("double"), t.try_cast("double")
        near = (x == y) | (F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9)) < tolerance)
        when = F.coalesce(F.try_to_timestamp(s) == F.try_to_timestamp(t), F.lit(False))
        same = F.when(x.isNotNull() & y.isNotNull(), near).otherwise((s == t) | when)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def exact(x: Column | str, scale: int = 2) -> Column:
    """A number as a decimal: sums of it do not depend on the order of rows."""
    return col_of(x).cast(f"decimal(20,{scale})")


def exact_sum(x: Column | str, scale: int = 2) -> Column:
    return F.sum(exact(x, scale)).cast("double")


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, null where whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float], rule: str = "round", weight: str | None = None) -> DataFrame:
    """``by`` and one column for each quantile: the value of rank round-half-even(q*(n-1)), or floor(q*n) with rule 'floor'; a row stands for ``weight`` rows, if that is named.

    Values are counted first, so that a hot value is one row. The counts are dealt to ranges of
    (group, value); each range is summed up by itself and moved by what stands before it, so that
    no task sorts a group's values alone.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__c"))
    ranged = settle(counts.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "__part").agg(F.sum("__c").alias("__own"))
    group = Window.partitionBy(*(list(by) or [F.lit(0)]))  # of parts: a row for each range of a group
    earlier = F.sum("__own").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__own")
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    before = parts.select(*keys, F.col("__part").alias("__p"), earlier.alias("__before"), F.sum("__own").over(group).alias("__n"))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    local = Window.partitionBy(*by, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("__upto", F.sum("__c").over(local)).join(before, same).withColumn("__upto", F.col("__upto") + F.col("__before"))

    def index(q: float) -> Column:
        return F.bround(F.lit(q) * (F.col("__n") - 1)) if rule == "round" else F.least(F.floor(F.lit(q) * F.col("__n")), F.col("__n") - 1)

    picked = [F.min(F.when(F.col("__upto") > index(q), F.col("__v"))).alias(name) for name, q in quantiles.items()]
    return ranked.groupBy(*by).agg(*picked)
