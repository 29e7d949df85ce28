"""Samples: head, random, stratified, stride, percent. What must be repeatable takes an order or a hash of the row's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def head(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def random_rows(df: DataFrame, n: int, key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """n random rows; with ``key`` the same ones on every run (the smallest hashes), found by a partial top-n in each task."""
    order = F.xxhash64(*key, F.lit(seed)) if key else F.rand(seed)
    return df.orderBy(order, *(key or [])).limit(n)


def stratified(df: DataFrame, group: str, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows of each group by a given order; a window limit that Spark applies before the shuffle too."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def stride(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """n rows at even distances of a total order: positions floor(i * rows / n).

    Rows are numbered without a global sort: ranges of the order are counted first and each
    range is numbered by itself from the rows before it.
    """
    total = df.count()
    if total <= n:
        return df
    numbered = row_numbers(df, order)
    i = F.ceil(F.col("__rn") * n / total).cast("long")  # the only i with floor(i * total / n) = rn, if there is one
    hit = (F.floor(i * F.lit(total) / n) == F.col("__rn")) & (i < n)
    return numbered.filter(hit).drop("__rn")


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "__rn") -> DataFrame:
    """``df`` with the row's position in a total order, from 0: sorted by ranges, each numbered from the count of rows before it."""
    parts = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select(F.col("__p").alias("__q"), (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"))  # one row for each partition
    own = parts.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1)
    return own.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__before") + F.col("__i")).drop("__p", "__q", "__before", "__i")


def percent(df: DataFrame, p: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=False, fraction=p / 100.0, seed=seed)


def percent_by_key(df: DataFrame, p: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """p percent of the rows by a hash of the key: the same rows on every run and on either side of a join."""
    return df.filter(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < int(p * 10_000))
