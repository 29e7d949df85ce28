"""Tables by name: Parquet folders, catalog tables, guarded and secured reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, where: str | Column | None = None) -> DataFrame:
    """The Parquet table ``name`` of a folder; ``where`` is an expression only, so it can neither write nor hold statements."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df if where is None else df.filter(F.expr(where) if isinstance(where, str) else where)


def secured(df: DataFrame, name: str, policies: Mapping[str, str | None]) -> DataFrame:
    """The rows that the policy of the table allows; a table without a policy entry is refused (None: all rows)."""
    if name.lower() not in {k.lower() for k in policies}:
        raise PermissionError(f"no row policy for {name}")
    rule = {k.lower(): v for k, v in policies.items()}[name.lower()]
    return df if rule is None else df.filter(F.expr(rule))


def kind_of_table(name: str) -> str:
    """'incremental' or 'full' by the suffix of the name, else 'unknown'."""
    suffix = name.lower().rpartition("_")[2]
    return {"di": "incremental", "hi": "incremental", "ri": "incremental", "df": "full", "hf": "full"}.get(suffix, "unknown")


def by_partition(df: DataFrame, name: str, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The partitions to read by the table's kind: a range of an incremental one, the last day of a full one, else the newest.

    The newest partition is found from the partition column alone and compared as a literal,
    so that the scan itself is pruned.
    """
    kind = kind_of_table(name)
    if kind == "incremental" and start is not None and end is not None:
        return df.filter(F.col(column).between(start, end))
    if kind == "full" and end is not None:
        return df.filter(F.col(column) == end)
    newest = df.agg(F.max(column)).first()[0]
    return df.filter(F.col(column) == F.lit(newest))


def newer_than(df: DataFrame, watermark: str, value, limit: int | None = None) -> DataFrame:
    """Rows past a watermark value; with ``limit`` the oldest of them in order."""
    out = df.filter(F.col(watermark) > F.lit(value))
    return out if limit is None else out.orderBy(watermark).limit(limit)


def catalog(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``table_name, column_name, data_type, ordinal`` of tables, from their schemas alone."""
    rows = [(n, f.name, f.dataType.simpleString(), i) for n in names for i, f in enumerate(table(spark, folder, n).schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int")
