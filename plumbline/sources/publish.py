"""Backfills that are written, audited and then published: readers see the rows of the newest manifest, whole, or those of the one before.

Every run writes a folder of its own below ``data``; a manifest says which run holds which slot (a day,
an hour). Publishing adds one manifest by renaming a finished folder. A run that breaks, or
that an audit stops, leaves files that no manifest names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.durable import settle

#: Slots of one backfill, at most, by grain; and how their names are formed.
GRAINS = {"day": (366, timedelta(days=1), "%Y-%m-%d"), "hour": (366 * 24, timedelta(hours=1), "%Y-%m-%d %H")}


class AuditError(ValueError):
    """What was written is not fit to be published."""


def slots(first: datetime, last: datetime, grain: str = "day") -> list[str]:
    """The names of the slots from first to last, both included."""
    most, step, form = GRAINS[grain]
    out, now = [], first
    while now <= last:
        out.append(now.strftime(form))
        now += step
    if not 0 < len(out) <= most:
        raise ValueError(f"between 1 and {most} slots at a time")
    return out


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published manifests."""
    fs, place = _files(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``slot, run`` of a version, the newest by default; nothing of an empty table."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], "slot string, run string")
    return spark.read.schema("slot string, run string").parquet(f"{path}/manifests/v{known[-1] if version is None else version}")


def read_published(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version; runs and slots that it does not name are not read (partitions are pruned by the manifest)."""
    named = manifest(spark, path, version)
    if not versions(spark, path):
        return spark.createDataFrame([], f"{schema}, slot string")
    rows = spark.read.schema(f"{schema}, run string, slot string").option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(F.broadcast(named), ["run", "slot"]).drop("run")  # a row for each slot of the table


def publish(df: DataFrame, path: str, names: Sequence[str], mode: str = "replace", key: Sequence[str] = (), audit: Callable[[DataFrame], str | None] | None = None) -> int:
    """Rewrites the slots ``names`` of a table from ``df`` (with a text column ``slot``) and gives the new version.

    mode 'replace': a slot's rows are those of ``df``, none if it has none; 'merge': rows of
    ``df`` stand for those of the same ``key`` (null is a value) in their slot, the others stay.
    Rows of other slots are ignored. ``audit`` gets what was written and says what is wrong with it,
    or None; merged keys must be unique. A repeated run gives the same rows.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    new = df.filter(F.col("slot").isin(list(names)))
    if mode == "merge":
        old = read_published(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "slot")).filter(F.col("slot").isin(list(names)))
        same = F.lit(True)
        right = new.select(*[F.col(c).alias(f"__{c}") for c in (*key, "slot")])
        for c in (*key, "slot"):
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        new = new.unionByName(old.join(right, same, "left_anti"))
    elif mode != "replace":
        raise ValueError(f"no mode {mode}")
    new.write.partitionBy("slot").parquet(f"{path}/data/run={run}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    written = spark.read.schema(fields).parquet(f"{path}/data/run={run}")
    wrong = audit(written) if audit is not None else None
    if key and wrong is None and not written.groupBy("slot", *key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").isEmpty():
        wrong = f"{', '.join(key)} is not unique"
    if wrong is not None:
        raise AuditError(wrong)
    filled = written.select("slot").distinct().withColumn("run", F.lit(run))
    now = settle(manifest(spark, path).filter(~F.col("slot").isin(list(names))).unionByName(filled))
    version = max(versions(spark, path), default=0) + 1
    now.coalesce(1).write.parquet(staged := f"{path}/manifests/_{run}")
    fs, place = _files(spark, staged)
    target = _files(spark, f"{path}/manifests/v{version}")[1]
    if fs.exists(target) or not fs.rename(place, target):
        raise RuntimeError(f"version {version} was published by another run")
    return version
