"""Readers of row files, logs, event logs and databases; writers of exports, ledgers and partitioned rewrites."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.durable import shared_folder
from plumbline.functions.values import normalize_nulls


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_rows_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: every cell a text, null tokens null, short rows padded."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", False).csv(path)
    return df.select(*[normalize_nulls(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_rows_jsonl(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """JSON lines, or files that are one array each: the union of all keys, every cell a text, null tokens null."""
    df = spark.read.option("primitivesAsString", True).option("multiLine", array).json(path)
    return df.select(*[normalize_nulls(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric column where one is given. The driver's jar comes with the cluster."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column and bounds:
        r = r.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


#: The part of Spark's event log that skew needs; a given schema keeps the many kinds of events apart.
EVENT = (
    "`Event` string, `Stage ID` long, `Task End Reason` struct<`Reason`: string>, `Task Info` struct<`Index`: long, `Launch Time`: long, `Finish Time`: long, `Failed`: boolean, `Killed`: boolean>, "
    "`Task Metrics` struct<`Shuffle Read Metrics`: struct<`Remote Bytes Read`: long, `Local Bytes Read`: long>>"
)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """``stage, index, duration_ms, shuffle_bytes`` of the tasks that ended well; plain, gzip and rolling logs."""
    e = spark.read.schema(EVENT).json(path).filter("Event = 'SparkListenerTaskEnd'")
    i, m = F.col("`Task Info`"), F.col("`Task Metrics`")["Shuffle Read Metrics"]
    ok = ~F.coalesce(i["Failed"], F.lit(False)) & ~F.coalesce(i["Killed"], F.lit(False))
    return e.filter(ok).select(F.col("`Stage ID`").alias("stage"), i["Index"].alias("index"), (i["Finish Time"] - i["Launch Time"]).alias("duration_ms"), (F.coalesce(m["Remote Bytes Read"], F.lit(0)) + F.coalesce(m["Local Bytes Read"], F.lit(0))).alias("shuffle_bytes"))


#: The part of Spark's event log that lineage needs.
SQL_START = "`Event` string, `executionId` long, `time` long, `physicalPlanDescription` string"


def read_plan_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, runs, last_ms``: which folders the logged SQL executions read to write which, how often and when last.

    Folders are taken from the plan texts of the event log, as Spark prints them: the
    locations of file scans and the first argument of the file insert. Executions that write
    no folder, or read none, give no edge. ``spark.sql.maxMetadataStringLength`` of the logged
    application cuts long lists of locations; what is cut is not seen.
    """
    plan = F.col("physicalPlanDescription")
    started = spark.read.schema(SQL_START).json(path).filter(F.col("Event").endswith("SparkListenerSQLExecutionStart"))
    written = F.regexp_extract(plan, r"Execute InsertIntoHadoopFsRelationCommand\s*\nInput[^\n]*\nArguments: ([^,\n]+),", 1)
    locations = F.regexp_extract_all(plan, F.lit(r"\nLocation: \w+(?:\(\d+ paths\))?\s*\[([^\]\n]*)\]"), 1)
    runs = started.select("executionId", "time", written.alias("dst"), F.explode(F.array_distinct(F.split(F.array_join(locations, ", "), ", "))).alias("src"))
    return runs.filter("dst <> '' and src <> '' and src not like '%...'").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("runs"), F.max("time").alias("last_ms"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_ledger(df: DataFrame, path: str, run: str) -> None:
    """One run's results added to a ledger; ``latest`` reads the last value of each key."""
    df.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def latest(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    led = spark.read.parquet(path)
    rest = [c for c in led.columns if c not in by]
    return led.groupBy(*by).agg(F.max(F.struct("run", *[c for c in rest if c != "run"])).alias("r")).select(*by, "r.*")


def backfill(df: DataFrame, path: str, partition: str, dates: Sequence[str]) -> None:
    """The partitions of the given dates (at most 366) rewritten from ``df``; the others stay; a repeated run gives the same."""
    if len(dates) > 366:
        raise ValueError("at most 366 dates at a time")
    df.filter(F.col(partition).isin(*dates)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def compact(spark: SparkSession, path: str, out: str, files: int) -> None:
    """A folder of many small files written as a few."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(out)
