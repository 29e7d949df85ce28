"""Lines of text files, numbered within their file although the file is read in many blocks, and records that cross blocks.

Spark says of each line in which block of which file it stands. Lines are counted block by
block, and a block's first number is the sum of the blocks before it, so that a file of any size
is read by as many tasks as it has blocks. Tables of blocks have one row for each; no
line is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.durable import settle

#: Blocks that are sent to all tasks; more are joined by a shuffle.
BLOCKS = 1_000_000


def block_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, i, line``: lines by '\\n' or '\\r\\n', numbered from 0 within their block (the byte at which it begins)."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, i = None, 0  # a task reads a block from its first line to its last
        for b in batches:
            at = []
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != last:
                    last, i = key, 0
                at.append(i)
                i += 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int64()), b.column(2)], names=["file", "block", "i", "line"])

    return raw.mapInArrow(number, "file string, block long, i long, line string")


def few(blocks: DataFrame) -> DataFrame:
    return F.broadcast(blocks) if blocks.count() <= BLOCKS else blocks


def earlier():
    """The blocks of a file before one."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, line``: lines are numbered from 0 within each file. A file without lines gives none."""
    lines = block_lines(spark, path)
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"))
    starts = settle(counts.select("file", "block", F.coalesce(F.sum("lines").over(earlier()), F.lit(0)).alias("first")))
    return lines.join(few(starts), ["file", "block"]).select("file", (F.col("first") + F.col("i")).alias("n"), "line")
