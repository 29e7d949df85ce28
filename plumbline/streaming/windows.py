"""Streams with a measured bound: windows, sessions, deduplication, late rows apart, and alerts that are raised once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(stream: DataFrame, event: str, bound: str, width: str, by: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """``start, by, n`` of tumbling (or sliding) windows behind a watermark of ``bound``."""
    w = F.window(event, width, slide) if slide else F.window(event, width)
    return stream.withWatermark(event, bound).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, event: str, bound: str, gap: str, by: str) -> DataFrame:
    """``by, start, finish, n`` of sessions that end after a gap."""
    g = stream.withWatermark(event, bound).groupBy(F.session_window(event, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def deduplicated(stream: DataFrame, event: str, bound: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(event, bound).dropDuplicatesWithinWatermark(keys)


def tagged_late(df: DataFrame, event: str, arrival: str, bound_s: int) -> DataFrame:
    """``df`` with ``late``: beyond the bound at its arrival. Spark drops late rows silently, so they are told apart before the stateful step."""
    return df.withColumn("late", F.unix_timestamp(arrival) - F.unix_timestamp(event) > bound_s)


def split_late(stream: DataFrame, event: str, arrival: str, bound_s: int, on_time: str, late: str, between: Callable[[int], None] | None = None):
    """A writer of each micro-batch's rows on time to one Parquet folder and of the late ones to another, each exactly once.

    A batch has a folder of its own in either; when it runs again after a failure, at whatever point (``between`` is called
    between the two), it writes the same rows over what it left. ``read_batches`` reads them.
    """

    def batch(df: DataFrame, number: int) -> None:
        x = tagged_late(df, event, arrival, bound_s).persist()
        try:
            x.filter("late is not true").drop("late").write.mode("overwrite").parquet(f"{on_time}/batch={number}")
            if between is not None:
                between(number)
            x.filter("late").drop("late").write.mode("overwrite").parquet(f"{late}/batch={number}")
        finally:
            x.unpersist()

    return stream.writeStream.foreachBatch(batch)


def read_batches(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """What the batches of ``split_late`` have written to one folder."""
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def remembered_alerts(stream: DataFrame, by: str, value: str, threshold: float, order: str) -> DataFrame:
    """``by, value, kind``: 'raised' when a value crosses the threshold, 'recovered' when it returns; nothing in between.

    The state of a key is one flag; rows of a key within a micro-batch are taken by ``order``.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on = state.get[0] if state.exists else False
        out = []
        rows = pd.concat(list(frames), ignore_index=True).sort_values("o", kind="stable")
        for v in rows["v"]:
            if (v > threshold) != on:
                on = v > threshold
                out.append((key[0], float(v), "raised" if on else "recovered"))
        state.update((on,))
        yield pd.DataFrame(out, columns=[by, "value", "kind"])

    kind = stream.schema[by].dataType.simpleString()
    narrow = stream.select(by, F.col(value).cast("double").alias("v"), F.col(order).alias("o"))
    return narrow.groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, value double, kind string", "on boolean", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, through the stream, into a Parquet folder."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
