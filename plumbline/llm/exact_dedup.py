"""Exact dedup: counting quotient filters per partition, merged by sorted remainders; what counts above one is verified by bytes.

A filter keeps a fingerprint as a quotient (its bucket) and a remainder (kept sorted within
the bucket) with a count. Two filters merge without loss by merging their sorted remainders,
so each partition's filter is cut by quotient ranges, and each range is merged in one task.
A hot text is one remainder with a large count in each partition: it is never a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, near, read_table, spread_left, whole_text

QUOTIENT_BITS, REMAINDER_BITS = 16, 48
#: Blocks of quotients at least, and fingerprints of a block, about: what one task merges.
BLOCKS, BLOCK_ROWS = 32, 1_000_000


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", " ")


def pack_filter(values: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """(occupied quotients, run lengths, remainders, counts) of sorted distinct fingerprints."""
    quotients, runs = np.unique((values >> np.uint64(REMAINDER_BITS)).astype("<u2"), return_counts=True)
    six = np.ascontiguousarray(values & np.uint64((1 << REMAINDER_BITS) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return quotients.tobytes(), runs.astype("<u4").tobytes(), six.tobytes(), counts.astype("<u8").tobytes()


def unpack_filter(quotients: bytes, runs: bytes, remainders: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    high = np.repeat(np.frombuffer(quotients, "<u2").astype(np.uint64), np.frombuffer(runs, "<u4"))
    eight = np.zeros((len(remainders) // 6, 8), np.uint8)
    eight[:, :6] = np.frombuffer(remainders, np.uint8).reshape(-1, 6)
    return (high << np.uint64(REMAINDER_BITS)) | eight.view("<u8").ravel(), np.frombuffer(counts, "<u8")


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with the sums of their counts."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[starts], np.add.reduceat(counts, starts)


def repeated_fingerprints(fingerprints: DataFrame, column: str = "fp", blocks: int | None = None) -> DataFrame:
    """``fp long, n long``: the fingerprints that occur more than once, by merged counting quotient filters."""
    blocks = blocks or min(1 << QUOTIENT_BITS, max(BLOCKS, -(-fingerprints.count() // BLOCK_ROWS)))

    def build(batches):
        values, counts, fresh, waiting = np.empty(0, np.uint64), np.empty(0, np.uint64), [], 0

        def merged():
            return summed(np.concatenate([values, *fresh]), np.concatenate([counts, np.ones(waiting, np.uint64)]))

        for b in batches:  # held as a filter, not as rows; merged when it can double, so that the time grows with the rows
            fresh.append(np.asarray(b.column(0)).astype(np.int64).view(np.uint64))
            waiting += len(fresh[-1])
            if waiting > max(len(values), 100_000):
                (values, counts), fresh, waiting = merged(), [], 0
        values, counts = merged()
        block = ((values >> np.uint64(REMAINDER_BITS)) * np.uint64(blocks)) >> np.uint64(QUOTIENT_BITS)
        at = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
        rows = [(k, *pack_filter(values[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 4)], names=["block", "quotients", "runs", "remainders", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack_filter(*(row[c] for c in ("quotients", "runs", "remainders", "counts"))) for row in table.to_pylist()]
        values, counts = summed(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]))
        many = counts > 1
        return pa.table({"fp": pa.array(values[many].view(np.int64)), "n": pa.array(counts[many].astype(np.int64))})

    filters = fingerprints.select(column).mapInArrow(build, "block int, quotients binary, runs binary, remainders binary, counts binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_groups(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Texts are equal if they are after each run of white space is one space; a null text is
    an empty one. Of equal texts the smallest doc_id stays (a null one only if there is no
    other). Rows that repeat both doc_id and text all count in ``group_size`` and share
    ``kept``. An empty table gives no rows; other columns are ignored.

    Only texts whose fingerprint counts above one are grouped by their bytes, after a
    map-side pre-aggregation, so that thousands of copies become one row in each task. Their
    fingerprints are sent to the tasks if they are few (``broadcast_rows``); else both sides
    are shuffled.
    """
    base = docs.select("doc_id", normalised().alias("norm")).select("doc_id", "norm", F.xxhash64("norm").alias("fp"))
    narrow = durable(base.select("doc_id", "fp", F.unhex(F.sha2("norm", 256)).alias("sha")))
    repeated = durable(repeated_fingerprints(narrow))
    routed = base.join(near(repeated.select("fp"), broadcast_rows), "fp", "left_semi")
    groups = (
        routed.groupBy("fp", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.col("fp").alias("group_fp"), F.unhex(F.sha2("norm", 256)).alias("group_sha"), "keep_id", "group_size")
    )
    same = (F.col("fp") == F.col("group_fp")) & (F.col("sha") == F.col("group_sha"))
    found = spread_left(narrow, durable(groups), same, "group_size", broadcast_rows)
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with all its columns, less the rows that repeat another's text; of rows with one doc_id and text, one stays.

    Whole rows are not shuffled while the ids that go are few (``broadcast_rows``); only rows
    that repeat both doc_id and text, if there are any, are brought together.
    """
    many = exact_groups(docs, broadcast_rows).filter("group_size > 1")
    marks = durable(many.groupBy(F.col("doc_id").alias("kid"), F.col("text_sha256").alias("ksha")).agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n")))
    gone, again = (marks.filter(x).select("kid", "ksha") for x in ("not stays", "stays and n > 1"))
    # the row as it came is one column, whatever names its own have
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.sha2(normalised(), 256).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("kid")) & (F.col("sha") == F.col("ksha"))
    rest = named.join(near(gone, broadcast_rows), same, "left_anti")
    if not again.isEmpty():
        few = near(again, broadcast_rows)
        rest = rest.join(few, same, "left_anti").unionByName(rest.join(few, same, "left_semi").dropDuplicates(["id", "sha"]))
    return rest.select("row.*")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents; see ``exact_groups`` for nulls, ties and repeated rows."""
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
