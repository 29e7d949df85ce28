"""SimHash near-dedup: exact comparison of all fingerprints by tiles, skipping tiles whose population counts differ too much.

Two fingerprints within the radius differ by no more than the radius in the population count
of the whole and, summed, in those of their four 16-bit parts. Fingerprints are dealt to
blocks in the order of their counts, so that most pairs of blocks need never meet; inside a
pair of blocks, tiles sorted by the four counts are skipped by the distance of their bounds,
and the rest is compared by exclusive-or and bit counts. A task reduces what it links to a
forest, at most one edge for each fingerprint, however many pairs a group of copies has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.similar import shingle_hashes

from .common import durable, map_texts, near, read_table, spread_join
from .components import connected

SHINGLE, RADIUS = 4, 4
BLOCKS, BLOCK_ROWS, TILE = 16, 1_000_000, 256
#: Tasks that pairs of blocks are dealt to, at most.
PAIR_TASKS = 10_000


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit, 1 if set in over half of the hashes; 0 of none. Signed, for a bigint column."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    full = n // 255 * 255
    if full:  # sums of 255 rows fit in a byte
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp long`` for each row."""
    return map_texts(docs, keep, "fp long", lambda: lambda texts: [(fingerprint(shingle_hashes(t, size)),) for t in texts])


class Forest:
    """Labels of numbered nodes; joining takes arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while len(u):
            a, b = label[u], label[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def signature(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def link_tiles(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, its root) of a forest that joins what is within ``radius``, between left and right, or within left."""

    def tiles(fps):
        sig = signature(fps)
        order = np.lexsort(sig.T[::-1])
        fps, sig = fps[order], sig[order]
        cuts = np.arange(0, len(fps), tile)
        return fps, cuts, np.minimum.reduceat(sig, cuts, axis=0), np.maximum.reduceat(sig, cuts, axis=0)

    if not len(left) or right is not None and not len(right):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, cuts_a, low_a, high_a = tiles(left)
    b, cuts_b, low_b, high_b = (a, cuts_a, low_a, high_a) if right is None else tiles(right)
    nodes, shift = (a, 0) if right is None else (np.concatenate([a, b]), len(a))
    forest = Forest(len(nodes))
    for i, s in enumerate(cuts_a):
        gap = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b)).sum(axis=1)
        close = np.flatnonzero(gap <= radius)
        if right is None:
            close = close[close >= i]
        own = a[s : s + tile]
        for k in range(0, len(close), 16):
            cols = np.concatenate([np.arange(c, min(c + tile, len(b))) for c in cuts_b[close[k : k + 16]]])
            u, v = np.nonzero(np.bitwise_count(own[:, None] ^ b[cols][None, :]) <= radius)
            if len(u):
                forest.join(u + s, cols[v] + shift)
    at = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return nodes[at], nodes[forest.label[at]]


def deal_blocks(rows: DataFrame, key: Column, apart: Callable[[int, int], bool], block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """``rows`` with ``block, i, j``: a row of a block for each pair of blocks (i <= j) that the block has to meet in.

    ``key`` is a long of few values (at most some thousand); rows go to blocks in its order,
    and a key of more rows than a block is dealt by hash. ``apart(high, low)`` says that keys
    up to ``high`` never meet keys from ``low`` on, so that a block meets a run of blocks; both
    tables that are sent to the tasks have one row for each key or block. None without rows.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", key)
    by_key = sorted((r["__key"], r["n"]) for r in keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).collect())
    if not by_key:
        return None
    total = sum(n for _, n in by_key)
    most = max(1, -(-total // max(BLOCKS, -(-total // block_rows))))
    spans: list[list[int]] = []  # of keys, both ends included
    places, room = [], 0
    for k, n in by_key:
        parts = -(-n // most)
        if parts == 1 and n <= room:
            spans[-1][1] = k
            room -= n
        else:
            spans += [[k, k] for _ in range(parts)]
            room = most - n if parts == 1 else 0
        places.append((k, len(spans) - parts, parts))
    last, j = [], 0
    for i, (_, high) in enumerate(spans):
        j = max(i, j)
        while j + 1 < len(spans) and not apart(high, spans[j + 1][0]):
            j += 1
        last.append(j)
    first, i = [], 0
    for b in range(len(spans)):
        while last[i] < b:
            i += 1
        first.append(i)
    start = near(spark.createDataFrame(places, "__key long, __start int, __parts int"))
    reach = near(spark.createDataFrame(list(zip(range(len(spans)), first, last)), "block int, __first int, __last int"))
    salt = F.pmod(F.xxhash64(*rows.columns[:1], F.lit("block")), F.col("__parts"))
    placed = keyed.join(start, "__key").withColumn("block", (F.col("__start") + salt).cast("int")).join(reach, "block")
    met = placed.withColumn("__other", F.explode(F.sequence("__first", "__last")))
    dealt = met.select(*rows.columns, "block", F.least("block", "__other").alias("i"), F.greatest("block", "__other").alias("j"))
    pairs = sum(b - a + 1 for a, b in enumerate(last))
    return dealt.repartition(min(pairs, PAIR_TASKS), "i", "j")


def near_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a long, b long``: a spanning set of the links between the distinct fingerprints ``fp``."""
    dealt = deal_blocks(classes.select("fp"), F.bit_count("fp").cast("long"), lambda high, low: low - high > radius)
    if dealt is None:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b"))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        fps, blocks = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("block"))
        a, b = link_tiles(fps[blocks == i], None if i == j else fps[blocks == j], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.groupBy("i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Fingerprints link if they differ in at most ``radius`` bits; a component is what can be
    reached by links, and ``component_id`` is its smallest doc_id that is not null (null if
    there is none). A null text is an empty one; texts without words have fingerprint zero and
    link like others. Rows with one fingerprint are one class, however many; repeated rows are
    returned again; an empty table gives no rows; other columns are ignored. Very long texts
    are read whole.
    """
    rows = durable(fingerprints(docs, size))
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).withColumn("node", F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "fp")))
    named = classes.select("fp", "node")
    links = near_links(classes, radius).join(named.toDF("a", "node_a"), "a").join(named.toDF("b", "node_b"), "b")
    roots = connected(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))  # of the smallest doc_id
    moved = roots.select(F.col("node.fp").alias("__fp"), F.col("root.first_id").alias("component_id"))
    labels = durable(classes.join(moved, F.col("fp") == F.col("__fp"), "left").select(F.col("fp").alias("__fp"), F.when(F.col("__fp").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), "n"))
    return spread_join(rows, labels, F.col("fp") == F.col("__fp"), "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents; see ``near_duplicates`` for nulls, texts without words, ties, and repeated rows."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
