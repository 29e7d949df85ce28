"""Merkle dataset manifest: a content-addressed graph of digests, and proofs by descent from the root.

Leaves of a language, in the order of doc_id, are joined by eights to nodes until one is left;
the languages' top nodes are joined likewise to the root. The store keeps, under each node's
digest, its children's digests. A leaf is asked for by its rank: the rank's digits in base 8 say
which child to follow from the root; the children that are not followed are collected, and
the path, reversed, is the proof.

The lowest three levels of 512 leaves are built, and later descended, within one task. All that
is above are tables with a row for each block of 512 leaves or less: built level by level,
descended level by level with one row for each node that requests pass through. Only leaves'
digests are shuffled, once to be ranked (by ranges) and once to be brought to their block.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, near, read_table, whole_text

#: Children of a node, and levels of a block.
FAN, DEPTH = 8, 3
BLOCK = FAN**DEPTH


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``tree_id`` (rank of the tree's name, null first, from 0), ``rank`` within the tree from 0 and ``n``, the tree's rows.

    Rows are sorted by ranges, and numbered in each range by itself from what stands before it;
    a tree of a third of all rows is many ranges. Rows that are alike are numbered one by one.
    """
    parts = durable(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("__part", F.spark_partition_id()))
    counts = durable(parts.groupBy(tree, "__part").agg(F.count(F.lit(1)).alias("__n")))  # of each tree, and one more for each range
    earlier = Window.partitionBy(tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy(tree).agg(F.sum("__n").alias("n"))
    trees = numbered(sizes, tree).withColumnRenamed(tree, "__tree")
    starts = counts.select("*", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")).join(near(trees), F.col(tree).eqNullSafe(F.col("__tree")))
    starts = starts.select(F.col("__tree"), F.col("__part").alias("__range"), F.col("rank").alias("tree_id"), "__before", "n")
    joined = parts.join(near(durable(starts)), (F.col("__part") == F.col("__range")) & F.col(tree).eqNullSafe(F.col("__tree")))
    local = F.row_number().over(Window.partitionBy("__part", tree).orderBy(*order)) - 1
    return joined.withColumn("rank", (local + F.col("__before")).cast("long")).select(*rows.columns, "tree_id", "rank", "n")


def numbered(names: DataFrame, name: str) -> DataFrame:
    """A table of distinct names with ``rank`` from 0, null first, by ranges."""
    parts = durable(names.repartitionByRange(name).withColumn("__part", F.spark_partition_id()))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", before.alias("__before"))  # a row for each range
    local = F.row_number().over(Window.partitionBy("__part").orderBy(name)) - 1
    return parts.withColumn("__local", local).join(F.broadcast(starts), "__part").withColumn("rank", (F.col("__local") + F.col("__before")).cast("long")).select(*names.columns, "rank")


def grow(leaves: list[str], levels: int | None) -> tuple[str, dict[str, list[str]]]:
    """The top digest of a list, and its store; up to one node, or exactly so many levels."""
    store: dict[str, list[str]] = {}
    level = 0
    while len(leaves) > 1 if levels is None else level < levels:
        runs = [leaves[i : i + FAN] for i in range(0, len(leaves), FAN)]
        leaves = [digest(*run) for run in runs]
        store.update(zip(leaves, runs))
        level += 1
    return leaves[0], store


def height_of(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def descend(store: dict[str, list[str]], top: str, rank: int, height: int) -> list[tuple[str, str]]:
    """What stands left and right of the path from ``top`` to the leaf of that rank, the leaf's level first."""
    path, node = [], top
    for level in range(height - 1, -1, -1):
        digit = rank // FAN**level % FAN
        children = store[node]
        path.append(("".join(children[:digit]), "".join(children[digit + 1 :])))
        node = children[digit]
    return path[::-1]


def fold(claimed: str, path: list[tuple[str, str]]) -> str:
    return functools.reduce(lambda node, sides: digest(sides[0], node, sides[1]), path, claimed)


def upper_levels(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``tree_id, digest, height`` of the trees' tops, and the store of each level, lowest first: ``digest, children``.

    ``nodes``: ``tree_id, rank, digest``. Each level has an eighth of the rows of the one below.
    """
    now = durable(nodes.select("tree_id", "rank", "digest"))
    tops, stores, height = None, [], 0
    while True:
        single = now.groupBy("tree_id").agg(F.count(F.lit(1)).alias("nodes"), F.min("digest").alias("digest"))
        done = single.filter("nodes = 1").select("tree_id", "digest", F.lit(height).alias("height"))
        tops = done if tops is None else tops.unionByName(done)
        open_ = now.join(near(single.filter("nodes > 1").select("tree_id")), "tree_id", "left_semi")
        runs = open_.groupBy("tree_id", F.floor(F.col("rank") / FAN).alias("rank")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("run"))  # 8 at most
        made = durable(runs.select("tree_id", "rank", F.col("run.digest").alias("children")).withColumn("digest", F.sha2(F.concat_ws("", "children"), 256)))
        if made.isEmpty():
            return durable(tops), stores
        stores.append(made.select("digest", "children").distinct())
        now, height = made.select("tree_id", "rank", "digest"), height + 1


def descended(tops: DataFrame, stores: list[DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """``tree_id, rank, digest, path``: from ``tops(tree_id, digest, height, path)`` down to the lowest nodes, or the ``wanted(tree_id, rank)`` of them.

    A node is stepped to once, however many requests pass through it; ``path`` has what is left
    and right of each step, the last one first.
    """
    front = tops.select("tree_id", F.lit(0).cast("long").alias("rank"), "digest", "height", "path")
    for level in range(len(stores), 0, -1):
        here, below = front.filter(F.col("height") >= level), front.filter(F.col("height") < level)
        step = here.join(stores[level - 1].withColumnRenamed("digest", "__node"), F.col("digest") == F.col("__node"))
        step = step.select("tree_id", "rank", "height", "path", "children", F.posexplode("children").alias("digit", "child"))
        sides = F.struct(
            F.array_join(F.expr("slice(children, 1, digit)"), "").alias("left"),
            F.array_join(F.expr("slice(children, digit + 2, 8)"), "").alias("right"),
        )
        step = step.select("tree_id", (F.col("rank") * FAN + F.col("digit")).alias("rank"), F.col("child").alias("digest"), "height", F.concat(F.array(sides), "path").alias("path"))
        if wanted is not None:
            passed = wanted.select("tree_id", F.floor(F.col("rank") / FAN ** (level - 1)).cast("long").alias("rank")).distinct()
            step = step.join(passed, ["tree_id", "rank"], "left_semi")
        front = durable(step.unionByName(below))
    return front.select("tree_id", "rank", "digest", "path")


BLOCK_TYPE = "tree_id long, rank long, digest string"


def block_tops(leaves: DataFrame) -> DataFrame:
    """``tree_id, rank, digest`` of the blocks of 512 leaves: three levels up, or the tree's top if it has one block."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("rank").to_pylist(), table.column("leaf").to_pylist()))
        one = table.column("n")[0].as_py() <= BLOCK
        top, _ = grow([d for _, d in rows], None if one else DEPTH)
        return pa.table({"tree_id": pa.array([key[0].as_py()], pa.int64()), "rank": pa.array([key[1].as_py()], pa.int64()), "digest": [top]})

    return leaves.select("tree_id", "block", "rank", "leaf", "n").groupBy("tree_id", "block").applyInArrow(build, BLOCK_TYPE)


def manifest(docs: DataFrame, claimed: Column | None = None, wanted: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof`` for each row of ``docs``, or each ``wanted`` one.

    A leaf is the digest of doc_id, source, lang, n_chars and text; ``claimed`` is the leaf that
    is held against the manifest (its own by default), ``wanted`` a condition on the rows whose
    proofs are asked for. ``proof`` has the digests beside the path on each level, the leaf's
    first; ``folded_root`` is what the claimed leaf and the proof give.

    Nulls are values of their own in leaves; rows without lang are a tree of their own, the
    first; rows without doc_id come first in their tree. Rows of one doc_id are ordered by their
    leaves; repeated rows are leaves of their own, next to each other. An empty table gives no
    rows; other columns are ignored; very long texts are read whole.
    """
    own = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    asked = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), own.alias("leaf"), (own if claimed is None else claimed).alias("claimed"), asked.alias("asked"))
    leaves = durable(ranked(rows, "lang", "doc_id", "leaf").drop("lang").withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long")))
    lower = block_tops(leaves)
    subroots, stores = upper_levels(lower)
    langs, lang_stores = upper_levels(subroots.select(F.lit(0).cast("long").alias("tree_id"), F.col("tree_id").alias("rank"), "digest"))
    root = langs.select("digest", "height", "tree_id", F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"))
    to_langs = descended(root, lang_stores).select(F.col("rank").alias("tree_id"), "path")
    tops = subroots.join(near(to_langs), "tree_id")
    blocks = None if wanted is None else leaves.filter("asked").select("tree_id", F.col("block").alias("rank")).distinct()
    to_blocks = descended(tops, stores, blocks).select("tree_id", F.col("rank").alias("block"), "path")
    named = to_blocks.join(near(subroots.select("tree_id", F.col("digest").alias("subroot"))), "tree_id").join(F.broadcast(langs.select(F.col("digest").alias("root"))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sides = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return out_type.empty_table()
        rows = left.sort_by("rank")
        top, ranks = right.to_pylist()[0], rows.column("rank").to_pylist()
        n = rows.column("n")[0].as_py()
        height = height_of(n) if n <= BLOCK else DEPTH
        node, store = grow(rows.column("leaf").to_pylist(), height)
        above = [(s["left"], s["right"]) for s in top["path"]]
        proofs, folded, kept = [], [], []
        for i, (rank, claim, ask) in enumerate(zip(ranks, rows.column("claimed").to_pylist(), rows.column("asked").to_pylist())):
            if ask:
                path = descend(store, node, rank % BLOCK, height) + above
                kept.append(i)
                proofs.append(path)
                folded.append(fold(claim, path))
        rows, size = rows.take(pa.array(kept, pa.int64())), len(kept)
        return pa.table(
            {
                "doc_id": rows.column("doc_id"), "leaf": rows.column("leaf"), "subroot": [top["subroot"]] * size, "root": [top["root"]] * size,
                "proof_sha256": [digest(*(x for s in p for x in s)) for p in proofs], "folded_root": folded, "verified": [f == top["root"] for f in folded],
                "proof": pa.array([[{"left": a, "right": b} for a, b in p] for p in proofs], sides),
            },
            schema=out_type.with_metadata(None),
        )

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out_type = pa.schema([("doc_id", arrow), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_()), ("proof", sides)])
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<struct<left: string, right: string>>"
    narrow = leaves.select("tree_id", "block", "rank", "n", "doc_id", "leaf", "claimed", "asked")
    return narrow.groupBy("tree_id", "block").cogroup(named.groupBy("tree_id", "block")).applyInArrow(prove, schema)


def tampered_leaf() -> Column:
    """The leaf as it is, or, where 3 divides the crc32 of doc_id, with the text's A-Z in lower case."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0, low).otherwise(F.col("text"))
    return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents, each held against the manifest, a third of them tampered with (none without doc_id); see ``manifest`` for nulls, ties, and repeated rows."""
    return manifest(read_table(spark, sf_dir, "documents"), tampered_leaf()).drop("proof")
