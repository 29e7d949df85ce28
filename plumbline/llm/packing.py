"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue of tokens, cut into slices of ``quantum`` tokens. A queue earns credit
in proportion to its target share of all that is served, and is served when it has earned the
next slice to one half; what it has earned and not got, its deficit, carries over windows and
partitions. A window holds the next ``window / quantum`` slices, ordered by queue, so that a
queue's slices of a window lie together. Queues of one weight and one length take turns as one
class, whatever their number; every task works out its slices' places from the tree of the
classes, in steps by the logarithm of their number, and no state passes between tasks. A queue
that ends leaves its share to the others; queues of weight zero come when the others have
ended. The queues' ends, shorter than a slice, follow last, and only the very last window can
be short.

Documents are tokenised once, their ids kept in the checkpoint folder (two bytes a token)
and never shuffled while the table of partition offsets is small; only counts by partition
and queue are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, near, read_table, small_batches, vocabulary, whole_text
from .tokens import VOCABULARY, kept_encoder

WINDOW, QUANTUM, END = 1024, 32, 0
#: Rows (partition, source, offset) that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Tasks that number the sources and add up their ends.
SALTS = 64


class Turns:
    """The order of the slices of classes: (weight of all the class, slices of all the class), and 1 for those that wait for the others.

    Classes are the leaves of a tree, the light ones deep (as in a Huffman code). Of a node's
    first e slices its lighter child has ``floor(e * share + 1/2)``, and the other one the rest,
    as long as both last. So a child is never more than half a slice from its share of its
    parent, and a class at most about one and a half from its share of all.
    """

    def __init__(self, weights: list[float], sizes: list[int], later: list[int]):
        q = self.leaves = len(weights)
        self.size = np.array([*sizes, *[0] * q], np.int64)
        self.parent, self.left = np.full(2 * q, -1), np.zeros(2 * q, bool)
        self.share, self.size_left, self.size_right = np.ones(2 * q), np.zeros(2 * q, np.int64), np.zeros(2 * q, np.int64)
        self.used = q
        roots = [self._tree([(weights[c], c) for c in range(q) if later[c] == k]) for k in (0, 1)]
        roots = [r for r in roots if r is not None]
        self.root = self._join(roots[0], roots[1], 1.0) if len(roots) == 2 else roots[0] if roots else None
        self.total = int(sum(sizes))
        paths = []
        for c in range(q):
            own = [c]
            while self.parent[own[-1]] >= 0:
                own.append(int(self.parent[own[-1]]))
            paths.append(own[::-1])
        self.depth = max(map(len, paths), default=0)
        self.path = np.array([p + [p[-1]] * (self.depth - len(p)) for p in paths], np.int64).reshape(q, self.depth)  # from the root to the leaf

    def _join(self, a: int, b: int, share: float) -> int:
        node = self.used
        self.used += 1
        self.parent[[a, b]], self.left[a] = node, True
        self.share[node], self.size_left[node], self.size_right[node], self.size[node] = share, self.size[a], self.size[b], self.size[a] + self.size[b]
        return node

    def _tree(self, leaves: list[tuple[float, int]]) -> int | None:
        heapify(leaves)
        while len(leaves) > 1:
            (wa, a), (wb, b) = heappop(leaves), heappop(leaves)
            heappush(leaves, (wa + wb, self._join(a, b, wa / (wa + wb))))
        return leaves[0][1] if leaves else None

    def to_left(self, node: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Of a node's first e slices, how many are of its left child."""
        return np.clip(np.floor(e * self.share[node] + 0.5).astype(np.int64), e - self.size_right[node], self.size_left[node])

    def rank(self, m: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The place of slice m of class c among all slices: at each parent, the first e that holds it."""
        m, node = m.astype(np.int64), c.astype(np.int64)
        while (at := np.flatnonzero(self.parent[node] >= 0)).size:
            own, up, left = m[at], self.parent[node[at]], self.left[node[at]]
            part = np.where(left, self.share[up], np.maximum(1 - self.share[up], 1e-300))
            e = np.minimum(np.ceil((own + 0.5) / part), 2.0 * self.size[up] + 2).astype(np.int64)
            e = np.clip(e, own + 1, own + 1 + np.where(left, self.size_right[up], self.size_left[up]))

            def holds(x, own=own, up=up, left=left):
                n = self.to_left(up, x)
                return np.where(left, n, x - n) > own

            while (low := ~holds(e)).any():  # rounding moves it by one or so
                e += low
            while (high := holds(e - 1)).any():
                e -= high
            m[at], node[at] = e - 1, up
        return m

    def served(self, e: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the first e slices in order, how many are of classes before c in the order of the leaves, and how many of c."""
        e, before = e.astype(np.int64), np.zeros(len(e), np.int64)
        for k in range(self.depth - 1):
            node, child = self.path[c, k], self.path[c, k + 1]
            at = np.flatnonzero(node != child)
            n, left = self.to_left(node[at], e[at]), self.left[child[at]]
            before[at] += np.where(left, 0, n)
            e[at] = np.where(left, n, e[at] - n)
        return before, e


def places(turns: Turns, starts: np.ndarray, sizes: np.ndarray, queues: dict[str, np.ndarray], quantum: int = QUANTUM, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(document, start in it, length, sequence, offset) of the pieces of many documents.

    A document is given by its place in its queue, and its queue by its class, its turn in the
    class, the class's number of queues, its number of slices and the place of its end.
    """
    per_window = window // quantum
    first, last = starts // quantum, (starts + sizes - 1) // quantum
    doc = np.repeat(np.arange(len(starts)), last - first + 1)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[doc]
    lo, hi = np.maximum(k * quantum, starts[doc]), np.minimum((k + 1) * quantum, starts[doc] + sizes[doc])
    slices = queues["slices"][doc]
    at = turns.total * quantum + queues["end"][doc] + lo - slices * quantum  # if it is the queue's end
    whole = np.flatnonzero(k < slices)
    if len(whole):
        own = doc[whole]
        c = queues["class"][own]
        m = k[whole] * queues["members"][own] + queues["turn"][own]
        begin = turns.rank(m, c) // per_window * per_window
        (others, own), (others_then, _) = turns.served(begin, c), turns.served(np.minimum(begin + per_window, turns.total), c)
        at[whole] = (begin + others_then - others + m - own) * quantum + lo[whole] % quantum
    begin, size = lo - starts[doc], hi - lo
    over = at % window + size - window  # only a queue's end can reach over a window
    if (cut := np.flatnonzero(over > 0)).size:
        doc, begin, at = (np.insert(x, cut + 1, x[cut] + y) for x, y in ((doc, 0), (begin, size[cut] - over[cut]), (at, size[cut] - over[cut])))
        size = np.insert(np.where(over > 0, size - over, size), cut + 1, over[cut])
    joined = np.zeros(len(doc), bool)  # to the piece before
    joined[1:] = (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + size[:-1]) & (at[1:] // window == at[:-1] // window)
    heads = np.flatnonzero(~joined)
    return doc[heads], begin[heads], np.add.reduceat(size, heads) if len(heads) else size, at[heads] // window, at[heads] % window


def tokenise(docs: DataFrame, path: str, queue: Column) -> DataFrame:
    """``doc_id, queue, part, queue_start, doc_tokens, ids``: the ids and the place among the partition's tokens of the queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, so_far = kept_encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([END], "<u2").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids = [encode(t) + end for t in b.column(2).to_pylist()]
                starts, queues = [], b.column(1).to_pylist()
                for q, x in zip(queues, ids):
                    starts.append(so_far.get(q, 0))
                    so_far[q] = starts[-1] + len(x) // 2
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "queue_start", "doc_tokens", "ids"])

    narrow = small_batches(docs).select("doc_id", queue.alias("queue"), whole_text().alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, queue string, part int, queue_start long, doc_tokens long, ids binary")


def queues_of(totals: DataFrame, weights: dict[str, float] | None, quantum: int) -> tuple[DataFrame, Turns]:
    """A row for each queue with its class, turn, members, slices, end and target share; and the order of the classes.

    ``totals`` has ``queue, n`` (tokens). Queues are numbered by salted parts, so that no task
    holds all of them; the classes, which go to the driver, are at most as many as there are
    different numbers of slices and weights.
    """
    sized = totals.withColumn("slices", F.floor(F.col("n") / quantum).cast("long")).withColumn("tail", F.col("n") % quantum)
    if weights is None:
        sized = sized.withColumn("weight", F.col("slices").cast("double"))
    else:
        given = totals.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__name string, weight double")
        sized = sized.join(near(given), F.col("queue") == F.col("__name"), "left").drop("__name").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sized = durable(sized.withColumn("salt", F.pmod(F.xxhash64("queue"), F.lit(SALTS))))
    key = ["slices", "weight"]
    parts = sized.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most SALTS rows each
    parts = parts.select(*key, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    tails = sized.groupBy("salt").agg(F.sum("tail").alias("tail")).collect()  # at most SALTS rows
    sums, at = {}, 0
    for r in sorted(tails):
        sums[r.salt] = at
        at += r.tail
    classes = sorted(tuple(r) for r in sized.filter("slices > 0").groupBy(*key).count().collect())
    small = totals.sparkSession.createDataFrame([(*c[:2], i, c[2]) for i, c in enumerate(classes)], "slices long, weight double, class int, members long")
    ends = totals.sparkSession.createDataFrame(list(sums.items()), "salt long, ends long")
    own = Window.partitionBy(*key, "salt").orderBy("queue")
    running = Window.partitionBy("salt").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sized.withColumn("turn", F.row_number().over(own) - 1).withColumn("so_far", F.coalesce(F.sum("tail").over(running), F.lit(0)))
    placed = numbered.join(near(parts), [*key, "salt"]).join(near(ends), "salt").join(near(small), key, "left")
    total = sum(w * n for _, w, n in classes) or 1.0
    table = placed.select(
        "queue", F.coalesce("class", F.lit(0)).alias("class"), (F.col("turn") + F.col("earlier")).alias("turn"), F.coalesce("members", F.lit(1)).alias("members"),
        "slices", (F.col("so_far") + F.col("ends")).alias("end"), (F.col("weight") / F.lit(total)).alias("target"),
    )
    turns = Turns([(w or float(k)) * n for k, w, n in classes], [k * n for k, _, n in classes], [int(w == 0) for _, w, _ in classes])
    return table, turns


def pack(docs: DataFrame, path: str | None = None, weights: dict[str, float] | None = None, source: str = "source", window: int = WINDOW, quantum: int = QUANTUM) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, target``.

    A document's tokens are those of its text and the end id 0, so an empty or null text is
    one token. ``weights`` are target proportions by source (default: each source's share of
    all tokens, so that all queues end together); a queue that ends leaves its share to the
    others, and sources of weight 0 or without a weight get nothing while another lasts.
    ``target`` is the share that the source is to have of a window. In each window a source
    is within two slices of what its weight earns. Every source is a queue of its own, a null
    source is the source ''. Rows that repeat a doc_id are documents of their own, very long
    texts go on over windows. An empty table gives no rows; other columns are ignored.
    ``quantum`` divides ``window``.
    """
    path = path or vocabulary(VOCABULARY)
    tokens = durable(tokenise(docs, path, F.coalesce(F.col(source).cast("string"), F.lit(""))))
    parts = tokens.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(parts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    table, turns = queues_of(offsets.groupBy("queue").agg(F.sum("n").alias("n")), weights, quantum)
    small = durable(offsets.select("part", "queue", "base").join(near(durable(table)), "queue"))
    small = small.withColumnRenamed("part", "__part").withColumnRenamed("queue", "__queue")
    names = ["base", "queue_start", "doc_tokens", "class", "turn", "members", "slices", "end"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                x = {c: np.asarray(b.column(i)).astype(np.int64) for i, c in enumerate(names, 4)}
                n = x["doc_tokens"]
                doc, start, size, sequence, offset = places(turns, x["base"] + x["queue_start"], n, x, quantum, window)
                wide = [memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes()) for ids in b.column(3).to_pylist()]
                crc = [zlib.crc32(wide[i][4 * s : 4 * (s + m)]) for i, s, m in zip(doc.tolist(), start.tolist(), size.tolist())]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows)] + [pa.array(c, pa.int64()) for c in (start, size, crc, n[doc], sequence, offset)] + [b.column(1).take(rows), b.column(2).take(rows)], names=fields)

    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "target"]
    kind = tokens.schema["doc_id"].dataType
    placed = tokens.join(near(small, BROADCAST_ROWS), (F.col("part") == F.col("__part")) & (F.col("queue") == F.col("__queue")))
    return placed.select("doc_id", "queue", "target", "ids", *names).mapInArrow(cut, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, target double")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in the proportions of their sources; see ``pack`` for nulls, empty texts, and repeated rows."""
    return pack(read_table(spark, sf_dir, "documents"))
