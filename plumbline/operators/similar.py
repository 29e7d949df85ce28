"""Pairs of texts whose shingle sets are alike, found whole by an exact join of prefixes.

Two sets of n items whose Jaccard similarity is ``least`` share one of the first
``n - ceil(least * n) + 1`` items in any order that is the same for all. Here
the order is by frequency, rarest first, from a table of counts by hash of bounded size: it sets
the cost only, never the result. What many texts share is thus seldom in a prefix.

Where many sets share a prefix shingle they do not all meet. In a round, one of them, drawn
by hash, meets the others; what links becomes one component, and only sets of different
components meet in the next. The pairs that are left are counted; when they are few, or
rounds are over, they all meet. Pairs are held against exact bounds (what is left of both sets
from the first shingle that they share on, and the parities of the hashes in as many places) before whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.batches import ROWS_AT_ONCE, map_texts, near, small_batches, whole_text
from plumbline.functions.durable import settle

from .graphs import components

#: Of the hashes, which are those of Spark's xxhash64.
SEED = 42
#: ASCII upper to lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The default of near-duplicate stages: words of a shingle, and similarity as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Bits of the table of counts: at least, at most (64 MB).
COUNT_BITS = (16, 24)
#: Least places of the parity bound; rounds of a drawn set against the others; shingles that one task compares at a time, about.
PLACES, ROUNDS, SHINGLES_AT_ONCE = 512, 2, 1_000_000


def shingle_hashes(text: str, size: int = 4) -> np.ndarray:
    """XXH64 of the ``size``-word shingles, repeats included; of the whole if there are fewer words; none without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes split at 20 and 09-0D only
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def shingle_set(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of the whole if there are fewer words; none without words."""
    return np.unique(shingle_hashes(text, size))


def set_id(items: np.ndarray) -> int:
    """A hash of the whole set, signed."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(items.tobytes(), SEED)).view(np.int64))


def parities(items: np.ndarray) -> bytes:
    """Of each of at least 512 places, and as many as there are items, whether an odd number of hashes falls on it. Places are a power of two, so that halves laid over each other are those of half as many."""
    places = max(PLACES, 1 << (len(items) - 1).bit_length()) if len(items) else PLACES
    odd = np.bincount((items & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Places in which two sets' parities differ: no more than the items in which the sets do."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """How many texts have a shingle with the same last bits: a table of bounded size, summed up in the tasks first."""
    bits = int(min(COUNT_BITS[1], max(COUNT_BITS[0], docs.count().bit_length())))
    blocks = 1 << (bits - COUNT_BITS[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.int64)
        for b in batches:
            for text in (t for at in range(0, b.num_rows, ROWS_AT_ONCE) for t in b.column(0).slice(at, ROWS_AT_ONCE).to_pylist()):
                np.add.at(held, (shingle_set(text, size) & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        for k, part in enumerate(np.split(held, blocks)):
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([part[at].astype("<i8").tobytes()], pa.binary())], names=["block", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << COUNT_BITS[0], np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist()):
            total[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<i8")
        return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    parts = small_batches(docs).select(whole_text().alias("text")).mapInArrow(count, "block int, at binary, n binary").groupBy("block").applyInArrow(add, "block int, n binary")
    out = np.zeros(1 << bits, np.int32)
    for r in parts.toLocalIterator():  # at most 256 rows of 256 KB
        out[r.block << COUNT_BITS[0] : (r.block + 1) << COUNT_BITS[0]] = np.frombuffer(r.n, "<i4")
    return out


def rare_first(items: np.ndarray, counts: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """The prefix of a set: any set of that similarity shares one of these with it."""
    many, whole = least
    length = len(items) - -(-len(items) * many // whole) + 1
    order = np.lexsort((items, counts[(items & np.uint64(len(counts) - 1)).astype(np.int64)]))
    return items[order[:length]]


def sketches(docs: DataFrame, keep: tuple[str, ...], size: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """``keep, id, n, parity, prefix`` of each text: its set's id (a hash of it), size, parities and prefix, but not the set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size))

    def build():
        counts = sent.value

        def rows(texts):
            sets = [shingle_set(t, size) for t in texts]
            return [(set_id(s), len(s), parities(s), rare_first(s, counts, least).view(np.int64).tolist() if len(s) else []) for s in sets]

        return rows

    return map_texts(docs, keep, "id long, n long, parity binary, prefix array<long>", build)


def may_be_similar(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The distinct ``a, b`` that both bounds let through, with ``n``, both sizes together.

    Similar sets of m and n items differ in at most (m + n) * (whole - many) / (whole + many) of
    them, and where their parities differ they differ.
    """
    many, whole = least
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("parity").alias(f"p{side}")), side)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole_batch.slice(at, ROWS_AT_ONCE) for whole_batch in batches for at in range(0, whole_batch.num_rows, ROWS_AT_ONCE)):
            total = np.asarray(batch.column(2))
            odd = np.array([apart(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)], names=["a", "b", "n"]).filter(pa.array(odd * (whole + many) <= total * (whole - many)))

    return pairs.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "pa", "pb").mapInArrow(close, "a long, b long, n long")


def verified(pairs: DataFrame, texts_of, least: tuple[int, int] = LEAST, size: int = WORDS) -> DataFrame:
    """``a, b`` of the pairs whose shingle sets have the similarity ``least`` or more.

    Pairs are dealt to chunks by hash; a set is sent once to each chunk that needs it, so that
    a text with many candidates is no hot key. ``texts_of`` takes a table of ``id`` and gives a
    table of one ``text`` for each.
    """
    many, whole = least
    pairs = settle(pairs)
    total = pairs.agg(F.sum("n")).first()[0]
    if not total:
        return pairs.select("a", "b")
    chunks = -(-total // SHINGLES_AT_ONCE)
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(chunks)).alias("chunk"))
    slots = settle(dealt.select("chunk", F.explode(F.array("a", "b")).alias("id")).distinct())

    def build():
        def rows(texts):
            sets = [shingle_set(t, size) for t in texts]
            return [(set_id(s), s.tobytes()) for s in sets]

        return rows

    items = map_texts(texts_of(slots.select("id").distinct()), (), "id long, items binary", build).dropDuplicates(["id"])
    sent = slots.join(items, "id").select("chunk", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "items")

    def verify(table: pa.Table) -> pa.Table:
        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        sets = {x: np.frombuffer(raw, np.uint64) for x, y, raw in zip(a, b, table.column("items").to_pylist()) if y is None}
        links = []
        for x, y in zip(a, b):
            if y is not None:
                shared, total = len(np.intersect1d(sets[x], sets[y], assume_unique=True)), len(sets[x]) + len(sets[y])
                if shared * whole >= (total - shared) * many:
                    links.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    both = dealt.select("chunk", "a", "b", F.lit(None).cast("binary").alias("items")).unionByName(sent)
    return settle(both.repartition(min(chunks, 10_000), "chunk").groupBy("chunk").applyInArrow(verify, "a long, b long"))


def similar_links(sets: DataFrame, links: DataFrame, texts_of, least: tuple[int, int] = LEAST, size: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """``a, b``: ``links`` and what completes them, so that all that is similar is in one component of them.

    ``sets``: ``id, n, parity, prefix``, one row each. Sets without items link to nothing here.
    """
    many, whole = least
    # of a pair the smaller set has the first shared shingle so early in its order that enough of it is left
    early = F.col("pos") * (many + whole) <= F.col("n") * (whole - many)
    tokens = sets.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    narrow = tokens.select("token", "id", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("code"))  # one long for size and place
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.count_if(early).alias("e")).filter("k > 1 and e > 0").select("token")
    placed = narrow.join(shared, "token").select("token", "id", F.shiftright("code", 32).alias("n"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))
    posted = settle(placed.select("token", "id", "n", (F.col("n") - F.col("pos")).alias("rest"), early.alias("early")))
    enough = F.least("rest", "other_rest") * (many + whole) >= (F.col("n") + F.col("other_n")) * many
    met = None
    for turn in range(rounds + 1):
        roots = components(links).toDF("node", "root")
        own = posted.join(near(settle(roots)), F.col("id") == F.col("node"), "left").select("token", "id", "n", "rest", "early", F.coalesce("root", "id").alias("root"))
        drawn = F.min(F.when(F.col("early"), F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), "id", "n", "rest", "root")))
        counts = own.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"), F.count_if("early").alias("e"), drawn.alias("hub"))
        mixed = counts.groupBy("token").agg(F.sum("k").alias("k"), (F.sum("k") * F.sum("e") - F.sum(F.col("k") * F.col("e"))).alias("pairs"), F.min("hub").alias("hub"))
        mixed = settle(mixed.filter("pairs > 0"))
        left = mixed.agg(F.sum("pairs").alias("pairs"), F.sum("k").alias("rows")).first()
        if not left.rows:
            break
        last = turn == rounds or left.pairs <= 2 * left.rows
        if last:  # all that is left
            x = settle(own.join(mixed.select("token"), "token"))
            y = x.filter("early").select("token", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("rest").alias("other_rest"), F.col("root").alias("other_root"))
            ordered = (F.col("n") > F.col("other_n")) | (F.col("n") == F.col("other_n")) & (F.col("id") < F.col("other"))
            pairs = x.join(y, "token").filter(ordered & (F.col("root") != F.col("other_root")) & enough)
        else:
            hubs = mixed.select("token", F.col("hub.id").alias("other"), F.col("hub.n").alias("other_n"), F.col("hub.rest").alias("other_rest"), F.col("hub.root").alias("other_root"))
            pairs = own.join(hubs, "token").filter((F.col("root") != F.col("other_root")) & enough)
        pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        if met is not None:
            pairs = pairs.join(met, ["a", "b"], "left_anti")
        pairs = settle(may_be_similar(pairs, sets, least))
        found = verified(pairs, texts_of, least, size)
        links = settle(links.unionByName(found))
        if last:
            break
        met = pairs.select("a", "b") if met is None else met.unionByName(pairs.select("a", "b"))
    return links
