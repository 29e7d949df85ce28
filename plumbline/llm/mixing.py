"""Mixing sources to target weights: Pareto order sampling of what is left after certain whole copies. DataFrame functions only.

A source's documents get, on average, so many copies that their words come to the source's
target: more for texts of a high measure, at most ``MOST``. The whole part of that number is
certain. For the rest each document has an inclusion probability p, and documents are taken
in the order of their random odds divided by their inclusion odds, (u / (1 - u)) / (p / (1 - p)),
until the words that are left are used up: a sample of fixed size with unequal probabilities.
The last documents of a source are those whose sizes come nearest to what is then left.

No source is ever gathered: the place where the order is cut is found by sums over 4,096 ranges
of the order, then over 4,096 ranges of the one in which the sum is passed, and only what is in
one of these 16 million ranges is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, near, read_table, spread_join, whole_text

MOST, LEVELS, BINS, SEED = 3, 16, 4096, 42
#: Documents of a source, at most, that close what the order leaves.
CLOSING = 3
#: The weights that sources take in turns.
WEIGHTS = (1, 2, 3)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def distinct_share(all_words: Column) -> Column:
    """The share of a text's words that are different: what repeats itself is taken less often."""
    return F.size(F.array_distinct(all_words)) / F.greatest(F.size(all_words), F.lit(1))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` from 0 in that order: numbered within ranges, and moved by what stands before the range."""
    parts = durable(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", before.alias("__before"))  # a row for each range
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__local", local).join(F.broadcast(starts), "__part").withColumn("rank", (F.col("__local") + F.col("__before")).cast("long")).drop("__part", "__local", "__before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources(source, source_size)`` with ``sid`` (their rank by code point, null last), ``weight`` and ``target``.

    Targets share the sum of all sizes by weight; none is above ``most`` times its source's
    size, and what that leaves goes to the others by weight, until none is above. A round
    settles all sources that are above; two sums go to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    found = durable(numbered(sources, F.col("source").asc_nulls_last()).withColumn("weight", weight).withColumnRenamed("rank", "sid"))
    total, level, full = found.agg(F.sum("source_size")).first()[0] or 0, 0.0, None
    while total:
        above = level * F.col("weight") > most * F.col("source_size")
        r = found.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("source_size"))).alias("s"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if r.n == full or not r.w:
            break
        level, full = (total - most * (r.s or 0)) / r.w, r.n if level else None
    return found.withColumn("target", F.least(level * F.col("weight"), (most * F.col("source_size")).cast("double")))


def expected_copies(groups: DataFrame, most: int = MOST) -> DataFrame:
    """``groups(sid, level, words, target)`` with ``expected`` copies: in proportion to the level, at most ``most``, words times copies sum up to the target.

    A source has at most ``LEVELS`` rows. The highest levels are full; the first at which the
    rest's share stays within ``most`` gives it.
    """
    down = Window.partitionBy("sid").orderBy(F.desc("level"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("level")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rate = F.try_divide(F.col("target") - most * above, rest)
    at = F.max(F.when(F.col("rate") * F.col("level") <= most, F.struct("level", "rate"))).over(Window.partitionBy("sid"))
    return groups.withColumn("rate", rate).withColumn("at", at).withColumn("expected", F.coalesce(F.least(F.lit(float(most)), F.col("at.rate") * F.col("level")), F.lit(float(most)))).drop("rate", "at")


def order_key(u: Column, p: Column) -> Column:
    """q / (1 + q) of the odds of u divided by those of p: in the order of q, between 0 and 1; null where p is 0."""
    return F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p))


def slot(width: int) -> Column:
    return F.least(F.floor(F.col("key") * width), F.lit(width - 1)).cast("long")


def cuts(rows: DataFrame, rooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the order of ``rows(sid, key, size)`` is cut so that a source's sum stays within ``rooms(sid, room)``.

    Gives ``sid, at`` (of the fine ranges all below ``at`` are taken; null: all are), and
    ``sid, key, size, m, n, room``: of the n rows of that key, in range ``at`` or the last one
    of a source, m are taken.
    """
    now, inside = rooms.select("sid", "room", F.lit(0).cast("long").alias("before")), rows
    for width in (BINS, BINS * BINS):
        sums = inside.withColumn("slot", slot(width)).groupBy("sid", "slot").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("sid").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
        passed = sums.withColumn("upto", upto).join(near(now.select("sid", "room", "before")), "sid").withColumn("upto", F.col("before") + F.col("upto")).filter("upto > room")
        now = durable(passed.groupBy("sid").agg(F.min("slot").alias("slot"), F.min("room").alias("room"), F.min_by(F.col("upto") - F.col("words"), F.col("slot")).alias("before")))
        inside = inside.select("sid", "key", "size", slot(width).alias("slot")).join(near(now.select("sid", "slot")), ["sid", "slot"]).drop("slot")
    at = now.select("sid", F.col("slot").alias("at"))
    groups = inside.groupBy("sid", "key", "size").agg(F.count(F.lit(1)).alias("n")).join(near(now.select("sid", "room", "before")), "sid")
    ahead = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("sid").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("before") + F.coalesce(ahead, F.lit(0))
    m = F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("room") - start) / F.col("size"))))
    return at, durable(groups.withColumn("m", m.cast("long")).select("sid", "key", "size", "m", "n", "room", (F.col("m") * F.col("size")).alias("words"), "before"))


def last_ones(rows: DataFrame, at: DataFrame, partly: DataFrame) -> DataFrame:
    """``sid, key, size``: for each source the rows not yet taken that close what is left, each the one whose size comes nearest to it."""
    keys = ["sid", "key", "size"]
    left = durable(partly.groupBy("sid").agg((F.min("room") - F.min("before") - F.sum("words")).alias("left")))
    open_ = rows.withColumn("slot", slot(BINS * BINS)).join(near(at), "sid").filter("slot > at or slot = at and size > 0").select(*keys, (F.col("slot") == F.col("at")).alias("inner"))
    inner = open_.filter("inner").join(near(partly.select(*keys, "m", "n")), keys).filter("m < n").select(*keys)
    open_ = open_.filter("not inner").select(*keys).unionByName(inner).join(near(left), "sid").filter(F.col("size") < 2 * F.col("left"))
    open_, chosen = durable(open_.groupBy(*keys).agg(F.first("left").alias("left"))), None
    for _ in range(CLOSING):
        gap = F.abs(F.col("left") - F.col("size"))
        best = open_.filter(gap < F.col("left")).groupBy("sid").agg(F.min(F.struct(gap.alias("gap"), "key", "size")).alias("b"), F.first("left").alias("left"))
        best = durable(best.select("sid", "b.key", "b.size", (F.col("left") - F.col("b.size")).alias("left")))
        chosen = best.select(*keys) if chosen is None else chosen.unionByName(best.select(*keys))
        open_ = open_.drop("left").join(near(best.select("sid", "left")), "sid").join(near(best.select(*keys)), keys, "left_anti")
    return chosen


class Mixture:
    """What a mixture takes of each source and level, and where each source's order is cut: tables of a few rows for each source."""

    def __init__(self, rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST):
        """``rows``: ``source, size, level, u``, written once."""
        groups = durable(rows.groupBy("source", "level").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
        sources = durable(targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most))
        named = groups.withColumnRenamed("source", "__source").join(near(sources), F.col("__source").eqNullSafe(F.col("source"))).drop("__source")
        self.groups = durable(expected_copies(named, most).select("source", "level", "sid", "n", "words", "source_size", "target", "expected"))
        rooms = self.groups.groupBy("sid").agg((F.min("target") - F.sum(F.floor("expected") * F.col("words"))).alias("room"))
        drawn = durable(self.placed(rows).filter("key is not null and size > 0").select("sid", "key", "size"))
        at, partly = cuts(drawn, durable(rooms))
        last = last_ones(drawn, at, partly).withColumn("more", F.lit(1))
        keys = ["sid", "key", "size"]
        taken = partly.select(*keys, "m").unionByName(last.select(*keys, F.col("more").cast("long").alias("m")))
        self.parts = durable(taken.groupBy(*keys).agg(F.sum("m").alias("m")))
        self.at = durable(self.groups.select("sid").distinct().join(at, "sid", "left"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their source's and level's numbers and their ``key``."""
        own = self.groups.withColumnsRenamed({"source": "__source", "level": "__level"})
        same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("level") == F.col("__level"))
        found = spread_join(rows, own, same, "n").drop("__source", "__level", "n", "words")
        return found.withColumn("key", order_key(F.col("u"), F.col("expected") - F.floor("expected")))

    def copies(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``copies``. Of rows that are alike in doc_id and text any may be the ones that are taken once more."""
        keys = ["sid", "key", "size"]
        place = self.placed(rows).join(near(self.at), "sid").join(near(self.parts), keys, "left")
        sure = F.floor("expected").cast("long")
        plain = F.when(F.col("key").isNotNull() & (F.col("size") > 0) & (F.col("at").isNull() | (slot(BINS * BINS) < F.col("at"))), sure + 1).otherwise(sure)
        ties = durable(place.filter("m is not null").withColumn("__part", F.spark_partition_id()))
        counts = ties.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("u"))  # alike; split by where they are
        told = ties.withColumn("__local", local).join(near(counts.select(*keys, "__part", before.alias("__before"))), [*keys, "__part"])
        told = told.withColumn("copies", F.when(F.col("__local") + F.col("__before") <= F.col("m"), sure + 1).otherwise(sure)).drop("__part", "__local", "__before")
        return place.filter("m is null").withColumn("copies", plain).unionByName(told.select(*place.columns, "copies"))


def _rows(docs: DataFrame, measure, seed: int, *more: Column) -> DataFrame:
    """What the mixture looks at, of each document; ``u`` is drawn from its doc_id and text."""
    w = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words(whole_text()).alias("w"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", whole_text()), 11).alias("h"), *more)
    level = F.lit(LEVELS) if measure is None else F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.ceil(measure(F.col("w")) * LEVELS)))
    return w.select("doc_id", "source", F.size("w").cast("long").alias("size"), level.cast("int").alias("level"), ((F.col("h") + 0.5) / float(1 << 53)).alias("u"), *[F.col(c) for c in w.columns[4:]])


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, measure=distinct_share, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, expected`` for each row of ``docs``.

    ``size`` is the number of words, ``target`` that of the document's source, ``expected`` the
    copies that a document has on average, ``taken`` the words of its copies. ``measure``
    makes of the array of words a number up to 1 (None: all documents alike). A null text is
    an empty one; texts without words are taken zero words; rows without source are a source
    of their own, the last one. Runs agree, whatever the order and the partitions of the rows:
    what is drawn depends on seed, doc_id and text. Repeated rows are drawn alike, and where
    only some of them fit in, any of them. An empty table gives no rows; other columns are
    ignored; very long texts are read whole.
    """
    rows = durable(_rows(docs, measure, seed))
    found = Mixture(rows, weights, most).copies(rows)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "expected")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, measure=distinct_share, seed: int = SEED, copy: str = "copy") -> DataFrame:
    """``docs`` with all its columns as often as the mixture takes them, and the number of the copy, from 1, in the column ``copy``.

    As ``mixture`` for nulls, ties and repeated rows. Documents without words go. Texts are not
    shuffled while the sources are few. A column that is named like ``copy`` is replaced.
    """
    rows = durable(_rows(docs, measure, seed))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != copy]).alias("row")
    found = Mixture(rows, weights, most).copies(_rows(docs, measure, seed, whole)).filter("copies > 0 and size > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("row.*", F.col("__copy").alias(copy))


def op11_mixture(spark, sf_dir: str) -> DataFrame:
    """All documents, sources of weight 1, 2 and 3 in turns, less of texts that repeat themselves; see ``mixture`` for nulls, ties, and repeated rows."""
    return mixture(read_table(spark, sf_dir, "documents"))
