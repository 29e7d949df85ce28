"""Near copies: SimHash links from tiles, completed by an exact join of word shingles, so that no link depends on a radius.

Two texts link if the 64-bit fingerprints of their 4-word shingles differ in at most 4 bits
(compared by tiles, as in ``simhash``), or if the Jaccard similarity of their sets of 5-word
shingles is 0.8 or more. The second kind is found whole, by prefixes of the
sets (``operators.similar``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.similar import LEAST, ROUNDS, WORDS, frequencies, parities, rare_first, set_id, shingle_hashes, shingle_set, similar_links

from .common import durable, map_texts, near, whole_text
from .components import connected
from .simhash import RADIUS, SHINGLE, fingerprint, near_links


def sketches(docs: DataFrame, keep: tuple[str, ...], size: int, least: tuple[int, int]) -> DataFrame:
    """``keep, id, n, fp, parity, prefix``: a set's id (a hash of it), size, parities and prefix, and the text's fingerprint."""
    sent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size))

    def build():
        counts = sent.value

        def rows(texts):
            out = []
            for t in texts:
                s = shingle_set(t, size)
                out.append((set_id(s), len(s), fingerprint(shingle_hashes(t, SHINGLE)), parities(s), rare_first(s, counts, least).view(np.int64).tolist() if len(s) else []))
            return out

        return rows

    return map_texts(docs, keep, "id long, n long, fp long, parity binary, prefix array<long>", build)


def fingerprint_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: a spanning set of the links between the ``id`` of rows whose fingerprints are within ``radius``."""
    pairs = durable(rows.groupBy("id", "fp").agg(F.count(F.lit(1)).alias("n")))
    classes = durable(pairs.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("ids")))
    first = classes.select("fp", "first")
    links = near_links(classes, radius).join(first.toDF("a", "first_a"), "a").join(first.toDF("b", "first_b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    shared = pairs.join(near(classes.filter("ids > 1").select("fp", "first")), "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return durable(links.unionByName(shared).filter("a <> b").distinct())


def keep_one_of_similar(docs: DataFrame, size: int = WORDS, least: tuple[int, int] = LEAST, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with all its columns, less the rows whose component has a smaller row.

    Texts link if the Jaccard similarity of their sets of ``size``-word shingles is ``least``
    (numerator, denominator) or more, or if their fingerprints differ in at most ``radius`` bits;
    no link is lost. Rows are told apart by doc_id and text, in the order of doc_id (null last),
    so that of several texts with one doc_id only the near copies go; repeated rows of one
    doc_id and text share their fate. Null and empty texts, and others without words, are
    copies of one another. Words are split at white space, ASCII in lower case; very long texts
    are read whole. Shingles and sets are known by 64-bit hashes. An empty table gives no rows;
    further columns may have any names. ``rounds`` changes cost, never results.
    """
    key = F.xxhash64(whole_text())
    keyed = docs.select("doc_id", key.alias("text_key"), "text")
    rows = durable(sketches(keyed, ("doc_id", "text_key"), size, least))
    named = rows.select("id", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key").alias("row"))
    best = durable(named.groupBy("id").agg(F.min("row").alias("best"), F.max("row").alias("last")))
    sets = durable(rows.groupBy("id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")))

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = best.join(near(durable(ids)), "id", "left_semi").select(F.col("best.doc_id").alias("__id"), F.col("best.text_key").alias("__key"))
        return keyed.join(near(durable(wanted)), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left_semi")

    links = similar_links(sets, fingerprint_links(rows, radius), texts_of, least, size, rounds)
    nodes = best.select("id", "best")
    ends = links.join(nodes.toDF("a", "best_a"), "a").join(nodes.toDF("b", "best_b"), "b")
    moved = connected(ends.select(F.col("best_a").alias("a"), F.col("best_b").alias("b")))  # to the smallest row
    fate = best.join(near(moved), F.col("best") == F.col("node"), "left").filter("root is not null or best <> last").select("id", F.coalesce("root", "best").alias("stays"))
    lost = durable(named.join(near(durable(fate)), "id").filter("row <> stays").select("row.doc_id", "row.text_key").distinct())
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("held_id"), key.alias("held_key"))
    gone = F.col("held_id").eqNullSafe(F.col("lost_id")) & (F.col("held_key") == F.col("lost_key"))
    return held.join(near(lost.toDF("lost_id", "lost_key")), gone, "left_anti").select("row.*")
