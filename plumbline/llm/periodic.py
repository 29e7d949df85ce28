"""Periodic runs of words: seed-and-extend along the diagonals of a document's self-comparison.

A run of smallest period q and length l repeats its words at lag q over l - q places, at least
5 of them if q is 1 and 3 * q else: the least overlap that is guaranteed. Seeds are k-grams of
that length, one length for the lags 1, 2 to 3, 4 to 7, and so on. As k is never below q, two
occurrences of a run's k-gram that follow each other are exactly q apart, so that only
neighbouring occurrences need be paired: there are fewer pairs than words at each length. A
table of each lag's furthest covered place drops seeds inside of what has been extended.

The first k-grams are found by 64-bit hashes, which can only let too many through; from there on
k-grams are exact numbers, and longer ones are looked for only where shorter ones repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, whole_text

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 6, 4
#: Words that a task looks at together (a longer document is looked at by itself), and rows that it turns into text at a time.
WORDS_AT_ONCE, ROWS_AT_ONCE = 1_000_000, 1000


def repeated(group: np.ndarray) -> np.ndarray:
    """Which entries of an array of numbers occur more than once."""
    order = np.argsort(group, kind="stable")
    same = group[order][1:] == group[order][:-1]
    out = np.zeros(len(group), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def ranks(*columns: np.ndarray) -> np.ndarray:
    """One number for each different row of the columns (of numbers below 2**31, not negative)."""
    out = columns[0]
    for c in columns[1:]:
        out = np.unique(out * np.int64(1 << 31) + c, return_inverse=True)[1].astype(np.int64)
    return out


def seeds(words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (places, lags) of neighbouring occurrences of k-grams within a document, for each length k."""
    k = 5
    if len(words) < k:
        return
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = doc[:n].astype(np.uint64)
        for i in range(k):
            h = (h ^ words[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    at = np.flatnonzero((doc[:n] == doc[k - 1 :]) & repeated(h))
    gram = ranks(doc[at], *[words[at + i] for i in range(k)])
    low = 1
    while True:
        keep = repeated(gram)
        at, gram = at[keep], gram[keep]
        if not len(at):
            return
        order = np.lexsort((at, gram))
        place, lag = at[order][:-1], np.diff(at[order])
        near = (np.diff(gram[order]) == 0) & (lag >= low) & (lag < 2 * low)
        yield place[near], lag[near]
        # the next length: 5 to 6 by one word, then by doubling, where both halves repeat
        step = 1 if k == 5 else k
        follows = np.searchsorted(at, at + step)
        has = (follows < len(at)) & (at[np.minimum(follows, len(at) - 1)] == at + step)
        at, gram = at[has], ranks(gram[has], gram[follows[has]])
        k, low = k + step, 2 * low


def extent(words: np.ndarray, place: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The first and the last place + 1 of the words around ``place`` that are like those ``lag`` further, within low to high."""
    start, width = place, 64
    while start > low:
        a = max(low, start - width)
        bad = np.flatnonzero(words[a:start] != words[a + lag : start + lag])
        if len(bad):
            start = a + int(bad[-1]) + 1
            break
        start, width = a, 2 * width
    end, width, last = place, 64, high - lag
    while end < last:
        b = min(last, end + width)
        bad = np.flatnonzero(words[end:b] != words[end + lag : b + lag])
        if len(bad):
            end += int(bad[0])
            break
        end, width = b, 2 * width
    return start, end


def runs_of(words: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each document (``bounds``: where it starts, and the end) its runs as (start, length, period) by start, then period."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    for places, lags in seeds(words, doc):
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        fresh = np.ones(len(places), bool)  # seeds side by side on one diagonal: the first stands for all
        fresh[1:] = (np.diff(places) != 1) | (np.diff(lags) != 0)
        covered: dict[int, int] = {}
        for place, lag in zip(places[fresh].tolist(), lags[fresh].tolist()):
            if place < covered.get(lag, 0):
                continue
            d = int(doc[place])
            low, high = int(bounds[d]), int(bounds[d + 1])
            start, end = extent(words, place, lag, low, high)
            covered[lag] = end
            length = end - start + lag
            if length >= max(LEAST, TIMES * lag):
                found[d].append((start - low, length, lag))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Which of n words no run holds after its first period; None for all."""
    if not runs:
        return None
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def scan(texts: list[str]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]], bytes]]:
    """Of each text its words, its runs, and what is left of it with single spaces."""
    i = 0
    while i < len(texts):
        number: dict[bytes, int] = {}
        own, ids, total = [], [], 0
        while i < len(texts) and (not own or total < WORDS_AT_ONCE):
            w = texts[i].encode("utf-8", "surrogatepass").split()  # bytes split at 20 and 09-0D only
            own.append(w)
            ids.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w)))
            total += len(w)
            i += 1
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in own])]).astype(np.int64)
        for w, runs in zip(own, runs_of(np.concatenate(ids), bounds)):
            keep = kept_words(len(w), runs)
            yield w, runs, b" ".join(w if keep is None else [x for x, k in zip(w, keep.tolist()) if k])


def periodic_runs(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """``doc_id, runs, collapsed`` for each row of ``docs``.

    ``runs`` are (start, length, period) in words, by start, then period; ``collapsed`` is the
    text without the words that a run holds after its first period, between single spaces. A
    null text is an empty one; it and texts without words have no runs. A place may be in runs
    of several periods; each stands for itself. Repeated rows are returned again, null ids
    kept; an empty table gives no rows; other columns are ignored. Very long texts are read
    whole; a task holds the words of one text, or of about a million, at a time.
    """
    narrow = docs.select("doc_id", (whole_text() if text is None else text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = [(runs, rest.decode("utf-8", "surrogatepass")) for _, runs, rest in scan(part.column(1).to_pylist())]
                found = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs, _ in rows], pa.list_(item))
                yield pa.RecordBatch.from_arrays([part.column(0), found, pa.array([t for _, t in rows], pa.string())], names=["doc_id", "runs", "collapsed"])

    return narrow.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(text: Column) -> Column:
    """The text of every document whose crc32 of doc_id ends in 0, from a word on, as a loop of its own words; the others as they are (null ids too)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    w = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(w)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    loop = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))  # no lambda: it would split the text for each word
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), loop), F.lit(1), n), " ")).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with a loop laid in; see ``periodic_runs`` for nulls, ties, and repeated rows."""
    found = periodic_runs(read_table(spark, sf_dir, "documents"), looped(whole_text()))
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
