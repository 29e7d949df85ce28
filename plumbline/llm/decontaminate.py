"""Benchmark decontamination: one automaton over all windows of the benchmark's texts, each document read once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_texts, read_table, small_batches, whole_text, word_bytes

WINDOW = 10
#: UTF-8 bytes of benchmark text that one automaton holds and that the driver and a broadcast hold at a time; a larger benchmark is scanned in several passes.
AUTOMATON_BYTES = 2_000_000


def windows(words: list[bytes], width: int = WINDOW) -> list[list[bytes]]:
    """Every ``width`` consecutive words; fewer words, but some, are one window."""
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []


class Matcher:
    """Windows of (item id, text) pairs, matched as whole words: the automaton's symbols are word numbers, 0 for words that no item has."""

    def __init__(self, items: list[tuple[object, str]], width: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        known: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for w in windows(word_bytes(text or "")[1], width):
                known.setdefault(tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w), set()).add(str(item))
        self.windows = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if known else None
        if known:
            for w, own in known.items():
                self.windows.add_word(w, (len(w), own))
            self.windows.make_automaton()

    def __call__(self, text: str) -> tuple[int, np.ndarray, list[str]]:
        """(number of words, indices of the words hit, the items' ids sorted as strings)."""
        words = word_bytes(text)[1]
        found = list(self.windows.iter(tuple([self.numbers.get(w, 0) for w in words]))) if self.windows is not None and words else []
        if not found:
            return len(words), np.empty(0, int), []
        depth = np.zeros(len(words) + 1, int)
        items: set[str] = set()
        for last, (n, own) in found:
            depth[last - n + 1] += 1
            depth[last + 1] -= 1
            items |= own
        return len(words), np.flatnonzero(np.cumsum(depth[:-1])), sorted(items)


_KEPT: dict[str, Matcher] = {}


def kept_matcher(items: list[tuple[object, str]], width: int) -> Matcher:
    """The automaton of the items: a Python worker keeps the last one that it built, for the tasks that it runs after one another."""
    key = hashlib.sha256(repr((width, items)).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Matcher(items, width)
    return _KEPT[key]


def original_spans(text: str, hit: np.ndarray) -> str:
    """Runs of hit words as start:end in code points of the text as it was."""
    if not len(hit):
        return ""
    flat, _ = word_bytes(text)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    inside = np.concatenate([[False], np.frombuffer(flat, np.uint8) != 32, [False]])
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
    return ",".join(f"{points[starts[a]]}:{points[ends[b]]}" for a, b in zip(first, last))


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items in blocks of bounded size, one of which is on the driver at a time; at least one, be it empty."""
    now, size = [], 0
    for row in benchmark.select("item_id", whole_text().alias("text")).toLocalIterator():
        own = len(row.text.encode())
        if now and size + own > most:
            yield now
            now, size = [], 0
        now.append((row.item_id, row.text))
        size += own
    yield now


def _hits_by_row(numbered: DataFrame, blocks: Iterator[list[tuple[object, str]]], width: int) -> DataFrame:
    """``__row, hit array<long>, items array<string>`` of the rows that are hit, by one pass and one broadcast for each block."""
    found = None
    for block in blocks:
        sent = numbered.sparkSession.sparkContext.broadcast(block)

        def build(sent=sent):
            match = kept_matcher(sent.value, width)
            return lambda texts: [(hit.tolist(), items) for _, hit, items in map(match, texts)]

        own = durable(map_texts(numbered, ("__row",), "hit array<long>, items array<string>", build, F.col("__text")).filter(F.size("hit") > 0))
        sent.destroy()
        found = own if found is None else found.unionByName(own)
    return found


def _numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    return durable(docs.select(*columns, whole_text().alias("__text"), F.monotonically_increasing_id().alias("__row")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """One row for each row of ``docs``: ``keep``, words, words hit, items found, and the hit spans in the original text.

    The benchmark is read once and its size is checked: up to ``most`` bytes it is one
    automaton sent to the tasks, and every document is read once without a shuffle. A larger
    one is held against the documents in as many passes as it has blocks of that size; only
    the hits of each pass are kept, by row, and joined to the documents at the end.
    Null texts count as empty and have no words; items without words match nothing; repeated
    rows are returned again; an empty table of documents gives no rows, an empty benchmark no
    hits. Other columns are ignored. ``items`` are ids sorted as strings.
    """
    blocks = _blocks(benchmark, most)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def build():
            match = kept_matcher(sent.value, width)
            return lambda texts: [(n, len(hit), len(items), items, original_spans(t, hit)) for t, (n, hit, items) in zip(texts, map(match, texts))]

        return map_texts(docs, keep, "n_words long, n_hit long, n_items long, items array<string>, spans string", build)
    kept = {f"__keep{i}": name for i, name in enumerate(keep)}
    numbered = _numbered(docs, *[F.col(f"`{name}`").alias(k) for k, name in kept.items()])
    hits = _hits_by_row(numbered, chain((block, more), blocks), width).groupBy("__row")
    found = hits.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit", "items")])  # a row has at most one entry for each block
    joined = numbered.join(found, "__row", "left").select(*kept, "__text", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hit", "array<bigint>"), ("items", "array<string>"))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hit = b.column(len(kept)).to_pylist(), [np.array(x, int) for x in b.column(len(kept) + 1).to_pylist()]
            items = b.column(len(kept) + 2)
            counts = [[len(word_bytes(t)[1]) for t in texts], [len(x) for x in hit], [len(x) for x in items]]
            spans = pa.array([original_spans(t, x) for t, x in zip(texts, hit)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [pa.array(c, pa.int64()) for c in counts] + [items, spans], names=[*kept.values(), "n_words", "n_hit", "n_items", "items", "spans"])

    kinds = "".join(f"`{name}` {joined.schema[k].dataType.simpleString()}, " for k, name in kept.items())
    return joined.mapInArrow(finish, f"{kinds}n_words long, n_hit long, n_items long, items array<string>, spans string")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with all its columns, less the rows with a word inside an occurrence of a window.

    Null, empty and wordless texts stay; repeated rows stay or go together; very long texts are
    read whole; an empty table gives no rows, an empty benchmark takes none away. No shuffle
    for one block of benchmark.
    """
    blocks = _blocks(benchmark, most)
    block, more = next(blocks), next(blocks, None)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if more is not None:
        numbered = _numbered(docs, row)
        return numbered.join(_hits_by_row(numbered, chain((block, more), blocks), width).select("__row").distinct(), "__row", "left_anti").select("row.*")
    sent = docs.sparkSession.sparkContext.broadcast(block)
    named = small_batches(docs).select(row, whole_text().alias("text"))

    def run(batches):
        match = kept_matcher(sent.value, width)
        for b in batches:
            yield b.filter(pa.array([not len(match(text)[1]) for text in b.column(1).to_pylist()], pa.bool_()))

    return named.mapInArrow(run, named.schema).select("row.*")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all of the benchmark; see ``find_contamination`` for nulls, empty tables, and repeated rows."""
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, places.n, i, item_id FROM places JOIN win USING (win) WHERE places.n = win.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
