"""What the text operators share: reading tables, mapping texts by Arrow batches, checkpoints, words."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.batches import BROADCAST_ROWS, ROWS_AT_ONCE, map_texts, near, small_batches, whole_text
from plumbline.functions.durable import settle as durable
from plumbline.functions.durable import shared_folder

__all__ = ["BROADCAST_ROWS", "ROWS_AT_ONCE", "automaton", "durable", "map_texts", "near", "phrase", "read_table", "shared_folder", "small_batches", "spaced", "spread_join", "spread_left", "vocabulary", "whole_text", "word_bytes"]

#: Upper-case ASCII to lower case; what is no digit, letter or byte of a non-ASCII character to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bytes(text: str) -> tuple[bytes, list[bytes]]:
    """A text's UTF-8 bytes with separators as spaces (each byte keeps its place), and its words.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.
    """
    flat = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    return flat, flat.split()


#: Keys that hold more than this share of all rows are told apart; there are at most so many.
HOT_KEYS = 10_000


def spread_join(rows: DataFrame, table: DataFrame, on: Column, count: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined to their row of ``table`` (one for each key, ``count``: the rows that have it), so that no key is hot.

    A table of few rows is sent to all tasks. Of a larger one only the keys that hold more than
    one of ``HOT_KEYS`` parts of all rows are, which are fewer than that; the others are shuffled.
    """
    if table.count() <= most:
        return rows.join(F.broadcast(table), on)
    total = table.agg(F.sum(count)).first()[0]
    hot = F.col(count) * HOT_KEYS > total
    few = F.broadcast(table.filter(hot))
    return rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(table.filter(~hot), on))


def spread_left(rows: DataFrame, table: DataFrame, on: Column, count: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """As ``spread_join``, but rows without a row of ``table`` stay, with nulls."""
    if table.count() <= most:
        return rows.join(F.broadcast(table), on, "left")
    hot = F.col(count) * HOT_KEYS > table.agg(F.sum(count)).first()[0]
    few = F.broadcast(table.filter(hot))
    return rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(table.filter(~hot), on, "left"))


def automaton(patterns: dict[str, object]):
    """An Aho-Corasick automaton of the patterns with their payloads; None without patterns."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for pattern, payload in patterns.items():
        found.add_word(pattern, payload)
    if not len(found):
        return None
    found.make_automaton()
    return found


def spaced(words: Sequence[bytes]) -> str:
    """Words between single spaces, one character a byte, so that a match of ' a b ' is one of whole words."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def phrase(text: str) -> str:
    """A phrase in the form that ``spaced`` gives."""
    return spaced(word_bytes(text)[1])


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; the folder can be named in PLUMBLINE_TOKENIZERS."""
    if folder := os.environ.get("PLUMBLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
