"""Token counts by rank-synchronous merging over ragged numpy arrays, and token ids for packing.

A text is cut at single spaces between two other characters; byte-level pre-tokens never
reach over such a place, so that a cut piece always has the same tokens and can be kept. The
pieces that a task has not met are pre-tokenised together and merged together: one flat
array of symbols with their sequence numbers, where each round finds the lowest-ranked pair
of every sequence and merges all its places at once. Only symbols that are left count. A
pre-token of many bytes (a text without spaces) has rounds of its own, which touch the places
of the lowest rank and their neighbours only, so that its time grows with its length.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, read_table, vocabulary

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Pieces that a task keeps with their counts, or with their ids; then it starts again with none.
KEPT, KEPT_IDS = 500_000, 350_000
#: Bytes from which on a pre-token is merged by itself.
LONG = 1024
CUT = re.compile(r" (?<=\S )(?=\S)")
# Fixed value: the pre-tokens of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)
#: White space but the space and the line feed.
WHITE = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]


def cut(text: str) -> list[str]:
    """The pieces between single spaces that stand between two other characters."""
    if text[:1] != " " and text[-1:] != " " and not ("  " in text or " \n" in text or "\n " in text or any(w in text for w in WHITE)):
        return text.split(" ")
    return CUT.split(text)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(rest.get(b, b)) for b in range(256)]


class Merges:
    """The merge table as sorted arrays: pair key to rank and merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.letters = np.array([ids[c] for c in byte_letters()], np.int64)
        keys = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], np.arange(len(keys), dtype=np.int64)[order]
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def count_long(self, pretoken: bytes) -> int:
        """Symbols that are left of one byte string: the same rounds, with the places kept by rank and the symbols linked to their neighbours."""
        symbols = self.letters[np.frombuffer(pretoken, np.uint8)]
        n = left = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.ranks(symbols[:-1], symbols[1:]), NONE)
        queue: list[int] = []
        waiting: dict[int, list[np.ndarray]] = {}

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for own in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                r = int(rank[own[0]])
                if r not in waiting:
                    waiting[r] = []
                    heappush(queue, r)
                waiting[r].append(own)

        wait(np.arange(n))
        while queue:
            r = heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            first = np.concatenate([[True], at[1:] != after[at[:-1]]])  # of a run such as a a a: every other pair, from the left
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            gone = after[at]
            symbols[at], rank[gone], after[at] = self.merged[r], NONE, after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left -= len(at)
            near = np.unique(np.concatenate([at, before[at]]))
            near = near[near >= 0]
            rank[near] = NONE
            near = near[after[near] < n]
            rank[near] = self.ranks(symbols[near], symbols[after[near]])
            wait(near)
        return left

    def count(self, pretokens: list[bytes], long: int = LONG) -> np.ndarray:
        """Symbols that are left of each byte string (none of them empty)."""
        if any(len(p) > long for p in pretokens):
            out = np.zeros(len(pretokens), np.int64)
            short = [i for i, p in enumerate(pretokens) if len(p) <= long]
            out[short] = self.count([pretokens[i] for i in short], long) if short else 0
            for i, p in enumerate(pretokens):
                if len(p) > long:
                    out[i] = self.count_long(p)
            return out
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        left = sizes.copy()
        symbols = self.letters[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(pretokens)), sizes)
        while len(symbols) > 1:
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.ranks(symbols[:-1], symbols[1:]), NONE)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            each = np.repeat(best, lengths)
            at = np.flatnonzero((rank == each) & (each != NONE))
            if not len(at):
                break
            first = np.concatenate([[True], np.diff(at) != 1])  # of a run such as a a a: every other pair, from the left
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            stay = each != NONE
            stay[at + 1] = False
            np.subtract.at(left, owner[at], 1)
            symbols, owner = symbols[stay], owner[stay]
        return left


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Token counts of texts, as the vocabulary's library gives them without added tokens; special strings count as one token."""

    def __init__(self, path: str, kept: int = KEPT):
        import regex

        self.table, self.kept, self.most = merges(path), {}, kept
        self.pretoken = regex.compile(PRETOKEN)
        self.special = re.compile("|".join(map(re.escape, sorted(self.table.special, key=len, reverse=True)))) if self.table.special else None

    def fresh(self, pieces: list[str]) -> list[int]:
        """Counts of pieces, without the kept ones."""
        counts, owner, found = np.zeros(len(pieces), np.int64), [], []
        for i, piece in enumerate(pieces):
            parts = [piece]
            if self.special and self.special.search(piece):
                parts = self.special.split(piece)
                counts[i] += len(parts) - 1
            for part in parts:
                own = self.pretoken.findall(part)
                found += own
                owner += [i] * len(own)
        if found:
            distinct: dict[str, int] = {}
            at = np.fromiter((distinct.setdefault(x, len(distinct)) for x in found), np.int64, len(found))
            counts += np.bincount(np.array(owner), self.table.count([x.encode() for x in distinct])[at], len(pieces)).astype(np.int64)
        return counts.tolist()

    def __call__(self, texts: list[str]) -> list[int]:
        kept = self.kept
        pieces_of = [cut(t.encode("utf-8", "replace").decode()) for t in texts]
        new: set[str] = set()
        for pieces in pieces_of:
            new |= set(pieces[1:]).difference(kept)
        if len(kept) + len(new) > self.most:
            kept.clear()
            new = {p for pieces in pieces_of for p in pieces[1:]}
        names = list(new)
        firsts = [p[0] for p in pieces_of]  # without a space before them
        counts = self.fresh([" " + x for x in names] + firsts)
        kept.update(zip(names, counts))
        return [n + sum(map(kept.__getitem__, pieces[1:])) for n, pieces in zip(counts[len(names) :], pieces_of)]


class Encoder:
    """Token ids of texts as little-endian 16-bit bytes, by the same cuts; the vocabulary has under 65,536 ids."""

    def __init__(self, path: str, kept: int = KEPT_IDS):
        import tiktoken

        table = merges(path)
        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(back[c] for c in token): i for token, i in ids.items() if token not in table.special}
        assert max(ids.values()) < 1 << 16
        self.bpe = tiktoken.Encoding("given", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=table.special)
        self.kept, self.most = {}, kept
        if any("<|" not in x for x in table.special):
            raise ValueError("special tokens are looked for by <|")

    def ids(self, piece: str) -> bytes:
        ids = self.bpe.encode(piece, allowed_special="all") if "<|" in piece else self.bpe.encode_ordinary(piece)
        return struct.pack(f"<{len(ids)}H", *ids)

    def __call__(self, text: str) -> bytes:
        pieces, kept = cut(text.encode("utf-8", "replace").decode()), self.kept
        first = self.ids(pieces[0])
        del pieces[0]
        if len(kept) > self.most:
            kept.clear()
        found = list(map(kept.get, pieces))
        if None in found:
            for i, p in enumerate(pieces):
                if found[i] is None:
                    found[i] = kept[p] = self.ids(" " + p)
        return first + b"".join(found)


@lru_cache(maxsize=1)
def kept_encoder(path: str) -> Encoder:
    """The encoder that a Python worker keeps, with its pieces, for the tasks that it runs after one another."""
    return Encoder(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: ``keep``, UTF-8 bytes, tokens, and whether there are more than ``limit``.

    ``path`` names a byte-level vocabulary (a .json file that every executor has). A null text
    counts as an empty one (0 bytes, 0 tokens); repeated rows are counted again; an empty
    table gives no rows; other columns are ignored. No shuffle; a task keeps a bounded number
    of pieces.
    """
    path = path or vocabulary(VOCABULARY)

    def build():
        count = Counter(path)
        return lambda texts: [(len(t.encode("utf-8", "replace")), n, n > limit) for t, n in zip(texts, count(texts))]

    return map_texts(docs, keep, "n_bytes long, n_tokens long, over_limit boolean", build)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents, whole; see ``count_tokens`` for nulls, empty and long texts, and repeated rows."""
    return count_tokens(read_table(spark, sf_dir, "documents"))
