"""Secret scan: fixed patterns, and strings that a primed compressor finds nothing known in.

A candidate is a long run of key characters with a sensitive word shortly before it, or the
next line of one. It is scored by blocks, which share what stands before the first. Its
novelty is the number of bytes that it adds to the compressed form of the code around it,
divided by its length; the compressor is zstandard, primed with a dictionary of identifiers:
a few fixed words, and those that occur most often in all of the documents. Names, paths and
repeated strings cost few bytes, keys cost nearly all of theirs. Candidates at or above the
threshold are reported besides the base spans, which are scored as well.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, read_table, whole_text

# The base patterns and least lengths.
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive.
SENSITIVE = "auth bearer credential private apikey access_key secret token passw passphrase passcode pwd signature session signing client_id license_key webhook cookie jwt otp nonce dsn connection_string (?<![a-z])key(?![a-z])"
#: The prefix that primes the compressor: identifiers and words that code and prose repeat.
IDENTIFIERS = (
    "import from return function class public static private const value default config settings environment variable "
    "https http www example com org net index html json yaml string integer boolean list array object null true false "
    "username password email address account number version release description documentation application service "
    "get set put post delete update insert select where order group by limit user_id client_id request response header "
    "authorization bearer basic content type length accept encoding abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx XXXXXXXX the and that with this from have for not "
)
CANDIDATE = r"[A-Za-z0-9+/_=.-]{16,}"
#: A name with its sign of equality before a key, in one run of characters; characters of a key, and of one without digits, which has letters of either case.
NAMED, KEY_LEAST, LETTERS_LEAST = r"(?:[A-Za-z_][A-Za-z0-9_.-]*=)+(?=[^=])", 16, 20
#: An identifier that the dictionary may take, and the bytes that it holds at most (zstandard looks no further back in short texts).
IDENTIFIER, DICTIONARY_BYTES = r"[A-Za-z_]{4,40}(?![A-Za-z0-9_])", 32_768
#: The least novelty of what is reported: random keys have 0.8 to 1.1 bytes a character, names of known words mostly 0.4 to 0.8.
LEAST = 0.8
#: Characters that are scored at a time, what may stand between the lines of one key, and a key's short last line.
BLOCK, NEXT_LINE = 200, r"[ \t]*\r?\n[ \t]*"
LAST_LINE = NEXT_LINE + r"([A-Za-z0-9+/_=]{1,19})(?=" + NEXT_LINE + "-----END)"


class Novelty:
    """Marginal compressed bytes of a candidate, given the text around it and the identifier dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        import zstandard

        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._zstd = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False)

    def __call__(self, candidate: str, around: str) -> float:
        known = around.encode("utf-8", "replace")
        own = candidate.encode("utf-8", "replace")
        return (len(self._zstd.compress(known + b" " + own)) - len(self._zstd.compress(known))) / max(1, len(own))


def common_identifiers(docs: DataFrame, size: int = DICTIONARY_BYTES, held: int = 200_000) -> str:
    """The identifiers without digits that occur most often in all texts, the most frequent last, up to ``size`` characters.

    A task sums up before the shuffle and holds at most ``held`` of them; only the list is collected.
    """
    word = re.compile(r"(?<![A-Za-z0-9_+/=-])" + IDENTIFIER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

        own: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                own.update(word.findall(text))
                if len(own) > held:
                    yield flushed()
                    own.clear()
        if own:
            yield flushed()

    counts = docs.select(whole_text().alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    rows = counts.orderBy(F.desc("n"), "word").limit(size // 5).collect()
    kept, room = [], size
    for r in rows:
        room -= len(r.word) + 1
        if room < 0:
            break
        kept.append(r.word)
    return " ".join(kept[::-1])


class Scanner:
    def __init__(self, novelty: float = LEAST, before: int = 48, around: int = 400, identifiers: str = ""):
        self.assign, self.access, self.hex, self.candidate = map(re.compile, (ASSIGN, ACCESS, HEX, CANDIDATE))
        self.named = re.compile(NAMED)
        self.sensitive = re.compile("|".join(SENSITIVE.split()))
        self.next_line, self.last_line = re.compile(NEXT_LINE), re.compile(LAST_LINE)
        self.least, self.before, self.around, self.measure = novelty, before, around, Novelty(f"{identifiers} {IDENTIFIERS}")

    def bound(self, n: int) -> float:
        """The least novelty of n characters; of long ones the compressor learns the alphabet, six bits a character of random ones."""
        return self.least - 0.1 * min(1.0, n / BLOCK)

    def marginal(self, text: str, a: int, b: int) -> float:
        """The novelty of text[a:b] between what stands around it."""
        return self.measure(text[a:b], text[max(0, a - self.around) : a] + text[b : b + self.around // 4])

    def known(self, text: str, span: tuple[int, int, int]) -> tuple[float, bool]:
        """The novelty of a base span's value, of its first block, and whether it would do for a candidate."""
        a, kind, b = span
        if kind == 0:
            a = self.assign.match(text, a).start(2)
        b = min(b, a + BLOCK)
        found = self.marginal(text, a, b)
        return found, found >= self.bound(b - a)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the base spans."""
        found, low = [], text.encode("utf-8", "surrogatepass").lower()
        if any(x in low for x in (b"passw", b"secret", b"token", b"api")):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        return found + [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]

    def novel(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found, starts, reach = [], [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
        stop, inherits = 0, False
        for m in self.candidate.finditer(text):
            e = m.start() + len(m[0].rstrip("."))
            name = self.named.match(text, m.start(), e)
            s = name.end() if name else m.end() - len(m[0].lstrip("."))
            if e - s < KEY_LEAST:
                continue
            body = text[s:e]
            further = inherits and self.next_line.fullmatch(text, stop, s) is not None  # a further line of a key
            further_dense = further and bool(found) and found[-1][2] == stop
            inherits = further or self.sensitive.search(text[max(0, s - self.before) : s].lower()) is not None
            stop = e
            if not inherits or not any(c.isalpha() for c in body) or not any(c.isdigit() for c in body) and not (len(body) >= LETTERS_LEAST and any(c.isupper() for c in body) and any(c.islower() for c in body)):
                continue
            last = None
            cuts = [*range(s, max(s + 1, e - 63), BLOCK), e]  # a rest of under 64 characters goes with the block before it
            for a, b in zip(cuts, cuts[1:]):
                if (k := bisect_left(starts, b)) and reach[k - 1] > a:  # a base span has some of it
                    continue
                if self.marginal(text, a, b) >= self.bound(b - a) - 0.15 * (last == a or further_dense):  # what goes on shares the alphabet
                    if last == a:
                        found[-1] = (found[-1][0], 3, b)
                    else:
                        found.append((a, 3, b))
                    last = b
            if last == e and (tail := self.last_line.match(text, e)) and not ((k := bisect_left(starts, tail.end(1))) and reach[k - 1] > tail.start(1)):
                found.append((tail.start(1), 3, tail.end(1)))
        return found

    def __call__(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = sorted(self.base(text))
        return base, sorted(base + self.novel(text, base))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), novelty: float = LEAST, identifiers: str = "") -> DataFrame:
    """One row for each row of ``docs``: ``keep``, counts by kind, the base spans and all spans as text, the base spans' novelty.

    Spans are code points, end exclusive. A null text counts as an empty one (no spans, empty
    strings); repeated rows are scanned and returned again; an empty table gives no rows; other
    columns are ignored. Candidates have any length; neighbouring blocks that are reported are
    one span. ``identifiers`` is what the compressor knows besides the fixed words (see
    ``common_identifiers``); ``n_dense`` counts base spans of the threshold or more. No shuffle.
    """

    def build():
        scan = Scanner(novelty, identifiers=identifiers)

        def rows(texts):
            out = []
            for text in texts:
                base, spans = scan(text)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                scores = [scan.known(text, x) for x in base]
                out.append((*n, sum(dense for _, dense in scores), spans_text(base), spans_text(spans), ",".join(f"{x:.2f}" for x, _ in scores)))
            return out

        return rows

    return map_texts(docs, keep, "n_assign long, n_access long, n_hex long, n_novel long, n_dense long, base_spans string, spans string, base_novelty string", build)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All documents, the compressor primed with their own identifiers."""
    docs = read_table(spark, sf_dir, "documents")
    found = scan_secrets(docs, identifiers=common_identifiers(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_novel", "n_dense", "base_novelty")


def base_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(spans_text(spans).encode()).hexdigest()
