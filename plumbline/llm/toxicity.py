"""Toxicity: a weighted lexicon, matched by one automaton after folding look-alike characters and digits.

The lexicon holds whole words and word beginnings. An entry has two weights, for texts that
have it once and for those that repeat it: log odds of that in toxic against other labelled
texts, learned from a bounded sample of labelled rows, besides a few fixed words. A match
inside an exception phrase does not count. The sum over entries, and the same normalised by
length, go into a small logistic model. It is fitted on scores by lexicons that have not seen
the text (one for each fold of the sample), so that it learns what an entry is worth on new
texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, automaton, durable, map_texts, read_table, small_batches, whole_text

#: Labelled rows that the model is fitted on, at most: those with the smallest hash of doc_id.
SAMPLE = 12_000
THRESHOLD = 0.3
#: Parts of the sample, each scored by a lexicon of the others.
FOLDS = 4
#: Least log odds of an entry. Its log likelihood ratio must pass the logarithm of the number of
#: features that were looked at (one of no meaning would by chance); repeats may fall short of it by some.
LEAST_WEIGHT, REPEAT_SLACK = 1.5, 4.0
#: Features that a task holds before it hands their counts on.
HELD = 50_000
BEGINNINGS = (3, 4, 5, 6, 7, 8, 9)
# Words that are toxic before any label is seen, and phrases in which a word is not.
WORDS = "idiot moron stupid scum loser trash pathetic worthless disgusting clown"
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash collection", "trash pickup", "trash talk radio", "empty the trash", "take out the trash",
    "clown fish", "rodeo clown", "circus clown", "birthday clown", "class clown award", "sore loser rule", "winner and loser", "winners and losers", "pond scum", "soap scum", "worthless check",
)
# Digits and signs that stand for letters, and letters that look like Latin ones.
ALIKE = {
    **dict(zip("0123456789", "oizeasgtbg")),
    **dict(zip("аеорсухіјѕԁһкмтвнг", "aeopcyxijsdhkmtbhr")),
    **dict(zip("αεορικντυχβ", "aeopikvtuxb")),
    **{c: "" for c in "\u200b\u200c\u200d\u2060\ufeff\u00ad"},
}
SIGNS = dict(zip("!|$@", "ilsa"))
#: A sign inside a word or at its beginning; letters of one word with signs between all of them.
INNER = re.compile(r"(?:(?<=[^\W_])|(?<!\S))[!|$@](?=[^\W\d_])")
SPELT = re.compile(r"(?<![^\W_])[^\W_](?:[.\-_*][^\W_]){2,}(?![^\W_])")
#: What a character becomes: signs separate words, combining marks go.
FOLDING = (
    {i: " " for i in [*range(128), *range(0xA0, 0xC0), *range(0x2000, 0x2070), *range(0x3000, 0x3020)] if not chr(i).isalpha()}
    | dict.fromkeys(range(0x300, 0x370))
    | str.maketrans(ALIKE)
)


def fold_line(text: str) -> str:
    """The folded words between single spaces."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low).lower()
    if any(c in low for c in SIGNS):
        low = INNER.sub(lambda m: SIGNS[m[0]], low)
    if SPELT.search(low):
        low = SPELT.sub(lambda m: re.sub(r"[.\-_*]", "", m[0]), low)
    return " " + " ".join(low.translate(FOLDING).split()) + " "


def features(line: str) -> Counter:
    """How often ' word ' occurs, for whole words, and ' begin', for beginnings."""
    out: Counter = Counter()
    for word, n in Counter(line.split()).items():
        if len(word) > 2:
            out[f" {word} "] += n
        for k in BEGINNINGS:
            if len(word) > k:
                out[f" {word[:k]}"] += n
    return out


class Lexicon:
    """Scores of folded lines: each word counts for the heaviest entry that matches it, outside of exceptions."""

    def __init__(self, weights: dict[str, tuple[float, float]], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights = weights
        entries: dict[str, tuple[int, float, str | None]] = {e: (len(e), sum(w), e) for e, w in weights.items()}
        self.found = automaton(entries | {f" {x} ": (len(x) + 2, 0.0, None) for x in exceptions})

    def __call__(self, line: str) -> tuple[float, int]:
        """(sum of the entries' weights, words that count)."""
        at: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight, entry) in self.found.iter(line):
            start = end - n + 1
            if entry is None:
                spared.append((start, end))
            elif start not in at or (weight, entry) > at[start]:
                at[start] = (weight, entry)
        if spared:
            inside: set[int] = set()
            for a, b in spared:
                inside.update(range(a, b))
            at = {s: w for s, w in at.items() if s not in inside}
        counts = Counter(entry for _, entry in at.values())
        return sum(self.weights[e][n > 1] for e, n in counts.items()), len(at)


def signals(score: float, hits: int, line: str) -> tuple[float, ...]:
    """What the logistic model sees: the sum of weights and that for each thousand words, both dampened, and steps of the number of words."""
    return math.log1p(score), math.log1p(1000.0 * score / (1 + line.count(" "))), float(hits >= 1), float(hits >= 2), float(hits >= 3), float(hits >= 5)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last coefficient is the constant, which is not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    def __init__(self, weights: dict[str, tuple[float, float]], beta: list[float]):
        self.weights, self.beta = weights, beta

    def scorer(self):
        lexicon, beta = Lexicon(self.weights), self.beta

        def score(text: str) -> tuple[float, int]:
            line = fold_line(text)
            total, hits = lexicon(line)
            z = sum(b * s for b, s in zip(beta, signals(total, hits, line))) + beta[-1]
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits

        return score


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def shingle_ends(text: str) -> tuple[int, int, int]:
    """A hash of the folded text, and the least and the largest of its three-word shingles, of which near copies share one most of the time."""
    words = fold_line(text).split()
    hashes = [xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) >> 1 for i in range(max(1, len(words) - 2))]
    return xxhash.xxh3_64_intdigest(" ".join(words)) >> 1, min(hashes), max(hashes)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, y, fold`` of at most ``sample`` labelled rows that are not held out, the same ones on every run.

    Of a doc_id's texts, and of (near) copies with one label, the smallest by hash or doc_id
    stays. Only hashes and ids are shuffled, summed up in the tasks first.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("y is not null and doc_id is not null").filter(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows are sent
    rows = durable(map_texts(rows, ("doc_id", "text", "y"), "key long, least long, most long", lambda: lambda texts: [shingle_ends(t) for t in texts]))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("key", "y", "least", "most")).alias("r")).select("doc_id", "r.*")
    for end in ("least", "most"):
        one = one.groupBy(end, "y").agg(F.min(F.struct("doc_id", "key", *{"least", "most"} - {end})).alias("r")).select(end, "y", "r.*")
    kept = durable(one.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")))
    found = rows.join(F.broadcast(kept), (F.col("doc_id") == F.col("__id")) & (F.col("key") == F.col("__key")))
    if found.count() > kept.count():  # rows that repeat a doc_id and its text
        found = found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return found.select("text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))


def likelihood_ratio(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Logarithm of that of a feature's share of toxic rows against that of all rows."""
    seen, n = pos + neg, n_pos + n_neg
    return (pos * math.log(pos * n / (seen * n_pos)) if pos else 0.0) + (neg * math.log(neg * n / (seen * n_neg)) if neg else 0.0)


def lexicon_of(counts: dict[str, np.ndarray], rows: np.ndarray, bounds: tuple[float, float]) -> dict[str, tuple[float, float]]:
    """Entries with their weights, of counts (once, repeated) x (other, toxic) of features, and of rows (other, toxic)."""
    fixed = {f" {w}{end} ": (6.0, 6.0) for w in WORDS.split() for end in ("", "s")}
    n_neg, n_pos = rows.tolist()
    if n_pos < 2 or n_neg < 2:
        return fixed
    weights = {}
    for feature, ((n1, p1), (n2, p2)) in counts.items():
        if p1 < 2:
            continue
        once, again = (math.log((p + 0.5) / (n_pos + 1) / ((n + 0.5) / (n_neg + 1))) for p, n in ((p1, n1), (p2, n2)))
        if once > LEAST_WEIGHT and likelihood_ratio(p1, n1, n_pos, n_neg) > bounds[0]:
            weights[feature] = (once, max(once, again) if p2 > 1 else once)
        elif p2 > 1 and again > LEAST_WEIGHT and likelihood_ratio(p2, n2, n_pos, n_neg) > bounds[1]:
            weights[feature] = (max(0.0, once), again)
    for word in WORDS.split():  # three or four letters of a word that is known as a whole say less than it
        for k in (3, 4):
            weights.pop(f" {word[:k]}", None)
    return weights | fixed


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The lexicon and the logistic model of a bounded sample of labelled rows; the fixed words alone without labels.

    Features are counted in the tasks, summed by a shuffle, and only those of some evidence
    come to the driver; so do a few numbers for each row of the sample. ``sample`` bounds both.
    """
    rows = durable(training_rows(docs, labels, sample))
    names = [f"c{i}" for i in range(FOLDS * 4)]  # fold, toxic or not, once or repeated

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, bytearray] = {}
        rows = 0

        def flushed():
            counts = np.frombuffer(b"".join(own.values()), np.uint8).reshape(len(own), len(names)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string())] + [pa.array(c) for c in counts.T], names=["feature", *names])

        for b in batches:
            for text, y, fold in zip(*(b.column(i).to_pylist() for i in range(3))):
                at = 4 * fold + 2 * (1 if y else 0)
                for feature, n in features(fold_line(text)).items():
                    c = own.get(feature)
                    if c is None:
                        c = own[feature] = bytearray(len(names))
                    c[at] += 1
                    c[at + 1] += n > 1
                rows += 1
                if rows == 255 or len(own) > HELD:  # a count fits in a byte
                    yield flushed()
                    own.clear()
                    rows = 0
        if own:
            yield flushed()

    sizes = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", (F.col("y") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.fold, int(r.toxic)] = r.n
    n_neg, n_pos = sizes.sum(axis=0)
    if n_pos < 2 or n_neg < 2:
        return Model(lexicon_of({}, sizes.sum(axis=0), (0.0, 0.0)), [1.0, 0.5, 0.0, 1.0, 1.0, 0.0, -5.0])
    of = lambda y, k: sum((F.col(names[4 * f + 2 * y + k]) for f in range(FOLDS)), F.lit(0))
    summed = durable(rows.mapInArrow(counted, "feature string, " + ", ".join(f"{n} long" for n in names)).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]).filter(of(0, 0) + of(1, 0) >= 2))
    tested = summed.agg(F.count(F.lit(1)).alias("once"), F.count_if(of(0, 1) + of(1, 1) >= 2).alias("again")).first()
    bounds = (math.log(max(2, tested.once)), max(1.0, math.log(max(2, tested.again)) - REPEAT_SLACK))

    def evidence(pos: Column, neg: Column) -> Column:
        seen, n = pos + neg, float(n_pos + n_neg)
        return F.when(pos > 0, pos * F.log(pos * n / (seen * float(n_pos)))).otherwise(0.0) + F.when(neg > 0, neg * F.log(neg * n / (seen * float(n_neg)))).otherwise(0.0)

    some = (evidence(of(1, 0), of(0, 0)) > bounds[0] / 2) | ((of(1, 1) > 1) & (evidence(of(1, 1), of(0, 1)) > bounds[1] / 2))
    best = summed.filter((of(1, 0) >= 2) & some).collect()
    counts = {r[0]: np.array(r[1:]).reshape(FOLDS, 2, 2) for r in best}
    weights = lexicon_of({f: c.sum(axis=0).T for f, c in counts.items()}, sizes.sum(axis=0), bounds)
    parts = [lexicon_of({f: (c.sum(axis=0) - c[k]).T for f, c in counts.items()}, sizes.sum(axis=0) - sizes[k], bounds) for k in range(FOLDS)]

    def signalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(w) for w in parts]
        for b in batches:
            lines = [(fold_line(t), k) for t, k in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            own = [signals(*lexicons[k](x), x) for x, k in lines]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*own)] + [b.column(1)], names=seen)

    seen = [f"s{i}" for i in range(len(signals(0.0, 0, "")))] + ["y"]
    found = rows.mapInArrow(signalled, ", ".join(f"{n} double" for n in seen[:-1]) + ", y int").collect()
    table = np.array(sorted(tuple(r) for r in found), float)
    return Model(weights, fit_logistic(table[:, :-1], table[:, -1]).tolist())


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score double`` and ``hits long`` for each row of ``docs``: from the text alone.

    A null text counts as an empty one and gets the score of no hits; repeated rows are scored
    again; an empty table gives no rows; other columns are ignored. No shuffle.
    """

    def build():
        score = model.scorer()
        return lambda texts: [score(t) for t in texts]

    return map_texts(docs, keep, "score double, hits long", build)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, the model fitted on the labels that are not held out; a null text counts as an empty one, repeated rows are scored again."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with all its columns, less the rows that the model, fitted on its own labelled rows, rejects.

    A null text counts as an empty one, which stays; repeated rows stay or go together; very
    long texts are read whole; an empty table gives no rows. Labels are used to fit the model only.
    """
    model = fit(docs, labels)
    named = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):  # texts are sent once, and some rows are held at a time
                b = whole.slice(at, ROWS_AT_ONCE)
                texts = pc.struct_field(b.column(0), [text]).to_pylist()
                yield b.filter(pa.array([score(t or "")[0] < THRESHOLD for t in texts], pa.bool_()))

    return named.mapInArrow(run, named.schema).select("row.*")
