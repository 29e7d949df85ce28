"""Quality classifier: document evidence combined with site and path posteriors by hierarchical empirical Bayes.

A logistic model over some counts of the text gives each document its evidence. Sites and
paths get beta posteriors of their documents' quality, each level shrunk toward the one above
(path to site, site to all) by a strength of the level, which the method of moments takes from
how much its parts differ; a sparse site so stays near the global rate. A document's score adds to its own log
odds what its path's posterior, without the document itself, differs from the global rate.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, near, read_table, spread_join, whole_text
from .toxicity import fit_logistic, held_out

#: Labelled rows that the document model is fitted on, at most: those with the smallest hash of doc_id.
SAMPLE = 12_000
FEATURES = ("noise", "capitals", "marks", "bars", "repeats", "again", "length")
#: A word that is followed by itself.
AGAIN = r"(?<!\S)(\S++)\s++(?=\1(?!\S))"


def features(text: str = "text") -> dict[str, Column]:
    """What the document model sees: shares of odd signs, capitals, marks, bars, repeated lines and words that follow themselves, and the length."""
    whole = whole_text(text)
    size = F.length(whole) + F.lit(1.0)
    lines = F.split(whole, "\n")
    return {
        "noise": F.regexp_count(whole, F.lit(r"[*&%$#]{2,}")) / size * 10,
        "capitals": (size - F.length(F.regexp_replace(whole, "[A-Z]", ""))) / size,
        "marks": F.regexp_count(whole, F.lit(r"[!?]{2,}")) / size * 10,
        "bars": F.regexp_count(whole, F.lit(r"[|]")) / size * 10,
        "repeats": 1.0 - F.size(F.array_distinct(lines)) / F.size(lines),
        "again": F.regexp_count(whole, F.lit(AGAIN)) / size * 10,
        "length": F.log(size) / 10,
    }


def usable_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, y`` of the labels that are not held out, one for each doc_id (the better one)."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("y is not null and doc_id is not null").filter(~held_out())
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Coefficients of the document model, from a bounded sample of labelled rows that are not held out; the constant is last.

    Of the rows of one doc_id, the one with the least features counts, so that at most ``sample`` rows are collected.
    """
    chosen = usable_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    seen = docs.select("doc_id", *[c.alias(k) for k, c in features().items()]).join(F.broadcast(chosen), "doc_id")
    seen = seen.groupBy("doc_id", "y").agg(F.min(F.struct(*FEATURES)).alias("f")).select("f.*", "y")
    rows = np.array(sorted(tuple(r) for r in seen.collect()), float)
    if len(rows) < 2 or len(set(rows[:, -1])) < 2:
        return [0.0] * len(FEATURES) + [1.0]
    return fit_logistic(rows[:, :-1], rows[:, -1], ridge=0.1).tolist()


def host_and_path(url: str) -> tuple[Column, Column]:
    """The host of a URL column in lower case without 'www.', and the first part of its path; empty where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?([^/:?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1), F.lit(""))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _bounded(p: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def _strength(mean: float, between: float) -> float:
    """Documents that the level above is worth, by the method of moments: the more its parts differ, the fewer."""
    return min(1e4, max(2.0, mean * (1 - mean) / max(1e-6, between) - 1))


def score_quality(docs: DataFrame, labels: DataFrame, site: str | Column = "source", path: str | Column = "lang", weight: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """``doc_id, evidence, site_posterior, path_posterior, score, kept`` for each row of ``docs``.

    A document counts in its site and path by its label, where it has one that is not held
    out, else by its evidence; in its own score it does not count. Null sites and paths are the empty
    one, null texts empty texts (very long ones are read whole); repeated rows are scored again
    (and counted in their site); labels that name no document, or are null, are not used; an
    empty table gives no rows; other columns are ignored. Sites and paths are summed before
    each shuffle, so that a site with a third of all rows is one row in each task.
    """
    beta = fit(docs, labels)
    z = sum((F.lit(b) * c for b, c in zip(beta, features().values())), F.lit(beta[-1]))
    named = [F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("")).alias(n) for x, n in ((site, "site"), (path, "path"))]
    known = near(usable_labels(labels).select(F.col("doc_id").alias("__id"), F.col("y").cast("double").alias("y")))
    rows = docs.select("doc_id", *named, _bounded(1 / (1 + F.exp(-z))).alias("evidence"))
    rows = durable(rows.join(known, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "site", "path", "evidence", F.coalesce("y", "evidence").alias("value")))
    paths = rows.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    sites = paths.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s"))
    rate = F.col("site_s") / F.col("site_n")
    total = sites.agg(F.sum("site_s").alias("s"), F.sum("site_n").alias("n"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("site_n")).alias("few")).first()
    mean = min(1 - 1e-6, max(1e-6, total.s / total.n)) if total.n else 0.5
    of_sites = _strength(mean, (total.v or 0.0) - mean * (1 - mean) * (total.few or 0.0))
    apart = F.pow(F.col("s") / F.col("n") - rate, 2) - rate * (1 - rate) / F.col("n")
    within = paths.join(sites, "site").agg(F.coalesce(F.avg(apart), F.lit(0.0)).alias("v")).first().v
    of_paths = _strength(mean, within)
    shrunk = sites.withColumn("site_rate", (F.col("site_s") + of_sites * mean) / (F.col("site_n") + of_sites))
    priors = paths.join(shrunk, "site").select(F.col("site").alias("__site"), F.col("path").alias("__path"), "n", "s", "site_rate")
    joined = spread_join(rows, durable(priors), (F.col("site") == F.col("__site")) & (F.col("path") == F.col("__path")), "n")
    others = _bounded((F.col("s") - F.col("value") + of_paths * F.col("site_rate")) / (F.col("n") - 1 + of_paths))
    score = 1 / (1 + F.exp(-(_logit(F.col("evidence")) + F.lit(weight) * (_logit(others) - F.lit(math.log(mean / (1 - mean)))))))
    return joined.select("doc_id", "evidence", F.col("site_rate").alias("site_posterior"), others.alias("path_posterior"), score.alias("score"), (score >= threshold).alias("kept"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """All documents, with ``source`` as site and ``lang`` as path; see ``score_quality`` for nulls, ties, and repeated rows."""
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
