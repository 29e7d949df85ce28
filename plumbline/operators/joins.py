"""Join quality and join shapes: audits without the join, suggestions, stars, ratios and hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.durable import settle
from plumbline.functions.values import share

# Name endings that make a column joinable, and names that never are.
KEY_SUFFIXES = ("_id", "key", "_key", "_code", "_no", "_num")
HOUSEKEEPING = ("created_at", "updated_at", "dt", "pt", "ds", "id")


def join_audit(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """One row of join quality by key counts of both sides; the join itself is never made.

    Null or empty keys match nothing. ``explosion`` is joined rows per matched left row.
    """

    def counts(df: DataFrame, cols: Sequence[str], n: str) -> DataFrame:
        keys = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"k{i}") for i, c in enumerate(cols)]
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))

    ks = [f"k{i}" for i in range(len(on))]
    x, y = counts(left, list(on), "n_l"), counts(right, list(on.values()), "n_r")
    null = " or ".join(f"{k} is null" for k in ks)
    both = x.filter(f"not ({null})").join(y.filter(f"not ({null})"), ks, "full")
    nulls = x.filter(null).select(F.col("n_l").alias("null_l"), F.lit(0).cast("long").alias("null_r")).unionAll(y.filter(null).select(F.lit(0).cast("long"), F.col("n_r")))
    hit = F.col("n_l").isNotNull() & F.col("n_r").isNotNull()
    cells = both.select("n_l", "n_r", F.lit(0).cast("long").alias("null_l"), F.lit(0).cast("long").alias("null_r")).unionAll(nulls.select(F.lit(None).cast("long"), F.lit(None).cast("long"), "null_l", "null_r"))
    out = cells.agg(
        F.coalesce(F.sum("n_l"), F.lit(0)).alias("keyed_left"),
        F.coalesce(F.sum("n_r"), F.lit(0)).alias("keyed_right"),
        F.coalesce(F.sum(F.when(hit, F.col("n_l"))), F.lit(0)).alias("matched_left"),
        F.coalesce(F.sum(F.when(hit, F.col("n_r"))), F.lit(0)).alias("matched_right"),
        F.count_if(F.col("n_l").isNotNull() & F.col("n_r").isNull()).alias("orphan_keys_left"),
        F.count_if(F.col("n_r").isNotNull() & F.col("n_l").isNull()).alias("orphan_keys_right"),
        F.coalesce(F.sum(F.when(hit, F.col("n_l") * F.col("n_r"))), F.lit(0)).alias("joined_rows"),
        F.count_if(hit & (F.col("n_l") > 1) & (F.col("n_r") > 1)).alias("many_to_many_keys"),
        F.coalesce(F.sum("null_l"), F.lit(0)).alias("null_left"),
        F.coalesce(F.sum("null_r"), F.lit(0)).alias("null_right"),
    )
    return out.withColumns(
        {
            "match_left": share(F.col("matched_left"), F.col("keyed_left")),
            "match_right": share(F.col("matched_right"), F.col("keyed_right")),
            "explosion": share(F.col("joined_rows"), F.col("matched_left")),
        }
    )


# Match rates below which unmatched rows are a medium and a high finding, and the share of null keys that is a medium one.
MATCH_MEDIUM, MATCH_HIGH, NULLS_MEDIUM = 0.9, 0.5, 0.01


def join_findings(audit: DataFrame) -> DataFrame:
    """``code, severity, side, value``: JA001 many-to-many keys (value: the explosion), JA002 left and JA003 right rows without a match (the match rate), JA004 null keys of a side (their share)."""

    def unmatched(side: str) -> tuple[Column, Column]:
        rate = F.coalesce(f"match_{side}", F.lit(0.0))
        return F.when(rate < MATCH_HIGH, "high").when(rate < MATCH_MEDIUM, "medium"), rate

    def nulls(side: str) -> tuple[Column, Column]:
        part = share(F.col(f"null_{side}"), F.col(f"null_{side}") + F.col(f"keyed_{side}"))
        return F.when(F.col(f"null_{side}") > 0, F.when(part >= NULLS_MEDIUM, "medium").otherwise("low")), part

    rules = [("JA001", "both", F.when(F.col("many_to_many_keys") > 0, "high"), F.col("explosion"))]
    rules += [(code, side, *unmatched(side)) for code, side in (("JA002", "left"), ("JA003", "right"))]
    rules += [("JA004", side, *nulls(side)) for side in ("left", "right")]
    cells = F.array(*[F.struct(F.lit(c).alias("code"), s.alias("severity"), F.lit(side).alias("side"), v.alias("value")) for c, side, s, v in rules])
    return audit.select(F.explode(cells).alias("f")).select("f.*").filter("severity is not null")


def suggest_joins(columns: DataFrame) -> DataFrame:
    """Joinable columns of a catalog (``table_name, column_name``): the same name with a key ending (.9), or ``id`` to ``<table>_id`` (.85)."""
    c = columns.select(F.lower("table_name").alias("t"), F.lower("column_name").alias("c"))
    a, b = c.select(F.col("t").alias("table_a"), F.col("c").alias("column_a")), c.select(F.col("t").alias("table_b"), F.col("c").alias("column_b"))
    key = F.lit(False)
    for s in KEY_SUFFIXES:
        key = key | F.col("column_a").endswith(s)
    same = a.filter(key & ~F.col("column_a").isin(*HOUSEKEEPING)).join(b, F.col("column_a") == F.col("column_b")).filter("table_a < table_b").withColumn("confidence", F.lit(0.9))
    owned = a.filter("column_a = 'id'").join(b, F.concat("table_a", F.lit("_id")) == F.col("column_b")).filter("table_a <> table_b").withColumn("confidence", F.lit(0.85))
    return same.unionByName(owned)


def with_overlap(suggestions: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Suggestions with each side's distinct values and how many both have: one pass over the values of key columns.

    Values are grouped, not columns, so that no task holds a column: of each value bits tell the
    columns that have it, 63 to a long, and what is compared is one row for each set of columns.
    """
    keys = [(n, c) for n, t in tables.items() for c in t.columns if c.lower().endswith(KEY_SUFFIXES) or c.lower() == "id"]
    words = [f"w{i}" for i in range(-(-len(keys) // 63))]
    place = {k: i for i, k in enumerate(keys)}
    values = None
    for n, t in tables.items():
        own = [(c, place[n, c]) for c in t.columns if (n, c) in place]
        if own:
            cells = [F.struct(F.col(f"`{c}`").cast("string").alias("v"), *[F.lit(1 << i % 63 if i // 63 == k else 0).cast("long").alias(w) for k, w in enumerate(words)]) for c, i in own]
            one = t.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
            values = one if values is None else values.unionByName(one)
    if values is None:
        return suggestions.withColumns({x: F.lit(0).cast("long") for x in ("ndv_a", "ndv_b", "shared")}).limit(0)
    sets = settle(values.filter("v is not null").groupBy("v").agg(*[F.bit_or(w).alias(w) for w in words]).groupBy(*words).agg(F.count(F.lit(1)).alias("n")))
    bits = [F.when(F.getbit(f"w{i // 63}", F.lit(i % 63)) == 1, F.struct(F.lit(n.lower()).alias("t"), F.lit(c.lower()).alias("c"))) for i, (n, c) in enumerate(keys)]
    held = sets.select(F.array_compact(F.array(*bits)).alias("columns"), "n")
    ndv = held.select(F.explode("columns").alias("x"), "n").groupBy("x.t", "x.c").agg(F.sum("n").alias("ndv"))
    out = suggestions
    for s in "ab":
        out = out.join(ndv.toDF("__t", "__c", f"ndv_{s}"), (F.col(f"table_{s}") == F.col("__t")) & (F.col(f"column_{s}") == F.col("__c"))).drop("__t", "__c")
    pairs = held.select("columns", "n", F.explode("columns").alias("a")).select("n", "a", F.explode("columns").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    both = pairs.select(F.col("a.t").alias("table_a"), F.col("a.c").alias("column_a"), F.col("b.t").alias("table_b"), F.col("b.c").alias("column_b"), "shared")
    return out.join(both, ["table_a", "column_a", "table_b", "column_b"], "left").fillna({"shared": 0})


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str, str | None]], how: str = "left") -> DataFrame:
    """A fact with dimensions (table, fact key, dimension key, filter in the ON clause); Catalyst broadcasts those that are small."""
    out = fact
    for dim, fk, pk, where in dims:
        d = dim if where is None else dim.filter(F.expr(where))
        out = out.join(d, out[fk] == d[pk], how)
    return out


def ratio_join(denominator: DataFrame, numerator: DataFrame, on: Sequence[str], null_safe: bool = False) -> DataFrame:
    """``on, num, den, ratio``: denominator left join numerator; null dimensions lose their numerator unless ``null_safe``."""
    n = numerator.select(*[F.col(c).alias(f"__{c}") for c in on], "num")
    cond = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"__{c}")) if null_safe else F.col(c) == F.col(f"__{c}")
        cond = same if cond is None else cond & same
    return denominator.join(n, cond, "left").select(*on, "num", "den", (F.col("num") * F.lit(1.0) / F.nullif(F.col("den"), F.lit(0))).alias("ratio"))


def hot_key_join(left: DataFrame, right: DataFrame, key: str, hot: Sequence, how: str = "inner", rows: int = 1_000_000) -> DataFrame:
    """A join whose named hot keys meet their right rows in every task, the rest by a shuffle; null keys stay with the rest.

    ``hot`` is what a probe found. The right rows of those keys are counted: up to ``rows`` they
    are sent to all tasks, beyond that the hot keys are joined by the adaptive skew join.
    """
    is_hot = F.coalesce(F.col(key).isin(*hot), F.lit(False))
    few = right.filter(F.col(key).isin(*hot))
    few = F.broadcast(few) if few.count() <= rows else few
    return left.filter(is_hot).join(few, key, how).unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key, how))


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, row: str) -> DataFrame:
    """An inner join with each key's rows dealt over ``salts`` tasks; the right side is repeated ``salts`` times.

    Both sides are shuffled, whatever their sizes: an estimate of the right side leaves out its
    repetition, and a side that is small enough for the driver needs no salt.
    """
    x = left.withColumn("__salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    y = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return x.join(y.hint("merge"), [key, "__salt"]).drop("__salt")
