"""Comparison of two datasets: schemas, counts, aggregates, keyed rows, checksums, chunks, skew, and trends of reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.values import close_enough, exact, share

METRICS = ("sum", "avg", "min", "max", "nulls")


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Renames columns of side B to those of side A (``{a: b}``), case-insensitively."""
    back = {b.lower(): a for a, b in mapping.items()}
    return df.withColumnsRenamed({c: back[c.lower()] for c in df.columns if c.lower() in back})


def stringify(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as texts, whole."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def schema_diff(spark: SparkSession, a: T.StructType, b: T.StructType) -> DataFrame:
    """``column_name, change, old_type, new_type``: added, removed and type_changed columns, names without regard to case."""
    x, y = ({f.name.lower(): f.dataType.simpleString() for f in s.fields} for s in (a, b))
    rows = [(c, "removed", x[c], None) for c in x if c not in y] + [(c, "added", None, y[c]) for c in y if c not in x] + [(c, "type_changed", x[c], y[c]) for c in x if c in y and x[c] != y[c]]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[:2]), "column_name string, change string, old_type string, new_type string")


def common_tables(a: DataFrame, b: DataFrame, name: str = "table_name") -> DataFrame:
    """Names that both catalogs have, without regard to case."""
    x, y = a.select(F.lower(name).alias("name"), F.col(name).alias("name_a")).distinct(), b.select(F.lower(name).alias("name"), F.col(name).alias("name_b")).distinct()
    return x.join(y, "name")


def row_count_diff(a: DataFrame, b: DataFrame, threshold: float = 0.0, percent: bool = False) -> DataFrame:
    """``rows_a, rows_b, delta, pct, within``: both sides counted in one job; pct is of the larger side."""
    both = a.select(F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(b.select(F.lit(0).alias("x"), F.lit(1).alias("y")))
    n = both.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("y"), F.lit(0)).alias("rows_b"))
    delta, pct = F.col("rows_a") - F.col("rows_b"), (F.col("rows_a") - F.col("rows_b")) / F.greatest("rows_a", "rows_b", F.lit(1)) * 100
    return n.select("rows_a", "rows_b", delta.alias("delta"), pct.alias("pct"), (F.abs(pct if percent else delta) <= threshold).alias("within"))


def column_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, metric, value``: sum, avg, min, max and null count of numeric columns in one scan."""
    one = {}
    for c in columns:
        total = F.sum(exact(c, 4)).cast("double")
        one |= {f"{c}|sum": total, f"{c}|avg": total / F.nullif(F.count(c).cast("double"), F.lit(0.0)), f"{c}|min": F.min(c).cast("double"), f"{c}|max": F.max(c).cast("double"), f"{c}|nulls": F.count_if(F.col(c).isNull()).cast("double")}
    return unpivoted(df.agg(*[v.alias(k) for k, v in one.items()]))


def unpivoted(row: DataFrame) -> DataFrame:
    """One row with columns ``name|metric`` as rows."""
    pairs = [F.struct(F.lit(c.rpartition("|")[0]).alias("column_name"), F.lit(c.rpartition("|")[2]).alias("metric"), F.col(f"`{c}`").alias("value")) for c in row.columns]
    return row.select(F.explode(F.array(*pairs)).alias("m")).select("m.*")


def metrics_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ``column_name, metric, value`` tables side by side with a tolerant verdict."""
    both = a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), ["column_name", "metric"], "full")
    return both.withColumn("same", close_enough(F.col("value_a"), F.col("value_b"), T.DoubleType()))


def aggregate_diff(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    return metrics_diff(column_metrics(a, columns), column_metrics(b, columns))


def profile_metrics(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """``column_name, metric, value`` (texts): distinct values, null percentage, least and largest value."""
    ndv = F.approx_count_distinct if approximate else F.count_distinct
    one = {}
    for c in columns:
        nulls = F.count_if(F.col(c).isNull()) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))
        one |= {f"{c}|ndv": ndv(c).cast("string"), f"{c}|null_pct": F.round(nulls, 4).cast("string"), f"{c}|min": F.min(c).cast("string"), f"{c}|max": F.max(c).cast("string")}
    return unpivoted(df.agg(*[v.alias(k) for k, v in one.items()]))


def profile_diff(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    both = profile_metrics(a, columns).withColumnRenamed("value", "value_a").join(profile_metrics(b, columns).withColumnRenamed("value", "value_b"), ["column_name", "metric"], "full")
    return both.withColumn("same", close_enough(F.col("value_a"), F.col("value_b"), T.StringType()))


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Of rows with the same key the last one by ``order``; pre-aggregated, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    if not order:
        return df.groupBy(*keys).agg(*[F.max(F.struct(*rest)).alias("__row")]).select(*keys, "__row.*") if rest else df.distinct()
    last = F.max(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *rest)).alias("__row")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__row.`{c}`") for c in rest])


def keyed_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, tolerance: float = 1e-6, unique: bool = False) -> DataFrame:
    """``keys, change, changed``: added (only B), removed (only A) and modified rows with (column, old, new) of what differs.

    Keys match null to null. Duplicate keys: the last row by the compared columns stands for
    the key (``unique=True`` skips that aggregation). One full outer join on the keys; equal
    rows never leave it.
    """
    columns = list(columns or [c for c in a.columns if c in b.columns and c not in keys])
    x, y = (d.select(*keys, *columns) for d in (a, b))
    if not unique:
        x, y = one_per_key(x, keys), one_per_key(y, keys)
    x = x.select(*[F.col(c).alias(f"a_{c}") for c in x.columns], F.lit(True).alias("__a"))
    y = y.select(*[F.col(c).alias(f"b_{c}") for c in y.columns], F.lit(True).alias("__b"))
    on = None
    for k in keys:
        same = F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
        on = same if on is None else on & same
    types = {f.name: f.dataType for f in a.schema.fields}
    diffs = [F.when(~close_enough(F.col(f"a_{c}"), F.col(f"b_{c}"), types[c], tolerance), F.struct(F.lit(c).alias("column_name"), F.col(f"a_{c}").cast("string").alias("old"), F.col(f"b_{c}").cast("string").alias("new"))) for c in columns]
    changed = F.array_compact(F.array(*diffs)) if diffs else F.array().cast("array<struct<column_name:string,old:string,new:string>>")
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size("changed") > 0, "modified")
    joined = x.join(y, on, "full").withColumn("changed", F.when(F.col("__a") & F.col("__b"), changed).otherwise(F.array().cast("array<struct<column_name:string,old:string,new:string>>")))
    return joined.withColumn("change", kind).filter("change is not null").select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], "change", "changed")


def result_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, over the shared columns, that only one side has: ``side`` and the columns; each distinct row once."""
    shared = [c for c in a.columns if c in b.columns]
    x, y = a.select(shared), b.select(shared)
    return x.subtract(y).withColumn("side", F.lit("only_a")).unionByName(y.subtract(x).withColumn("side", F.lit("only_b")))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``only_a, only_b, equal``: rows of each side that the other lacks, with repeats: empty on both sides if equal, at any size."""
    both = a.exceptAll(b).select(F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(b.exceptAll(a).select(F.lit(0).alias("x"), F.lit(1).alias("y")))
    n = both.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("only_a"), F.coalesce(F.sum("y"), F.lit(0)).alias("only_b"))
    return n.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def eval_match(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Whether two results match whatever the order of rows and the names of columns; numbers rounded, extra columns of B ignored."""

    def plain(df: DataFrame) -> DataFrame:
        picked = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns[: len(a.columns)])])
        return picked.select(*[(F.round(F.col(f.name).cast("double"), digits) if isinstance(f.dataType, T.NumericType) else F.col(f.name).cast("string")).alias(f.name) for f in picked.schema.fields])

    if len(b.columns) < len(a.columns):
        return a.sparkSession.createDataFrame([(None, None, False)], "only_a long, only_b long, equal boolean")
    return multiset_diff(plain(a), plain(b))


def row_digest(columns: Sequence[str], null: str = "\x1e", separator: str = "\x1f") -> Column:
    """md5 of a row's columns as texts; null apart from the empty text."""
    return F.md5(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns]))


def checksum_segments(df: DataFrame, columns: Sequence[str], segments: int = 10, fast: bool = False) -> DataFrame:
    """``segment, n, checksum``: rows dealt by hash; a sum of 32 bits of each row's md5, which any change of a row moves.

    ``fast`` takes xxhash64 and exclusive-or instead of md5, for sides that Spark reads both.
    """
    if fast:
        h = F.xxhash64(*columns)
        return df.groupBy(F.pmod(h, F.lit(segments)).alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("checksum"))
    h = F.conv(F.substring(row_digest(columns), 1, 8), 16, 10).cast("long")
    return df.groupBy((h % segments).alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("checksum"))


def checksum_diff(a: DataFrame, b: DataFrame, columns: Sequence[str], segments: int = 10) -> DataFrame:
    x, y = (checksum_segments(d, columns, segments) for d in (a, b))
    both = x.withColumnsRenamed({"n": "n_a", "checksum": "checksum_a"}).join(y.withColumnsRenamed({"n": "n_b", "checksum": "checksum_b"}), "segment", "full")
    return both.withColumn("same", F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("checksum_a").eqNullSafe(F.col("checksum_b")))


def chunk_digests(df: DataFrame, key: str, columns: Sequence[str], low: int, width: int) -> DataFrame:
    h = F.conv(F.substring(row_digest([key, *columns]), 1, 8), 16, 10).cast("long")
    chunk = F.floor((F.col(key) - low) / width).cast("long")
    return df.filter(F.col(key).isNotNull()).groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("checksum"))


def chunked_diff(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], rows: int = 5000, most: int = 4096) -> DataFrame:
    """``chunk, key, change``: digests of key ranges first, then only the ranges that differ are compared row by row.

    The key's bounds and the row count (one scan of the key column) fix the width of the
    chunks. Digests shuffle one row per chunk and task; the second phase reads only key
    ranges that differ by a semi-join on the chunk, so that its cost follows the damage. Rows
    without a key are held against each other as a bag of digests, in chunk -1.
    """
    low, high, n = a.select(key).unionAll(b.select(key)).agg(F.min(key), F.max(key), F.count(key)).first()
    if low is None:
        low, high = 0, 0
    width = max(1, -(-(high - low + 1) // max(1, min(most, -(-n // (2 * rows))))))
    x, y = (chunk_digests(d, key, columns, low, width) for d in (a, b))
    bad = x.withColumnsRenamed({"n": "n_a", "checksum": "c_a"}).join(y.withColumnsRenamed({"n": "n_b", "checksum": "c_b"}), "chunk", "full").filter(~(F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("c_a").eqNullSafe(F.col("c_b")))).select("chunk")
    bad = F.broadcast(bad)  # at most `most` + 1 rows
    chunk = F.floor((F.col(key) - low) / width).cast("long")

    def side(d: DataFrame, name: str) -> DataFrame:
        hit = d.filter(F.col(key).isNotNull()).withColumn("chunk", chunk).join(bad, "chunk", "left_semi")
        return hit.select("chunk", F.col(key).alias("key"), row_digest(columns).alias(name))

    found = side(a, "da").join(side(b, "db"), ["chunk", "key"], "full")
    kind = F.when(F.col("db").isNull(), "only_a").when(F.col("da").isNull(), "only_b").when(F.col("da") != F.col("db"), "changed")
    keyed = found.withColumn("change", kind).filter("change is not null").select("chunk", "key", "change")

    def bare(d: DataFrame, name: str) -> DataFrame:
        return d.filter(F.col(key).isNull()).groupBy(row_digest(columns).alias("d")).agg(F.count(F.lit(1)).alias(name))

    bags = bare(a, "na").join(bare(b, "nb"), "d", "full").select((F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))).alias("more")).filter("more <> 0")
    each = bags.select(F.explode(F.array_repeat(F.when(F.col("more") > 0, "only_a").otherwise("only_b"), F.abs("more").cast("int"))).alias("change"))
    return keyed.unionByName(each.select(F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast(keyed.schema["key"].dataType).alias("key"), "change"))


def partition_diff(a: DataFrame, b: DataFrame, partition: Column) -> DataFrame:
    """``part, rows_a, rows_b, delta, pct`` of every partition value on either side."""
    x, y = (d.groupBy(partition.alias("part")).agg(F.count(F.lit(1)).alias("n")) for d in (a, b))
    both = x.withColumnRenamed("n", "x").join(y.withColumnRenamed("n", "y"), "part", "full").select("part", F.coalesce("x", F.lit(0)).alias("rows_a"), F.coalesce("y", F.lit(0)).alias("rows_b"))
    return both.withColumn("delta", F.col("rows_a") - F.col("rows_b")).withColumn("pct", F.col("delta") / F.greatest("rows_a", "rows_b", F.lit(1)) * 100)


def custom_agg_diff(a: DataFrame, b: DataFrame, lines: Sequence[str]) -> DataFrame:
    """``alias=AGG(expr)`` lines on both sides, compared tolerantly."""
    pairs = [tuple(p.strip() for p in line.split("=", 1)) for line in lines]

    def side(d: DataFrame) -> DataFrame:
        return unpivoted(d.agg(*[F.expr(e).cast("double").alias(f"{n}|value") for n, e in pairs]))

    return metrics_diff(side(a), side(b))


def skew_metrics(df: DataFrame, columns: Sequence[str], top: int = 20, exact_all: bool = False) -> DataFrame:
    """``column_name, ndv, top1_pct, gini, cv`` of value counts; over the ``top`` largest unless ``exact_all``.

    All columns in one pass: values are counted by (column, value), so hot values collapse
    before the shuffle. Of a single value the result is (100, 0, 0).
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_first("v"))
    up = Window.partitionBy("column_name").orderBy(F.asc("n"), F.desc("v"))
    every = Window.partitionBy("column_name")
    kept = counts.withColumn("ndv", F.count(F.lit(1)).over(every)).withColumn("total", F.sum("n").over(every)).withColumn("r", F.row_number().over(down))
    kept = kept if exact_all else kept.filter(F.col("r") <= top)
    kept = kept.withColumn("i", F.row_number().over(up)).withColumn("m", F.count(F.lit(1)).over(every))
    out = kept.groupBy("column_name").agg(
        F.max("ndv").alias("ndv"),
        (F.max("n") * 100.0 / F.sum("n")).alias("top1_pct"),
        (F.sum((2 * F.col("i") - F.col("m") - 1) * F.col("n")) / (F.max("m") * F.sum("n")).cast("double")).alias("gini"),
        (F.stddev_pop("n") / F.avg("n")).alias("cv"),
    )
    return out.select("column_name", "ndv", F.round("top1_pct", 6).alias("top1_pct"), F.round("gini", 6).alias("gini"), F.round("cv", 6).alias("cv"))


def skew_diff(a: DataFrame, b: DataFrame, columns: Sequence[str], top: int = 20) -> DataFrame:
    """Both sides' skew and the verdict: mismatch, both_skewed or ok."""
    x, y = (skew_metrics(d, columns, top).withColumnsRenamed({c: f"{c}_{s}" for c in ("ndv", "top1_pct", "gini", "cv")}) for d, s in ((a, "a"), (b, "b")))
    skewed = lambda s: (F.col(f"gini_{s}") > 0.6) | (F.col(f"top1_pct_{s}") > 50)
    apart = (F.abs(F.col("gini_a") - F.col("gini_b")) > 0.2) | (F.abs(F.col("top1_pct_a") - F.col("top1_pct_b")) > 20)
    return x.join(y, "column_name").withColumn("verdict", F.when(apart, "mismatch").when(skewed("a") & skewed("b"), "both_skewed").otherwise("ok"))


def quality_rules(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """``rule, actual, passed`` of rules ``col:not_null>p``, ``col:unique>p``, ``col:min>v``, ``col:max<v``, ``col:range:lo-hi``, ``col:expr:e``; a missing column fails."""
    made = {}
    total = F.nullif(F.count(F.lit(1)).cast("double"), F.lit(0.0))
    for rule in rules:
        column, check = rule.split(":", 1)
        if column not in df.columns:
            made[rule] = (F.lit(None).cast("double"), F.lit(False))
        elif check.startswith("expr:"):
            bad = F.count_if(~F.coalesce(F.expr(check[5:]), F.lit(False))).cast("double")
            made[rule] = (bad, bad == 0)
        elif check.startswith("range:"):
            low, high = check[6:].split("-", 1)
            bad = F.count_if((F.col(column) < float(low)) | (F.col(column) > float(high))).cast("double")
            made[rule] = (bad, bad == 0)
        else:
            name, sign, limit = next((n, s, float(v)) for s in "<>" if s in check for n, _, v in [check.partition(s)])
            value = {"not_null": F.count(column) * 100.0 / total, "unique": F.count_distinct(column) * 100.0 / total, "min": F.min(column).cast("double"), "max": F.max(column).cast("double")}[name]
            made[rule] = (value, value > limit if sign == ">" else value < limit)
    row = df.agg(*[x.alias(f"r{i}_{k}") for i, pair in enumerate(made.values()) for k, x in zip("vp", pair)])
    rows = [F.struct(F.lit(rule).alias("rule"), F.round(F.col(f"r{i}_v"), 4).alias("actual"), F.coalesce(F.col(f"r{i}_p"), F.lit(False)).alias("passed")) for i, rule in enumerate(made)]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def incremental_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], watermark: str, value, columns: Sequence[str] | None = None) -> DataFrame:
    """keyed_diff of the rows past a watermark on each side."""
    past = F.col(watermark) > F.lit(value)
    return keyed_diff(a.filter(past), b.filter(past), keys, columns)


def report_diff(old: DataFrame, new: DataFrame, counters: Sequence[str]) -> DataFrame:
    """``counter, old, new, delta`` of two one-row reports."""
    x, y = (unpivoted(d.select(*[F.col(c).cast("double").alias(f"{c}|v") for c in counters])).select("column_name", "value") for d in (old, new))
    both = x.withColumnRenamed("value", "old").join(y.withColumnRenamed("value", "new"), "column_name")
    return both.select(F.col("column_name").alias("counter"), "old", "new", (F.col("new") - F.col("old")).alias("delta"))


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], numeric: Sequence[str] = (), columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All stages of a comparison, each a lazy DataFrame: schema, count, keyed, aggregate, profile, checksum; the last two over ``columns``, else all shared ones."""
    shared = [c for c in a.columns if c in b.columns] if columns is None else list(columns)
    return {
        "schema": schema_diff(a.sparkSession, a.schema, b.schema),
        "count": row_count_diff(a, b),
        "keyed": keyed_diff(a, b, keys),
        "aggregate": aggregate_diff(a, b, numeric),
        "profile": profile_diff(a, b, shared),
        "checksum": checksum_diff(a, b, shared),
    }


def stage_findings(stages: Mapping[str, DataFrame]) -> DataFrame:
    """``stage, findings`` of ``compare``'s stages: columns, rows of difference, keys, metrics, profile values and segments that differ."""
    apart = F.count_if(~F.coalesce(F.col("same"), F.lit(False)))
    count = {"schema": F.count(F.lit(1)), "keyed": F.count(F.lit(1)), "count": F.sum(F.abs("delta"))}
    return reduce(DataFrame.unionByName, [d.agg(F.lit(stage).alias("stage"), count.get(stage, apart).alias("findings")) for stage, d in stages.items()])


def batch_report(a: Mapping[str, DataFrame], b: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, schema_changes, rows_a, rows_b, delta, mismatches, has_diffs`` of the tables that both sides have, names without regard to case.

    ``mismatches`` counts the aggregates that differ of columns numeric on both sides. A table
    is one row that its own scans make; tables of one side only are not listed. ``a`` must not be empty.
    """
    other = {n.lower(): d for n, d in b.items()}
    out = []
    for name, x in a.items():
        if name.lower() not in other:
            continue
        y = other[name.lower()]
        numeric = {f.name.lower() for f in y.schema.fields if isinstance(f.dataType, T.NumericType)}
        shared = [f.name for f in x.schema.fields if isinstance(f.dataType, T.NumericType) and f.name.lower() in numeric]
        changes = schema_diff(x.sparkSession, x.schema, y.schema).count()  # of columns, not of rows
        apart = F.count_if(~F.coalesce(F.col("same"), F.lit(False))).alias("mismatches")
        found = aggregate_diff(x, y, shared).agg(apart) if shared else x.sparkSession.range(1).select(F.lit(0).cast("long").alias("mismatches"))
        counts = row_count_diff(x, y).select(F.lit(name.lower()).alias("table_name"), F.lit(changes).cast("long").alias("schema_changes"), "rows_a", "rows_b", "delta")
        out.append(counts.join(F.broadcast(found), F.lit(True)))  # one row each
    if not out:
        empty = "table_name string, schema_changes long, rows_a long, rows_b long, delta long, mismatches long"
        out = [next(iter(a.values())).sparkSession.createDataFrame([], empty)]
    return reduce(DataFrame.unionByName, out).withColumn("has_diffs", (F.col("schema_changes") > 0) | (F.col("delta") != 0) | (F.col("mismatches") > 0))


def trend(history: DataFrame, by: Sequence[str], time: str, metric: str) -> DataFrame:
    """The metric, its previous known value and the jump from it, per series."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("previous", F.last(metric, ignorenulls=True).over(w)).withColumn("jump", F.col(metric) - F.col("previous"))


def trend_alert(history: DataFrame, by: Sequence[str], time: str, metric: str, threshold: float, k: int) -> DataFrame:
    """``by, run, fired``: length of the run of latest values beyond the threshold (absolute), and whether it reaches k."""
    w = Window.partitionBy(*by).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    beyond = F.coalesce(F.abs(F.col(metric)) > threshold, F.lit(False))
    run = history.withColumn("__ok", F.min(beyond.cast("int")).over(w)).groupBy(*by).agg(F.sum("__ok").alias("run"))
    return run.withColumn("fired", F.col("run") >= k)


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 0.01, time_key: str | None = None, grace: int = 0) -> DataFrame:
    """Two result sets aligned by key: ``keys, metric, value_a, value_b, rel, status`` of cells that are not equal.

    Status is missing_a, missing_b, null_mismatch or mismatch. The relative difference is of
    side B; of a zero B it is 0 for a zero A, else 100. The newest ``grace`` values of the time
    key are left out.
    """

    def side(d: DataFrame, s: str) -> DataFrame:
        if time_key and grace:
            newest = d.select(time_key).distinct().orderBy(F.desc(time_key)).limit(grace)
            d = d.join(F.broadcast(newest), time_key, "left_anti")  # at most `grace` rows
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
        return d.select(*keys, cells.alias("c")).select(*keys, F.col("c.metric").alias("metric"), F.col("c.value").alias(f"value_{s}"), F.lit(True).alias(f"has_{s}"))

    both = side(a, "a").join(side(b, "b"), [*keys, "metric"], "full")
    rel = F.when(F.col("value_b") == 0, F.when(F.col("value_a") == 0, 0.0).otherwise(100.0)).otherwise(F.abs(F.col("value_a") - F.col("value_b")) / F.abs("value_b"))
    status = (
        F.when(F.col("has_a").isNull(), "missing_a").when(F.col("has_b").isNull(), "missing_b").when(F.col("value_a").isNull() & F.col("value_b").isNull(), None)
        .when(F.col("value_a").isNull() | F.col("value_b").isNull(), "null_mismatch").when(rel > tolerance, "mismatch")
    )
    return both.select(*keys, "metric", "value_a", "value_b", rel.alias("rel"), status.alias("status")).filter("status is not null")


def reconcile_bias(diffs: DataFrame, least: int = 3, sided: float = 0.8) -> DataFrame:
    """``metric, diffs, share_lower, median_diff, systematic``: whether the differences of a metric have one sign."""
    d = diffs.filter("status = 'mismatch'").withColumn("d", F.col("value_a") - F.col("value_b"))
    out = d.groupBy("metric").agg(F.count(F.lit(1)).alias("diffs"), share(F.count_if(F.col("d") < 0), F.count(F.lit(1))).alias("share_lower"), F.round(F.median("d"), 4).alias("median_diff"))
    return out.withColumn("systematic", (F.col("diffs") >= least) & (F.greatest("share_lower", 1 - F.col("share_lower")) >= sided))


def change_table(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Operations that turn A into B: ``op`` (INSERT, UPDATE, DELETE), the keys, and B's columns."""
    diff = keyed_diff(a, b, keys).select(*keys, "change")
    op = F.when(F.col("change") == "added", "INSERT").when(F.col("change") == "removed", "DELETE").otherwise("UPDATE")
    return diff.join(b, list(keys), "left").withColumn("op", op).drop("change")


def apply_changes(a: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target after the operations, rebuilt by an anti-join and a union; repeated runs give the same."""
    return a.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes.filter("op <> 'DELETE'").select(*a.columns))
