"""Data quality: checks, profiles, findings, drift, duplicates, repairs, key choice, and synthetic rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.values import kind_of, share


@dataclass(frozen=True)
class Check:
    """A rule: row_count (least, most), null_rate (most, percent), unique, enum_domain (values)."""

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    values: tuple = field(default=())


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """``check_name, kind, actual, passed``: all single-pass checks of a table in one scan, one job more for each unique key.

    The null rate of an empty table is 0; null key groups count as groups; nulls are in every domain.
    """
    made, out = {}, None
    for c in checks:
        if c.kind == "row_count":
            made[c] = F.count(F.lit(1)).cast("double")
        elif c.kind == "null_rate":
            made[c] = F.coalesce(F.count_if(F.col(c.columns[0]).isNull()) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
        elif c.kind == "enum_domain":
            made[c] = F.count_if(F.col(c.columns[0]).isNotNull() & ~F.col(c.columns[0]).isin(*c.values)).cast("double")
        elif c.kind != "unique":
            raise ValueError(c.kind)
    one = F.array(*[F.struct(F.lit(c.name).alias("check_name"), F.lit(c.kind).alias("kind"), F.col(f"x{i}").alias("actual"), _passes(c, F.col(f"x{i}")).alias("passed")) for i, c in enumerate(made)])
    if made:
        out = df.agg(*[v.alias(f"x{i}") for i, v in enumerate(made.values())]).select(F.explode(one).alias("r")).select("r.*")
    for c in checks:
        if c.kind == "unique":
            twice = df.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).cast("double").alias("actual"))
            row = twice.select(F.lit(c.name).alias("check_name"), F.lit(c.kind).alias("kind"), "actual", (F.col("actual") == 0).alias("passed"))
            out = row if out is None else out.unionByName(row)
    return out


def _passes(c: Check, actual: Column) -> Column:
    if c.kind == "enum_domain":
        return actual == 0
    ok = F.lit(True)
    if c.least is not None:
        ok = ok & (actual >= c.least)
    if c.most is not None:
        ok = ok & (actual <= c.most)
    return ok


def row_count_change(current: DataFrame, ledger: DataFrame, by: str = "table_name") -> DataFrame:
    """``by, rows, previous, change_pct`` of counts against the last run in a ledger (``by, run, rows``)."""
    last = ledger.groupBy(by).agg(F.max_by("rows", "run").alias("previous"))
    pct = (F.col("rows") - F.col("previous")) * 100.0 / F.nullif(F.col("previous"), F.lit(0))
    return current.join(last, by, "left").select(by, "rows", "previous", pct.alias("change_pct"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, v, n``: counts of all columns' values as texts in one shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """One row for each column: kind (a bucket with 90 % of the values, else mixed), rows, non-null, null %, distinct, unique %, top share, numbers' min, max, mean."""
    c = (counts if counts is not None else value_counts(df, columns)).withColumn("kind", kind_of("v"))
    by_kind = c.filter("v is not null").groupBy("column_name", "kind").agg(F.sum("n").alias("k"))
    kinds = by_kind.groupBy("column_name").agg(F.max(F.struct("k", "kind")).alias("m"), F.sum("k").alias("all"))
    dominant = kinds.select("column_name", F.when(F.col("m.k") >= 0.9 * F.col("all"), F.col("m.kind")).otherwise("mixed").alias("kind"))
    num = F.col("v").try_cast("double")
    totals = c.groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("v").alias("ndv"),
        F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("top_n"),
        F.min(num).alias("min_num"),
        F.max(num).alias("max_num"),
        (F.sum(F.when(num.isNotNull(), F.col("v").try_cast("decimal(20,4)") * F.col("n"))).cast("double") / F.sum(F.when(num.isNotNull(), F.col("n")))).alias("mean_num"),
    )
    out = totals.join(dominant, "column_name", "left")
    return out.select(
        "column_name", F.coalesce("kind", F.lit("empty")).alias("kind"), "rows", "non_null",
        F.round((F.col("rows") - F.col("non_null")) * 100.0 / F.col("rows"), 4).alias("null_pct"),
        "ndv", F.round(F.coalesce(F.col("ndv") * 100.0 / F.nullif(F.col("non_null"), F.lit(0)), F.lit(0.0)), 4).alias("unique_pct"),
        F.round(F.coalesce(F.col("top_n") * 100.0 / F.nullif(F.col("non_null"), F.lit(0)), F.lit(0.0)), 4).alias("top_pct"), "min_num", "max_num", F.round("mean_num", 4).alias("mean_num"),
    )


FINDING = "code string, severity string, subject string, value double"


def profile_findings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``code, severity, subject, value``: SP001 mixed kinds, SP002 half null, SP003 constant, SP004 minority formats, SP005 numbers as text, SP006 variants of case and space."""
    counts = value_counts(df, columns)
    p = profile(df, columns, counts)
    kinds = counts.filter("v is not null").withColumn("kind", kind_of("v")).groupBy("column_name", "kind").agg(F.sum("n").alias("k"))
    total = kinds.groupBy("column_name").agg(F.sum("k").alias("all"), F.max("k").alias("most"), F.count(F.lit(1)).alias("kinds"))
    variants = counts.filter("v is not null").groupBy("column_name", F.lower(F.trim("v")).alias("norm")).agg(F.count(F.lit(1)).alias("forms")).groupBy("column_name").agg(F.count_if(F.col("forms") > 1).cast("double").alias("value"))
    as_text = counts.filter(F.col("v").rlike(r"^[¥$€]?\s*-?\d{1,3}(,\d{3})+(\.\d+)?%?$|^[¥$€]\s*-?\d+(\.\d+)?$|^-?\d+(\.\d+)?%$")).groupBy("column_name").agg(F.sum("n").cast("double").alias("value"))

    def found(rows: DataFrame, code: str, severity: str, value: str) -> DataFrame:
        return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("column_name").alias("subject"), F.col(value).cast("double").alias("value"))

    parts = [
        found(p.filter("kind = 'mixed'"), "SP001", "high", "top_pct"),
        found(p.filter("null_pct >= 50"), "SP002", "mid", "null_pct"),
        found(p.filter("ndv <= 1"), "SP003", "low", "ndv"),
        found(total.filter("most >= 0.9 * all and kinds > 1").withColumn("rest", F.col("all") - F.col("most")), "SP004", "mid", "rest"),
        found(as_text.filter("value > 0"), "SP005", "mid", "value"),
        found(variants.filter("value > 0"), "SP006", "mid", "value"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def draft_rules(p: DataFrame, counts: DataFrame) -> DataFrame:
    """``column_name, rule, argument`` from a profile: null cap, uniqueness, domains of at most 12 values; columns over half null get none."""
    ok = p.filter("null_pct <= 50")
    cap = ok.select("column_name", F.lit("null_rate").alias("rule"), F.least(F.ceil("null_pct") + 5, F.lit(100)).cast("string").alias("argument"))
    idlike = (F.col("kind") == "integer") | F.lower("column_name").rlike("(^|_)(id|key|no|code)$|key$")
    unique = ok.filter((F.col("unique_pct") == 100) & idlike).select("column_name", F.lit("unique").alias("rule"), F.lit("").alias("argument"))
    few = ok.filter("ndv <= 12 and ndv > 1 and kind not in ('integer', 'decimal')").select("column_name")
    values = counts.filter("v is not null").join(few, "column_name").groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("argument"))  # at most 12 values each
    return cap.unionByName(unique).unionByName(values.select("column_name", F.lit("enum_domain").alias("rule"), "argument"))


def outliers(df: DataFrame, columns: Sequence[str], sigmas: float = 3.0) -> DataFrame:
    """``column_name, n, null_pct, distinct_n, outside``: values beyond the mean by more than so many sample deviations."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))])
    wide = df.select(*columns).join(F.broadcast(stats))  # one row
    rows = wide.agg(
        F.count(F.lit(1)).alias("n"),
        *[x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"null_{c}"), F.count_distinct(c).alias(f"ndv_{c}"), F.count_if(F.abs(F.col(c) - F.col(f"m_{c}")) > sigmas * F.col(f"s_{c}")).alias(f"out_{c}"))],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n"), F.round(F.col(f"null_{c}") * 100.0 / F.col("n"), 4).alias("null_pct"), F.col(f"ndv_{c}").alias("distinct_n"), F.col(f"out_{c}").alias("outside")) for c in columns])
    return rows.select(F.explode(cells).alias("r")).select("r.*")


def profile_drift(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``code, severity, subject, value``: DA001 columns, DA002 mean shift, DA003 null points, DA004 top shares, DA006 unique points, DA007 kind."""
    cb, cc = value_counts(base, [c for c in columns if c in base.columns]), value_counts(current, [c for c in columns if c in current.columns])
    pb, pc = (profile(None, [], c).select(*[F.col(n).alias(f"{n}_{s}") for n in ("kind", "null_pct", "unique_pct", "mean_num")], "column_name") for c, s in ((cb, "b"), (cc, "c")))
    both = pb.join(pc, "column_name", "full")
    shift = F.abs(F.col("mean_num_c") - F.col("mean_num_b")) / F.greatest(F.abs("mean_num_b"), F.lit(1e-9))
    nulls = F.abs(F.col("null_pct_c") - F.col("null_pct_b"))
    unique = F.abs(F.col("unique_pct_c") - F.col("unique_pct_b"))
    level = lambda v, mid, high: F.when(v >= high, "high").when(v >= mid, "mid")
    rules = [
        ("DA001", F.when(F.col("kind_b").isNull() | F.col("kind_c").isNull(), "high"), F.lit(1.0)),
        ("DA002", level(shift, 0.2, 0.5), shift),
        ("DA003", level(nulls, 10, 25), nulls),
        ("DA006", level(unique, 20, 40), unique),
        ("DA007", F.when(F.col("kind_b") != F.col("kind_c"), "high"), F.lit(1.0)),
    ]
    cells = F.array(*[F.struct(F.lit(c).alias("code"), s.alias("severity"), F.round(v.cast("double"), 4).alias("value")) for c, s, v in rules])
    plain = both.select(F.col("column_name").alias("subject"), F.explode(cells).alias("f")).select("f.code", "f.severity", "subject", "f.value").filter("severity is not null")
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "v")
    every = Window.partitionBy("column_name")

    def top(c: DataFrame, s: str) -> DataFrame:
        return c.filter("v is not null").withColumn("r", F.row_number().over(w)).withColumn("all", F.sum("n").over(every)).filter("r <= 5").select("column_name", "v", (F.col("n") / F.col("all")).alias(f"share_{s}"))

    narrow = pb.filter("unique_pct_b <= 50").select("column_name")
    moved = top(cb, "b").join(top(cc, "c"), ["column_name", "v"], "full").join(narrow, "column_name").groupBy("column_name").agg(F.sum(F.abs(F.coalesce("share_b", F.lit(0.0)) - F.coalesce("share_c", F.lit(0.0)))).alias("l1"))
    shares = moved.select(F.lit("DA004").alias("code"), level(F.col("l1"), 0.2, 0.4).alias("severity"), F.col("column_name").alias("subject"), F.round("l1", 4).alias("value")).filter("severity is not null")
    return plain.unionByName(shares)


def key_drift(ledger: DataFrame, by: Sequence[str], run: str) -> DataFrame:
    """Latest key measurement against the median of earlier ones (``top1_pct, null_pct, ndv``); needs three runs."""
    w = Window.partitionBy(*by).orderBy(F.desc(run))
    r = ledger.withColumn("__r", F.row_number().over(w))
    last, rest = F.col("__r") == 1, F.col("__r") > 1
    agg = {m: (F.max(F.when(last, F.col(m))), F.median(F.when(rest, F.col(m)))) for m in ("top1_pct", "null_pct", "ndv")}
    out = r.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *[x.alias(f"{m}_{s}") for m, pair in agg.items() for s, x in zip(("now", "before"), pair)]).filter("runs >= 3")
    return out.withColumn("drifted", (F.col("top1_pct_now") - F.col("top1_pct_before") >= 10) | (F.col("null_pct_now") - F.col("null_pct_before") >= 5) | (F.col("ndv_now") < 0.7 * F.col("ndv_before")))


def duplicate_groups(df: DataFrame, keys: Sequence[str], order: str, compare: Sequence[str] = ()) -> DataFrame:
    """``keys, size, first_row, last_row, differing``: groups of a key with more than one row; keys with a null are left out.

    ``differing`` names the compared columns with more than one value; it is empty in groups
    of equal rows. Everything is aggregated before the shuffle, so a hot group is one row a task.
    """
    some = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    agg = [F.count(F.lit(1)).alias("size"), F.min(order).alias("first_row"), F.max(order).alias("last_row")]
    agg += [x for c in compare for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))]
    g = some.groupBy(*keys).agg(*agg).filter("size > 1")
    names = F.array_compact(F.array(*[F.when(~F.col(f"__lo_{c}").eqNullSafe(F.col(f"__hi_{c}")), F.lit(c)) for c in compare])) if compare else F.array().cast("array<string>")
    return g.select(*keys, "size", "first_row", "last_row", F.array_join(names, ",").alias("differing"))


def dedup_keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *rest)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`") for c in df.columns])


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def forward_fill(df: DataFrame, by: Sequence[str], order: str, column: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def standardize_case(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lower(F.trim(F.col(c))) for c in columns})


def clean_number(x: Column) -> Column:
    """The number in a text with thousands' commas, a currency sign or a percent sign (percent divides by 100); null if there is none."""
    bare = F.regexp_replace(F.trim(x), r"[,¥$€\s]", "")
    return F.when(bare.endswith("%"), F.regexp_replace(bare, "%$", "").try_cast("double") / 100).otherwise(bare.try_cast("double"))


def key_measures(df: DataFrame, columns: Sequence[str], tasks: int = 16, counts: DataFrame | None = None) -> DataFrame:
    """``column_name, total, ndv, null_share, top1_share, verdict, rank``: how well a column deals rows to tasks."""
    c = counts if counts is not None else value_counts(df, columns)
    m = c.groupBy("column_name").agg(F.sum("n").alias("total"), F.count("v").alias("ndv"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.coalesce(F.max(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("top"))
    m = m.select("column_name", "total", "ndv", share(F.col("nulls"), F.col("total")).alias("null_share"), share(F.col("top"), F.col("total")).alias("top1_share"))
    verdict = F.when(F.col("null_share") >= 0.1, "null").when(F.col("ndv") < 4 * tasks, "low_ndv").when(F.col("top1_share") >= 0.2, "bad").when(F.col("top1_share") >= 0.05, "suspect").otherwise("good")
    order = F.when(verdict == "good", 0).when(verdict == "suspect", 1).when(verdict == "bad", 2).otherwise(3)
    return m.withColumn("verdict", verdict).withColumn("rank", F.row_number().over(Window.orderBy(order, "top1_share", "column_name")))  # one row for each column


def hot_keys(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """``value, n, share, verdict`` of the most frequent keys, null among them."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = counts.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(top).join(F.broadcast(total))
    s = F.col("n") / F.col("total")
    return rows.select("value", "n", s.alias("share"), F.when(s >= 0.2, "confirmed").when(s >= 0.05, "suspect").otherwise("ok").alias("verdict"))


def salt_count(top1: float) -> int:
    """Salts for a hot share: 50 times it, from 8 to 64."""
    return max(8, min(64, int(top1 * 50)))


def salted_sum(df: DataFrame, key: str, value: Column, row: str, salts: int = 16) -> DataFrame:
    """``key, n, total`` in two stages: by key and salt, then by key. For aggregates that have no map-side part."""
    part = df.groupBy(key, F.pmod(F.xxhash64(row), F.lit(salts)).alias("__salt")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("t"))
    return part.groupBy(key).agg(F.sum("n").alias("n"), F.sum("t").cast("double").alias("total"))


def partition_candidates(p: DataFrame, usage: DataFrame) -> DataFrame:
    """Scores of partition columns from a profile and a table of filter use (``column_name, hits``)."""
    total = usage.agg(F.sum("hits").alias("all"))
    x = p.join(usage, "column_name", "left").join(F.broadcast(total))
    timed = F.col("kind").isin("date", "datetime", "date_slash") | F.lower("column_name").rlike("(^|_)(dt|pt|ds|day|date|time|ts)(_|$)|date$")
    inside = F.col("ndv").between(2, 5000)
    score = 3.0 * F.coalesce(F.col("hits") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0)) + F.when(timed, 2).otherwise(0) + F.when(inside, 1).otherwise(-1)
    verdict = F.when(~inside, "unsuitable").when(timed, "recommended").otherwise("possible")
    return x.select("column_name", "ndv", F.round(score, 4).alias("score"), verdict.alias("verdict"))


def domain_index(df: DataFrame, most: int = 50, longest: int = 64) -> DataFrame:
    """``column_name, v, n`` of the string columns with few distinct values, ids left out."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.lower().endswith("_id")]
    c = value_counts(df, columns).filter("v is not null")
    few = c.groupBy("column_name").agg(F.count(F.lit(1)).alias("k"), F.max(F.length("v")).alias("l")).filter((F.col("k") <= most) & (F.col("l") <= longest)).select("column_name")
    return c.join(few, "column_name")


@dataclass(frozen=True)
class Column_:
    """A column to make up: sequence, enum (values with weights), int, float, date, text."""

    name: str
    kind: str
    low: float = 0
    high: float = 1
    values: tuple = ()
    weights: tuple = ()
    null_rate: float = 0.0


def plan_mock(df: DataFrame, columns: Sequence[str], most: int = 20) -> list[Column_]:
    """How to make up rows of the same shape, from one profile: ranges of numbers and dates, frequencies of few values, lengths of texts."""
    made = []
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = value_counts(df, columns)
    p = {r.column_name: r for r in profile(df, columns, counts).collect()}  # one row for each column
    dates = [c for c in columns if isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    few = [c for c in columns if c not in dates and not isinstance(types[c], T.NumericType) and p[c].ndv <= most]
    number = {c: F.unix_date(F.to_date(c)) if c in dates else F.length(F.col(c).cast("string")) for c in columns if c not in few and not isinstance(types[c], T.NumericType)}
    bounds = df.agg(F.count(F.lit(1)), *[f(x).alias(f"{c}|{n}") for c, x in number.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top: dict[str, list] = {c: [] for c in few}
    for r in counts.filter(F.col("column_name").isin(*few) & F.col("v").isNotNull()).orderBy("column_name", "v").collect() if few else ():  # at most `most` for each column
        top[r.column_name].append((r.v, r.n))
    for c in columns:
        r, nulls = p[c], p[c].null_pct / 100
        if isinstance(types[c], T.NumericType):
            whole = isinstance(types[c], T.IntegralType)
            made.append(Column_(c, "sequence" if whole and r.unique_pct == 100 else "int" if whole else "float", r.min_num or 0, r.max_num or 0, null_rate=nulls))
        elif c in few:
            made.append(Column_(c, "enum", values=tuple(v for v, _ in top[c]), weights=tuple(n for _, n in top[c]), null_rate=nulls))
        else:
            made.append(Column_(c, "date" if c in dates else "text", bounds[f"{c}|lo"] or 0, bounds[f"{c}|hi"] or 0, null_rate=nulls))
    return made


def mock_rows(spark, plan: Sequence[Column_], n: int, seed: int = 42) -> DataFrame:
    """n made-up rows. Every cell is a hash of row, seed and column, so the rows do not depend on how they are dealt to tasks."""
    out = spark.range(n)
    for c in plan:
        u = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(c.name)), F.lit(1 << 30)) / float(1 << 30)
        if c.kind == "sequence":
            x = (F.col("id") + int(c.low)).cast("long")
        elif c.kind == "int":
            x = F.floor(u * (c.high - c.low + 1) + c.low).cast("long")
        elif c.kind == "float":
            x = F.round(u * (c.high - c.low) + c.low, 2)
        elif c.kind == "date":
            x = F.date_from_unix_date(F.floor(u * (c.high - c.low + 1) + c.low).cast("int"))
        elif c.kind == "enum":
            x, upto, total = F.lit(None).cast("string"), float(sum(c.weights)), float(sum(c.weights)) or 1.0
            for v, w in zip(c.values[::-1], c.weights[::-1]):
                x = F.when(u < upto / total, F.lit(v)).otherwise(x)
                upto -= w
        else:
            size = F.floor(u * (c.high - c.low + 1) + c.low).cast("int")
            x = F.substring(F.repeat(F.sha2(F.concat_ws("-", "id", F.lit(c.name)), 256), max(1, -(-int(c.high) // 64))), F.lit(1), size)
        dice = F.pmod(F.xxhash64("id", F.lit(seed + 1), F.lit(c.name)), F.lit(1_000_000))
        out = out.withColumn(c.name, F.when(dice < int(c.null_rate * 1_000_000), None).otherwise(x) if c.null_rate else x)
    return out.drop("id")
