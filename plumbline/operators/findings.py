"""Findings of run boards and inventories: rows of (code, severity, subject, value), graded by fixed limits.

Each function takes the measures that another operator made, or the inventory itself, and
gives a row for each rule that a subject breaks. Rules are an array of cells for each row, so
that all of them are one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.values import share

# Limits of the rules.
SLA_RATE, SLA_RATE_HIGH, SLA_STREAK, SLA_LATE_MIN = 0.95, 0.80, 3, 60.0
DETECT_MIN, RESPOND_MIN, SILENT_MIN, HIGH_FACTOR = 15.0, 15.0, 30.0, 4.0
SMALL_MB, SMALL_FILES, MANY_FILES, SMALL_SHARE, SMALL_SHARE_HIGH = 32, 10, 1000, 0.25, 0.5
ACTIVE_DAYS, GRACE_DAYS, COLD_SHARE, COLD_SHARE_HIGH = 90, 30, 0.25, 0.5
UNALLOCATED_SHARE, UNALLOCATED_HIGH, CONCENTRATION = 0.10, 0.30, 0.50
BACKPRESSURE, WATERMARK_MS, RESTARTS = (0.5, 0.8), (60_000.0, 300_000.0), (1, 3)
BUCKET_S, STORM_RATIO, STORM_LEAST, STORM_ALERTS, FLAPS, FLAP_S, NOISY_SHARE = 300, 3.0, 5, 8, 5, 3600, 0.5
COLD_GB, COLD_DAYS, SMALL_FILE_MB, RETENTION_DAYS = 100.0, 90, 16.0, 365
LEAST_CADENCE_S, DAILY_S, SEVERAL_DAYS_S, GRACE_SHARE = 45 * 60, 0.75 * 86400, 1.75 * 86400, 0.25
HOT_LAYERS = ("dwd", "dws", "ads")
# Classes of change capture errors; the first that matches wins.
CAPTURE_ERRORS = (("schema_change", r"(?i)(alter\s+table|schema|ddl|unknown column|column count)"), ("duplicate_key", r"(?i)(duplicate\s+(entry|key)|primary)"), ("connection", r"(?i)(connect|timeout|eof|broken pipe|reset|refused)"))
# What marks an error line of a job log, and what stands for its volatile parts, in the order of replacement.
LOG_STAMP, LOG_ERROR = r"^\d{4}-\d{2}-\d{2}T[\d:.]+Z\s?", r"##\[error\]|^Traceback \(most recent call last\)|^(?:FAILED|ERROR)\b|[A-Za-z]*Error\b|\berror\[|npm ERR!|FATAL"
LOG_PARTS = ((r"\b(?=\d*[a-f])[0-9a-f]{7,40}\b", "<hash>"), (r"\b\d+(\.\d+)+\b", "<ver>"), (r"\b\d+\b", "<n>"), (r"(?:[A-Za-z]:)?[\\/][\w.\\/-]{6,}", "<path>"), (r"'[^']{1,80}'", "'<s>'"), (r'"[^"]{1,80}"', '"<s>"'), (r"\s+", " "))
# Families of column types.
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "integer": 32, "bigint": 64}
#: Fixed value: names of keys.
KEYISH = r"(^id$|_id$|_key$|_no$)"
STRINGS, FLOATS, TIMES = ("string", "varchar", "char", "text"), ("float", "double"), ("timestamp", "timestamp_ntz", "datetime")


def finding(code: str, severity: Column | str, subject: Column, value: Column, when: Column) -> Column:
    """A cell of a row's findings; null if the rule holds."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(F.lit(code).alias("code"), level.alias("severity"), subject.cast("string").alias("subject"), value.cast("double").alias("value")))


def found(df: DataFrame, *cells: Column) -> DataFrame:
    """``code, severity, subject, value`` of the cells that are not null."""
    return df.select(F.explode(F.array_compact(F.array(*cells))).alias("f")).select("f.*")


def graded(value: Column, limits: tuple[float, float], low: str = "mid") -> Column:
    """'high' from the second limit on, ``low`` from the first, else null."""
    return F.when(value >= limits[1], "high").when(value >= limits[0], low)


def sla_findings(board: DataFrame, target: float = SLA_RATE) -> DataFrame:
    """SL001 attainment below the target, SL002 a live streak of misses, SL003 late by more than an hour at the 90th percentile, of a board's tasks."""
    rate, task = F.col("attainment"), F.col("task")
    return found(
        board,
        finding("SL001", F.when(rate < SLA_RATE_HIGH, "high").otherwise("medium"), task, rate, rate < target),
        finding("SL002", "high", task, F.col("live"), F.col("live") >= SLA_STREAK),
        finding("SL003", "medium", task, F.col("late_p90"), F.col("late_p90") > SLA_LATE_MIN),
    )


def incident_findings(times: DataFrame) -> DataFrame:
    """IR001 slow to detect, IR002 slow to respond, IR003 a silent gap, IR004 never recovered, of incidents' times in minutes; four times the limit is high."""
    cells = [finding(code, F.when(F.col(c) >= HIGH_FACTOR * least, "high").otherwise("medium"), F.col("incident"), F.col(c), F.col(c) >= least) for code, c, least in (("IR001", "mttd", DETECT_MIN), ("IR002", "mtta", RESPOND_MIN), ("IR003", "silent", SILENT_MIN))]
    return found(times, *cells, finding("IR004", "high", F.col("incident"), F.lit(None), F.col("mttr").isNull()))


def compaction_findings(files: DataFrame) -> DataFrame:
    """CP001 the share of a table's files that are in partitions of small files, CP002 partitions of a thousand files (``table_name, part, file_count, total_mb``)."""
    small = (F.col("file_count") > SMALL_FILES) & (F.col("total_mb") / F.col("file_count") < SMALL_MB)
    tables = files.groupBy("table_name").agg(share(F.sum(F.when(small, F.col("file_count")).otherwise(0)), F.sum("file_count")).alias("s"))
    one = found(tables, finding("CP001", graded(F.col("s"), (SMALL_SHARE, SMALL_SHARE_HIGH), "medium"), F.col("table_name"), F.col("s"), F.col("s") >= SMALL_SHARE))
    return one.unionByName(found(files, finding("CP002", "high", F.concat_ws("/", "table_name", "part"), F.col("file_count"), F.col("file_count") >= MANY_FILES)))


def retention_plan(parts: DataFrame, active: int = ACTIVE_DAYS) -> DataFrame:
    """``table_name, ttl_days, total, cold, archive, purge, undated``: how long each table's partitions are needed (``table_name, day, size, last_access``).

    A partition is warm if it was read in the last ``active`` days before the newest date. The
    TTL is the oldest warm age and 30 days, in steps of 30; what is older and not warm goes to
    the archive, and what was never read besides can be purged. Partitions without a date are counted.
    """
    today = parts.agg(F.max(F.greatest("day", F.coalesce("last_access", "day"))).alias("today"))
    x = parts.join(F.broadcast(today)).withColumn("age", F.datediff("today", "day"))  # one row is sent
    warm = F.coalesce(F.datediff("today", "last_access") <= active, F.lit(False))
    ttl = x.groupBy("table_name").agg(F.max(F.when(warm, F.col("age"))).alias("w"))
    ttl = ttl.select("table_name", F.coalesce(F.greatest(F.lit(30), F.ceil((F.col("w") + GRACE_DAYS) / 30) * 30), F.lit(30)).cast("long").alias("ttl_days"))
    cold = (F.col("age") > F.col("ttl_days")) & ~warm
    y = x.join(ttl, "table_name")
    sums = [F.sum(F.when(F.col("day").isNotNull(), F.col("size"))).alias("total"), F.coalesce(F.sum(F.when(cold, F.col("size"))), F.lit(0)).alias("cold")]
    return y.groupBy("table_name", "ttl_days").agg(*sums, F.count_if(cold).alias("archive"), F.count_if(cold & F.col("last_access").isNull()).alias("purge"), F.count_if(F.col("day").isNull()).alias("undated"))


def retention_findings(plan: DataFrame) -> DataFrame:
    """RP001 the share of a table that is cold, RP002 partitions to purge, RP003 partitions without a date, of a retention plan."""
    cold = share(F.col("cold"), F.col("total"))
    table = F.col("table_name")
    return found(
        plan,
        finding("RP001", graded(cold, (COLD_SHARE, COLD_SHARE_HIGH), "medium"), table, cold, cold >= COLD_SHARE),
        finding("RP002", "medium", table, F.col("purge"), F.col("purge") > 0),
        finding("RP003", "low", table, F.col("undated"), F.col("undated") > 0),
    )


def cost_findings(bill: DataFrame, unallocated: str = "unallocated") -> DataFrame:
    """CA001 the share without an owner, CA002 one owner with half of all, of a bill (``owner, cost, share``)."""
    top = bill.agg(F.max("share").alias("__top"))
    own = F.col("owner") == unallocated
    x = bill.join(F.broadcast(top))
    return found(
        x,
        finding("CA001", graded(F.col("share"), (UNALLOCATED_SHARE, UNALLOCATED_HIGH), "medium"), F.col("owner"), F.col("share"), own & (F.col("share") >= UNALLOCATED_SHARE)),
        finding("CA002", "low", F.col("owner"), F.col("share"), ~own & (F.col("share") == F.col("__top")) & (F.col("share") >= CONCENTRATION)),
    )


def job_findings(operators: DataFrame, restarts: DataFrame) -> DataFrame:
    """FD004 backpressure and FD005 watermark lag of a job's worst operator (``job, operator, backpressure, watermark_lag_ms``), FD006 restarts in the last hour (``job, count_1h``)."""
    worst = operators.groupBy("job").agg(F.max("backpressure").alias("b"), F.max("watermark_lag_ms").alias("w"))
    x = worst.join(restarts, "job", "full")
    limits = (("FD004", F.col("b"), BACKPRESSURE), ("FD005", F.col("w"), WATERMARK_MS), ("FD006", F.col("count_1h"), RESTARTS))
    return found(x, *[finding(code, graded(v, two), F.col("job"), v, v >= two[0]) for code, v, two in limits])


def capture_errors(errors: DataFrame) -> DataFrame:
    """``pipeline, kind, n, severity``: classes of change capture errors (``pipeline, error``); a change of schema is high."""
    kind = F.lit("other")
    for name, pattern in reversed(CAPTURE_ERRORS):
        kind = F.when(F.col("error").rlike(pattern), name).otherwise(kind)
    g = errors.filter(F.trim("error") != "").groupBy("pipeline", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("severity", F.when(F.col("kind") == "schema_change", "high").otherwise("mid"))


def due_slots(updates: DataFrame, cadence: DataFrame, now: int) -> DataFrame:
    """``table_name, slot_s, grid``: slots of a table's calendar that have no update and are due (``table_name, s``; ``table_name, interval_s``).

    Cadences under 45 minutes have no calendar; from three quarters of a day on the grid is of
    days, from 1.75 days on of several, else of hours. It runs from the first slot seen. A slot
    is due after the table's median offset in a slot and a quarter of its cadence.
    """
    daily = F.col("interval_s") >= DAILY_S
    unit = F.when(daily, 86400).otherwise(3600)
    step = F.when(F.col("interval_s") >= SEVERAL_DAYS_S, F.greatest(F.lit(1), F.bround(F.col("interval_s") / 86400.0)) * 86400).when(daily, F.lit(86400)).otherwise(F.greatest(F.lit(1), F.bround(F.col("interval_s") / 3600.0)) * 3600).cast("long")
    x = updates.join(cadence.filter(F.col("interval_s") >= LEAST_CADENCE_S), "table_name").withColumns({"unit": unit.cast("long"), "step": step})
    x = x.withColumn("slot_s", F.col("s") - F.pmod("s", "unit"))
    have = x.select("table_name", "slot_s").distinct()
    g = x.groupBy("table_name", "unit", "step", "interval_s").agg(F.min("slot_s").alias("first"), F.median(F.col("s") - F.col("slot_s")).alias("offset"))
    spine = g.withColumn("slot_s", F.explode(F.sequence("first", F.lit(now).cast("long"), F.col("step"))))
    due = spine.filter(F.col("slot_s") + F.col("offset") + GRACE_SHARE * F.col("interval_s") <= now)
    return due.join(have, ["table_name", "slot_s"], "left_anti").select("table_name", "slot_s", F.when(F.col("unit") == 86400, "day").otherwise("hour").alias("grid"))


def alert_findings(alerts: DataFrame, title: Column, second: str = "s", source: str = "source") -> DataFrame:
    """AS001 alerts for each signature, AS002 windows of a storm, AS003 signatures that fire five times in an hour, AS004 a source with half of all.

    Storms are looked for among eight alerts or more. A signature's alerts are one window; a
    source's and a bucket's are sums.
    """
    from .telemetry import signature

    rows = alerts.select(signature(title).alias("signature"), F.col(second).alias("s"), F.col(source).alias("source"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("signature").alias("k"))
    ratio = share(F.col("n"), F.col("k"))
    out = found(total, finding("AS001", "low", F.lit("all"), ratio, F.col("n") > 0))
    buckets = rows.groupBy(F.floor(F.col("s") / BUCKET_S).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sizes = buckets.groupBy("n").agg(F.count(F.lit(1)).alias("c"))  # as many rows as there are sizes
    run = sizes.withColumn("upto", F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    all_ = run.agg(F.sum("c").alias("m"), F.sum(F.col("n") * F.col("c")).alias("alerts"))
    mid = run.join(F.broadcast(all_)).filter(F.col("upto") > F.floor(F.col("m") / 2)).agg(F.min("n").alias("mid"), F.max("alerts").alias("alerts"))
    storm = buckets.join(F.broadcast(mid)).filter((F.col("alerts") >= STORM_ALERTS) & (F.col("n") >= STORM_RATIO * F.col("mid")) & (F.col("n") >= STORM_LEAST))
    out = out.unionByName(found(storm, finding("AS002", "high", (F.col("b") * BUCKET_S).cast("long"), F.col("n"), F.lit(True))))
    w = Window.partitionBy("signature").orderBy("s")
    spans = rows.withColumn("span", F.lead("s", FLAPS - 1).over(w) - F.col("s")).groupBy("signature").agg(F.min("span").alias("span"))
    out = out.unionByName(found(spans, finding("AS003", "mid", F.col("signature"), F.col("span") / 60, F.col("span") <= FLAP_S)))
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("c"))
    noisy = sources.join(F.broadcast(sources.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))))
    return out.unionByName(found(noisy, finding("AS004", "mid", F.col("source"), share(F.col("c"), F.col("n")), (F.col("k") > 1) & (F.col("c") >= NOISY_SHARE * F.col("n")))))


def storage_findings(inventory: DataFrame, parts: DataFrame, today: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """``action, table_name, freed_gb, severity``: cold tables, partitions past the retention (``table_name, day, size``), tables of small files."""
    cold = inventory.filter(f"size_gb >= {COLD_GB} and access_cnt = 0 and (idle_days is null or idle_days > {COLD_DAYS})")
    one = cold.select(F.lit("cold_tier").alias("action"), "table_name", F.col("size_gb").alias("freed_gb"), F.when(F.col("size_gb") >= 1000, "high").otherwise("mid").alias("severity"))
    old = parts.filter(F.datediff(today, "day") > days).groupBy("table_name").agg(F.sum("size").cast("double").alias("freed_gb"))
    two = old.select(F.lit("drop_partitions").alias("action"), "table_name", "freed_gb", F.when(F.col("freed_gb") >= 500, "high").otherwise("mid").alias("severity"))
    small = inventory.filter(f"avg_file_mb > 0 and avg_file_mb < {SMALL_FILE_MB}")
    return one.unionByName(two).unionByName(small.select(F.lit("compact").alias("action"), "table_name", F.lit(0.0).alias("freed_gb"), F.lit("low").alias("severity")))


def table_usage(log: DataFrame) -> DataFrame:
    """``table_name, ok, rejected, no_partition`` of a query log (``tables array, status, error``): hot tables, tables of rejected queries, and where a partition filter was missing."""
    bad = F.col("status").isin("rejected", "error")
    x = log.select(F.explode("tables").alias("t"), "status", F.lower(F.coalesce("error", F.lit(""))).alias("e"))
    return x.groupBy(F.lower("t").alias("table_name")).agg(F.count_if(F.col("status").isin("success", "cache_hit")).alias("ok"), F.count_if(bad).alias("rejected"), F.count_if(bad & F.contains("e", F.lit("partition"))).alias("no_partition"))


def question_failures(log: DataFrame) -> DataFrame:
    """``question, source, n, failures, last_error`` of interactive questions (not '[tag] ...') in one form of case and space, by where they came from."""
    q = F.lower(F.trim(F.regexp_replace("question", r"\s+", " ")))
    x = log.filter((F.trim("question") != "") & ~F.trim("question").startswith("[")).withColumn("question", q)
    return x.groupBy("question", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "success").alias("failures"), F.substring(F.max_by(F.when(F.col("status") != "success", F.col("error")), F.when(F.col("status") != "success", F.col("ts"))), 1, 200).alias("last_error")
    )


def value_changes(old: DataFrame, new: DataFrame, columns: Sequence[str], unique: float = 0.5) -> DataFrame:
    """``column_name, v, change``: values that appeared or vanished (DA005) in columns of which at most half of the old values are distinct."""

    def values(df):
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")
        return df.select(cells).select("x.*").filter("v is not null").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))

    a, b = values(old), values(new)
    few = a.groupBy("column_name").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).filter(F.col("k") <= unique * F.col("all")).select("column_name")
    both = a.select("column_name", "v", F.lit(True).alias("__a")).join(b.select("column_name", "v", F.lit(True).alias("__b")), ["column_name", "v"], "full")
    changed = both.withColumn("change", F.when(F.col("__a").isNull(), "appeared").when(F.col("__b").isNull(), "vanished")).filter("change is not null")
    return changed.join(few, "column_name", "left_semi").select("column_name", "v", "change")


def top_growers(trends: DataFrame, by: str, k: int = 5) -> DataFrame:
    """``by, per_day, share``: the metrics that grow most (CF002), and their share of all growth together (``by, per_day``)."""
    total = trends.filter(F.col(by) != "total").agg(F.sum("per_day").alias("__t"))
    up = trends.filter((F.col(by) != "total") & (F.col("per_day") > 0)).join(F.broadcast(total)).filter("__t > 0")
    return up.orderBy(F.desc("per_day"), by).limit(k).select(by, "per_day", share(F.col("per_day"), F.col("__t")).alias("share"))


def log_error_templates(logs: DataFrame, k: int = 10) -> DataFrame:
    """``template, n, jobs``: the error lines of job logs (``job, line``) in one form; the ten most frequent of all jobs."""
    line = F.regexp_replace("line", LOG_STAMP, "")
    out = F.trim(F.replace(line, F.lit("##[error]"), F.lit("")))
    for pattern, name in LOG_PARTS:
        out = F.regexp_replace(out, pattern, name)
    x = logs.filter(line.rlike(LOG_ERROR)).select("job", F.substring(F.trim(out), 1, 200).alias("template")).filter("template <> ''")
    return x.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job").alias("jobs")).orderBy(F.desc("n"), "template").limit(k)


def align_findings(source: DataFrame, sink: DataFrame) -> DataFrame:
    """Columns (``column_name, data_type, nullable, has_default``) that a sink cannot take as they come.

    SA001 no such column, SA002 a column that must be given, SA003 narrower, SA004 text into
    another kind, SA005 time into date, SA006 nulls into a column without.
    """
    base = lambda c: F.lower(F.regexp_extract(c, r"^\s*([A-Za-z_]+)", 1))
    arg = lambda c, i: F.nullif(F.regexp_extract(c, r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", i), F.lit("")).cast("int")
    a = source.select(F.lower("column_name").alias("k"), F.col("column_name").alias("c"), F.col("data_type").alias("t"), F.col("nullable").alias("nul"))
    b = sink.select(F.lower("column_name").alias("k"), F.col("column_name").alias("c2"), F.col("data_type").alias("t2"), F.col("nullable").alias("nul2"), F.col("has_default").alias("d2"))
    x = a.join(b, "k", "full").withColumns({"s": base("t"), "d": base("t2")})
    bits = lambda c: F.coalesce(*[F.when(F.col(c) == n, v) for n, v in BITS.items()])
    p1, p2, q1, q2 = F.coalesce(arg("t", 1), F.lit(10)), F.coalesce(arg("t2", 1), F.lit(10)), F.coalesce(arg("t", 2), F.lit(0)), F.coalesce(arg("t2", 2), F.lit(0))
    dec = (F.col("s") == "decimal") & (F.col("d") == "decimal")
    text = F.col("s").isin(*STRINGS)
    number = bits("d").isNotNull() | F.col("d").isin(*FLOATS, "decimal")
    both = F.col("c").isNotNull() & F.col("c2").isNotNull()
    narrow = F.when(bits("d") < bits("s"), "high").when(dec & ((p2 < p1) | (q2 < q1)), "high").when(text & F.col("d").isin(*STRINGS) & (arg("t2", 1) < arg("t", 1)), "mid").when((F.col("s").isin(*FLOATS) | (F.col("s") == "decimal")) & bits("d").isNotNull(), "high")
    none, name = F.lit(None), F.coalesce("c", "c2")
    return found(
        x,
        finding("SA001", F.when(F.col("k").rlike(KEYISH), "high").otherwise("mid"), name, none, F.col("c2").isNull()),
        finding("SA002", "high", name, none, F.col("c").isNull() & ~F.col("nul2") & ~F.col("d2")),
        finding("SA003", narrow, name, none, both & narrow.isNotNull()),
        finding("SA004", "high", name, none, both & text & (number | F.col("d").isin(*TIMES, "date"))),
        finding("SA005", "mid", name, none, both & F.col("s").isin(*TIMES) & (F.col("d") == "date")),
        finding("SA006", "high", name, none, both & ~F.col("nul2") & F.col("nul")),
    )


def coverage_findings(tables: DataFrame, checks: DataFrame) -> DataFrame:
    """CM001 tables without a rule or contract (hot layers are high), CM002 rules and contracts of no table (``artifact, table_name``)."""
    t, c = tables.select(F.lower("table_name").alias("k"), F.col("table_name").alias("t")), checks.select(F.lower("table_name").alias("k"), "artifact").distinct()
    hot = F.element_at(F.split("k", "[._]", 2), 1).isin(*HOT_LAYERS)
    bare = found(t.join(c, "k", "left_anti"), finding("CM001", F.when(hot, "high").otherwise("medium"), F.col("t"), F.lit(None), F.lit(True)))
    return bare.unionByName(found(c.join(t, "k", "left_anti"), finding("CM002", "medium", F.concat_ws(":", "artifact", "k"), F.lit(None), F.lit(True))))


def busy_windows(runs: DataFrame, by: Sequence[str], slots: float, memory: float | None = None) -> DataFrame:
    """``by, start, finish, peak_slots, peak_memory``: maximal times at which runs (``start, finish, slots, memory``) take more than there is; finishes count before starts.

    Runs are summed at each moment first, so that a group's window has a row for each moment.
    """
    ends = F.explode(F.array(F.struct(F.col("start").alias("t"), F.col("slots").alias("ds"), F.col("memory").alias("dm")), F.struct(F.col("finish").alias("t"), (-F.col("slots")).alias("ds"), (-F.col("memory")).alias("dm")))).alias("e")
    w = Window.partitionBy(*by).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = runs.select(*by, ends).select(*by, "e.*").groupBy(*by, "t").agg(F.sum("ds").alias("ds"), F.sum("dm").alias("dm"))
    x = x.withColumns({"s": F.sum("ds").over(upto), "m": F.sum("dm").over(upto), "next": F.lead("t").over(w)}).filter("next is not null")
    over = (F.col("s") > slots) | ((F.col("m") > memory) if memory else F.lit(False))
    x = x.withColumn("over", over).withColumn("run", F.sum(F.when(~F.col("over"), 1).otherwise(0)).over(upto))
    return x.filter("over").groupBy(*by, "run").agg(F.min("t").alias("start"), F.max("next").alias("finish"), F.max("s").alias("peak_slots"), F.max("m").alias("peak_memory")).drop("run")


def column_dictionary(column_edges: DataFrame) -> DataFrame:
    """``table_name, column_name, sources, expression, aggregates`` of each column of a lineage (``src_table, src_column, dst_table, dst_column, expression, is_aggregation``); columns that are only read have no sources."""
    made = column_edges.groupBy(F.col("dst_table").alias("table_name"), F.col("dst_column").alias("column_name")).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "src_table", "src_column"))), ",").alias("sources"), F.max("expression").alias("expression"), F.max("is_aggregation").alias("aggregates")
    )
    read = column_edges.select(F.col("src_table").alias("table_name"), F.col("src_column").alias("column_name")).distinct().join(made, ["table_name", "column_name"], "left_anti")
    return made.unionByName(read.select("table_name", "column_name", F.lit("").alias("sources"), F.lit(None).cast("string").alias("expression"), F.lit(False).alias("aggregates")))
