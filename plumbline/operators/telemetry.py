"""Telemetry of streams and operations: lateness, hops, lag, freshness, service levels, alerts, failures, partitions, storage, cost, access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.durable import settle
from plumbline.functions.values import nearest_rank, share

from . import graphs as G
from .windows import out_of_order

HOUR = 3600
# Classes of task errors; the first that matches wins.
ERRORS = (
    ("dependency_missing", r"(?i)(upstream|dependen|not\s+found|no\s+such|missing|partition.*(miss|not)|filenotfound|does not exist|等待上游|上游未就绪)"),
    ("resource", r"(?i)(outofmemory|oom|memory limit|killed|container|yarn|quota|disk.*(full|space)|slots?|资源不足|内存)"),
    ("timeout", r"(?i)(time.?out|deadline|expired|超时)"),
    ("connection", r"(?i)(connect|refused|reset|unreachable|broken pipe|eof|网络)"),
    ("data_error", r"(?i)(parse|cast|schema|column|null.*constraint|duplicate|malformed|corrupt|encoding|脏数据|类型)"),
    ("code_error", r"(?i)(traceback|exception|nullpointer|nameerror|syntaxerror|indexerror|keyerror|assert)"),
)


def lateness(df: DataFrame, event: str, arrival: str, key: str) -> DataFrame:
    """One row: events, p50/p95/p99 of the lateness from 0 to an hour, the largest, the share out of order, the bound, what the bound leaves late, and the codes WM001-WM003."""
    late = df.withColumn("__late", F.col(arrival) - F.col(event))
    inside = nearest_rank(late.filter(f"__late between 0 and {HOUR}"), [], "__late", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    order = out_of_order(df, event, [arrival, key], F.floor(F.col(arrival) / HOUR)).agg(F.count(F.lit(1)).alias("events"), F.count_if("late").alias("late_n"))
    bound = inside.withColumn("bound", F.greatest(F.lit(1), F.ceil(F.col("p99") * 1.25)).cast("long"))
    rest = late.join(F.broadcast(bound)).agg(F.max("__late").alias("most"), F.count_if(F.col("__late") > F.col("bound")).alias("residual_n"), F.count_if(F.col("__late") < 0).alias("ahead_n"), F.count_if(F.col("__late") > HOUR).alias("stragglers"))
    x = bound.join(order).join(rest)  # each is one row
    codes = F.array_compact(F.array(F.when(F.col("ahead_n") >= 0.05 * F.col("events"), "WM001"), F.when(F.col("most") >= 10 * F.col("p99"), "WM002"), F.when(F.col("stragglers") > 0, "WM003")))
    return x.select("events", "p50", "p95", "p99", "most", share(F.col("late_n"), F.col("events")).alias("out_of_order"), "bound", share(F.col("residual_n"), F.col("events")).alias("residual"), F.array_join(codes, ",").alias("codes"))


def stage_hops(df: DataFrame, key: str, stages: Sequence[str]) -> DataFrame:
    """``key, hop, delta`` between present stages (missing ones are bridged); negative deltas are zero. Stages are numbers of one unit."""
    cells = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("t")) for s in stages]), lambda c: c["t"].isNotNull())
    x = df.select(key, cells.alias("c")).filter(F.size("c") >= 2)
    pairs = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.struct(F.concat(a["s"], F.lit("->"), b["s"]).alias("hop"), F.greatest(b["t"] - a["t"], F.lit(0)).alias("delta")))
    ends = F.struct(F.lit("total").alias("hop"), F.greatest(F.element_at("c", -1)["t"] - F.element_at("c", 1)["t"], F.lit(0)).alias("delta"))
    return x.select(key, F.explode(F.concat(pairs, F.array(ends))).alias("h")).select(key, "h.hop", "h.delta")


def hop_latency(hops: DataFrame) -> DataFrame:
    """``hop, n, p50, p95, most`` and whether the hop has the largest p95 of the single hops."""
    q = nearest_rank(hops, ["hop"], "delta", {"p50": 0.5, "p95": 0.95})
    x = hops.groupBy("hop").agg(F.count(F.lit(1)).alias("n"), F.max("delta").alias("most")).join(q, "hop")
    top = x.filter("hop <> 'total'").agg(F.max_by("hop", F.struct("p95", "hop")).alias("__top"))
    return x.join(F.broadcast(top)).select("hop", "n", "p50", "p95", "most", (F.col("hop") == F.col("__top")).alias("dominant"))


def slow_events(hops: DataFrame, key: str, factor: float = 3.0) -> DataFrame:
    """``key, total, worst_hop``: events whose total is over three times the median of all (of at least four events)."""
    m = hops.filter("hop = 'total'").agg(F.median("delta").alias("__m"), F.count(F.lit(1)).alias("__n"))
    worst = hops.filter("hop <> 'total'").groupBy(key).agg(F.max_by("hop", F.struct("delta", "hop")).alias("worst_hop"))
    slow = hops.filter("hop = 'total'").join(F.broadcast(m)).filter((F.col("__n") >= 4) & (F.col("delta") > factor * F.col("__m")))
    return slow.select(key, F.col("delta").alias("total")).join(worst, key)


def consumer_lag(snapshot: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lag per group of a snapshot (``end_offset, committed, consume_rate, produce_rate``) with KL001 total, KL002 hot partition, KL003 falling behind, KL004 stalled, KL005 slow to catch up."""
    x = snapshot.withColumn("lag", F.greatest(F.col("end_offset") - F.col("committed"), F.lit(0)))
    g = x.groupBy(*by).agg(F.sum("lag").alias("lag"), F.max("lag").alias("worst"), F.median("lag").alias("mid"), F.sum("consume_rate").alias("consume"), F.sum("produce_rate").alias("produce"))
    ratio = share(F.col("worst"), F.col("mid"))
    eta = F.when(F.col("consume") > F.col("produce"), F.col("lag") / (F.col("consume") - F.col("produce")) / 60)
    codes = F.array_compact(F.array(
        F.when(F.col("lag") >= 1_000_000, "KL001 high").when(F.col("lag") >= 100_000, "KL001 mid"), F.when(ratio >= 20, "KL002 high").when(ratio >= 5, "KL002 mid"),
        F.when((F.col("consume") <= F.col("produce")) & (F.col("consume") > 0), "KL003"), F.when((F.col("consume") == 0) & (F.col("lag") > 0), "KL004"), F.when(eta >= 180, "KL005 high").when(eta >= 30, "KL005 mid")))
    return g.select(*by, "lag", ratio.alias("ratio"), eta.alias("eta_min"), F.array_join(codes, ",").alias("codes"))


def cdc_gaps(fleet: DataFrame) -> DataFrame:
    """A fleet snapshot's pipelines (``source_file, source_pos, file, pos, age_s, retention_s``) with files behind, byte lag, staleness and share of retention used."""
    files = F.col("source_file") - F.col("file")
    lag = F.when(files == 0, F.col("source_pos") - F.col("pos"))
    used = share(F.col("age_s"), F.col("retention_s"))
    codes = F.array_compact(F.array(
        F.when((files < 0) | (lag < 0), "ahead"), F.when(lag >= 200 * 2**20, "bytes high").when(lag >= 10 * 2**20, "bytes mid"), F.when(files > 0, "files"),
        F.when(F.col("age_s") >= 1800, "stale high").when(F.col("age_s") >= 300, "stale mid"), F.when(used >= 0.8, "retention high").when(used >= 0.5, "retention mid")))
    return fleet.select("pipeline", files.alias("files_behind"), lag.alias("byte_lag"), used.alias("retention_used"), F.array_join(codes, ",").alias("codes"))


def checkpoint_health(history: DataFrame, by: Sequence[str], run: str) -> DataFrame:
    """Checkpoints of jobs (``duration_s, failed, alignment_s``): failures, whether the last is slow (60 or 300 s, or twice the median before), alignment share."""
    r = history.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(run))))
    g = r.groupBy(*by).agg(F.count_if("failed").alias("failures"), F.max(F.when(F.col("__r") == 1, F.col("duration_s"))).alias("last_s"), F.median(F.when(F.col("__r") > 1, F.col("duration_s"))).alias("before_s"), F.sum("alignment_s").alias("a"), F.sum("duration_s").alias("d"))
    slow = F.when(F.col("last_s") >= 300, "high").when((F.col("last_s") >= 60) | (F.col("last_s") >= 2 * F.col("before_s")), "mid")
    return g.select(*by, "failures", "last_s", "before_s", slow.alias("slow"), (share(F.col("a"), F.col("d")) >= 0.5).alias("aligning"))


def stage_skew(tasks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stages of a task table (``duration_ms, shuffle_bytes``): median and largest, ratio, and the gates of time and bytes."""
    g = tasks.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), F.median("duration_ms").alias("p50_ms"), F.max("duration_ms").alias("max_ms"), F.median("shuffle_bytes").alias("p50_bytes"), F.max("shuffle_bytes").alias("max_bytes"))
    t, b = share(F.col("max_ms"), F.col("p50_ms")), share(F.col("max_bytes"), F.col("p50_bytes"))
    high = (t >= 5) & (F.col("max_ms") >= 30_000) | (b >= 5) & (F.col("max_bytes") >= 128 * 2**20)
    mid = (t >= 3) & (F.col("max_ms") >= 10_000) | (b >= 3) & (F.col("max_bytes") >= 32 * 2**20)
    return g.select(*by, "tasks", "p50_ms", "max_ms", t.alias("ratio"), F.when(F.col("tasks") < 3, None).when(F.coalesce(high, F.lit(False)), "high").when(F.coalesce(mid, F.lit(False)), "mid").alias("severity"))


def shuffle_spread(tasks: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by, p50, p99, most, ratio, salts``: the spread of what tasks read, and the least number of salts that brings the largest under twice the median."""
    q = nearest_rank(tasks, by, value, {"p99": 0.99}, rule="floor")
    g = tasks.groupBy(*by).agg(F.median(value).alias("p50"), F.max(value).alias("most")).join(q, list(by))
    ratio = share(F.col("p99"), F.col("p50"))
    salts = F.get(F.filter(F.sequence(F.lit(2), F.lit(64)), lambda n: F.col("most") / n <= 2 * F.col("p50")), 0)
    return g.select(*by, "p50", "p99", "most", ratio.alias("ratio"), F.when(ratio >= 2, F.coalesce(salts, F.lit(64))).alias("salts"))


def run_diagnosis(runs: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The latest run of each name (``scan_bytes, spill_bytes, gc_s, queue_s, duration_s``) against the median scan before: codes of what stands out."""
    r = runs.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))))
    base = r.groupBy(*by).agg(F.median(F.when(F.col("__r") > 1, F.col("scan_bytes"))).alias("base_scan"))
    x = r.filter("__r = 1").join(base, list(by))
    codes = F.array_compact(F.array(F.when(F.col("scan_bytes") >= 2 * F.col("base_scan"), "scan"), F.when(F.col("spill_bytes") > 0, "spill"), F.when(F.col("gc_s") >= 0.2 * F.col("duration_s"), "gc"), F.when(F.col("queue_s") >= 0.3 * F.col("duration_s"), "queue")))
    return x.select(*by, "scan_bytes", "base_scan", F.array_join(codes, ",").alias("codes"))


def table_freshness(updates: DataFrame, rules: DataFrame, now: int | None = None) -> DataFrame:
    """``table_name, age_s, interval_s, state`` of update times (``table_name, s``): stalled, stale, late, unknown or ok.

    ``rules`` (``rank, pattern, interval_s, max_age_s``; a glob) apply by the first that fits;
    without an interval it is the median gap of at least three updates.
    """
    w = Window.partitionBy("table_name").orderBy("s")
    gaps = updates.select("table_name", "s").distinct().withColumn("gap", F.col("s") - F.lag("s").over(w))
    g = gaps.groupBy("table_name").agg(F.max("s").alias("last"), F.count(F.lit(1)).alias("n"), F.median("gap").alias("typical"), F.max_by("gap", "s").alias("last_gap"))
    latest = F.lit(now) if now is not None else F.max("last").over(Window.partitionBy(F.lit(0)))  # one row for each table
    regex = F.concat(F.lit("^"), F.replace(F.replace(F.col("pattern"), F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$"))
    hits = g.join(F.broadcast(rules), F.rlike(F.col("table_name"), regex), "left")
    best = hits.groupBy("table_name").agg(F.min_by(F.struct("interval_s", "max_age_s"), "rank").alias("r"))
    x = g.withColumn("now", latest).join(best, "table_name")
    interval = F.coalesce(F.col("r.interval_s").cast("double"), F.when(F.col("n") >= 3, F.col("typical")))
    age = F.col("now") - F.col("last")
    state = F.when(age > 2 * interval, "stalled").when(age > F.col("r.max_age_s"), "stale").when(F.col("last_gap") > 1.25 * interval, "late").when(interval.isNull(), "unknown").otherwise("ok")
    return x.select("table_name", age.alias("age_s"), interval.alias("interval_s"), state.alias("state"))


def missing_slots(updates: DataFrame, by: str, day: Column, start: str, end: str) -> DataFrame:
    """``by, day``: days of a range on which a table has no update, by a spine and an anti-join."""
    have = updates.select(by, day.alias("day")).distinct()
    spine = updates.select(by).distinct().select(by, F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return spine.join(have, [by, "day"], "left_anti")


def cascade(missing: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, day, hop``: what must run again downstream of missing days (``node, day``), with the largest number of hops: batches in order.

    At any depth; a cycle downstream is an error. Only edges that lead on from what is asked are drawn together and walked.
    """
    asked = settle(missing.select("node", "day").distinct())
    nodes = asked.select("node").distinct()
    e, runs, rings = G.chain_runs(G.ahead(edges, nodes), keep=nodes)
    if rings:
        raise ValueError("the graph has a cycle")
    steps = G.contracted(e, runs).groupBy(F.col("src").alias("__from"), F.col("dst").alias("to")).agg(F.max("hops").alias("more"))
    found = G.walks(steps, asked.withColumn("v", F.lit(0)), e.count() + 1, F.max("v"), F.col("v") + F.col("more"), ["day"])
    if runs is not None:
        inner = runs.select(F.col("node").alias("inner"), F.col("head").alias("node"), "hops")
        found = found.unionByName(found.join(inner, "node").select(F.col("inner").alias("node"), "day", (F.col("v") + F.col("hops")).alias("v")))
    return found.select("node", "day", F.col("v").cast("int").alias("hop"))


def sla_board(runs: DataFrame) -> DataFrame:
    """``task, runs, misses, attainment, late_p50, late_p90, worst, longest, live`` of runs (``task, day, deadline_min, finish_min``)."""
    from .windows import streaks

    x = runs.withColumn("late", F.col("finish_min") - F.col("deadline_min"))
    g = x.groupBy("task").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("late") > 0).alias("misses"), F.max(F.when(F.col("late") > 0, F.col("late"))).alias("worst"))
    q = nearest_rank(x.filter("late > 0"), ["task"], "late", {"late_p50": 0.5, "late_p90": 0.9})
    s = streaks(x, ["task"], "day", F.col("late") > 0)
    return g.join(q, "task", "left").join(s, "task", "left").withColumn("attainment", 1 - share(F.col("misses"), F.col("runs")))


def critical_run(tasks: DataFrame, goal: str) -> DataFrame:
    """``step, task, start, finish, wait``: from the goal back through the dependency that finished last (``task, start, finish, deps``)."""
    deps = tasks.select("task", F.explode("deps").alias("dep")).join(tasks.select(F.col("task").alias("dep"), F.col("finish").alias("f")), "dep")
    blocker = settle(deps.groupBy("task").agg(F.max_by("dep", F.struct("f", "dep")).alias("dep"), F.max("f").alias("f")))
    path = G.follow(blocker.select(F.col("task").alias("node"), F.col("dep").alias("to")), goal)
    run = path.select("step", F.col("node").alias("task")).join(tasks.select("task", "start", "finish"), "task").join(blocker.select("task", "f"), "task", "left")
    return run.select(F.col("step").cast("int").alias("step"), "task", "start", "finish", (F.col("start") - F.col("f")).alias("wait"))


def signature(x: Column, noise: str = r"[\d/:\\.\-_=']+", most: int = 70) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), noise, " "), r"\s+", " ")), 1, most)


def alert_summary(alerts: DataFrame, title: str, second: str) -> DataFrame:
    """``signature, n, first_s, last_s`` of alerts without their volatile parts."""
    return alerts.groupBy(signature(F.col(title)).alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min(second).alias("first_s"), F.max(second).alias("last_s"))


def alert_storms(alerts: DataFrame, second: str, bucket: int = 300, factor: float = 3.0, least: int = 5) -> DataFrame:
    """``bucket_s, n``: buckets of five minutes with at least three times the upper median of all and five alerts."""
    b = alerts.groupBy((F.floor(F.col(second) / bucket) * bucket).cast("long").alias("bucket_s")).agg(F.count(F.lit(1)).alias("n"))
    mid = nearest_rank(b, [], "n", {"mid": 0.5}, rule="floor")
    return b.join(F.broadcast(mid)).filter((F.col("n") >= factor * F.col("mid")) & (F.col("n") >= least)).select("bucket_s", "n")


def error_class(x: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(ERRORS):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return out


def failure_clusters(failures: DataFrame) -> DataFrame:
    """``cause, signature, n, retried, recovered`` of failed tasks (``error, retries, final_status``)."""
    return failures.groupBy(error_class(F.col("error")).alias("cause"), signature(F.col("error"), r"[\d/:\\.\-_']+", 60).alias("signature")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("retries") > 0).alias("retried"), F.count_if((F.col("retries") > 0) & (F.col("final_status") == "success")).alias("recovered")
    )


def incident_times(events: DataFrame) -> DataFrame:
    """``incident, mttd, mtta, mttr, silent`` in minutes of incidents' events (``incident, s, kind``): impact, alert, action, comm, recovery."""
    at = lambda k: F.min(F.when(F.col("kind") == k, F.col("s")))
    g = events.groupBy("incident").agg(at("impact").alias("i"), at("alert").alias("a"), at("action").alias("x"), F.max(F.when(F.col("kind") == "recovery", F.col("s"))).alias("r"))
    w = Window.partitionBy("incident").orderBy("s")
    gaps = events.join(g.select("incident", "i", "r"), "incident").filter("s between i and r").withColumn("gap", F.lead("s").over(w) - F.col("s")).groupBy("incident").agg(F.max("gap").alias("gap"))
    return g.join(gaps, "incident", "left").select("incident", ((F.col("a") - F.col("i")) / 60).alias("mttd"), ((F.col("x") - F.col("a")) / 60).alias("mtta"), ((F.col("r") - F.col("i")) / 60).alias("mttr"), (F.col("gap") / 60).alias("silent"))


def partition_health(parts: DataFrame) -> DataFrame:
    """``table_name, day, code``: empty partitions, sizes over 5 (high 20) times the median or over 3 times, or under 0.3 of, the median of earlier ones (``table_name, day, size``)."""
    mid = parts.groupBy("table_name").agg(F.median("size").alias("mid"), F.count(F.lit(1)).alias("k"))
    last = parts.groupBy("table_name").agg(F.max("day").alias("last"))
    earlier = parts.join(last, "table_name").filter("day < last").groupBy("table_name").agg(F.median("size").alias("before"))
    x = parts.join(mid, "table_name").join(last, "table_name").join(earlier, "table_name", "left")
    code = (
        F.when(F.col("size") == 0, "empty").when((F.col("k") >= 4) & (F.col("size") >= 20 * F.col("mid")), "skew high").when((F.col("k") >= 4) & (F.col("size") >= 5 * F.col("mid")), "skew mid")
        .when((F.col("day") == F.col("last")) & (F.col("size") >= 3 * F.col("before")), "surge").when((F.col("day") == F.col("last")) & (F.col("size") <= 0.3 * F.col("before")), "shrink")
    )
    return x.select("table_name", "day", code.alias("code")).filter("code is not null")


def compaction(files: DataFrame, target_mb: int = 256) -> DataFrame:
    """``table_name, part, files, freed, share``: partitions of small files, what one rewrite frees, and its share of all that is freed (``file_count, total_mb``)."""
    after = F.greatest(F.lit(1), F.ceil(F.col("total_mb") / target_mb)).cast("long")
    small = files.filter((F.col("total_mb") / F.col("file_count") < 32) & (F.col("file_count") > 10)).select("table_name", "part", F.col("file_count").alias("files"), (F.col("file_count") - after).alias("freed"))
    total = small.agg(F.sum("freed").alias("__t"))
    return small.join(F.broadcast(total)).select("table_name", "part", "files", "freed", share(F.col("freed"), F.col("__t")).alias("share"))


def asset_value(inventory: DataFrame) -> DataFrame:
    """``table_name, score, tier, quadrant`` by access, downstream tables and recency, against the median size."""
    recent = F.when(F.col("idle_days") <= 7, 20).when(F.col("idle_days") <= 30, 10).when(F.col("idle_days") <= 90, 5).otherwise(0)
    score = F.least(F.lit(50.0), 8 * F.log2(1 + F.col("access_cnt"))) + F.least(F.lit(30.0), 6.0 * F.col("downstream_cnt")) + recent
    mid = inventory.agg(F.median("size_gb").alias("__m"))
    x = inventory.join(F.broadcast(mid)).withColumn("score", F.round(score, 4))
    tier = F.when(F.col("score") >= 60, "core").when(F.col("score") >= 35, "important").when(F.col("score") >= 15, "normal").otherwise("low")
    return x.select("table_name", "score", tier.alias("tier"), F.concat_ws("-", F.when(F.col("score") >= 35, "valued").otherwise("plain"), F.when(F.col("size_gb") > F.col("__m"), "heavy").otherwise("light")).alias("quadrant"))


def cost_allocation(bill: DataFrame, top: int = 3) -> DataFrame:
    """``owner, cost, share, top_items`` of a bill (``owner, item, cost``); rows without an owner are 'unallocated'."""
    b = bill.withColumn("owner", F.coalesce(F.nullif(F.trim("owner"), F.lit("")), F.lit("unallocated")))
    items = b.groupBy("owner", "item").agg(F.sum(F.col("cost").cast("decimal(20,2)")).alias("c"))
    w = Window.partitionBy("owner").orderBy(F.desc("c"), "item")
    r = items.withColumn("r", F.row_number().over(w))
    g = r.groupBy("owner").agg(F.sum("c").cast("double").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "item")))), lambda x: x["item"]), ",").alias("top_items"))
    total = items.agg(F.sum("c").cast("double").alias("__t"))
    return g.join(F.broadcast(total)).select("owner", "cost", share(F.col("cost"), F.col("__t")).alias("share"), "top_items")


def ingest_strategy(inventory: DataFrame) -> DataFrame:
    """``table_name, strategy, risk`` of source tables by ordered rules: small tables whole, change capture where deletes or minutes matter, else by update time or key."""
    change = share(F.col("daily_change"), F.col("rows"))
    strategy = (
        F.when(F.col("rows") <= 100_000, "full").when((F.col("has_deletes") | (F.col("latency") == "minutes")) & F.col("cdc"), "cdc")
        .when(F.col("has_update_ts"), "incr_timestamp").when(F.col("has_pk"), "incr_pk").otherwise("full")
    )
    risk = F.when((strategy != "cdc") & (strategy != "full") & F.col("has_deletes"), "deletes are missed").when((strategy == "full") & (F.col("rows") > 10_000_000), "a full copy of a large table").when(change > 0.3, "most rows change")
    return inventory.select("table_name", strategy.alias("strategy"), risk.alias("risk"))


def query_insights(log: DataFrame, k: int = 10) -> DataFrame:
    """``question, n, failures, slowest_ms`` of the most asked questions, in one form of case and space."""
    q = F.lower(F.trim(F.regexp_replace("question", r"\s+", " ")))
    return log.groupBy(q.alias("question")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "ok").alias("failures"), F.max("elapsed_ms").alias("slowest_ms")).orderBy(F.desc("n"), "question").limit(k)


def access_review(requests: DataFrame) -> DataFrame:
    """``request, risk, decision`` of permission requests (``columns`` as (name, level) structs, ``write, role, days, purpose``)."""
    s3, s2 = F.size(F.filter("columns", lambda c: c["level"] == "S3")), F.size(F.filter("columns", lambda c: c["level"] == "S2"))
    star = F.exists("columns", lambda c: c["name"] == "*")
    risk = (
        25 * F.least(s3, F.lit(2)) + 5 * F.least(s2, F.lit(3)) + F.when(star, 20).otherwise(0) + F.when(F.col("write"), F.when(F.col("role").isin("owner", "engineer"), 10).otherwise(30)).otherwise(0)
        + F.when(F.col("days").isNull() | (F.col("days") > 180), 15).when(F.col("days") > 90, 8).otherwise(0) + F.when(F.length(F.trim(F.coalesce("purpose", F.lit("")))) < 8, 15).otherwise(0)
    )
    capped = F.least(risk, F.lit(100))
    return requests.select("request", capped.alias("risk"), F.when(capped >= 60, "reject").when(capped >= 30, "review").otherwise("approve").alias("decision"))


def grant_surface(grants: DataFrame) -> DataFrame:
    """``target, principal, privilege, severity`` of grants left after later revokes (``s, op, target, principal, privilege``)."""
    last = grants.groupBy("target", "principal", "privilege").agg(F.max_by("op", F.struct("s", "op")).alias("op")).filter("op = 'grant'")
    severity = F.when(F.lower("principal").isin("public", "everyone"), "high").when((F.upper("privilege") == "ALL") | F.contains("target", F.lit("*")), "medium").otherwise("low")
    return last.select("target", "principal", "privilege", severity.alias("severity"))


# The ratio of a stage's slowest task to its median that is skew, and tasks and bytes a task that are small files.
SKEWED, SMALL_TASKS, SMALL_BYTES = 5.0, 200, 8 * 2**20


def stage_metrics(tasks: DataFrame, run: str, stage: str) -> DataFrame:
    """``run, stage, tasks, max_s, median_s, spill_bytes, input_bytes`` of a task table (``duration_s, spill_bytes, input_bytes``); medians by ranges, so that a stage of many tasks is no hot key. Tasks are read once, to one row for each time of a stage."""
    t = tasks.select(F.col(run).alias("run"), F.col(stage).alias("stage"), "duration_s", "spill_bytes", "input_bytes")
    held = settle(t.groupBy("run", "stage", "duration_s").agg(F.count(F.lit(1)).alias("tasks"), F.sum("spill_bytes").alias("spill_bytes"), F.sum("input_bytes").alias("input_bytes")))
    low, high = nearest_rank_pair(held, ["run", "stage"], "duration_s", "tasks")
    sums = held.groupBy("run", "stage").agg(F.sum("tasks").alias("tasks"), F.max("duration_s").alias("max_s"), F.sum("spill_bytes").alias("spill_bytes"), F.sum("input_bytes").alias("input_bytes"))
    return sums.join(low, ["run", "stage"]).join(high, ["run", "stage"]).select("run", "stage", "tasks", "max_s", ((F.col("__low") + F.col("__high")) / 2).alias("median_s"), "spill_bytes", "input_bytes")


def nearest_rank_pair(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``by, __low`` and ``by, __high``: the two middle values of each group, the same one of an odd number; a row counts as ``weight`` rows."""
    high = nearest_rank(df, by, value, {"__high": 0.5}, rule="floor", weight=weight)
    negated = nearest_rank(df.withColumn("__v0", -F.col(value)), by, "__v0", {"__low": 0.5}, rule="floor", weight=weight)
    return negated.withColumn("__low", -F.col("__low")), high


def stage_causes(stages: DataFrame, runs: DataFrame) -> DataFrame:
    """``run, code, stage, share`` of runs (``run, duration_s``) by their stages (``stage_metrics``): what held a run up, as a share of its time.

    SQ001: the stage with the largest ratio of slowest task to median, if it is ``SKEWED`` or more (of
    equal ratios the first by name); SQ006: the first stage of many tasks that read little each.
    """
    ratio = F.when(F.col("median_s") > 0, F.col("max_s") / F.col("median_s"))
    worst = stages.withColumn("ratio", ratio).filter("ratio is not null").groupBy("run").agg(F.min(F.struct((-F.col("ratio")).alias("down"), "stage", "max_s", "median_s", "ratio")).alias("w")).select("run", "w.*")
    skew = worst.filter(F.col("ratio") >= SKEWED).join(runs, "run").select("run", F.lit("SQ001").alias("code"), "stage", F.least(F.lit(1.0), (F.col("max_s") - F.col("median_s")) / F.col("duration_s")).alias("share"))
    small = stages.filter((F.col("tasks") >= SMALL_TASKS) & (F.col("input_bytes") > 0) & (F.col("input_bytes") / F.col("tasks") < SMALL_BYTES)).groupBy("run").agg(F.min("stage").alias("stage"))
    return skew.unionByName(small.select("run", F.lit("SQ006").alias("code"), "stage", F.lit(0.2).alias("share")))


def stage_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``stage, side, max_ratio, median_ratio, spill_a, spill_b`` of two runs' stages by name: how much slower b is; ``side`` is both, a or b. A time of zero in a gives the ratio 0."""
    x, y = (d.select("stage", *[F.col(c).alias(f"{c}_{s}") for c in ("max_s", "median_s", "spill_bytes")], F.lit(True).alias(s)) for d, s in ((a, "a"), (b, "b")))
    both = x.join(y, "stage", "full")
    grown = lambda c: F.when(F.col("a") & F.col("b"), F.coalesce(F.round(F.col(f"{c}_b") / F.nullif(F.col(f"{c}_a"), F.lit(0.0)), 2), F.lit(0.0)))
    side = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "a").otherwise("b")
    return both.select("stage", side.alias("side"), grown("max_s").alias("max_ratio"), grown("median_s").alias("median_ratio"), F.col("spill_bytes_a").alias("spill_a"), F.col("spill_bytes_b").alias("spill_b"))
