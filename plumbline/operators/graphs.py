"""Lineage and task graphs as edge tables: closures, paths, cycles, levels, critical paths, slack, overlaps.

Every traversal is a loop of joins on the frontier only, which is sent to all tasks while it is small; ``settle``
writes each round to the checkpoint folder so that a lost executor costs one round, and plans
stay short. Loops end when the frontier is empty, at any depth; where only a cycle can keep
one going, they raise an error. Runs of nodes that are joined one to one are ranked by pointer
doubling first, so that a chain costs rounds by the logarithm of its length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.durable import settle
from plumbline.functions.values import share

#: Peeling steps of a round, rounds after which what was found is written anew, and rows that a round may send to all tasks.
HOPS, ROUNDS, FRONT = 3, 16, 200_000
#: Edges of the connected parts that one task takes together; larger parts are searched hop by hop.
PART_EDGES = 200_000
#: Links that a task draws together at a time.
CHUNK = 50_000


def near(df: DataFrame, rows: int) -> DataFrame:
    """A frontier of a counted number of rows, sent to all tasks if it is small."""
    return F.broadcast(df) if rows <= FRONT else df


def _reach(steps: DataFrame, roots: DataFrame, depth: int | None) -> DataFrame:
    """``root, node, hop``: what ``steps(__from, node)`` reach from ``roots(root)``, with the least number of hops."""
    key = ["root", "node"]
    seen = settle(roots.select("root", F.col("root").alias("node")).distinct().withColumn("hop", F.lit(0)))
    front, hop, rows = seen, 0, seen.count()
    while rows and (depth is None or hop < depth):
        hop += 1
        step = near(front.select("root", F.col("node").alias("__from")), rows).join(steps, "__from").select(key).distinct()
        front = settle(step.join(seen, key, "left_anti").withColumn("hop", F.lit(hop)))
        rows = front.count()
        seen = seen.unionByName(front)
        if hop % ROUNDS == 0:
            seen = settle(seen)
    return seen.filter("hop > 0")


def trace(edges: DataFrame, roots: DataFrame, depth: int | None = 10, direction: str = "down") -> DataFrame:
    """``root, node, hop``: what is reached from each root (``root``), with the least number of hops; upstream hops are negative.

    ``direction`` is down, up or both; ``depth`` None goes as far as there are edges. The edges
    are kept in memory while the loop runs; what it returns is written.
    """
    e, out = edges.select("src", "dst").persist(), None
    try:
        for way, a, b, sign in (("down", "src", "dst", 1), ("up", "dst", "src", -1)):
            if direction in (way, "both"):
                found = _reach(e.select(F.col(a).alias("__from"), F.col(b).alias("node")), roots, depth)
                found = found.select("root", "node", (F.lit(sign) * F.col("hop")).cast("int").alias("hop"))
                out = found if out is None else out.unionByName(found)
    finally:
        e.unpersist()
    return out


def column_impact(columns: DataFrame, tables: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """``root_table, root_column, table_name, column_name, hop, kind`` of what is downstream of columns (``roots``: ``table_name, column_name``).

    ``columns``: ``src_table, src_column, dst_table, dst_column``; ``tables``: ``src, dst``. A root that column
    edges leave is followed along them (kind 'column'); one that they only reach has no impact; one
    that they do not know is followed along table edges (kind 'table', ``column_name`` null). Names
    are held in lower case. All roots go in one search over both kinds of nodes.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    node = lambda t, c: F.concat(F.lit("column\x1f"), t, F.lit("\x1f"), c)
    whole = lambda t: F.concat(F.lit("table\x1f"), t, F.lit("\x1f"))
    c = columns.select(node(low("src_table"), low("src_column")).alias("src"), node(low("dst_table"), low("dst_column")).alias("dst"))
    edges = c.unionByName(tables.select(whole(low("src")).alias("src"), whole(low("dst")).alias("dst")))  # a search takes repeats for one edge
    wanted = roots.select(low("table_name").alias("root_table"), low("column_name").alias("root_column")).distinct()
    named = wanted.withColumn("__node", node(F.col("root_table"), F.col("root_column")))
    asked = named.select("__node")  # a request: what is known of others is not gathered
    asked = near(asked, asked.count())
    leaves = c.select(F.col("src").alias("__node"), F.lit(True).alias("__out")).join(asked, "__node", "left_semi").distinct()
    reached = c.select(F.col("dst").alias("__node"), F.lit(True).alias("__in")).join(asked, "__node", "left_semi").distinct()
    known = named.join(leaves, "__node", "left").join(reached, "__node", "left").filter("__out or __in is null")
    starts = settle(known.select("root_table", "root_column", F.when(F.col("__out"), F.col("__node")).otherwise(whole(F.col("root_table"))).alias("root")))
    found = trace(edges, starts.select("root").distinct(), depth).join(starts, "root")
    parts = F.split("node", "\x1f")
    return found.select("root_table", "root_column", F.get(parts, 1).alias("table_name"), F.when(F.get(parts, 0) == "column", F.get(parts, 2)).alias("column_name"), "hop", F.get(parts, 0).alias("kind"))


def dead_columns(columns: DataFrame, tables: DataFrame, final: str = "^ads") -> DataFrame:
    """``table_name, column_name``: columns that are made and that no column edge reads, in tables that something reads (unless final).

    Column edges are read once, with both ends in one shuffle.
    """
    ends = F.array(*[F.struct(F.col(f"{end}_table").alias("table_name"), F.col(f"{end}_column").alias("column_name"), F.lit(end == "src").alias("read")) for end in ("dst", "src")])
    held = columns.select(F.explode(ends).alias("e")).select("e.*").groupBy("table_name", "column_name").agg(F.max(~F.col("read")).alias("made"), F.max("read").alias("read"))
    dead = held.filter(F.col("made") & (~F.col("read") | F.col("column_name").isNull()) & ~F.col("table_name").rlike(final)).select("table_name", "column_name")
    used = tables.select(F.col("src").alias("table_name")).distinct().unionByName(columns.select(F.col("src_table").alias("table_name")).distinct())
    return dead.join(used, "table_name", "left_semi")


def ahead(edges: DataFrame, starts: DataFrame, hops: int = ROUNDS) -> DataFrame:
    """``src, dst``: the edges that lead on from ``starts(node)``, read hop by hop from where the last hop ended; all edges where that is deeper than ``hops``.

    A front is held against the edges as they are, before anything is shuffled: its names while
    it is small, then their hashes, and the names after that.
    """
    seen = front = settle(starts.select("node").dropna().distinct())
    found, rows = None, front.count()
    for _ in range(hops):
        if not rows:
            return edges.select("src", "dst").limit(0) if found is None else found
        own = front.withColumnRenamed("node", "src")
        step = edges.select("src", "dst")
        if FRONT < rows <= 10 * FRONT:
            step = step.withColumn("__h", F.xxhash64("src")).join(F.broadcast(own.select(F.xxhash64("src").alias("__h"))), "__h", "left_semi").select("src", "dst")
        step = settle(step.join(near(own, rows), "src", "left_semi").distinct())
        front = settle(step.select(F.col("dst").alias("node")).dropna().distinct().join(seen, "node", "left_anti"))
        rows = front.count()
        seen, found = seen.unionByName(front), step if found is None else found.unionByName(step)
    return edges if rows else found


def both_ways(edges: DataFrame, roots: DataFrame, depth: int | None = 10) -> DataFrame:
    return trace(edges, roots, depth, "both")


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst``: all pairs joined by a path, by doubling: the number of rounds is the logarithm of the longest path.

    Its size is that of the answer; for large graphs it is meant for those of many small parts.
    """
    now = settle(edges.select("src", "dst").distinct())
    n = -1
    while (m := now.count()) != n:
        n = m
        two = now.alias("x").join(now.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"))
        now = settle(now.unionByName(two).distinct())
    return now


def chain_runs(edges: DataFrame, lengths: DataFrame | None = None, keep: Sequence[str] | DataFrame = ()) -> tuple[DataFrame, DataFrame | None, bool]:
    """``(edges, runs, rings)``: distinct ``src, dst, link``; ``node, head, hops, length`` of nodes inside of runs; is there a ring?

    An edge is a link if its source has no other way out and its target no other way in
    (targets in ``keep`` are not). A run's nodes after its head are ranked by pointer doubling;
    ``length`` sums ``lengths(node, duration)`` of the nodes after the head. Nodes of rings, which
    have no head, have a null one. ``runs`` is None without links.
    """
    e = edges.select("src", "dst").distinct()
    kept = keep if isinstance(keep, DataFrame) else e.sparkSession.createDataFrame([(k,) for k in keep], "node string")
    kept = kept.select(F.col("node").alias("dst"), F.lit(True).alias("__keep"))
    outs = e.groupBy("src").agg(F.count(F.lit(1)).alias("__outs"))
    ins = e.groupBy("dst").agg(F.count(F.lit(1)).alias("__ins"))
    link = (F.col("__outs") == 1) & (F.col("__ins") == 1) & F.col("__keep").isNull() & (F.col("src") != F.col("dst"))
    e = settle(e.join(outs, "src").join(ins, "dst").join(kept, "dst", "left").select("src", "dst", link.alias("link")))
    links = e.filter("link")
    n = links.count()
    if not n:
        return e, None, False
    own = links.select(F.col("dst").alias("node"), F.col("src").alias("to"), F.lit(1).alias("hops"))
    own = own.join(lengths.select("node", F.col("duration").cast("double").alias("length")), "node", "left") if lengths is not None else own.withColumn("length", F.lit(0.0))
    now = settle(own.select("node", "to", "hops", F.coalesce("length", F.lit(0.0)).alias("length")))
    heads = links.select(F.col("src").alias("to")).join(links.select(F.col("dst").alias("to")), "to", "left_anti")
    reach = 1
    while (left := now.join(heads, "to", "left_anti").count()) and reach <= n:
        nxt = now.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("length").alias("length2"))
        hops, length = F.col("hops") + F.coalesce("hops2", F.lit(0)), F.col("length") + F.coalesce("length2", F.lit(0.0))
        now = settle(now.join(nxt, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), hops.alias("hops"), length.alias("length")))
        reach *= 2
    runs = now.join(heads.withColumnRenamed("to", "__head"), F.col("to") == F.col("__head"), "left").select("node", F.col("__head").alias("head"), "hops", "length")
    return e, settle(runs), bool(left)


def contracted(e: DataFrame, runs: DataFrame | None, trails: bool = False) -> DataFrame:
    """``src, dst, hops, length``: edges that are no links, from the head of a run, with what stands between; and its names, on demand.

    A run is left at its last node only, so that ``trail`` has its nodes after the head, joined by '>', and the target.
    """
    names = [F.col("dst").alias("trail")] if trails else []
    if runs is None:
        return e.select("src", "dst", F.lit(1).alias("hops"), F.lit(0.0).alias("length"), *names)
    x = e.filter("not link").join(runs, F.col("src") == F.col("node"), "left")
    if trails:
        x = x.join(run_names(runs), "head", "left")
        names = [F.concat_ws(">", "names", "dst").alias("trail")]
    return x.select(F.coalesce("head", "src").alias("src"), "dst", (1 + F.coalesce("hops", F.lit(0))).alias("hops"), F.coalesce("length", F.lit(0.0)).alias("length"), *names)


def run_names(runs: DataFrame) -> DataFrame:
    """``head, names``: the nodes of a run after its head, joined by '>'."""
    return runs.filter("head is not null").groupBy("head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hops", "node"))), lambda x: x["node"]), ">").alias("names"))


def _short_way(e: DataFrame, start: str, goal: str) -> tuple[tuple[str, int] | None, bool]:
    """``(path, hops)`` of up to ``ROUNDS`` hops, of equal lengths the first by names, and whether that is the answer: edges are only read from a frontier on."""
    if start == goal:
        return (start, 0), True
    seen = front = settle(e.sparkSession.createDataFrame([(start, start)], "node string, path string"))
    rows = 1
    for hop in range(1, ROUNDS + 1):
        step = near(front, rows).join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat_ws(">", "path", "dst").alias("path")).groupBy("node").agg(F.min("path").alias("path"))
        front = settle(step.join(seen.select("node"), "node", "left_anti"))
        if hit := front.filter(F.col("node") == goal).first():
            return (hit.path, hop), True
        if not (rows := front.count()):
            return None, True
        seen = seen.unionByName(front)
    return None, False


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """``path, hops`` from start to goal, else from goal to start; of equal lengths the first by names. No row if there is none.

    Short paths are searched for on the edges as they are; only if that leaves it open, runs without branches are drawn together.
    """
    e = edges.select("src", "dst").persist()
    try:
        for a, b in ((start, goal), (goal, start)):
            path, settled = _short_way(e, a, b)
            if path is not None:
                return edges.sparkSession.createDataFrame([path], "path string, hops int")
            if not settled:
                return _long_path(edges, start, goal)
    finally:
        e.unpersist()
    return edges.sparkSession.createDataFrame([], "path string, hops int")


def _long_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """The same for paths of any length."""
    spark = edges.sparkSession
    e, runs, _ = chain_runs(edges, keep=(start, goal))
    steps = settle(contracted(e, runs, trails=True).select(F.col("src").alias("__from"), F.col("dst").alias("to"), F.col("hops").alias("more"), "trail"))
    for a, b in ((start, goal), (goal, start)):
        best = settle(spark.createDataFrame([(a, 0, a)], "node string, hops int, path string"))
        front, rows = best, 1
        while rows:
            step = near(front, rows).join(steps, F.col("node") == F.col("__from")).select(F.col("to").alias("node"), F.struct((F.col("hops") + F.col("more")).alias("hops"), F.concat_ws(">", "path", "trail").alias("path")).alias("r"))
            step = step.groupBy("node").agg(F.min("r").alias("r")).select("node", "r.*")
            known = best.select("node", F.struct("hops", "path").alias("__known"))
            front = settle(step.join(known, "node", "left").filter("__known is null or struct(hops, path) < __known").select("node", "hops", "path"))
            rows = front.count()
            if rows:
                best = settle(best.unionByName(front).groupBy("node").agg(F.min(F.struct("hops", "path")).alias("r")).select("node", "r.*"))
                found = best.filter(F.col("node") == b).first()
                front = front if found is None else front.filter(F.col("hops") < found.hops)
                rows = rows if found is None else front.count()
        hit = best.filter(F.col("node") == b)
        if not hit.isEmpty():
            return hit.select("path", "hops")
    return spark.createDataFrame([], "path string, hops int")


def _core(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Places of the edges that are left when nodes without a way in or out are taken away, within one task."""
    names, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
    ends = codes[: len(src)].tolist(), codes[len(src) :].tolist()
    kept = np.ones(len(src), bool)
    for a, b in (ends, ends[::-1]):  # forward by ways in, then backward by ways out
        ways: list[list[int]] = [[] for _ in names]
        n = [0] * len(names)
        for i in np.flatnonzero(kept).tolist():
            ways[a[i]].append(i)
            n[b[i]] += 1
        todo = [x for x, k in enumerate(n) if not k]
        for x in todo:  # grows while it is read
            for i in ways[x]:
                kept[i] = False
                n[b[i]] -= 1
                if not n[b[i]]:
                    todo.append(b[i])
    return np.flatnonzero(kept)


def core_of_cycles(edges: DataFrame, part: int = PART_EDGES) -> DataFrame:
    """``src, dst``: edges in cycles or between them; what has no way in or no way out is peeled off until nothing is.

    Connected parts of up to ``part`` edges are peeled some to a task; larger ones layer by layer.
    """
    dealt, large = parted(edges, part)

    def search(table: pa.Table) -> pa.Table:
        return table.select(["src", "dst"]).take(pa.array(_core(*ends_of(table))))

    near_ones = dealt.groupBy("deal").applyInArrow(search, fields_of(dealt))
    return near_ones if large is None else near_ones.unionByName(_core_far(large))


def _core_far(edges: DataFrame) -> DataFrame:
    """The same for parts of any size."""
    e, runs, _ = chain_runs(edges)
    inner = contracted(e, runs).select("src", "dst").distinct()
    now, n = settle(inner), -1
    while (m := now.count()) != n:
        n = m
        for _ in range(HOPS):
            now = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        now = settle(now)
    if runs is None:
        return now
    named = e.join(runs.select(F.col("node").alias("__node"), "head"), F.when(F.col("link"), F.col("dst")).otherwise(F.col("src")) == F.col("__node"), "left")
    named = named.withColumn("a", F.coalesce("head", "src"))
    ring = named.filter("link and __node is not null and head is null").select("src", "dst")
    whole = named.filter("not link").join(now.withColumnRenamed("src", "a"), ["a", "dst"], "left_semi").select("src", "dst")
    inside = named.filter("link and head is not null").join(now.select(F.col("src").alias("a")).distinct(), "a", "left_semi").select("src", "dst")
    return whole.unionByName(inside).unionByName(ring)


def _way(edges: list[tuple[str, str]], start: str, goal: str) -> str:
    """The shortest path within one task, of equal lengths the first by names."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    known, front = {start}, {start: start}
    while goal not in front:
        step: dict[str, str] = {}
        for node, path in front.items():
            for b in after.get(node, ()):
                if b not in known and (b not in step or f"{path}>{b}" < step[b]):
                    step[b] = f"{path}>{b}"
        known.update(step)
        front = step
    return front[goal]


def cycle_samples(edges: DataFrame, most: int = 5, part: int = PART_EDGES) -> DataFrame:
    """``cycle``: a report of at most ``most`` cycles, as 'a>b>a': of the first components by name, the shortest one through the first edge of its first node.

    Of any length: components of up to ``part`` edges are searched in a task each; in larger
    ones runs without branches are drawn together before a path is searched.
    """
    spark, parts = edges.sparkSession, settle(strong_components(edges, part))
    chosen = [r.component for r in parts.select("component").distinct().orderBy("component").limit(most).collect()]  # the report's rows
    own = parts.filter(F.col("component").isin(chosen)).select("node", F.col("component").alias("c"))
    ends = own.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).select("c", "src", "dst")
    inner = settle(ends.join(own.select(F.col("node").alias("dst"), F.col("c").alias("d")), "dst").filter("c = d").select("c", "src", "dst"))
    first = inner.groupBy("c").agg(F.min(F.when(F.col("src") == F.col("c"), F.col("dst"))).alias("next"), F.count(F.lit(1)).alias("n")).orderBy("c").collect()  # one for each of them

    def search(table: pa.Table) -> pa.Table:
        c, src, dst = (table.column(x).to_pylist() for x in ("c", "src", "dst"))
        goal = c[0]
        return pa.table({"cycle": [f"{goal}>{_way(list(zip(src, dst)), min(b for a, b in zip(src, dst) if a == goal), goal)}"]})

    small = [r.c for r in first if r.n <= part]
    out = inner.filter(F.col("c").isin(small)).groupBy("c").applyInArrow(search, "cycle string")
    for r in first:
        if r.n > part:
            far = inner.filter(F.col("c") == r.c).select("src", "dst")
            way = spark.createDataFrame([(r.c,)], "path string") if r.next == r.c else shortest_path(far, r.next, r.c).select("path")
            out = out.unionByName(way.select(F.concat_ws(">", F.lit(r.c), "path").alias("cycle")))
    return out


def _rank(x: object) -> tuple:
    """A node as Spark orders it: nulls first, structs by their fields."""
    return (False,) if x is None else (True, *map(_rank, x.values())) if isinstance(x, dict) else (True, x)


def _stars(a: list, b: list) -> dict:
    """Of links within one task, each node's rank to that of the smallest node that it is linked to."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def drawn_together(links: DataFrame, chunk: int | None = None, roots: bool = False) -> DataFrame:
    """``a, b`` with the components of the links ``a, b``, fewer of them: each task draws together what it has, ``chunk`` links at a time, to pairs of a node and the smallest (with ``roots``, of the smallest and itself too)."""
    chunk = chunk or CHUNK

    def draw(table: pa.Table) -> pa.RecordBatch:
        values = [table.column(c).to_pylist() for c in ("a", "b")]
        plain = not any(isinstance(x, dict) or x is None for v in values for x in v[:1])
        ranks = values if plain else [[_rank(x) for x in v] for v in values]
        node = None if plain else dict(zip(ranks[0] + ranks[1], values[0] + values[1]))
        found = [(x, y) for x, y in _stars(*ranks).items() if roots or x != y]
        columns = [[p[i] if plain else node[p[i]] for p in found] for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(v, table.schema.field(i).type) for i, v in enumerate(columns)], names=["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield draw(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield draw(pa.Table.from_batches(held))

    x = links.select("a", "b")
    return x.mapInArrow(run, x.schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``edges(a, b)`` that is not its component's smallest; roots are those smallest nodes.

    Tasks draw together the links that they have; up to ``CHUNK`` links that are left are drawn
    together at once, more in alternating large-star and small-star rounds. Nodes are of any type
    that has an order; a struct makes the root the smallest by its fields.
    Every round is two joins on a node with its smallest neighbour, pre-aggregated before
    each shuffle, and is written to the checkpoint folder. Hot nodes are split by the
    adaptive skew join, for nothing above the joins needs a key's rows together. No side is
    sent through the driver, for a hash table of each round would stay there.
    """
    now = settle(drawn_together(edges.filter("a <> b")))
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if mark[0] <= CHUNK:
            return settle(drawn_together(now.coalesce(1), CHUNK + 1)).select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        met = large.join(low.hint("merge"), F.col("a") == F.col("k"))
        pairs = met.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = settle(pairs.select("e.a", "e.b").filter("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def parts_of(links: DataFrame) -> DataFrame:
    """``node, root`` as ``components`` gives them, for links that mostly lie beside the others of their part, as a window by part leaves them.

    Tasks draw together what they have. Only roots that share a node are linked and go through rounds.
    """
    drawn = settle(drawn_together(links.filter("a <> b"), roots=True))
    own = settle(drawn.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")))
    shared = settle(own.filter("low <> high").select("a", "low"))
    if n := shared.count():
        met = drawn.join(near(shared, n), "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        top = components(met).withColumnsRenamed({"node": "low", "root": "top"})
        own = own.join(near(top, top.count()), "low", "left").withColumn("low", F.coalesce("top", "low"))
    return own.filter("a <> low").select(F.col("a").alias("node"), F.col("low").alias("root"))


def degrees(nodes: DataFrame, edges: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """``node, known, ins, outs, more...``: of every node (one row each) and every end of an edge, whether it is one of ``nodes``, and how many edges reach and leave it.

    Edges are read once, and all is counted in one shuffle.
    """
    none = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in more]
    ends = F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("ins"), F.lit(0).alias("outs")), F.struct(F.col("src").alias("node"), F.lit(0).alias("ins"), F.lit(1).alias("outs")))
    found = edges.select(F.explode(ends).alias("e")).filter("e.node is not null").select("e.node", F.lit(False).alias("known"), "e.ins", "e.outs", *none)
    own = nodes.select("node", F.lit(True).alias("known"), F.lit(0).alias("ins"), F.lit(0).alias("outs"), *more)
    return own.unionByName(found).groupBy("node").agg(F.max("known").alias("known"), F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), *[F.max(c).alias(c) for c in more])


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, ins, outs, state``: isolated, source, leaf or inner. Nodes are one row each."""
    state = F.when((F.col("ins") == 0) & (F.col("outs") == 0), "isolated").when(F.col("outs") == 0, "leaf").when(F.col("ins") == 0, "source").otherwise("inner")
    return degrees(nodes, edges).filter("known").select("node", "ins", "outs", state.alias("state"))


def merge(graphs: Sequence[DataFrame]) -> DataFrame:
    """``src, dst, confidence, sources``: the union of edge tables (``confidence`` a number, ``source``); the higher confidence stands."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``src, dst, change``: added and removed edges, and edges whose confidence changed."""
    both = old.select("src", "dst", F.col("confidence").alias("c0"), F.lit(True).alias("a")).join(new.select("src", "dst", F.col("confidence").alias("c1"), F.lit(True).alias("b")), ["src", "dst"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("c0") != F.col("c1"), "confidence")
    return both.select("src", "dst", change.alias("change")).filter("change is not null")


def change_impact(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """``node, change, reached, severity`` of changed nodes (``node, change``): removals that reach something are errors, other changes warnings."""
    t = trace(edges, changes.select(F.col("node").alias("root")).distinct()).groupBy("root").agg(F.count(F.lit(1)).alias("reached"))
    x = changes.join(t, changes.node == t.root, "left").select("node", "change", F.coalesce("reached", F.lit(0)).alias("reached"))
    return x.withColumn("severity", F.when((F.col("change") == "removed") & (F.col("reached") > 0), "error").when((F.col("change") != "added") & (F.col("reached") > 0), "warn").otherwise("info"))


def hygiene(nodes: DataFrame, edges: DataFrame, final: str = "^ads") -> DataFrame:
    """``node, problem``: outputs that nothing reads (unless final), and nodes of edges that are not defined."""
    orphan = F.col("known") & (F.col("ins") > 0) & (F.col("outs") == 0) & ~F.col("node").rlike(final)
    problem = F.when(~F.col("known"), "dangling").when(orphan, "orphan_output")
    return degrees(nodes, edges).select("node", problem.alias("problem")).filter("problem is not null")


def layers(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """``src, dst, problem``: edges that skip a layer, go back, stay in one, or have an unknown end (``node, layer``)."""
    a, b = ranks.select(F.col("node").alias("src"), F.col("layer").alias("la")), ranks.select(F.col("node").alias("dst"), F.col("layer").alias("lb"))
    step = F.col("lb") - F.col("la")
    problem = F.when(step.isNull(), "unknown").when(step < 0, "reverse").when(step == 0, "same_layer").when(step > 1, "skip")
    return edges.select("src", "dst").distinct().join(a, "src", "left").join(b, "dst", "left").select("src", "dst", problem.alias("problem")).filter("problem is not null")


def suspects(edges: DataFrame, node: str, tainted: DataFrame, hits: DataFrame, transforms: DataFrame) -> DataFrame:
    """``node, distance, score``: upstream suspects: 100/(1+distance), 0.4 of it off the taint path, 40 more on a column hit, 10 on a transform."""
    root = edges.sparkSession.createDataFrame([(node,)], "root string")
    up = trace(edges, root, direction="up").select("node", (-F.col("hop")).alias("distance"))
    x = up.join(tainted.select("node", F.lit(1.0).alias("t")).distinct(), "node", "left").join(hits.select("node", F.lit(40.0).alias("h")).distinct(), "node", "left").join(transforms.select("node", F.lit(10.0).alias("x")).distinct(), "node", "left")
    return x.select("node", "distance", F.round(100.0 / (1 + F.col("distance")) * F.coalesce("t", F.lit(0.4)) + F.coalesce("h", F.lit(0.0)) + F.coalesce("x", F.lit(0.0)), 4).alias("score"))


def canonical(expression):
    """An expression without alias, qualifiers and spaces, upper case, COUNT(1) as COUNT(*)."""
    x = F.regexp_replace(F.upper(expression), r"\s+AS\s+\w+\s*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\b\w+\.(\w+)", "$1"), r"\s+", "")
    return F.regexp_replace(x, r"COUNT\(1\)", "COUNT(*)")


def metric_conflicts(column_edges: DataFrame) -> DataFrame:
    """``column_name, forms, tables, severity``: one output name with different expressions in several tables; high if any side computes."""
    x = column_edges.select("table_name", "column_name", canonical(F.col("expression")).alias("e"))
    g = x.groupBy("column_name").agg(F.count_distinct("e").alias("forms"), F.count_distinct("table_name").alias("tables"), F.max(F.col("e").rlike(r"[(+*/-]")).alias("computed"))
    return g.filter("forms > 1 and tables > 1").select("column_name", "forms", "tables", F.when(F.col("computed"), "high").otherwise("medium").alias("severity"))


def duplicate_pipelines(edges: DataFrame) -> DataFrame:
    """``sources, targets, n``: targets with one and the same set of sources."""
    sets = edges.select("src", "dst").distinct().groupBy("dst").agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("sources"))
    return sets.groupBy("sources").agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("targets"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def equal_expressions(edges: DataFrame, expressions: DataFrame, least: float = 0.5) -> DataFrame:
    """``a, b, targets_a, targets_b, shared, share``: targets with one set of sources whose output expressions (``dst, expression``) are the same to ``least`` or more.

    The share is of the smaller set of expressions; empty ones and ``*`` do not count. Targets
    with the same sources and the same expressions are one class, known by its smallest name, with
    their number; a class of several is a row with itself (a = b). Of two sets that share
    ``least`` of the smaller one's ``n``, one has one of the other's ``n - ceil(least * n) + 1`` rarest
    expressions: only these are joined, so that classes without a common expression never meet.
    Targets without expressions or sources are in no row.
    """
    sets = edges.filter("src is not null").select("dst", "src").distinct().groupBy("dst").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("src"))), 256).alias("sources"))
    own = expressions.filter("expression <> '' and expression <> '*'").select("dst", "expression").distinct()
    per = own.groupBy("dst").agg(F.array_sort(F.collect_list("expression")).alias("e")).join(sets, "dst")
    classes = settle(per.groupBy("sources", "e").agg(F.min("dst").alias("name"), F.count(F.lit(1)).alias("targets")))
    held = classes.select("sources", "name", F.explode("e").alias("x"))
    df = held.groupBy("sources", "x").agg(F.count(F.lit(1)).alias("df"))
    ranked = held.join(df, ["sources", "x"]).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("s"))
    head = ranked.select("name", F.explode(F.slice("s.x", 1, (F.size("s") - F.ceil(F.size("s") * least) + 1).cast("int"))).alias("x"))
    met = head.join(held.select("name", "sources"), "name").distinct().join(held.withColumnRenamed("name", "other"), ["sources", "x"]).filter("name <> other")
    met = met.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct()
    side = classes.select("name", "e", "targets")
    both = met.join(side.toDF("a", "ea", "targets_a"), "a").join(side.toDF("b", "eb", "targets_b"), "b").withColumn("shared", F.size(F.array_intersect("ea", "eb")))
    smaller = F.least(F.size("ea"), F.size("eb"))
    apart = both.filter(F.col("shared") >= smaller * least).select("a", "b", "targets_a", "targets_b", "shared", share(F.col("shared"), smaller).alias("share"))
    alike = classes.filter("targets > 1").select(F.col("name").alias("a"), F.col("name").alias("b"), F.col("targets").alias("targets_a"), F.col("targets").alias("targets_b"), F.size("e").alias("shared"), F.lit(1.0).alias("share"))
    return apart.unionByName(alike)


def overlapping_pipelines(edges: DataFrame, least: float = 0.6) -> DataFrame:
    """``a, b, shared, jaccard, kind``: pairs of targets whose sources overlap: equal, subset (all of a's are b's), superset, or overlap of ``least`` or more.

    Two sets of that similarity share one of the first ``n - ceil(least * n) + 1`` sources of
    each, the rarest first, and a subset shares its rarest: only these are joined. Where they
    meet, masks of 64 places (a place is set if a source's hash falls on it) are held against
    each other: places that only one side has are sources that only that side has. Only pairs
    that may be in the result leave the join; whole sets are compared for these alone.
    """
    e = edges.select("src", "dst").distinct()
    df = e.groupBy("src").agg(F.count(F.lit(1)).alias("df"))
    ranked = e.join(df, "src").groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("df", "src"))).alias("s"), F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(src), 64) as int))")).alias("mask"))
    sets = settle(ranked.select("dst", F.col("s.src").alias("src"), F.size("s").alias("n"), "mask"))
    head = sets.select("dst", "n", "mask", F.explode(F.slice("src", 1, (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("k"))
    all_ = sets.select(F.explode("src").alias("k"), F.col("dst").alias("other"), F.col("n").alias("n2"), F.col("mask").alias("mask2"))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    x, y = apart("mask", "mask2"), apart("mask2", "mask")
    may = (x == 0) | (y == 0) | ((x + y) * (1 + least) <= (1 - least) * (F.col("n") + F.col("n2")) + 1e-6)
    met = head.join(all_.hint("merge"), "k").filter((F.col("dst") != F.col("other")) & may).select(F.least("dst", "other").alias("a"), F.greatest("dst", "other").alias("b")).distinct()
    sets = sets.drop("mask")
    both = met.join(sets.toDF("a", "sa", "na"), "a").join(sets.toDF("b", "sb", "nb"), "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    union = F.col("na") + F.col("nb") - F.col("shared")
    kind = F.when((F.col("shared") == F.col("na")) & (F.col("shared") == F.col("nb")), "equal").when(F.col("shared") == F.col("na"), "subset").when(F.col("shared") == F.col("nb"), "superset").when(F.col("shared") >= least * union, "overlap")
    return both.select("a", "b", "shared", share(F.col("shared"), union).alias("jaccard"), kind.alias("kind")).filter("kind is not null")


def dictionary(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """``node, ins, outs, layer`` of every node of a layer table (``node, layer``, one row each)."""
    more = [c for c in ranks.columns if c != "node"]
    return degrees(ranks, edges.select("src", "dst").distinct(), more).filter("known").select("node", "ins", "outs", *more)


def sla_impact(edges: DataFrame, root: str, slas: DataFrame) -> DataFrame:
    """``node, hop, sla``: nodes with a service level (``node, sla``) downstream of a root."""
    return trace(edges, edges.sparkSession.createDataFrame([(root,)], "root string")).join(slas, "node").select("node", "hop", "sla")


def from_meta(meta: DataFrame, partition: str) -> DataFrame:
    """``src, dst`` from a lineage meta table's newest partition: ``target`` and ``sources`` as '[a, b]' or 'a,b'."""
    newest = meta.agg(F.max(partition)).first()[0]
    items = F.split(F.regexp_replace("sources", r"[\[\]\"'\s]", ""), ",")
    return meta.filter(F.col(partition) == F.lit(newest)).select(F.explode(items).alias("src"), F.col("target").alias("dst")).filter("src <> ''").distinct()


def walks(steps: DataFrame, start: DataFrame, most: int, better: Column, value: Column, tags: Sequence[str] = ()) -> DataFrame:
    """``node, tags..., v``: the best value over all walks from ``start(node, tags..., v)`` by ``steps(__from, to, more)``; ``better`` picks it, ``value`` moves it on.

    Each round goes one edge further from all that the round before reached, so that it ends
    after the longest walk, or never if there is a cycle: then after ``most`` rounds it raises.
    """
    key = ["node", *tags]
    best, rounds = settle(start.select(*key, "v")), 0
    steps = settle(steps)
    front = best
    while rows := front.count():
        rounds += 1
        if rounds > most + 1:
            raise ValueError("the graph has a cycle")
        moved = near(front, rows).join(steps, F.col("node") == F.col("__from")).select(F.col("to").alias("node"), *tags, value.alias("v"))
        front = settle(moved.groupBy(key).agg(better.alias("v")))
        best = best.unionByName(front)
        if rounds % ROUNDS == 0:
            best = settle(best.groupBy(key).agg(better.alias("v")))
    return best.groupBy(key).agg(better.alias("v"))


def _acyclic(edges: DataFrame, durations: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    e, runs, rings = chain_runs(edges, durations)
    if rings:
        raise ValueError("the graph has a cycle")
    return e, runs


def _levels_far(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same for parts of any size, by walks after runs are drawn together."""
    e, runs = _acyclic(edges)
    steps = contracted(e, runs).groupBy(F.col("src").alias("__from"), F.col("dst").alias("to")).agg(F.max("hops").alias("more"))
    start = nodes.select("node", F.lit(0).alias("v")) if runs is None else nodes.select("node", F.lit(0).alias("v")).join(runs.select("node"), "node", "left_anti")
    found = settle(walks(steps, start, nodes.count(), F.max("v"), F.col("v") + F.col("more")))
    if runs is not None:
        inner = runs.join(found.withColumnRenamed("node", "head"), "head").select("node", (F.col("v") + F.col("hops")).alias("v"))
        found = found.unionByName(inner)
    return nodes.select("node").join(found, "node").select("node", F.col("v").cast("int").alias("level"))


def _critical_far(edges: DataFrame, durations: DataFrame) -> DataFrame:
    """The same for parts of any size, by walks after runs are drawn together."""
    e, runs = _acyclic(edges, durations)
    own = durations.select(F.col("node").alias("to"), "duration")
    steps = contracted(e, runs, trails=True).withColumnsRenamed({"src": "__from", "dst": "to"}).join(own, "to").select("__from", "to", (F.col("length") + F.col("duration")).alias("more"), "trail")
    start = durations.select("node", F.struct((-F.col("duration")).alias("f"), F.col("node").alias("path")).alias("v"))
    start = start if runs is None else start.join(runs.select("node"), "node", "left_anti")
    further = F.struct((F.col("v.f") - F.col("more")).alias("f"), F.concat_ws(">", "v.path", "trail").alias("path"))
    found = settle(walks(steps, start, durations.count(), F.min("v"), further))
    if runs is not None:
        ends = runs.groupBy("head").agg(F.max("length").alias("length"), F.max_by("node", "hops").alias("node")).join(run_names(runs), "head")
        inner = ends.join(found.withColumnRenamed("node", "head"), "head").select("node", F.struct((F.col("v.f") - F.col("length")).alias("f"), F.concat_ws(">", "v.path", "names").alias("path")).alias("v"))
        found = found.unionByName(inner)
    return found.orderBy("v.f", "v.path").limit(1).select("node", (-F.col("v.f")).alias("finish"), F.col("v.path").alias("path"))


def dealt_tasks(edges: DataFrame, nodes: DataFrame, part: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``(node, dst, duration, deal)``, ``(src, dst)``, ``(node, duration)``: edges (``duration`` null) and nodes (``dst`` null) of connected parts of up to ``part`` rows, dealt out some parts to a task; edges and nodes of larger parts (None without)."""
    e = settle(edges.select("src", "dst").dropna())
    duration = F.col("duration").cast("double") if "duration" in nodes.columns else F.lit(None).cast("double")
    rows = e.select(F.col("src").alias("node"), "dst", F.lit(None).cast("double").alias("duration")).unionByName(nodes.select("node", F.lit(None).cast(e.schema["dst"].dataType).alias("dst"), duration.alias("duration")))
    n = e.count() + nodes.count()
    if n <= part:
        return rows.withColumn("deal", F.lit(0)), None, None
    roots = parts_of(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    named = settle(rows.join(roots.hint("merge"), "node", "left").select("node", "dst", "duration", F.coalesce("root", "node").alias("part")))
    deals = max(e.sparkSession.sparkContext.defaultParallelism, -(-2 * n // part))
    dealt = named.select("node", "dst", "duration", F.pmod(F.xxhash64("part"), F.lit(deals)).alias("deal"), "part")
    large = settle(named.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > part) & F.col("part").isNotNull()).select("part"))
    if not (m := large.count()):
        return dealt.drop("part"), None, None
    far = settle(named.join(near(large, m), "part", "left_semi"))
    return dealt.join(near(large, m), "part", "left_anti").drop("part"), far.filter("dst is not null").select(F.col("node").alias("src"), "dst"), far.filter("dst is null").select("node", "duration")


def _laid_out(table: pa.Table) -> tuple[pa.Array, list[int], list[float | None], list[float | None], list[list[int]], list[int]] | None:
    """Of a task's rows ``names, own, given, duration, after, order``: nodes by number, those of its rows with what they give, the longest of each number (None if not known), ways on, and a topological order; None if there is a cycle."""
    e, n = (table.filter(keep(table["dst"])) for keep in (pc.is_valid, pc.is_null))
    ends = [x.combine_chunks() for x in (e["node"], e["dst"], n["node"])]
    found = pa.concat_arrays(ends).dictionary_encode(null_encoding="encode")
    codes, k, size = found.indices.to_pylist(), e.num_rows, len(found.dictionary)
    own, given = codes[2 * k :], n["duration"].to_pylist()
    duration: list[float | None] = [None] * size
    for x, d in zip(own, given):
        if d is not None and (duration[x] is None or d > duration[x]):
            duration[x] = d
    after: list[list[int]] = [[] for _ in range(size)]
    ins = [0] * size
    for x, y in zip(codes[:k], codes[k : 2 * k]):
        after[x].append(y)
        ins[y] += 1
    order = [x for x, i in enumerate(ins) if not i]
    for x in order:  # grows while it is read
        for y in after[x]:
            ins[y] -= 1
            if not ins[y]:
                order.append(y)
    return (found.dictionary, own, given, duration, after, order) if len(order) == size else None


def _searched(dealt: DataFrame, search, fields: str) -> DataFrame:
    """The columns that ``search`` gives of each task's rows; a cycle in any of them is an error."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        graph = _laid_out(table)
        columns = [[None]] * len(names) if graph is None else search(*graph)
        return pa.table([*columns, [graph is None] * len(columns[0])], schema=shape)

    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    shape = pa.schema([*((f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")), ("cycle", pa.bool_())])
    found = settle(dealt.groupBy("deal").applyInArrow(run, f"{fields}, cycle boolean"))
    if not found.filter("cycle").isEmpty():
        raise ValueError("the graph has a cycle")
    return found.drop("cycle")


def _levels(names, own, given, duration, after, order) -> list:
    level = [-1] * len(names)
    for x in own:
        level[x] = 0
    for x in order:
        if level[x] >= 0:
            for y in after[x]:
                level[y] = max(level[y], level[x] + 1)
    own = sorted(set(own))
    return [names.take(pa.array(own, pa.int64())), [level[x] for x in own]]


def levels(edges: DataFrame, nodes: DataFrame, part: int = PART_EDGES) -> DataFrame:
    """``node, level``: the longest path to each node, for graphs without cycles (else an error).

    Connected parts are dealt out, some to a task, and taken there in topological order; those of more than ``part`` rows by walks.
    """
    dealt, e, own = dealt_tasks(edges, nodes.select("node"), part)
    found = _searched(dealt, _levels, "node string, level int")
    return found if e is None else found.unionByName(_levels_far(e, own))


def _critical(names, own, given, duration, after, order) -> list:
    """The best path of a task's rows: from the ends of the longest back over edges that keep its length, then forward by the first name."""
    finish = list(duration)
    for x in order:
        if duration[x] is not None:
            for y in after[x]:
                if duration[y] is not None:
                    finish[y] = max(finish[y], finish[x] + duration[y])
    most = max((f for f in finish if f is not None), default=None)
    if most is None:
        return [[], [], []]
    names = names.to_pylist()
    leads = [f == most for f in finish]
    keeps = lambda x: [y for y in after[x] if leads[y] and finish[x] + duration[y] == finish[y]]
    for x in reversed(order):
        leads[x] = leads[x] or duration[x] is not None and bool(keeps(x))
    path, ways = [], [x for x in order if leads[x] and finish[x] == duration[x]]
    while not path or finish[path[-1]] != most:
        path.append(min(ways, key=lambda x: names[x] if finish[x] == most else names[x] + ">"))
        ways = keeps(path[-1])
    return [[names[path[-1]]], [most], [">".join(names[x] for x in path)]]


def critical_path(edges: DataFrame, durations: DataFrame, part: int = PART_EDGES) -> DataFrame:
    """``node, finish, path`` of the longest path by ``node, duration``; of equal lengths the first path by names. Durations are not negative.

    Connected parts are dealt out, some to a task, which gives its best path; those of more than ``part`` rows go by walks.
    """
    dealt, e, own = dealt_tasks(edges, durations.select("node", "duration").dropna(), part)
    found = _searched(dealt, _critical, "node string, finish double, path string")
    found = found if e is None else found.unionByName(_critical_far(e, own))
    return found.orderBy(F.desc("finish"), "path").limit(1)


def _implied(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Places of the edges that a longer path implies, within one task."""
    names, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = codes[: len(src)].tolist(), codes[len(src) :].tolist()
    after: list[list[tuple[int, int]]] = [[] for _ in names]
    ins = [0] * len(names)
    for i, (x, y) in enumerate(zip(a, b)):
        after[x].append((y, i))
        ins[y] += 1
    todo, place = [x for x, n in enumerate(ins) if not n], [-1] * len(names)
    for at, x in enumerate(todo):  # grows while it is read: a topological order
        place[x] = at
        for y, _ in after[x]:
            ins[y] -= 1
            if not ins[y]:
                todo.append(y)
    if len(todo) < len(names):
        raise ValueError("the graph has a cycle")
    out = []
    for targets in after:
        if len(targets) > 1:
            targets = sorted(targets, key=lambda t: place[t[0]])
            last, seen = place[targets[-1][0]], set()
            for y, i in targets:
                if y in seen:
                    out.append(i)
                    continue
                stack = [y]
                while stack:
                    for z, _ in after[stack.pop()]:
                        if z not in seen and place[z] <= last:
                            seen.add(z)
                            stack.append(z)
    return np.array(sorted(out), np.int64)


def _implied_far(e: DataFrame) -> DataFrame:
    """The same for parts of any size: a search from each edge's other targets that stops at the edge's level, or when it is found."""
    nodes = settle(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    level = settle(_levels_far(e, nodes))
    placed = settle(e.join(level.select(F.col("node").alias("src"), F.col("level").alias("ls")), "src").join(level.select(F.col("node").alias("dst"), F.col("level").alias("ld")), "dst"))
    steps = settle(placed.select(F.col("src").alias("__from"), F.col("dst").alias("next"), F.col("ld").alias("at")))
    open_ = placed.filter("ld - ls > 1").select("src", "dst", "ld")
    first = open_.join(steps, F.col("src") == F.col("__from")).filter("at < ld").select("src", "dst", "ld", F.col("next").alias("node"))
    front, found = settle(first), None
    seen = front
    while not front.isEmpty():
        step = front.join(steps, F.col("node") == F.col("__from")).filter("at <= ld").select("src", "dst", "ld", "next", "at")
        step = settle(step.distinct())
        hit = settle(step.filter("next = dst").select("src", "dst").distinct())
        found = hit if found is None else found.unionByName(hit)
        rest = step.filter("at < ld").select("src", "dst", "ld", F.col("next").alias("node")).join(hit, ["src", "dst"], "left_anti")
        front = settle(rest.join(seen, ["src", "dst", "ld", "node"], "left_anti"))
        seen = settle(seen.join(hit, ["src", "dst"], "left_anti").unionByName(front))
    return e.select("src", "dst").limit(0) if found is None else found.distinct()


def parted(edges: DataFrame, part: int) -> tuple[DataFrame, DataFrame | None]:
    """``(src, dst, deal)``, ``(src, dst)``: distinct edges of connected parts of up to ``part`` edges, dealt out some parts to a task, and those of larger parts (None without)."""
    own = settle(edges.select("src", "dst").dropna())
    roots = components(own.select(F.col("src").alias("a"), F.col("dst").alias("b")))  # before rows are dealt anew, for links may lie together
    e = own.distinct()
    named = settle(e.join(roots, F.col("src") == F.col("node"), "left").select("src", "dst", F.coalesce("root", "src").alias("part")))
    large = settle(named.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part).select("part"))
    deals = max(e.sparkSession.sparkContext.defaultParallelism, -(-2 * named.count() // part))
    deal = F.pmod(F.xxhash64("part"), F.lit(deals)).alias("deal")
    if large.isEmpty():
        return named.select("src", "dst", deal), None
    return named.join(large, "part", "left_anti").select("src", "dst", deal), settle(named.join(large, "part", "left_semi").select("src", "dst"))


def ends_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(table.column(c).to_pylist(), object) for c in ("src", "dst"))


def fields_of(e: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema.fields if f.name in ("src", "dst"))


def redundant(edges: DataFrame, part: int = PART_EDGES) -> DataFrame:
    """``src, dst``: edges that a longer path implies, for graphs without cycles (else an error).

    Connected parts are told apart first. Parts of up to ``part`` edges are dealt out, some to a
    task, and searched there in topological order; larger ones hop by hop, held to levels.
    """
    dealt, large = parted(edges, part)

    def search(table: pa.Table) -> pa.Table:
        return table.select(["src", "dst"]).take(pa.array(_implied(*ends_of(table))))

    near_ones = dealt.groupBy("deal").applyInArrow(search, fields_of(dealt))
    return near_ones if large is None else near_ones.unionByName(_implied_far(large))


def chains(edges: DataFrame, least: int = 3) -> DataFrame:
    """``head, nodes``: runs of nodes joined one to one, with at least three nodes."""
    _, runs, _ = chain_runs(edges)
    if runs is None:
        return edges.select(F.col("src").alias("head"), F.lit(0).cast("long").alias("nodes")).limit(0)
    return runs.filter("head is not null").groupBy("head").agg((F.count(F.lit(1)) + 1).alias("nodes")).filter(F.col("nodes") >= least)


def rerun_plan(edges: DataFrame, states: DataFrame) -> DataFrame:
    """``node, reason, origins``: failed tasks and all that runs after them; successes among these are stale."""
    failed = states.filter("state = 'failed'").select(F.col("node").alias("root"))
    down = trace(edges, failed, None).groupBy("node").agg(F.count_distinct("root").alias("origins"))
    x = states.join(down, "node", "left").join(failed.select(F.col("root").alias("node"), F.lit(True).alias("f")), "node", "left")
    reason = F.when(F.col("f"), "failed").when(F.col("origins").isNotNull() & (F.col("state") == "success"), "stale").when(F.col("origins").isNotNull(), "downstream")
    return x.select("node", reason.alias("reason"), F.coalesce("origins", F.lit(0)).alias("origins")).filter("reason is not null")


def _schedule_far(edges: DataFrame, durations: DataFrame, goal: str, deadline: float) -> DataFrame:
    """The same for parts of any size, by walks after runs are drawn together."""
    e, runs = _acyclic(edges, durations)
    base, n = contracted(e, runs), durations.count()
    own = durations.select("node", "duration")
    first = own if runs is None else own.join(runs.select("node"), "node", "left_anti")
    steps = base.join(own.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("__from"), F.col("dst").alias("to"), (F.col("duration") + F.col("length")).alias("more"))
    early = settle(walks(steps, first.select("node", F.lit(0.0).alias("v")), n, F.max("v"), F.col("v") + F.col("more")))
    if runs is not None:  # a node of a run starts when the head has finished and what stands between
        after = runs.join(early.withColumnRenamed("node", "head"), "head").join(own.select(F.col("node").alias("head"), F.col("duration").alias("d0")), "head").join(own, "node")
        early = early.unionByName(after.select("node", (F.col("v") + F.col("d0") + F.col("length") - F.col("duration")).alias("v")))
    whole = e.select("src", "dst").join(own.select(F.col("node").alias("dst"), "duration"), "dst").select(F.col("dst").alias("__from"), F.col("src").alias("to"), F.col("duration").alias("more"))
    last = edges.sparkSession.createDataFrame([(goal, float(deadline))], "node string, v double")
    late = settle(walks(whole, last, n, F.min("v"), F.col("v") - F.col("more"))).withColumnRenamed("v", "latest")
    now = early.join(own, "node").withColumnRenamed("v", "start")
    return now.join(late, "node", "left").select("node", "start", (F.col("start") + F.col("duration")).alias("finish"), (F.col("latest") - F.col("start") - F.col("duration")).alias("slack"))


def schedule(edges: DataFrame, durations: DataFrame, goal: str, deadline: float, part: int = PART_EDGES) -> DataFrame:
    """``node, start, finish, slack``: earliest times, and for what runs before the goal how late it may finish.

    Connected parts are dealt out, some to a task, and taken there in topological order; those of more than ``part`` rows by walks.
    """

    def search(names, own, given, duration, after, order):
        start, latest = [None] * len(names), [None] * len(names)
        for x in own:
            start[x] = 0.0
        for x in order:
            if duration[x] is not None:
                for y in after[x]:
                    start[y] = max(start[y] or 0.0, start[x] + duration[x])
        if (at := names.index(goal).as_py()) >= 0:
            latest[at] = float(deadline)
        for x in reversed(order):
            for y in after[x]:
                if latest[y] is not None and duration[y] is not None:
                    at = latest[y] - duration[y]
                    latest[x] = at if latest[x] is None else min(latest[x], at)
        finish = [None if d is None else start[x] + d for x, d in zip(own, given)]
        slack = [None if d is None or latest[x] is None else latest[x] - start[x] - d for x, d in zip(own, given)]
        return [names.take(pa.array(own, pa.int64())), [start[x] for x in own], finish, slack]

    dealt, e, own = dealt_tasks(edges, durations.filter("node is not null"), part)
    found = _searched(dealt, search, "node string, start double, finish double, slack double")
    return found if e is None else found.unionByName(_schedule_far(e, own, goal, deadline))


def follow(pointers: DataFrame, start: str) -> DataFrame:
    """``step, node``: from the start along ``node, to`` (one row a node) to its end, by doubling: rounds by the logarithm of its length."""
    jump = settle(pointers.select("node", "to").filter("to is not null"))
    path, reach, n = settle(pointers.sparkSession.createDataFrame([(0, start)], "step long, node string")), 1, jump.count()
    while True:
        further = path.join(jump, "node").select((F.col("step") + reach).alias("step"), F.col("to").alias("node"))
        now = settle(path.unionByName(further))
        if now.count() < 2 * path.count():
            return now
        path, reach = now, 2 * reach
        if reach > 2 * n + 2:
            raise ValueError("the graph has a cycle")
        jump = settle(jump.alias("x").join(jump.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", "y.to"))


def peak_parallel(intervals: DataFrame, by: Sequence[str], start: str = "start", finish: str = "finish", weight: str | None = None) -> DataFrame:
    """``by, peak``: the most (or heaviest) intervals that run at once; finishes count before starts."""
    w = F.col(weight) if weight else F.lit(1)
    events = intervals.select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("k"), w.alias("d")), F.struct(F.col(finish).alias("t"), F.lit(0).alias("k"), (-w).alias("d")))).alias("e")).select(*by, "e.*")
    sums = events.groupBy(*by, "t", "k").agg(F.sum("d").alias("d"))
    run = F.sum("d").over(Window.partitionBy(*by).orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("run", run).groupBy(*by).agg(F.max("run").alias("peak"))


def write_overlaps(runs: DataFrame) -> DataFrame:
    """``target, dag_a, dag_b, start, finish``: declared runs (``dag, target, start, finish``) of two graphs that write one table at the same time."""
    a, b = runs.alias("a"), runs.alias("b")
    on = (F.col("a.target") == F.col("b.target")) & (F.col("a.dag") < F.col("b.dag")) & (F.col("a.start") < F.col("b.finish")) & (F.col("b.start") < F.col("a.finish"))
    return a.join(b, on).select("a.target", F.col("a.dag").alias("dag_a"), F.col("b.dag").alias("dag_b"), F.greatest("a.start", "b.start").alias("start"), F.least("a.finish", "b.finish").alias("finish"))


def rollback_levels(edges: DataFrame, nodes: DataFrame, root: str, durations: DataFrame) -> DataFrame:
    """``level, tasks, slowest``: what must run again after a rollback of a node, in topological levels, with the slowest task of each."""
    hit = trace(edges, edges.sparkSession.createDataFrame([(root,)], "root string"), None).select("node").unionByName(edges.sparkSession.createDataFrame([(root,)], "node string"))
    hit = settle(hit)
    n = hit.count()
    inner = edges.join(near(hit.select(F.col("node").alias("src")), n), "src", "left_semi").join(near(hit.select(F.col("node").alias("dst")), n), "dst", "left_semi").select("src", "dst")
    lv = settle(levels(inner, hit))
    return durations.join(near(lv, n), "node").groupBy("level").agg(F.count(F.lit(1)).alias("tasks"), F.max("duration").alias("slowest"))


def usage(edges: DataFrame, nodes: DataFrame, log: DataFrame) -> DataFrame:
    """``node, queries, state``: how often each table is queried; leaves and isolated tables that nobody queries can go."""
    bare = F.regexp_replace(F.lower("table_name"), r"^.*\.", "")
    n = log.groupBy(bare.alias("node")).agg(F.count(F.lit(1)).alias("queries"))
    x = health(nodes, edges).join(n, "node", "left").fillna({"queries": 0})
    return x.select("node", "queries", F.when((F.col("queries") == 0) & F.col("state").isin("leaf", "isolated"), "decommission").when(F.col("queries") > 0, "used").otherwise("inner").alias("state"))


def fan_in_share(edges: DataFrame) -> DataFrame:
    """``src, targets, share``: sources that three or more targets read, and their share of all edges.

    Edges are read once: the number of all of them is summed up from the sources' own.
    """
    own = settle(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).groupBy("src").agg(F.count("dst").alias("targets"), F.sum("k").alias("k")))
    total = own.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    return own.filter("targets >= 3").join(F.broadcast(total)).select("src", "targets", share(F.col("targets"), F.col("n")).alias("share"))


def peeled(edges: DataFrame) -> DataFrame:
    """``src, dst``: what is left when nodes without a way in or a way out are taken away, again and again."""
    now, n = settle(edges.select("src", "dst").distinct()), -1
    while (m := now.count()) != n:
        n = m
        for _ in range(HOPS):
            now = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        now = settle(now)
    return now


def _coloured(edges: DataFrame) -> DataFrame:
    """``node, colour``: the largest node that reaches each (itself too). Only nodes whose colour has changed pass it on."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colours = front = settle(ends.withColumn("colour", F.col("node")))
    rows = front.count()
    while rows:
        step = near(front.select(F.col("node").alias("src"), F.col("colour").alias("new")), rows).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max("new").alias("new"))
        moved = settle(colours.join(step, "node", "left").withColumn("more", F.coalesce(F.col("new") > F.col("colour"), F.lit(False))).select("node", F.greatest("colour", "new").alias("colour"), "more"))
        front, colours = moved.filter("more").select("node", "colour"), moved.select("node", "colour")
        rows = front.count()
    return colours


def _colour_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of cycles, by forward colours and backward searches within them."""
    found, now = None, peeled(edges)
    while not now.isEmpty():
        colours = _coloured(now)
        own = colours.select(F.col("node").alias("src"), F.col("colour").alias("ca")).join(now, "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("cb")), "dst").filter("ca = cb")
        back = settle(own.select(F.col("dst").alias("__from"), F.col("src").alias("node")))
        # a colour's root reaches all of its nodes; those that reach the root are its component
        front = seen = settle(colours.filter("node = colour").select("node", F.col("colour").alias("component")))
        rows = front.count()
        while rows:
            step = near(front.select(F.col("node").alias("__from"), "component"), rows).join(back, "__from").select("node", "component").distinct()
            front = settle(step.join(seen, ["node", "component"], "left_anti"))
            rows, seen = front.count(), settle(seen.unionByName(front))
        looped = now.filter("src = dst").select(F.col("src").alias("component"))  # else a root that is alone only stands between cycles
        real = seen.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component").unionByName(looped)
        part = settle(seen.join(real.distinct(), "component", "left_semi").select("node", "component"))
        found = part if found is None else found.unionByName(part)
        gone = seen.select("node")
        now = peeled(now.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return found


def _strong(src: np.ndarray, dst: np.ndarray) -> list[tuple[object, object, int]]:
    """``node, component, size`` of the nodes of cycles, within one task (Tarjan's search without recursion)."""
    names, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)  # in order, so that the smallest code is the smallest name
    after: list[list[int]] = [[] for _ in names]
    for x, y in zip(codes[: len(src)].tolist(), codes[len(src) :].tolist()):
        after[x].append(y)
    at, low, held, out = [0] * len(names), [0] * len(names), [False] * len(names), []
    stack: list[int] = []
    clock = 0
    for root in range(len(names)):
        if at[root]:
            continue
        todo = [(root, iter(after[root]))]
        clock += 1
        at[root] = low[root] = clock
        stack.append(root)
        held[root] = True
        while todo:
            x, ways = todo[-1]
            for y in ways:
                if not at[y]:
                    clock += 1
                    at[y] = low[y] = clock
                    stack.append(y)
                    held[y] = True
                    todo.append((y, iter(after[y])))
                    break
                if held[y]:
                    low[x] = min(low[x], at[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == at[x]:
                    cut = len(stack) - 1
                    while stack[cut] != x:
                        cut -= 1
                    own = stack[cut:]
                    del stack[cut:]
                    for y in own:
                        held[y] = False
                    if len(own) > 1 or x in after[x]:
                        first = names[min(own)]
                        out += [(names[y], first, len(own)) for y in own]
    return out


def strong_components(edges: DataFrame, part: int = PART_EDGES) -> DataFrame:
    """``node, component, size`` of every node that is in a cycle: components are named by their smallest node; a node with an edge to itself may be alone.

    Connected parts of up to ``part`` edges are searched some to a task, larger ones together.
    """
    dealt, large = parted(edges, part)
    kind = dealt.schema["src"].dataType.simpleString()

    def search(table: pa.Table) -> pa.Table:
        found, own = _strong(*ends_of(table)), table.schema.field("src").type
        node, component, size = zip(*found) if found else ((), (), ())
        return pa.table({"node": pa.array(node, own), "component": pa.array(component, own), "size": pa.array(size, pa.int64())})

    near_ones = dealt.groupBy("deal").applyInArrow(search, f"node {kind}, component {kind}, size long")
    return near_ones if large is None else near_ones.unionByName(_strong_far(large))


def _strong_far(edges: DataFrame) -> DataFrame:
    """The same for parts of any size.

    Nodes that are in no cycle are peeled off, and runs of nodes joined one to one are
    drawn together (ranked by pointer doubling), until neither finds anything: a cycle of any
    length without branches takes rounds by the logarithm of its length. What is left is coloured
    forward and searched backward, all colours at a time.
    """
    now, runs_above, rings = peeled(edges), [], None
    while True:
        before = now.count()
        e, runs, ringed = chain_runs(now)
        if ringed:
            ring = e.filter("link").join(runs.filter("head is null").select(F.col("node").alias("dst")), "dst", "left_semi")
            parts = components(ring.select(F.col("src").alias("a"), F.col("dst").alias("b")))
            nodes = ring.select(F.col("dst").alias("node")).distinct().join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
            rings = nodes if rings is None else rings.unionByName(nodes)
        if runs is not None:
            runs_above.append(runs.filter("head is not null").select("node", "head"))
        now = peeled(contracted(e, runs).select("src", "dst").distinct())
        if now.count() == before:
            break
    found = _colour_components(now)
    for runs in reversed(runs_above):  # a run is in its head's component: its head has no other way out
        if found is not None:
            found = settle(found.select("node", "component").unionByName(runs.join(found.withColumnRenamed("node", "head"), "head").select("node", "component")))
    found = rings if found is None else found if rings is None else found.unionByName(rings)
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    found = settle(found)
    named = found.groupBy("component").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size"))
    return found.join(named, "component").select("node", F.col("first").alias("component"), "size")
