"""Steps whose memory, time or disk must not grow faster than their input."""

from plumbline.operators import joins as J


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overlap_is_counted_by_values_and_not_by_columns(spark):
    """No column's values come together by its name; more than 63 columns take a second long."""
    names = [f"c{i}_key" for i in range(70)]
    rows = [tuple(None if (r + i) % 5 == 0 else r * (i % 3 + 1) for i in range(70)) for r in range(30)]
    a = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    b = spark.createDataFrame([(r, str(r)) for r in range(0, 40, 2)] + [(None, "x")], "c69_key int, c64_key string")
    catalog = spark.createDataFrame([("a", n) for n in names] + [("b", "c69_key"), ("b", "c64_key")], "table_name string, column_name string")
    out = J.with_overlap(J.suggest_joins(catalog), {"a": a, "b": b})
    assert " v#" not in plan(out)
    got = {r.column_a: (r.ndv_a, r.ndv_b, r.shared) for r in out.collect()}
    for c, other in (("c69_key", set(range(0, 40, 2))), ("c64_key", set(range(0, 40, 2)) | {"x"})):
        own = {row[names.index(c)] for row in rows} - {None}
        assert got.pop(c) == (len(own), len(other), len(own & other))
    assert not got


def test_few_links_are_drawn_together_without_rounds(spark, monkeypatch):
    """Chains, a star and struct nodes with nulls, at once and by rounds, against a search; few links take no shuffle."""
    import random

    from plumbline.operators import graphs as G

    rng = random.Random(3)
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(150) if i % 40] + [("n010", f"m{i}") for i in range(20)] + [("n005", "n005")]
    rng.shuffle(chain)
    least = {x: x for e in chain for x in e}
    while any(least[a] != least[b] for a, b in chain):
        for a, b in chain:
            least[a] = least[b] = min(least[a], least[b])
    want = {(x, r) for x, r in least.items() if x != r}
    links = spark.createDataFrame(chain, "a string, b string").repartition(7)
    for chunk in (50_000, 5):
        monkeypatch.setattr(G, "CHUNK", chunk)
        assert {tuple(r) for r in G.components(links).collect()} == want
    monkeypatch.setattr(G, "CHUNK", 50_000)
    steps = []
    settle = G.settle
    monkeypatch.setattr(G, "settle", lambda df: steps.append(plan(df)) or settle(df))
    G.components(links).collect()
    assert len(steps) == 2 and not any("Join" in x or "Aggregate" in x for x in steps)
    pairs = [((True, None, 1), (False, 9, 4)), ((True, None, 1), (True, None, 0)), ((False, 7, None), (False, 7, 2))]
    kind = "struct<u: boolean, i: long, k: long>"
    got = {(tuple(r.node), tuple(r.root)) for r in G.components(spark.createDataFrame(pairs, f"a {kind}, b {kind}")).collect()}
    assert got == {((True, None, 1), (False, 9, 4)), ((True, None, 0), (False, 9, 4)), ((False, 7, 2), (False, 7, None))}


def plain_tasks(edges, took, goal, deadline):
    """Levels, the best path, and starts, finishes and slacks, from all walks."""
    after = {}
    for a, b in set(edges):
        after.setdefault(a, []).append(b)
    level, start, best, latest = {}, {}, (1.0, ""), {}

    def walk(path, length):
        nonlocal best
        x = path[-1]
        level[x], start[x] = max(level.get(x, 0), len(path) - 1), max(start.get(x, 0.0), length)
        best = min(best, (-(length + took[x]), ">".join(path)))
        if x == goal:
            for i, y in enumerate(path):
                at = deadline - sum(took[z] for z in path[i + 1 :])
                latest[y] = min(latest.get(y, at), at)
        for y in after.get(x, ()):
            walk([*path, y], length + took[x])

    for x in took:
        walk([x], 0.0)
    slack = {x: (start[x], start[x] + t, latest[x] - start[x] - t if x in latest else None) for x, t in took.items()}
    return level, best, slack


def test_tasks_of_parts_take_no_round_for_each_layer(spark, monkeypatch):
    """Levels, critical paths and slacks of small and large parts, with ties, repeats and tasks that take no time, against all walks."""
    import random

    from plumbline.operators import graphs as G

    rng = random.Random(4)
    edges = [(f"t{p}{min(x, y)}", f"t{p}{max(x, y)}") for p in range(1, 9) for x, y in ((rng.randrange(12), rng.randrange(12)) for _ in range(14)) if x != y]
    edges += [("t1", "t10"), ("t10", "t100"), ("t1", "t100"), *edges[:5]]
    took = {x: float(rng.randrange(3)) for x in sorted({x for e in edges for x in e} | {"alone"})}
    goal = edges[3][1]
    level, best, slack = plain_tasks(edges, took, goal, 20.0)
    e, n = spark.createDataFrame(edges, "src string, dst string").repartition(3), spark.createDataFrame(list(took.items()), "node string, duration double")
    for part, chunk in ((G.PART_EDGES, G.CHUNK), (45, 4), (18, 50)):
        monkeypatch.setattr(G, "CHUNK", chunk)
        assert {r.node: r.level for r in G.levels(e, n, part).collect()} == level
        r = G.critical_path(e, n, part).first()
        assert (-r.finish, r.path) == best and r.path.split(">")[-1] == r.node
        assert {r.node: (r.start, r.finish, r.slack) for r in G.schedule(e, n, goal, 20.0, part).collect()} == slack
    written = []
    monkeypatch.setattr(G, "CHUNK", 50)
    monkeypatch.setattr(G, "settle", lambda df, own=G.settle: written.append(1) or own(df))
    deep = [(f"g{g}n{i:02}", f"g{g}n{i + k:02}") for g in range(5) for i in range(58) for k in (1, 2)]
    assert G.levels(spark.createDataFrame(deep, "src string, dst string"), spark.createDataFrame(sorted({(x,) for p in deep for x in p}), "node string"), 200).agg({"level": "max"}).first()[0] == 58
    assert len(written) <= 14


def test_a_cascade_reads_only_what_is_downstream(spark, monkeypatch):
    """A ring elsewhere is no error, and edges that nothing asked leads to are in no step."""
    import pytest

    from plumbline.operators import graphs as G
    from plumbline.operators import telemetry as T

    rows = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "a"), (None, "a"), ("d", None), ("a", "b")]
    e = spark.createDataFrame(rows, "src string, dst string").repartition(3)
    missing = spark.createDataFrame([("a", 1), ("c", 2), ("gone", 2), ("a", 1)], "node string, day int")
    want = {("a", 1): 0, ("b", 1): 1, ("c", 1): 2, ("d", 1): 3, ("c", 2): 0, ("d", 2): 1, ("gone", 2): 0}
    for front in (G.FRONT, 1, 0):
        monkeypatch.setattr(G, "FRONT", front)
        assert sorted((r.src, r.dst or "") for r in G.ahead(e, missing).collect()) == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "")]
    assert {(r.node, r.day): r.hop for r in T.cascade(missing, e.filter("dst is not null")).collect()} == want
    assert G.ahead(e, missing, 1).count() == len(rows) and G.ahead(e, missing.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        T.cascade(spark.createDataFrame([("x", 1)], "node string, day int"), e).count()


def test_stage_metrics_read_tasks_once(spark):
    """Nothing after the first grouping reads the tasks again; medians of times that repeat, of odd and even numbers, and of times that are null."""
    import statistics

    from plumbline.operators import telemetry as T

    tasks = spark.range(101).selectExpr("'r' as run", "concat('s', id % 3) as stage", "case when id % 17 = 1 then null else double(id % 7) end as duration_s", "id as spill_bytes", "2L as input_bytes")
    rows = [(i, None if i % 17 == 1 else float(i % 7)) for i in range(101)]
    out = T.stage_metrics(tasks, "run", "stage")
    assert "Range" not in plan(out)
    own = {f"s{k}": [(i, d) for i, d in rows if i % 3 == k] for k in range(3)}
    want = {s: (len(v), 6.0, statistics.median(d for _, d in v if d is not None), sum(i for i, _ in v), 2 * len(v)) for s, v in own.items()}
    assert {r.stage: tuple(r)[2:] for r in out.collect()} == want


def test_the_written_event_log_is_compressed(spark, tmp_path, monkeypatch):
    """One event for each order and target, in less than a tenth of its text."""
    from plumbline.plans import sources as P

    monkeypatch.setattr(P.I, "scratch", lambda spark, name: str(tmp_path / name))
    d = "/root/testdata/sf0.001"
    P.ln_from_spark(spark, d).collect()
    files = [f for f in (tmp_path / "sqllog").iterdir() if f.name.startswith("part-")]
    lines = spark.read.text(str(tmp_path / "sqllog"))
    assert lines.count() == spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey", "l_suppkey % 7").distinct().count()
    assert sum(f.stat().st_size for f in files) * 10 < lines.selectExpr("sum(length(value))").first()[0]
