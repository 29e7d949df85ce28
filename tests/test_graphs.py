"""Components, cycles and redundant edges against plain versions."""

import random

import pytest

from plumbline.operators import graphs as G


def table(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string").repartition(3)


def reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for m in after.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[n] = seen
    return out


def plain_components(edges):
    r = reach(edges)
    groups = {n: sorted(m for m in r[n] if n in r[m]) for n in r if n in r[n]}
    return sorted((n, g[0], len(g)) for n, g in groups.items())


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(70)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("s", "s"), ("d", "n01")]
    assert sorted(map(tuple, G.strong_components(table(spark, edges)).collect())) == plain_components(edges)


def test_a_cycle_of_5000_edges(spark):
    ring = [(f"r{i:04}", f"r{(i + 1) % 5000:04}") for i in range(5000)]
    tails = [(f"r{i:04}", f"leaf{i}") for i in range(0, 5000, 7)] + [("r0003", "x"), ("x", "y")]
    df = table(spark, ring + tails)
    got = G.strong_components(df).collect()
    assert len(got) == 5000 and {(r.component, r.size) for r in got} == {("r0000", 5000)}
    (sample,) = G.cycle_samples(df).collect()
    assert sample.cycle == ">".join([a for a, _ in ring] + ["r0000"])


def test_no_cycles(spark):
    df = table(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    assert G.strong_components(df).count() == 0 and G.cycle_samples(df).count() == 0 and G.strong_components(df.limit(0)).count() == 0


def plain_redundant(edges):
    r, edges = reach(edges), set(edges)
    return sorted((a, b) for a, b in edges if any(c != b and (c == b or b in r[c]) for x, c in edges if x == a))


@pytest.mark.parametrize("part", [G.PART_EDGES, 3])
def test_redundant(spark, part):
    rng = random.Random(8)
    edges = [(f"{p}{min(x, y):02}", f"{p}{max(x, y):02}") for p in "abcd" for x, y in ((rng.randrange(25), rng.randrange(25)) for _ in range(40)) if x != y] + [("x", "y"), ("y", "z"), ("x", "z")]
    assert sorted(map(tuple, G.redundant(table(spark, edges), part).collect())) == plain_redundant(edges)
    assert G.redundant(table(spark, edges).limit(0)).count() == 0


def test_equal_expressions(spark):
    rng = random.Random(3)
    sources, made = {}, {}
    for i in range(60):
        sources[f"t{i}"] = frozenset(rng.sample(["a", "b", "c"], rng.randrange(1, 3)))
        made[f"t{i}"] = frozenset(rng.sample([f"x{j}" for j in range(12)], rng.randrange(0, 6)))
    edges = spark.createDataFrame([(s, t) for t, own in sources.items() for s in own], "src string, dst string")
    rows = [(t, x) for t, own in made.items() for x in [*own, "*", "", None]]
    got = {(r.a, r.b): (r.targets_a, r.targets_b, r.shared, round(r.share, 9)) for r in G.equal_expressions(edges, spark.createDataFrame(rows, "dst string, expression string")).collect()}
    classes = {}
    for t in sorted(made):
        if made[t]:
            classes.setdefault((sources[t], made[t]), []).append(t)
    want = {}
    for (s, e), own in classes.items():
        for (s2, e2), others in classes.items():
            n, shared = min(len(e), len(e2)), len(e & e2)
            if s == s2 and (own[0] < others[0] and shared * 2 >= n or e == e2 and len(own) > 1):
                want[own[0], others[0]] = (len(own), len(others), shared, round(shared / n, 9))
    assert got == want and len(want) > 20
