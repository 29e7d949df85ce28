"""What keeps figures in proportion to the input: no sides that only look small, no rows that a table's size multiplies."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import findings as N
from plumbline.operators import graphs as G
from plumbline.operators import joins as J
from plumbline.operators import masking as K
from plumbline.operators import texts as T
from tests.test_graphs import plain_components, table


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_repeated_side_is_not_sent_to_all_tasks(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(30)], "k long, row long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "k long, v string")
    out = J.salted_join(left, right, "k", 4, "row")
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted((r.k, r.row, r.v) for r in out.collect()) == sorted((i % 3, i, "ab"[i % 3]) for i in range(30) if i % 3 < 2)


def plain_core(edges):
    edges = set(edges)
    while True:
        left = {(a, b) for a, b in edges if a in {d for _, d in edges} and b in {s for s, _ in edges}}
        if left == edges:
            return sorted(edges)
        edges = left


@pytest.mark.parametrize("part", [G.PART_EDGES, 3])
def test_cycles_of_small_and_large_parts(spark, part):
    rng = random.Random(11)
    edges = [(f"{p}{rng.randrange(20):02}", f"{p}{rng.randrange(20):02}") for p in "abc" for _ in range(22)] + [("s", "s"), ("s", "t"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("w", "z"), (None, "x"), ("x", None)]
    whole = [e for e in edges if None not in e]
    df = table(spark, edges)
    assert sorted(map(tuple, G.core_of_cycles(df, part).collect())) == plain_core(whole)
    want = plain_components(whole)
    assert sorted(map(tuple, G.strong_components(df, part).collect())) == want
    got = sorted(r.cycle.split(">") for r in G.cycle_samples(df, 4, part).collect())
    assert [c[0] for c in got] == sorted({c for _, c, _ in want})[:4] and all(c[0] == c[-1] and set(zip(c, c[1:])) <= set(whole) for c in got)
    assert all(c[1] == min(b for a, b in whole if a == c[0] and (b, c[0]) in {(n, k) for n, k, _ in want}) for c in got)
    for f in (G.core_of_cycles, G.strong_components, G.cycle_samples):
        assert f(df.limit(0)).count() == 0


def test_many_small_graphs_take_no_round_for_each_layer(spark, monkeypatch):
    """Chains of 60 nodes with skips, which have no runs to draw together: a peel by layers takes ten rounds of three, the parts are known after some rounds."""
    edges = [(f"g{g}n{i:02}", f"g{g}n{i + k:02}") for g in range(5) for i in range(58) for k in (1, 2)]
    written = []
    monkeypatch.setattr(G, "settle", lambda df, own=G.settle: written.append(1) or own(df))
    assert G.core_of_cycles(table(spark, edges)).count() == 0
    assert len(written) <= 14


def test_long_numbers_are_no_hashes(spark):
    lines = [f"2024-01-01T00:00:00.000Z ##[error]ValueError: bad value {k} in /data/in/x{k}.csv at 1.{k}, abcdef0 and 1234567e" for k in (7, 1234567, 10**12)]
    got = N.log_error_templates(spark.createDataFrame([("j", x) for x in lines], "job string, line string")).collect()
    assert [tuple(r) for r in got] == [("ValueError: bad value <n> in <path> at <ver>, <hash> and <hash>", 3, 1)]


def test_only_pairs_that_may_overlap_leave_the_join(spark):
    rng = random.Random(5)
    sets = {f"t{i:03}": frozenset(rng.sample([f"s{j}" for j in range(30)], rng.randrange(1, 9))) for i in range(120)}
    sets |= {"t_c": frozenset(["s1", "s2", "s3", "s4", "s5"]), "t_d": frozenset(["s1", "s2", "s3", "s4", "s6"]), "wide": frozenset(f"s{j}" for j in range(30)), "t_a": frozenset(["s1", "s2"]), "t_b": frozenset(["s1", "s2"])}
    df = G.overlapping_pipelines(spark.createDataFrame([(s, t) for t, own in sets.items() for s in own], "src string, dst string"))
    want = {}
    for a in sets:
        for b in sets:
            x, y, both = sets[a], sets[b], len(sets[a] & sets[b])
            if a < b and both and (kind := "equal" if x == y else "subset" if x < y else "superset" if x > y else "overlap" if both >= 0.6 * len(x | y) else None):
                want[a, b] = (both, round(both / len(x | y), 9), kind)
    assert {(r.a, r.b): (r.shared, round(r.jaccard, 9), r.kind) for r in df.collect()} == want and {k for _, _, k in want.values()} == {"equal", "subset", "superset", "overlap"}
    assert "bit_count" in df._jdf.queryExecution().analyzed().toString()


def plain_bm25(docs, asked, k):
    words = {i: t.split() for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = {t: sum(t in w for w in words.values()) for t in {t for w in words.values() for t in w}}
    scores, shared = {}, {}
    for q, text in asked:
        for i, w in words.items():
            own = set(text.split()) & set(w)
            if own:
                shared[q, i] = len(own)
                scores[q, i] = round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in own), 6)
    return scores, shared


def plain_best(scores, k):
    return [(q, i, pytest.approx(v, abs=2e-6), r) for q in {q for q, _ in scores} for r, (v, i) in enumerate(sorted(((s, i) for (x, i), s in scores.items() if x == q), key=lambda x: (-x[0], x[1]))[:k], 1)]


def searched(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BLOCK", 3)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "of", f"w{rng.randrange(40)}", f"r{rng.randrange(900)}"]) for _ in range(rng.randrange(0, 30)))) for i in range(300)]
    asked = [(i, t) for i, t in docs if i % 25 == 0]
    df = spark.createDataFrame(docs, "id long, text string").repartition(2)
    return docs, asked, *T.inverted_index(df, "id"), spark.createDataFrame(asked + asked[:2], "query_id long, query string")


def matches(got, want):
    want = {(w[0], w[3]): w for w in want}
    assert len(got) == len(want)
    for q, i, score, rank in got:
        assert (q, i, score, rank) == want[q, rank]


def test_bm25_of_blocks_of_queries_with_few_rows_that_leave_the_tasks(spark, monkeypatch):
    docs, asked, postings, lengths, queries = searched(spark, monkeypatch)
    scores, _ = plain_bm25(docs, asked, 4)
    matches(sorted(map(tuple, T.bm25(queries, postings, lengths, "id", 4).select("query_id", "id", "score", "rank").collect())), plain_best(scores, 4))
    rows, terms = T.weighed_terms(queries, postings, lengths, "id")
    left = sum(T._top(rows.coalesce(2), b, "id", 4, ("bigint", "bigint")).count() for b in T.query_blocks(terms))
    assert left < len(scores) / 4


def test_hybrid_of_blocks_of_queries(spark, monkeypatch):
    docs, asked, postings, lengths, queries = searched(spark, monkeypatch)
    rng = np.random.default_rng(3)
    # some documents have no vector, some vectors no document, one is zero, one has another length
    vectors = {i: rng.integers(-9, 9, 4).astype(float) for i in range(0, 330, 3)} | {3: np.zeros(4), 6: np.ones(3)}
    own = {q: vectors[q] for q in vectors if q % 25 == 0}
    scores, shared = plain_bm25(docs, asked, 5)
    near = {(q, i): round(float(a @ b / np.sqrt((a * a).sum() * (b * b).sum())), 5) for q, a in own.items() for i, b in vectors.items() if len(a) == len(b) and a.any() and b.any()}
    whole = {}
    for part, weight in ((scores, 0.3), (shared, 0.4), (near, 0.3)):
        for (q, i), v in part.items():
            whole[q, i] = whole.get((q, i), 0) + weight * v / max(x for (p, _), x in part.items() if p == q)
    table_of = lambda x, c: spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], f"{c} long, v array<double>")
    got = T.hybrid(queries, postings, lengths, table_of(vectors, "id"), table_of(own, "query_id"), "id", "v", {"bm25": 0.3, "keyword": 0.4, "vector": 0.3}, 5)
    matches(sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect())), plain_best({k: round(v, 6) for k, v in whole.items()}, 5))


def splits(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("split(")


def test_words_of_a_text_are_split_once_and_not_for_each_shingle(spark):
    df = spark.createDataFrame([("a b C d e f",), ("a b",), (None,)], "text string")
    out = df.select(T.shingle_set(F.col("text"), 5).alias("s"))
    assert splits(out) == 1
    assert [len(r.s) for r in out.collect()] == [2, 1, 0]
    want = df.limit(1).select(F.sort_array(F.array(F.xxhash64(F.lit("a b c d e")), F.xxhash64(F.lit("b c d e f"))))).first()[0]
    assert out.first().s == want


def test_characters_of_a_value_are_split_once_and_not_for_each_character(spark):
    df = spark.createDataFrame([("aabb",), ("",), ("abcd",), (None,)], "v string")
    out = df.select(K.entropy(F.col("v")).alias("e"))
    assert splits(out) == 1
    assert [r.e for r in out.collect()] == [1.0, 0.0, 2.0, 0.0]


def test_rules_on_a_line_are_tried_once(spark):
    out = K.secret_lines(spark.createDataFrame([(1, "password = 'hunter2hunter2'")], "id long, text string"), "id")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aws_access_key") == 1


def test_shares_read_the_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("a", x) for x in "bcdd"] + [("e", "b"), ("e", None), ("e", "c"), (None, "x"), (None, "y"), (None, "z")]
    e = spark.createDataFrame(rows, "src string, dst string").mapInArrow(count, "src string, dst string")
    assert sorted(map(tuple, G.fan_in_share(e).collect()), key=str) == [("a", 3, 0.3), (None, 3, 0.3)]
    assert read.value == len(rows)
