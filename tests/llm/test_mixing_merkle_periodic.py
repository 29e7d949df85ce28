"""Mixtures, the Merkle manifest and periodic runs against plain versions, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle, mixing, periodic

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, sid long, key string, copies string, rank long, block string, digest string, runs string, row string, path string, __part int"


def make(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "k", "c", 2, "b", "d", "r", "w", "p", 3) for r in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(400):
        w = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))]
        out.append((i, " ".join(w) if i % 17 else None, rng.choice(["en", "de", None]), None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}", i if i % 5 else None))
    out.append((400, " ".join(["Long", "text"] * 5000), "fr", "s1", 1))
    out += [out[7]] * 3 + [(None, "no id", "en", "s2", 4)] * 2 + [(None, None, None, None, None)]
    return out


# mixtures


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, full = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        level = (total - sum(full.values())) / max(1, sum(weight[s] for s in open_))
        above = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not above:
            return {s: full.get(s, level * weight[s]) for s in names}
        full |= {s: 3.0 * sizes[s] for s in above}


def test_mixture(spark, rows):
    got = mixing.mixture(make(spark, rows)).collect()
    assert len(got) == len(rows)
    again = mixing.mixture(make(spark, list(reversed(rows))).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    size = lambda t: len((t or "").split())
    by_source = Counter()
    for r in rows:
        by_source[r[3]] += size(r[1])
    want = plain_targets(by_source)
    source_of = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = Counter()
    for r in got:
        source = source_of[r.doc_id] if r.doc_id is not None else "s2" if r.size else None
        assert (r.size, r.source_size) == (size(next(x[1] for x in rows if x[0] == r.doc_id and x[3] == source)), by_source[source])
        assert r.target == pytest.approx(want[source]) and r.taken == r.copies * r.size <= 3 * r.size
        assert int(r.expected) <= r.copies <= int(r.expected) + 1
        taken[source] += r.taken
    for source, t in want.items():
        if source not in ("s1",):  # a text of 10,000 words is a quarter of it
            assert abs(taken[source] - t) <= 30
    whole = mixing.mix(make(spark, rows)).collect()
    assert len(whole) == sum(r.copies for r in got if r.size) and whole[0].asDict().keys() >= {"row", "sid", "copies", "copy"}
    assert {r.key for r in whole} == {"k"}


def test_mixture_order(spark):
    """The documents that are taken once more are the first by odds divided by odds, but for the last ones."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["x", f"w{rng.randrange(10**6)}"]) for _ in range(20)), "en", f"s{i % 2}", 0) for i in range(1000)]
    df = make(spark, docs)
    sampled = mixing._rows(df, mixing.distinct_share, mixing.SEED)
    u = {r.doc_id: r.u for r in sampled.collect()}
    got = mixing.mixture(df).collect()
    for source in (0, 1):
        own = [r for r in got if r.doc_id % 2 == source]
        assert len({round(r.expected, 6) for r in own}) > 3
        assert sum(r.expected * r.size for r in own) == pytest.approx(own[0].target)
        p = {r.doc_id: r.expected - int(r.expected) for r in own}
        order = sorted((r for r in own if p[r.doc_id] > 0), key=lambda r: u[r.doc_id] / (1 - u[r.doc_id]) / (p[r.doc_id] / (1 - p[r.doc_id])))
        more = [r.copies - int(r.expected) for r in order]
        assert sum(more[: sum(more) - mixing.CLOSING]) == sum(more) - mixing.CLOSING and abs(sum(r.taken for r in own) - own[0].target) <= 20


def test_mixture_ties_and_many_sources(spark, monkeypatch):
    docs = [(1, "a b c d", "en", "s", 0)] * 50 + [(2, "a b", "en", "t", 0)] * 10 + [(3, "", "en", "u", 0)]
    got = mixing.mixture(make(spark, docs)).collect()
    assert sorted(Counter((r.doc_id, r.copies) for r in got).values())[-1] >= 25
    for s, i in (("s", 1), ("t", 2)):
        t = plain_targets({"s": 200, "t": 20, "u": 0})[s]
        assert abs(sum(r.taken for r in got if r.doc_id == i) - t) <= 4
    from plumbline.llm import common

    rng = random.Random(2)
    many = [(i, " ".join("abcdefgh"[rng.randrange(8)] for _ in range(rng.randint(1, 9))), "en", "hot" if i % 3 else f"s{i}", 0) for i in range(300)]
    want = sorted(map(tuple, mixing.mixture(make(spark, many)).collect()))
    monkeypatch.setattr(mixing, "spread_join", lambda *a: common.spread_join(*a, most=5))
    assert sorted(map(tuple, mixing.mixture(make(spark, many)).collect())) == want


def test_mixture_of_nothing(spark):
    assert mixing.mixture(spark.createDataFrame([], COLUMNS)).count() == 0
    assert [(r.taken, r.target) for r in mixing.mixture(make(spark, [(1, None, None, None, None)])).collect()] == [(0, 0.0)]


# manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def plain_manifest(rows):
    """Of (doc_id, source, lang, n_chars, text): the rows of the query, level by level over the whole lists."""
    trees, paths, tops = defaultdict(list), defaultdict(list), []
    for i, r in enumerate(rows):
        trees[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), i))

    def up(nodes):
        while len(nodes) > 1:
            above = []
            for at in range(0, len(nodes), 8):
                run = nodes[at : at + 8]
                for j, (_, members) in enumerate(run):
                    for m in members:
                        paths[m].append(([d for d, _ in run[:j]], [d for d, _ in run[j + 1 :]]))
                above.append((H(*(d for d, _ in run)), [m for _, ms in run for m in ms]))
            nodes = above
        return nodes[0]

    top_of = {}
    for lang in sorted(trees, key=lambda x: (x is not None, (x or "").encode())):
        tops.append(up([(d, [i]) for _, _, d, i in sorted(trees[lang])]))
        top_of[lang] = tops[-1][0]
    root = up(tops)[0] if tops else None
    out = []
    for i, r in enumerate(rows):
        claimed = list(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            claimed[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
        node = plain_leaf(claimed)
        for left, right in paths[i]:
            node = H(*left, node, *right)
        out.append((r[0], plain_leaf(r), top_of[r[2]], root, H(*(d for a, b in paths[i] for d in a + b)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 600, 5000])
def test_manifest(spark, rows, n):
    data = rows[:n] if n <= len(rows) else rows + [(1000 + i, f"Text {i}", "en", "s", i) for i in range(n)]
    df = make(spark, data) if data else spark.createDataFrame([], COLUMNS)
    got = merkle.manifest(df, merkle.tampered_leaf()).drop("proof").collect()
    want = plain_manifest([(i, s, lang, c, t) for i, t, lang, s, c in data])
    assert sorted(map(tuple, got), key=str) == want
    assert n < 600 or {r[-1] for r in want} == {True, False}


def test_proofs_of_some(spark, rows):
    df = make(spark, rows + [(1000 + i, f"Text {i}", "en", "s", i) for i in range(1500)])
    every = {r.doc_id: tuple(r) for r in merkle.manifest(df).filter("doc_id >= 1000").collect()}
    some = merkle.manifest(df, wanted=F.col("doc_id").isin(1003, 1777, 2200)).collect()
    assert len(some) == 3 and all(tuple(r) == every[r.doc_id] and r.verified for r in some)


def test_same_subtrees(spark):
    """Nodes of one digest are one record of the store; each leaf is still proved."""
    got = merkle.manifest(make(spark, [(1, "a", "en", "s", 1)] * 5000)).collect()
    assert len(got) == 5000 and all(r.verified for r in got)


# periodic runs


def plain_runs(w):
    runs = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            x = w[s : i + q]
            if len(x) >= max(6, 4 * q) and not any(all(x[t] == x[t + d] for t in range(len(x) - d)) for d in range(1, q)):
                runs.append((s, len(x), q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    digests = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode(), b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *(hashlib.sha256(x).hexdigest() for x in digests))


def loops(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        k, w = rng.choice([1, 2, 3, 10]), []
        while len(w) < rng.randint(0, 120):
            w += [str(rng.randrange(k)) for _ in range(rng.randint(1, 9))] * rng.choice([1, 1, 2, 3, 4, 5, 8])
        yield " ".join(w)


def test_runs_by_scan():
    texts = list(loops(1500, 3))
    assert [runs for _, runs, _ in periodic.scan(texts)] == [plain_runs(t.split()) for t in texts]


def test_long_runs_take_few_steps():
    texts = [" ".join(["a"] * 300_000), " ".join(f"w{i % 5000}" for i in range(100_000))]
    assert [runs for _, runs, _ in periodic.scan(texts)] == [[(0, 300_000, 1)], [(0, 100_000, 5000)]]


def test_periodic_query(spark, rows, tmp_path):
    more = [(i, t, "en", "s", 0) for i, t in enumerate(loops(300, 4), 2000)] + [(5000, " a b\x1ca " * 30, "en", "s", 0), (None, "x " * 9, "en", "s", 0)]
    data = rows + more
    make(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(r[0], r[1]) for r in data), key=str)
    assert periodic.periodic_runs(spark.createDataFrame([], COLUMNS)).count() == 0
