"""The pipeline over the smallest tables: each stage against brute force on what the stage before kept."""

import random
import re

import corpus_pipeline as P
from plumbline.llm import similar, simhash
from plumbline.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_llm_operators import brute_windows, check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    from plumbline.llm.common import vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if name == "packing":
            check_packing(out.collect(), kept, Tokenizer.from_file(vocabulary("byte_bpe_50k.json")))
            break
        assert out.columns == docs.columns
        out.write.parquet(path := str(tmp_path / str(i)))
        docs = spark.read.parquet(path)
        now = {r.doc_id: r.text for r in docs.collect()}
        if name == "exact_dedup":
            first = {}
            for d in sorted(kept):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[d]), d)
            assert set(now) == set(first.values())
        elif name == "simhash_near_dedup":
            roots = similar_roots(kept)
            assert set(now) == {d for d in kept if roots[d] == d}
        elif name == "decontamination":
            assert set(now) == {d for d, t in kept.items() if not brute_windows(t, bench)[1]}
        else:
            assert 0.8 * len(kept) < len(now) <= len(kept)
        kept = now


def test_run(spark):
    assert P.run(spark, SF).columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_roots(texts):
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    fps = {d: simhash.fingerprint(simhash.shingle_hashes(t)) & (2**64 - 1) for d, t in texts.items()}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and ((fps[a] ^ fps[b]).bit_count() <= 4 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def test_similar_texts(spark):
    rng = random.Random(3)
    texts = []
    for size in (3, 4, 5, 8, 9, 30, 60, 200, 900):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for changes in (0, 0, 1, 1, 2, 3, 5, 8, 13):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(size)] = f"n{rng.randrange(5000)}"
            texts.append(" ".join(w + [f"end{i}" for i in range(changes % 3)]))
    line = " ".join(f"common{i}" for i in range(25))
    texts += [f"{line} {' '.join(f'own{i}-{k}' for k in range(i % 9))}" for i in range(40)]  # one hot line, chains of links
    texts = dict(enumerate(texts + ["", " \n", None]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    roots = similar_roots({d: t or "" for d, t in texts.items()})
    assert 20 < len(set(roots.values())) < len(roots) - 20
    assert {r.doc_id for r in similar.keep_one_of_similar(df).collect()} == set(roots.values())


def test_rows_go_by_themselves(spark):
    long, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, long), (7, long + " tail"), (7, other), (None, other + " tail"), (None, "alone")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in similar.keep_one_of_similar(df).collect()) == sorted([(1, long), (7, other), (0, "alone")])
    assert similar.keep_one_of_similar(df.limit(0)).count() == 0


def pairs_at_the_border(seed):
    """Texts of 8 to 500 words and copies whose similarity is 0.80 to 0.85, the least one that counts among them."""
    rng = random.Random(seed)
    for n in [8] * 150 + [12, 16, 24, 40, 60, 100, 250, 500] * 6:
        w = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        sets, tail = n - 4, 0
        while 4 * (sets + tail + 1) <= 5 * sets:  # one shingle more for each word at the end
            tail += 1
        yield " ".join(w), " ".join(w + [f"w{rng.randrange(10**9)}" for _ in range(tail)])


def test_no_link_depends_on_a_radius(spark):
    pairs = list(pairs_at_the_border(11))
    lost = "w390231882 w600559186 w756418445 w717589761 w301562595 w896824052 w521500536 w284389589"
    pairs.append((lost, lost + " w826510054"))
    texts = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = similar.keep_one_of_similar(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in kept} == set(range(0, 2 * len(pairs), 2))


def test_rounds_and_names(spark):
    """A family of texts round a border, by each number of rounds; columns that have the stage's own names."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = [(i, t, i, "k", "s", 1, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, __key string, __id string, lost_id long, held_key string, row string").repartition(3)
    roots = similar_roots(dict(enumerate(texts)))
    for rounds in (0, 8):
        kept = similar.keep_one_of_similar(df, rounds=rounds)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(roots.values())


def test_small_batches(spark):
    """Texts go to the workers some at a time; what the session has set lower stays."""
    import pyarrow as pa
    from plumbline.llm.common import ROWS_AT_ONCE, small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, df = spark.conf.get(name), spark.range(0, 5000, 1, 1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    try:
        for given, most in (("10000", ROWS_AT_ONCE), ("0", ROWS_AT_ONCE), ("70", 70)):
            spark.conf.set(name, given)
            got = [r.n for r in small_batches(df).mapInArrow(sizes, "n long").collect()]
            assert max(got) == most and sum(got) == 5000
    finally:
        spark.conf.set(name, before)
