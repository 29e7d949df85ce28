"""Lines, logs and broken CSV files that are read in many small blocks."""

import csv
import datetime as dt
import io
import random

import pytest

from plumbline.operators import texts as X
from plumbline.sources.csvs import DELIMITERS, Quotes, cells, repair_csv
from plumbline.sources.lines import numbered_lines


@pytest.fixture(params=["64", "128m"])
def blocks(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers(spark, blocks, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.log").write_text("".join(f"line {k} {i}{' x' * (i % 60)}\n" for i in range(80 * k)))
    got = sorted((r.file[-5], r.n, r.line.strip()) for r in numbered_lines(spark, str(tmp_path)).collect())
    assert got == sorted((str(k), i, f"line {k} {i}{' x' * (i % 60)}") for k in range(3) for i in range(80 * k))


def test_events_over_borders(spark, blocks, monkeypatch):
    rng = random.Random(3)
    kinds = ["2024-01-01 00:00:00 ERROR a.B - failed {}", "java.io.IOException: bare {}", "  at a.b.C{}", "Caused by: x.YError: z {}", "2024-01-01 00:00:01 INFO fine {}", "plain {}", "WARN odd {}"]
    lines = [(f, i, rng.choice(kinds).format(i)) for f in ("a", "b") for i in range(150)]
    df = spark.createDataFrame(lines, "file string, n long, line string").repartition(3)
    whole = sorted(map(str, X.log_events(df).collect()))
    monkeypatch.setattr(X, "LOG_BLOCK", 7)
    assert sorted(map(str, X.log_events(df).collect())) == whole and len(whole) > 60


def plain_state(line, inside, d):
    """The automaton letter by letter."""
    state = "in" if inside else "start"
    for c in line:
        if state == "start":
            state = "in" if c == '"' else "start" if c == d else "cell"
        elif state == "cell":
            state = "start" if c == d else "cell"
        elif state == "in":
            state = "seen" if c == '"' else "in"
        else:
            state = "in" if c == '"' else "start" if c == d else "cell"
    return state == "in"


@pytest.mark.parametrize("d", DELIMITERS)
def test_automaton(d):
    rng, quotes = random.Random(1), Quotes(d)
    for _ in range(4000):
        line = "".join(rng.choice(['"', '"', d, "a", " "]) for _ in range(rng.randrange(12)))
        for inside in (False, True):
            assert quotes.ends_inside(line, inside) == plain_state(line, inside, d), (line, inside)


def test_csv_over_borders(spark, blocks, tmp_path):
    rng = random.Random(2)
    cell = lambda: rng.choice(["plain", "with, comma", 'a "b" c', "two\nlines", "é", '"', "one\n\ntwo, three", "x" * 90, "NULL"])
    rows = [[str(i), cell(), cell()] for i in range(120)] + [["id", "name", "note"]]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "name", "note"], *rows])
    (tmp_path / "a.csv").write_text(out.getvalue())
    got, findings = repair_csv(spark, str(tmp_path))
    blank = lambda x: None if x == "NULL" else x
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(map(blank, r))) for r in rows) and got.columns == ["id", "name", "note"]
    assert [r.code for r in findings.collect()] in ([], ["CD003"])


def test_csv_findings(spark, blocks, tmp_path):
    text = "﻿id;name;name;\n" + "1;Zoë;a\x07\x07;b\n2;CafÃ©;x;y;z\n3;lost � �;p;q\n4;\"stray;r;s\n;;;\n" + "".join(f"{i};n;o;p\n" for i in range(5, 12)) + "12;short\n"
    (tmp_path / "b.csv").write_text(text, encoding="utf-8")
    rows, findings = repair_csv(spark, str(tmp_path))
    assert {(r.code, r.severity, r.n) for r in findings.collect()} == {("CD001", "low", 1), ("CD002", "high", 3), ("CD003", "medium", 1), ("CD004", "high", 2), ("CD005", "medium", 1), ("CD006", "low", 2), ("CD007", "medium", 1)}
    got = {r[0]: tuple(r)[1:] for r in rows.collect()}
    assert got["2"] == ("Café", "x", "y;z") and got["4"] == ("stray;r;s", None, None) and got["12"] == ("short", None, None) and got["1"] == ("Zoë", "a", "b")
    assert rows.columns[:3] == ["id", "name", "name_2"]


def test_empty_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("\n \n")
    rows, findings = repair_csv(spark, str(tmp_path))
    assert rows.count() == 0 and findings.count() == 0


def test_cells():
    assert cells('1,"Smith, John",Rome', ",") == ["1", "Smith, John", "Rome"] and cells('"a ""b"" c"', ",") == ['a "b" c']


# tables that are published, and databases


def test_a_run_that_breaks_leaves_the_old_rows(spark, tmp_path):
    from plumbline.sources import publish as P

    path, schema = str(tmp_path / "t"), "k long, v string"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string, slot string")
    read = lambda version=None: sorted((r.slot, r.k, r.v) for r in P.read_published(spark, path, schema, version).collect())
    assert read() == []
    days = ["2024-01-01", "2024-01-02"]
    assert P.publish(rows((1, "a", days[0]), (2, "b", days[0]), (3, "c", days[1]), (9, "z", "2023-12-31")), path, days) == 1
    first = [("2024-01-01", 1, "a"), ("2024-01-01", 2, "b"), ("2024-01-02", 3, "c")]
    assert read() == first
    with pytest.raises(P.AuditError, match="too few"):
        P.publish(rows((1, "x", days[0])), path, days[:1], audit=lambda df: "too few" if df.count() < 2 else None)
    with pytest.raises(P.AuditError, match="not unique"):
        P.publish(rows((4, "x", days[0]), (4, "y", days[0])), path, days[:1], "merge", ["k"])
    broken = rows((1, "x", days[0])).selectExpr("cast(raise_error('half way') as long) as k", "v", "slot")
    with pytest.raises(Exception, match="half way"):
        P.publish(broken, path, days)
    assert read() == first
    assert P.publish(rows((2, "B", days[0]), (None, "n", days[0])), path, days[:1], "merge", ["k"]) == 2
    P.publish(rows((None, "N", days[0])), path, days[:1], "merge", ["k"])
    got = {(r.slot, r.k, r.v) for r in P.read_published(spark, path, schema).collect()}
    assert got == {("2024-01-01", 1, "a"), ("2024-01-01", 2, "B"), ("2024-01-01", None, "N"), ("2024-01-02", 3, "c")}
    P.publish(rows(), path, days[:1])
    assert read() == first[2:] and read(1) == first
    assert P.slots(dt.datetime(2024, 1, 1, 22), dt.datetime(2024, 1, 2, 1), "hour") == ["2024-01-01 22", "2024-01-01 23", "2024-01-02 00", "2024-01-02 01"]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_even_parts(spark, kind):
    from pyspark.sql import functions as F

    from plumbline.sources.databases import even_predicates

    rng = random.Random(3)
    keys = [None] * 20 + [7] * 400 + [int(rng.paretovariate(0.5)) for _ in range(1600)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select(F.col("k").cast(kind))
    where = even_predicates(df, "k", 8)
    found = [df.filter(w.replace("{key}", "k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("kinds")).first() for w in where]
    assert sum(r.n for r in found) == len(keys) and all(r.kinds == 1 or r.n <= 2 * len(keys) / 8 + 20 for r in found)
    assert even_predicates(df.limit(0), "k", 8) == ["1 = 1"]
