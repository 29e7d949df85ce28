"""Broken CSV files: what is wrong with them, and their rows, for files of any size.

Whether a line begins inside of quotes depends on all lines before it. Each block of a file is
run through the quote automaton once from either state, which gives a function of the state;
functions of blocks that follow each other are composed, and each block learns the state that it
begins in. Lines that begin inside of quotes belong to the record before them. Only
the lines of records that have several are brought together; other records stay where they are.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.durable import settle
from plumbline.functions.values import normalize_nulls

from .lines import block_lines, earlier, few

# Delimiters that are tried, in their order; control characters; UTF-8 that was read as a Western single-byte code.
DELIMITERS = (",", ";", "|", "\t")
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
MOJIBAKE = r"[Â-Ãä-æè-ê][\x80-ÿ–—‘’“”…Œœˆ‰ŠšŽžƒ†‡•€™]"
# Codes and severities (ragged rows are high from this share of rows on), and the lines that the delimiter is looked for in.
SEVERITY = {"CD001": "low", "CD002": "medium", "CD003": "medium", "CD004": "high", "CD005": "medium", "CD006": "low", "CD007": "medium"}
RAGGED_HIGH, HEAD_LINES = 0.2, 50


def read_back(line: str) -> str:
    """A line as it was before its UTF-8 was read as Windows-1252 or Latin-1; as it is if it does not decode."""
    if re.search(MOJIBAKE, line):
        for code in ("cp1252", "latin-1"):
            try:
                return line.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return line


def repaired(line: str) -> str:
    return re.sub(CONTROL, "", read_back(line))


def cells(record: str, delimiter: str) -> list[str]:
    """The cells of one record; a quote that never closes takes what is left."""
    csv.field_size_limit(2**31 - 1)
    return next(csv.reader([record], delimiter=delimiter), [])


class Quotes:
    """The quote automaton of a delimiter: a quote opens at the start of a cell only; inside, two are one, and one closes."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter)
        self.inside = re.compile(r'(?:[^"]|"")*"(?!")')  # up to the closing quote
        self.cell = re.compile(f'[^{d}]*(?:{d}|$)')  # a cell without quotes, or the rest of one

    def ends_inside(self, line: str, inside: bool) -> bool:
        """Whether the line ends inside of quotes, if it begins so."""
        if '"' not in line:
            return inside
        at, n = 0, len(line)
        while True:
            if inside:
                m = self.inside.match(line, at)
                if m is None:
                    return True
                inside, at = False, m.end()
                at = self.cell.match(line, at).end()
            elif line.startswith('"', at):
                inside, at = True, at + 1
                continue
            else:
                at = self.cell.match(line, at).end()
            if at >= n:
                return False


def sniff(lines: list[str]) -> str:
    """The delimiter with which most of the lines have one width over 1; of equal ones the widest, then the first."""
    best, top = ",", -1.0
    for d in DELIMITERS:
        widths = [w for w in (len(cells(x, d)) for x in lines) if w]
        most = max(((widths.count(w), -widths.index(w), w) for w in set(widths)), default=(0, 0, 0))
        if most[2] > 1 and most[0] / len(widths) + most[2] / 1000 > top:
            best, top = d, most[0] / len(widths) + most[2] / 1000
    return best


def header_names(first: list[str], width: int) -> tuple[list[str], int]:
    """Column names, repeated ones with _2, _3, ... and missing ones as col_i; and how many repeat another."""
    names, seen, repeats = [], {}, 0
    for c in (x.strip() for x in first):
        seen[c] = seen.get(c, 0) + 1
        repeats += seen[c] > 1
        names.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return names[:width] + [f"col_{k + 1}" for k in range(width - len(names))], repeats


def _composed(blocks: DataFrame) -> DataFrame:
    """``file, block, inside, before``: the state that each block begins in, and the records that begin before it.

    ``blocks``: ``file, block, from_out, from_in`` (the state it ends in, begun outside and
    inside of quotes), ``starts_out, starts_in`` (records that begin in it then).
    A block that ends in one state however it begins sets it; one that turns the state
    round is counted; the others leave it.
    """
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(upto)
    known = blocks.withColumn("turns", turns).withColumn("set", F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "turns")))
    last = F.last("set", ignorenulls=True).over(upto)
    ends = known.withColumn("last", last).withColumn("ends", (F.coalesce("last.from_out", F.lit(False)).cast("int") + F.col("turns") - F.coalesce("last.turns", F.lit(0))) % 2 == 1)
    begun = ends.withColumn("inside", F.coalesce(F.lag("ends").over(Window.partitionBy("file").orderBy("block")), F.lit(False)))
    begun = begun.withColumn("whole", ~F.last("ends").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # a file that ends inside of quotes is read line by line: which quote is the stray one cannot be told
    begun = begun.withColumn("inside", F.col("inside") & F.col("whole")).withColumn("starts", F.when(~F.col("whole"), F.col("lines")).when(F.col("inside"), F.col("starts_in")).otherwise(F.col("starts_out")))
    return begun.select("file", "block", "inside", "whole", F.coalesce(F.sum("starts").over(earlier()), F.lit(0)).alias("before"))


def _records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """``file, record, text``: the records of the files, repaired; blank lines between them go."""
    lines = block_lines(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, key = Quotes(delimiter), None
        ends, starts, n = [False, True], [0, 0], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, ends[0], ends[1], starts[0], starts[1], n)], names=["file", "block", "from_out", "from_in", "starts_out", "starts_in", "lines"])

        for b in batches:
            for *now, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if now != key:
                    if key is not None:
                        yield row()
                    key, ends, starts, n = now, [False, True], [0, 0], 0
                line = repaired(line)
                filled = bool(line.strip())
                n += filled
                for k in (0, 1):
                    starts[k] += filled and not ends[k]
                    ends[k] = quotes.ends_inside(line, ends[k])
        if key is not None:
            yield row()

    blocks = settle(lines.mapInArrow(run, "file string, block long, from_out boolean, from_in boolean, starts_out long, starts_in long, lines long"))
    states = settle(_composed(blocks))
    placed = lines.join(few(states), ["file", "block"]).select("file", "block", "i", "line", "inside", "whole", "before")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, key, inside, record = Quotes(delimiter), None, False, 0
        for b in batches:
            rows = []
            for file, block, i, line, begins, whole, before in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != key:
                    key, inside, record = (file, block), begins, before - 1
                line = repaired(line)
                part = inside
                if not inside:
                    if not line.strip():
                        continue
                    record += 1
                inside = whole and quotes.ends_inside(line, inside)
                rows.append((file, record, block, i, line, part or inside))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["file", "record", "block", "i", "line", "more"])

    parts = placed.mapInArrow(cut, "file string, record long, block long, i long, line string, more boolean")
    long = parts.filter("more").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "i", "line"))).alias("lines"))  # of one record
    return parts.filter("not more").select("file", "record", F.col("line").alias("text")).unionByName(long.select("file", "record", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text")))


def repair_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows as texts, findings ``code, severity, n``) of broken CSV files.

    Repaired are mojibake, control characters, repeated or missing column names, and rows that
    are too short (padded) or too long (what is over goes to the last cell); the width is that
    of most records, of equal ones the one that comes first. Cells in quotes may hold
    delimiters, doubled quotes and line breaks. Where a file ends inside of quotes, so that some
    quote is a stray one, it is read line by line, and a quote that never closes takes the rest of
    its line. The first record of each file is its header; the first file's names stand. Cells
    that are null tokens become null. Findings: CD001 a byte order mark (uncompressed files), CD002
    ragged rows, CD003 lines with an odd number of quotes, CD004 lost characters, CD005 lines
    of mojibake, CD006 control characters, CD007 repeated column names. No lines give no rows
    and no findings.
    """
    lines = block_lines(spark, path)
    head = lines.filter("block = 0").filter(F.length(F.trim("line")) > 0).orderBy("file", "i").limit(HEAD_LINES).select("line").collect()
    delimiter = sniff([repaired(r.line.removeprefix("﻿")) for r in head])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([cells(x, delimiter) for x in b.column(2).to_pylist()], pa.list_(pa.string()))], names=["file", "record", "c"])

    records = _records(spark, path, delimiter).mapInArrow(parse, "file string, record long, c array<string>")
    widths = settle(records.groupBy(F.size("c").alias("w"), (F.col("record") == 0).alias("head")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "record")).alias("first")))
    modal = widths.groupBy("w").agg(F.sum("n").alias("n"), F.min("first").alias("first")).orderBy(F.desc("n"), "first").first()
    width = modal.w if modal else 1
    first = records.filter("record = 0").orderBy("file").limit(1).select("c").first() if modal else None
    names, repeats = header_names(first.c if first else [], width)
    merged = F.when(F.size("c") > width, F.concat(F.slice("c", 1, width - 1), F.array(F.array_join(F.slice("c", F.lit(width), F.size("c")), delimiter)))).otherwise(F.col("c"))
    rows = records.filter("record > 0").select(merged.alias("c")).select(*[normalize_nulls(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(names)])
    return rows, _findings(spark, path, lines, widths, width, repeats)


def _findings(spark: SparkSession, path: str, lines: DataFrame, widths: DataFrame, width: int, repeats: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0, 0, 0, 0]
        for b in batches:
            for line in b.column(0).to_pylist():
                back = read_back(line)
                clean = re.sub(CONTROL, "", back)
                n = [n[0] + (clean.count('"') % 2 if clean.strip() else 0), n[1] + line.count("�"), n[2] + (back != line), n[3] + len(back) - len(clean)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], names=["CD003", "CD004", "CD005", "CD006"])

    marks = lines.select("line").mapInArrow(count, "CD003 long, CD004 long, CD005 long, CD006 long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("CD003", "CD004", "CD005", "CD006")])
    ragged = widths.filter("not head").agg(F.coalesce(F.sum(F.when(F.col("w") != width, F.col("n"))), F.lit(0)).alias("CD002"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    # the reader drops a mark without a word: the file is then three bytes longer than its lines and their breaks
    sizes = spark.read.option("lineSep", "\n").text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max("_metadata.file_size").alias("size"), F.sum(F.octet_length("value") + 1).alias("read"))
    mark = sizes.agg(F.count_if(~F.col("file").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$") & (F.col("size") - F.col("read")).between(2, 3)).alias("CD001"))
    found = marks.join(F.broadcast(ragged)).join(F.broadcast(mark)).withColumn("CD007", F.lit(repeats).cast("long"))

    def severity(code: str) -> Column:
        return F.when(F.col("CD002") >= RAGGED_HIGH * F.col("rows"), "high").otherwise("medium") if code == "CD002" else F.lit(SEVERITY[code])

    listed = F.array(*[F.struct(F.lit(c).alias("code"), severity(c).alias("severity"), F.col(c).cast("long").alias("n")) for c in SEVERITY])
    return found.select(F.explode(listed).alias("f")).select("f.*").filter("n > 0")
