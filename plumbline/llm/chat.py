"""Chat formatting: cumulative-snapshot collapse by rolling prefix hashes, then rendering. DataFrame functions only.

A log that is written after every turn holds each conversation many times, each a prefix of
the next. The rolling hash of a prefix is the exclusive-or, over its turns, of two 64-bit
hashes of position, role and text; a conversation whose whole hash is some other's strict
prefix hash is a snapshot and goes by an anti-join. Only hashes are shuffled to find them;
texts are shuffled once, to render what stays.

Turns are numbered by ranges of (conversation, turn): a range is numbered by itself and then
moved by what stands before it, so that a conversation of a third of all rows is split over
as many tasks as its rows need. Its rendering comes in chunks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, near, read_table

# The marks around a turn, and what keeps them out of texts.
START, STOP = "<|im_start|>", "<|im_end|>"
MARK, SHOWN = "<|im_", "<| im_"
#: Characters from which on a rendering goes on in a further chunk.
CHUNK = 1_000_000
ORDER = ("turn", "role", "content", "tie")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _ranged(rows: DataFrame) -> DataFrame:
    """``rows`` in ranges of their order, each with its number; rows that are alike are split as well."""
    ties = rows.withColumn("tie", F.monotonically_increasing_id())
    return durable(ties.repartitionByRange("conv_id", *ORDER).withColumn("part", F.spark_partition_id()))


def _running(rows: DataFrame, **sums: str) -> DataFrame:
    """``rows`` with running aggregates (name to expression) of each conversation: within the range, and of the ranges before it.

    The window over a conversation's ranges has one row for each range.
    """
    local = Window.partitionBy("conv_id", "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    xor = {n for n, e in sums.items() if e.startswith("bit_xor")}
    parts = rows.groupBy("conv_id", "part").agg(*[F.expr(e).alias(f"__{n}") for n, e in sums.items()])
    all_before = [F.expr(f"{'bit_xor' if n in xor else 'sum'}(__{n})").over(earlier).alias(f"__before_{n}") for n in sums]
    before = parts.select(F.col("conv_id").alias("__conv"), F.col("part").alias("__part"), *all_before)
    out = rows.select("*", *[F.expr(e).over(local).alias(n) for n, e in sums.items()])
    out = out.join(before, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part")))
    carried = {n: F.coalesce(f"__before_{n}", F.lit(0)) for n in sums}
    both = {n: F.col(n).bitwiseXOR(c) if n in xor else F.col(n) + c for n, c in carried.items()}
    return out.withColumns(both).select(*rows.columns, *sums)


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies``: conversations that are no strict prefix of another; of equal ones the smallest id."""
    rows = _ranged(turns.select("conv_id", "turn", _text("role").alias("role"), F.md5(_text("text")).alias("content")))
    placed = _running(rows, pos="count(1)")
    hashed = placed.withColumns({"h1": F.xxhash64("pos", "role", "content"), "h2": F.xxhash64("content", F.lit("second"), "role", "pos")})
    prefixes = durable(_running(hashed, p1="bit_xor(h1)", p2="bit_xor(h2)").select("conv_id", "pos", "p1", "p2"))
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("r"))
    whole = last.select("conv_id", "r.*").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    ends = last.select(F.col("conv_id").alias("__conv"), F.col("r.pos").alias("n"))
    strict = prefixes.join(ends, F.col("conv_id").eqNullSafe(F.col("__conv"))).filter("pos < n").select("pos", "p1", "p2").distinct()
    return whole.join(strict, ["pos", "p1", "p2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "copies")


def format_chats(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, n_turns, copies, chunk, rendered`` of the maximal conversations.

    Turns are ordered by ``turn`` (null first), then role and text. Null roles and texts are
    empty ones; rows without conv_id are one conversation; repeated rows are turns of their
    own; an empty table gives no rows; other columns are ignored. Marks inside of texts are
    shown with a space, so that they end no turn. A turn goes to chunk k if at least k times
    ``chunk`` characters stand before it, so that a chunk is longer than that by one turn at
    most; the chunks of a conversation, joined in order, are its rendering. Only texts of
    conversations that stay are shuffled.
    """
    kept = durable(maximal_conversations(turns)).withColumnRenamed("conv_id", "__kept")
    named = turns.select("conv_id", "turn", _text("role").alias("role"), F.md5(_text("text")).alias("content"), _text("text").alias("text"))
    shown = F.concat(F.lit(START), F.replace("role", F.lit(MARK), F.lit(SHOWN)), F.lit("\n"), F.replace("text", F.lit(MARK), F.lit(SHOWN)), F.lit(STOP), F.lit("\n"))
    stays = named.join(near(kept), F.col("conv_id").eqNullSafe(F.col("__kept"))).select("conv_id", "n_turns", "copies", *ORDER[:-1], shown.alias("shown"))
    placed = _running(_ranged(stays).withColumn("size", F.length("shown")), reach="sum(size)")
    turn = F.struct("reach", *ORDER, "shown")
    parts = placed.withColumn("chunk", F.floor((F.col("reach") - F.col("size")) / chunk).cast("long"))
    return parts.groupBy("conv_id", "n_turns", "copies", "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select("conv_id", "n_turns", "copies", "chunk", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("rendered"))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations; see ``format_chats`` for nulls, ties, long conversations, and repeated rows."""
    return format_chats(read_table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations),
s AS (
  SELECT *, '<|im_start|>' || replace(r, '<|im_', '<| im_') || chr(10) || replace(x, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS shown FROM t),
o AS (
  SELECT *, row_number() OVER w AS pos, sum(length(shown)) OVER w - length(shown) AS before
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, md5(x) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT conv_id, count(*) AS n, list(r || chr(31) || x ORDER BY pos) AS turns FROM o GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, n)) AS i FROM c)),
g AS (SELECT turns, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns, n),
k AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = g.turns))
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies, CAST(before // 1000000 AS BIGINT) AS chunk, string_agg(shown, '' ORDER BY pos) AS rendered
FROM o JOIN k USING (conv_id) GROUP BY ALL
"""
