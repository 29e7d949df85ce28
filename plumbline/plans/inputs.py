"""Inputs that the queries derive from the test tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.sources.tables import table

#: A changed copy of orders: every 97th row gone, every 101st price raised by one, ten shifted keys added.
ORDERS_B = """
orders_b AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey BETWEEN 1 AND 10)
"""


def orders_b(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 101 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    changed = o.filter("o_orderkey % 97 <> 0").withColumn("o_totalprice", price)
    return changed.unionByName(o.filter("o_orderkey between 1 and 10").withColumn("o_orderkey", F.col("o_orderkey") + 100000000))


#: Daily sums and counts of orders by priority.
DAILY = """
daily AS (
  SELECT o_orderpriority AS metric, CAST(o_orderdate AS DATE) AS day, CAST(SUM(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2)
"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("metric"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("value"))


#: Events with an arrival time: up to 96 seconds late, every 250th two hours more.
ARRIVALS = """
arrivals AS (
  SELECT event_id, user_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS event_s,
         CAST(epoch(date_trunc('second', ts)) AS BIGINT) + event_id * 7919 % 97 + CASE WHEN event_id % 250 = 0 THEN 7200 ELSE 0 END AS arrival_s
  FROM events)
"""


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    event_s = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    late = F.col("event_id") * 7919 % 97 + F.when(F.col("event_id") % 250 == 0, 7200).otherwise(0)
    return e.select("event_id", "user_id", "event_type", event_s.alias("event_s"), (event_s + late).alias("arrival_s"))


#: Lineage drawn by whole keys: parts to suppliers to orders to customers to nations to regions, so it has no cycles.
EDGES = """
edges AS (
  SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT 's' || l_suppkey, 'o' || l_orderkey FROM lineitem
  UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
"""
NODES = "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges UNION SELECT 'lone' || l_returnflag FROM lineitem)"


def name(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    pairs = ((li, "p", "l_partkey", "s", "l_suppkey"), (li, "s", "l_suppkey", "o", "l_orderkey"), (o, "o", "o_orderkey", "c", "o_custkey"), (c, "c", "c_custkey", "n", "c_nationkey"), (n, "n", "n_nationkey", "r", "n_regionkey"))
    parts = [t.select(a, b).distinct().select(name(pa, a).alias("src"), name(pb, b).alias("dst")) for t, pa, a, pb, b in pairs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The ends of all edges and the lone flags, drawn from the keys themselves: kinds and numbers are told apart before they are named. A key that is null names none; all of them are one null node."""
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    keys = ((li, {"p": "l_partkey", "s": "l_suppkey", "o": "l_orderkey"}), (o, {"o": "o_orderkey", "c": "o_custkey"}), (c, {"c": "c_custkey", "n": "c_nationkey"}), (n, {"n": "n_nationkey", "r": "n_regionkey"}))
    out = None
    for t, kinds in keys:
        cells = [F.struct(F.when(F.col(k).isNotNull(), kind).alias("kind"), F.col(k).cast("long").alias("key")) for kind, k in kinds.items()]
        part = t.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    flags = li.select("l_returnflag").distinct()
    named = out.distinct().select(F.concat("kind", F.col("key").cast("string")).alias("node"))
    return named.unionByName(flags.filter("l_returnflag is not null").select(name("lone", "l_returnflag").alias("node"))).unionByName(flags.filter("l_returnflag is null").select(F.lit(None).cast("string").alias("node")))


#: Task graphs, one for each customer: an order runs after the one before it, some after those two and three before as well.
TASKS = """
seq AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
tasks AS (SELECT 't' || o_orderkey AS node, CAST(o_orderkey * 7 % 11 + 1 AS DOUBLE) AS duration FROM orders),
deps AS (SELECT DISTINCT 't' || a.o_orderkey AS src, 't' || b.o_orderkey AS dst FROM seq a JOIN seq b ON a.o_custkey = b.o_custkey AND (b.k = a.k + 1 OR b.k = a.k + 2 AND b.o_orderkey % 3 = 0 OR b.k = a.k + 3 AND b.o_orderkey % 5 = 0))
"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(name("t", "o_orderkey").alias("node"), (F.col("o_orderkey") * 7 % 11 + 1).cast("double").alias("duration"))


def deps(spark: SparkSession, d: str) -> DataFrame:
    """One row for each pair while keys of orders are, with a customer's rows in one partition; operators of graphs take repeats for one edge."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k, o = F.col("o_orderkey"), table(spark, d, "orders").select("o_custkey", "o_orderkey")
    lags = o.select("o_orderkey", F.lag("o_orderkey", 1).over(before).alias("x"), F.when(k % 3 == 0, F.lag("o_orderkey", 2).over(before)).alias("y"), F.when(k % 5 == 0, F.lag("o_orderkey", 3).over(before)).alias("z"))
    return lags.select(F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("p"), "o_orderkey").filter("p is not null").select(name("t", "p").alias("src"), name("t", "o_orderkey").alias("dst"))


#: Column lineage by the same keys: three measures go from parts to suppliers to orders, the price of even orders on to customers.
COLUMNS = """
ce AS (
  SELECT DISTINCT 'p' || l_partkey AS st, m AS sc, 's' || l_suppkey AS dt, m AS dc FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'price' WHEN 1 THEN 'qty' ELSE 'tax' END AS m FROM lineitem)
  UNION SELECT 's' || l_suppkey, m, 'o' || l_orderkey, m FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'price' WHEN 1 THEN 'qty' ELSE 'tax' END AS m FROM lineitem)
  UNION SELECT 'o' || o_orderkey, 'price', 'c' || o_custkey, 'spend' FROM orders WHERE o_orderkey % 2 = 0)
"""


def column_edges(spark: SparkSession, d: str) -> DataFrame:
    """``src_table, src_column, dst_table, dst_column``."""
    names = ["src_table", "src_column", "dst_table", "dst_column"]
    measure = F.when(F.col("l_linenumber") % 3 == 0, "price").when(F.col("l_linenumber") % 3 == 1, "qty").otherwise("tax")
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", measure.alias("m"))
    first = li.select("l_partkey", "l_suppkey", "m").distinct().select(name("p", "l_partkey"), "m", name("s", "l_suppkey"), "m").toDF(*names)
    second = li.select("l_suppkey", "l_orderkey", "m").distinct().select(name("s", "l_suppkey"), "m", name("o", "l_orderkey"), "m").toDF(*names)
    third = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey").distinct().select(name("o", "o_orderkey"), F.lit("price"), name("c", "o_custkey"), F.lit("spend")).toDF(*names)
    return first.unionByName(second).unionByName(third)
