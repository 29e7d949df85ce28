"""Queries of lineage and task graphs: lineage drawn by the keys of the sales tables, and a task graph for each customer's orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import graphs as G
from plumbline.sources import tables as S

from .inputs import COLUMNS, EDGES, NODES, TASKS, column_edges, deps, edges, name, nodes, tasks
from .registry import query

NUM = "CAST(regexp_replace({}, '^[a-z]+', '') AS BIGINT)"
DOWN = "t(node, hop) AS (SELECT '{root}', 0 UNION SELECT dst, hop + 1 FROM t JOIN edges ON src = node WHERE hop < {depth})"
REAL = "node NOT LIKE 'lone%'"


def number(c="node"):
    return F.regexp_replace(F.col(c), "^[a-z]+", "").cast("long")


def real(spark, d):
    return nodes(spark, d).filter("node not like 'lone%'")


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


@query("ln_trace", f"WITH RECURSIVE {EDGES}, {DOWN.format(root='s5', depth=10)} SELECT 's5' AS root, node, CAST(min(hop) AS INTEGER) AS hop FROM t WHERE hop > 0 GROUP BY node UNION ALL SELECT * FROM (WITH RECURSIVE u(node, hop) AS (SELECT 's5', 0 UNION SELECT src, hop + 1 FROM u JOIN edges ON dst = node WHERE hop < 10) SELECT 's5', node, CAST(-min(hop) AS INTEGER) FROM u WHERE hop > 0 GROUP BY node)")
def ln_trace(spark, d):
    return G.both_ways(edges(spark, d), roots(spark, "s5"))


_ROOTS = "roots AS (SELECT * FROM (VALUES ('p7', 'qty'), ('p7', 'tax'), ('p11', 'price'), ('s3', 'price'), ('n5', 'gdp'), ('c4', 'spend'), ('c4', 'name'), ('s5', 'gdp')) v(rt, rc))"


@query("ln_column_impact", f"""WITH RECURSIVE {EDGES}, {COLUMNS}, {_ROOTS}, t(rt, rc, tn, cn, hop) AS (SELECT rt, rc, rt, rc, 0 FROM roots UNION SELECT rt, rc, dt, dc, hop + 1 FROM t JOIN ce ON st = tn AND sc = cn WHERE hop < 5),
f(rt, rc, tn, hop) AS (SELECT rt, rc, rt, 0 FROM roots WHERE NOT EXISTS (SELECT 1 FROM ce WHERE st = rt AND sc = rc OR dt = rt AND dc = rc) UNION SELECT rt, rc, dst, hop + 1 FROM f JOIN edges ON src = tn WHERE hop < 5)
SELECT rt AS root_table, rc AS root_column, tn AS table_name, cn AS column_name, CAST(min(hop) AS INTEGER) AS hop, 'column' AS kind FROM t WHERE hop > 0 GROUP BY 1, 2, 3, 4 UNION ALL SELECT rt, rc, tn, NULL, CAST(min(hop) AS INTEGER), 'table' FROM f WHERE hop > 0 GROUP BY 1, 2, 3""")
def ln_column_impact(spark, d):
    """Of columns with edges, of one that is only written (c4.spend), and of some that no column edge knows."""
    named = spark.createDataFrame([("p7", "qty"), ("P7", "Tax"), ("p11", "price"), ("s3", "price"), ("n5", "gdp"), ("c4", "spend"), ("c4", "name"), ("s5", "gdp")], "table_name string, column_name string")
    return G.column_impact(column_edges(spark, d), edges(spark, d), named)


@query("ln_dead_columns", f"WITH {EDGES}, {COLUMNS} SELECT DISTINCT dt AS table_name, dc AS column_name FROM ce x WHERE dt NOT LIKE 'c1%' AND NOT EXISTS (SELECT 1 FROM ce y WHERE y.st = x.dt AND y.sc = x.dc) AND (dt IN (SELECT src FROM edges) OR dt IN (SELECT st FROM ce))")
def ln_dead_columns(spark, d):
    return G.dead_columns(column_edges(spark, d), edges(spark, d), "^c1")


@query("ln_path", f"WITH RECURSIVE {EDGES}, p(node, path, hops) AS (SELECT 'p2', 'p2', 0 UNION ALL SELECT dst, min(path || '>' || dst), hops + 1 FROM p JOIN edges ON src = node WHERE hops < 8 GROUP BY dst, hops) SELECT path, CAST(hops AS INTEGER) AS hops FROM p WHERE node = 'n17' ORDER BY hops, path LIMIT 1")
def ln_path(spark, d):
    return G.shortest_path(edges(spark, d), "p2", "n17")


@query("ln_sla_impact", f"WITH RECURSIVE {EDGES}, {DOWN.format(root='p3', depth=10)} SELECT node, CAST(min(hop) AS INTEGER) AS hop, '0' || {NUM.format('node')} % 9 || ':00' AS sla FROM t WHERE hop > 0 AND {NUM.format('node')} % 4 = 0 GROUP BY node")
def ln_sla_impact(spark, d):
    slas = real(spark, d).filter(number() % 4 == 0).select("node", F.concat(F.lit("0"), (number() % 9).cast("string"), F.lit(":00")).alias("sla"))
    return G.sla_impact(edges(spark, d), "p3", slas)


_LOOPS = "loops AS (SELECT * FROM deps UNION SELECT 't' || max(o_orderkey), 't' || min(o_orderkey) FROM orders GROUP BY o_custkey HAVING o_custkey % 3 = 0 AND count(*) > 1)"


def loops(spark, d):
    """The task graphs, where every third customer's last order leads back to the first."""
    back = S.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("a"), F.min("o_orderkey").alias("b"), F.count(F.lit(1)).alias("n")).filter("o_custkey % 3 = 0 and n > 1")
    return deps(spark, d).unionByName(back.select(name("t", "a").alias("src"), name("t", "b").alias("dst"))).distinct()


@query("ln_cycles", f"WITH {TASKS}, {_LOOPS}, own AS (SELECT 't' || o_orderkey AS node, o_custkey FROM orders) SELECT src, dst FROM loops JOIN own ON src = node WHERE o_custkey % 3 = 0")
def ln_cycles(spark, d):
    """Whole graphs of every third customer are in cycles, for the first order leads to all of its others."""
    return G.core_of_cycles(loops(spark, d))


@query("ln_components", f"WITH {TASKS}, {_LOOPS}, n AS (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1 HAVING count(*) > 1) SELECT 't' || o_orderkey AS node, min('t' || o_orderkey) OVER (PARTITION BY o_custkey) AS component, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders JOIN n USING (o_custkey)")
def ln_components(spark, d):
    """Strongly connected components: the whole graph of every third customer is one."""
    return G.strong_components(loops(spark, d))


@query("ln_cycle_samples")
def ln_cycle_samples(spark, d):
    return G.cycle_samples(loops(spark, d))


_HEALTH = "h AS (SELECT node, coalesce(i.n, 0) AS ins, coalesce(o.n, 0) AS outs, CASE WHEN coalesce(i.n, 0) = 0 AND coalesce(o.n, 0) = 0 THEN 'isolated' WHEN coalesce(o.n, 0) = 0 THEN 'leaf' WHEN coalesce(i.n, 0) = 0 THEN 'source' ELSE 'inner' END AS state FROM nodes LEFT JOIN (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1) i USING (node) LEFT JOIN (SELECT src AS node, count(*) AS n FROM edges GROUP BY 1) o USING (node))"


@query("ln_health", f"WITH {EDGES}, {NODES}, {_HEALTH} SELECT * FROM h")
def ln_health(spark, d):
    return G.health(nodes(spark, d), edges(spark, d))


def graph(spark, d, where, confidence, source):
    return edges(spark, d).filter(where).select("src", "dst", F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))


@query("ln_merge", f"WITH {EDGES}, g AS (SELECT src, dst, 0.9 AS confidence, 'sql' AS source FROM edges WHERE {NUM.format('src')} % 3 <> 0 UNION ALL SELECT src, dst, 0.5, 'log' FROM edges WHERE {NUM.format('src')} % 2 = 0) SELECT src, dst, CAST(max(confidence) AS DOUBLE) AS confidence, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM g GROUP BY 1, 2")
def ln_merge(spark, d):
    return G.merge([graph(spark, d, number("src") % 3 != 0, 0.9, "sql"), graph(spark, d, number("src") % 2 == 0, 0.5, "log")])


@query("ln_diff", f"WITH {EDGES}, a AS (SELECT src, dst, 0.9 AS c FROM edges WHERE {NUM.format('src')} % 3 <> 0), b AS (SELECT src, dst, CASE WHEN {NUM.format('dst')} % 5 = 0 THEN 0.5 ELSE 0.9 END AS c FROM edges WHERE {NUM.format('src')} % 4 <> 0) SELECT * FROM (SELECT src, dst, CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' WHEN a.c <> b.c THEN 'confidence' END AS change FROM a FULL JOIN b USING (src, dst)) WHERE change IS NOT NULL")
def ln_diff(spark, d):
    new = graph(spark, d, number("src") % 4 != 0, 0.9, "sql").withColumn("confidence", F.when(number("dst") % 5 == 0, 0.5).otherwise(0.9))
    return G.diff(graph(spark, d, number("src") % 3 != 0, 0.9, "sql"), new)


@query("ln_change_impact", f"WITH RECURSIVE {EDGES}, c AS (SELECT * FROM (VALUES ('s3', 'removed'), ('c5', 'modified'), ('r1', 'removed'), ('p1', 'added')) v(node, change)), t(root, node, hop) AS (SELECT node, node, 0 FROM c UNION SELECT root, dst, hop + 1 FROM t JOIN edges ON src = t.node WHERE hop < 10), r AS (SELECT root, count(DISTINCT node) AS n FROM t WHERE hop > 0 GROUP BY 1) SELECT node, change, coalesce(n, 0) AS reached, CASE WHEN change = 'removed' AND coalesce(n, 0) > 0 THEN 'error' WHEN change <> 'added' AND coalesce(n, 0) > 0 THEN 'warn' ELSE 'info' END AS severity FROM c LEFT JOIN r ON c.node = r.root")
def ln_change_impact(spark, d):
    changes = spark.createDataFrame([("s3", "removed"), ("c5", "modified"), ("r1", "removed"), ("p1", "added")], "node string, change string")
    return G.change_impact(edges(spark, d), changes)


@query("ln_hygiene", f"WITH {EDGES}, {NODES}, known AS (SELECT node FROM nodes WHERE node <> 's7') SELECT node, 'orphan_output' AS problem FROM known WHERE node NOT IN (SELECT src FROM edges) AND node IN (SELECT dst FROM edges) AND NOT regexp_matches(node, '^r[01]$') UNION ALL SELECT DISTINCT x, 'dangling' FROM (SELECT src AS x FROM edges UNION SELECT dst FROM edges) WHERE x NOT IN (SELECT node FROM known)")
def ln_hygiene(spark, d):
    return G.hygiene(nodes(spark, d).filter("node <> 's7'"), edges(spark, d), "^r[01]$")


_RANKS = f"ranks AS (SELECT node, CASE substr(node, 1, 1) WHEN 'p' THEN 0 WHEN 's' THEN CAST({NUM.format('node')} % 3 AS INTEGER) WHEN 'o' THEN 2 WHEN 'c' THEN 3 WHEN 'n' THEN 5 ELSE 6 END AS layer FROM nodes WHERE {REAL} AND node <> 'c12')"


def ranks(spark, d):
    kind = F.substring("node", 1, 1)
    layer = F.when(kind == "p", 0).when(kind == "s", (number() % 3).cast("int")).when(kind == "o", 2).when(kind == "c", 3).when(kind == "n", 5).otherwise(6)
    return real(spark, d).filter("node <> 'c12'").select("node", layer.alias("layer"))


@query("ln_layers", f"WITH {EDGES}, {NODES}, {_RANKS} SELECT * FROM (SELECT src, dst, CASE WHEN b.layer - a.layer IS NULL THEN 'unknown' WHEN b.layer < a.layer THEN 'reverse' WHEN b.layer = a.layer THEN 'same_layer' WHEN b.layer - a.layer > 1 THEN 'skip' END AS problem FROM edges LEFT JOIN ranks a ON src = a.node LEFT JOIN ranks b ON dst = b.node) WHERE problem IS NOT NULL")
def ln_layers(spark, d):
    return G.layers(edges(spark, d), ranks(spark, d))


@query("ln_suspects", f"WITH RECURSIVE {EDGES}, u(node, hop) AS (SELECT 'c20', 0 UNION SELECT src, hop + 1 FROM u JOIN edges ON dst = node WHERE hop < 10), m AS (SELECT node, min(hop) AS distance FROM u WHERE hop > 0 GROUP BY 1) SELECT node, CAST(distance AS INTEGER) AS distance, round(100.0 / (1 + distance) * CASE WHEN {NUM.format('node')} % 2 = 0 THEN 1.0 ELSE 0.4 END + CASE WHEN {NUM.format('node')} % 7 = 0 THEN 40.0 ELSE 0 END + CASE WHEN {NUM.format('node')} % 5 = 0 THEN 10.0 ELSE 0 END, 4) AS score FROM m")
def ln_suspects(spark, d):
    n = real(spark, d)
    return G.suspects(edges(spark, d), "c20", n.filter(number() % 2 == 0), n.filter(number() % 7 == 0), n.filter(number() % 5 == 0)).withColumn("score", F.col("score").cast("double"))


@query("ln_metric_conflict", "SELECT 'gmv_' || p_size AS column_name, CAST(2 AS BIGINT) AS forms, count(DISTINCT p_brand) AS tables, 'high' AS severity FROM part GROUP BY p_size HAVING count(DISTINCT p_brand) > 1 AND count(DISTINCT p_partkey % 2) > 1")
def ln_metric_conflict(spark, d):
    ce = S.table(spark, d, "part").select(F.col("p_brand").alias("table_name"), F.concat(F.lit("gmv_"), F.col("p_size").cast("string")).alias("column_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit("sum(a.price * a.qty) as gmv")).otherwise("SUM(b.price) AS g").alias("expression"))
    return G.metric_conflicts(ce)


@query("ln_dup_pipelines", "WITH e AS (SELECT DISTINCT 'c' || o_orderpriority AS src, 'c' || o_custkey AS dst FROM orders), s AS (SELECT dst, string_agg(src, ',' ORDER BY src) AS sources FROM e GROUP BY 1) SELECT sources, string_agg(dst, ',' ORDER BY dst) AS targets, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1")
def ln_dup_pipelines(spark, d):
    """Customers as targets of the priorities that they order with."""
    return G.duplicate_pipelines(S.table(spark, d, "orders").select(name("c", "o_orderpriority").alias("src"), name("c", "o_custkey").alias("dst")))


@query("ln_dup_expressions", """WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS dst, l_returnflag || l_linestatus AS src FROM lineitem), x AS (SELECT DISTINCT 'o' || l_orderkey AS dst, 'qty' || CAST(l_quantity AS BIGINT) % 7 AS x FROM lineitem),
s AS (SELECT dst, string_agg(src, '|' ORDER BY src) AS sources FROM e GROUP BY 1), y AS (SELECT dst, list(x ORDER BY x) AS e FROM x GROUP BY 1),
k AS (SELECT sources, e, min(dst) AS name, count(*) AS n FROM s JOIN y USING (dst) GROUP BY 1, 2),
h AS (SELECT sources, name, unnest(e) AS x FROM k), p AS (SELECT a.name AS a, b.name AS b, count(*) AS shared FROM h a JOIN h b ON a.sources = b.sources AND a.x = b.x AND a.name < b.name GROUP BY 1, 2)
SELECT a, b, ka.n AS targets_a, kb.n AS targets_b, CAST(shared AS INTEGER) AS shared, shared / CAST(least(len(ka.e), len(kb.e)) AS DOUBLE) AS share FROM p JOIN k ka ON ka.name = a JOIN k kb ON kb.name = b WHERE shared * 2 >= least(len(ka.e), len(kb.e))
UNION ALL SELECT name, name, n, n, CAST(len(e) AS INTEGER), 1.0 FROM k WHERE n > 1""")
def ln_dup_expressions(spark, d):
    """Orders as targets of their lines' flags and states; their quantities modulo 7 stand for expressions."""
    lines = S.table(spark, d, "lineitem").withColumn("o", name("o", "l_orderkey"))
    made = lines.select(F.col("o").alias("dst"), F.concat(F.lit("qty"), (F.col("l_quantity").cast("long") % 7).cast("string")).alias("expression"))
    return G.equal_expressions(lines.select(F.concat("l_returnflag", "l_linestatus").alias("src"), F.col("o").alias("dst")), made)


_PARTS_OF = "e AS (SELECT DISTINCT 'o' || l_orderkey AS dst, 'p' || l_partkey AS src FROM lineitem)"


@query("ln_overlaps", f"WITH {_PARTS_OF}, s AS (SELECT dst, count(*) AS n FROM e GROUP BY 1), p AS (SELECT a.dst AS a, b.dst AS b, count(*) AS shared FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2), q AS (SELECT p.a, p.b, shared, x.n AS na, y.n AS nb FROM p JOIN s x ON x.dst = p.a JOIN s y ON y.dst = p.b) SELECT * FROM (SELECT a, b, CAST(shared AS INTEGER) AS shared, shared / CAST(na + nb - shared AS DOUBLE) AS jaccard, CASE WHEN shared = na AND shared = nb THEN 'equal' WHEN shared = na THEN 'subset' WHEN shared = nb THEN 'superset' WHEN shared >= 0.6 * (na + nb - shared) THEN 'overlap' END AS kind FROM q) WHERE kind IS NOT NULL")
def ln_overlaps(spark, d):
    """Orders as targets of their parts."""
    return G.overlapping_pipelines(S.table(spark, d, "lineitem").select(name("p", "l_partkey").alias("src"), name("o", "l_orderkey").alias("dst")))


@query("ln_fan_in", f"WITH {EDGES} SELECT src, count(DISTINCT dst) AS targets, count(DISTINCT dst) / CAST((SELECT count(*) FROM edges) AS DOUBLE) AS share FROM edges GROUP BY 1 HAVING count(DISTINCT dst) >= 3")
def ln_fan_in(spark, d):
    return G.fan_in_share(edges(spark, d))


@query("ln_offboard", f"WITH RECURSIVE {EDGES}, {DOWN.format(root='s2', depth=10)} SELECT CAST(hop AS INTEGER) AS hop, count(*) AS consumers FROM (SELECT node, min(hop) AS hop FROM t WHERE hop > 0 GROUP BY 1) GROUP BY 1")
def ln_offboard(spark, d):
    return G.trace(edges(spark, d), roots(spark, "s2")).groupBy("hop").agg(F.count(F.lit(1)).alias("consumers"))


DUR = f"dur AS (SELECT node, CAST({NUM.format('node')} * 7 % 11 + 1 AS DOUBLE) AS duration FROM nodes WHERE {REAL})"
_LEVELS = "lv(node, level) AS (SELECT node, 0 FROM hit UNION SELECT dst, level + 1 FROM lv JOIN inn ON src = node), lm AS (SELECT node, max(level) AS level FROM lv GROUP BY 1)"


@query("ln_rollback", f"WITH RECURSIVE {EDGES}, {NODES}, {DUR}, {DOWN.format(root='s3', depth=40)}, hit AS (SELECT DISTINCT node FROM t), inn AS (SELECT * FROM edges WHERE src IN (SELECT node FROM hit) AND dst IN (SELECT node FROM hit)), {_LEVELS} SELECT CAST(level AS INTEGER) AS level, count(*) AS tasks, max(duration) AS slowest FROM lm JOIN dur USING (node) GROUP BY 1")
def ln_rollback(spark, d):
    return G.rollback_levels(edges(spark, d), nodes(spark, d), "s3", real(spark, d).select("node", (number() * 7 % 11 + 1).cast("double").alias("duration")))


@query("ln_dictionary", f"WITH {EDGES}, {NODES}, {_RANKS}, {_HEALTH} SELECT node, ins, outs, layer FROM h JOIN ranks USING (node)")
def ln_dictionary(spark, d):
    return G.dictionary(edges(spark, d), ranks(spark, d))


@query("ln_from_meta", "WITH m AS (SELECT strftime(ts, '%Y%m%d') AS pt, 'u' || user_id % 9 AS target, event_type AS s FROM events) SELECT DISTINCT x AS src, target AS dst FROM (SELECT target, unnest([s, 'base']) AS x FROM m WHERE pt = (SELECT max(pt) FROM m))")
def ln_from_meta(spark, d):
    m = S.table(spark, d, "events").select(F.date_format("ts", "yyyyMMdd").alias("pt"), F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")).alias("target"), F.concat(F.lit('["'), "event_type", F.lit('", "base"]')).alias("sources"))
    return G.from_meta(m, "pt")


@query("gov_usage", f"WITH {EDGES}, {NODES}, {_HEALTH}, q AS (SELECT 'c' || user_id AS node, count(*) AS queries FROM events GROUP BY 1) SELECT node, coalesce(queries, 0) AS queries, CASE WHEN coalesce(queries, 0) = 0 AND state IN ('leaf', 'isolated') THEN 'decommission' WHEN coalesce(queries, 0) > 0 THEN 'used' ELSE 'inner' END AS state FROM h LEFT JOIN q USING (node)")
def gov_usage(spark, d):
    log = S.table(spark, d, "events").select(F.concat(F.lit("DB.C"), F.col("user_id").cast("string")).alias("table_name"))
    return G.usage(edges(spark, d), nodes(spark, d), log)


_TASK_LEVELS = "lv(node, level) AS (SELECT node, 0 FROM tasks UNION SELECT dst, level + 1 FROM lv JOIN deps ON src = node), lm AS (SELECT node, max(level) AS level FROM lv GROUP BY 1)"


@query("dag_levels", f"WITH RECURSIVE {TASKS}, {_TASK_LEVELS} SELECT node, CAST(level AS INTEGER) AS level FROM lm")
def dag_levels(spark, d):
    return G.levels(deps(spark, d), tasks(spark, d))


@query("dag_critical", f"WITH RECURSIVE {TASKS}, lp(node, finish, path) AS (SELECT node, duration, node FROM tasks UNION ALL SELECT e.dst, max(finish + d.duration), arg_min(path || '>' || e.dst, (-(finish + d.duration), path || '>' || e.dst)) FROM lp JOIN deps e ON e.src = lp.node JOIN tasks d ON d.node = e.dst GROUP BY e.dst) SELECT node, finish, path FROM lp ORDER BY finish DESC, path LIMIT 1")
def dag_critical(spark, d):
    return G.critical_path(deps(spark, d), tasks(spark, d))


@query("dag_redundant", f"WITH RECURSIVE {TASKS}, r(src, dst, n) AS (SELECT src, dst, 1 FROM deps UNION SELECT r.src, e.dst, 2 FROM r JOIN deps e ON r.dst = e.src) SELECT DISTINCT e.src, e.dst FROM deps e JOIN r ON e.src = r.src AND e.dst = r.dst AND r.n = 2")
def dag_redundant(spark, d):
    return G.redundant(deps(spark, d))


@query("dag_chains", f"WITH {TASKS}, e AS (SELECT 't' || a.o_orderkey AS src, 't' || b.o_orderkey AS dst, a.o_custkey AS c, a.k AS k FROM seq a JOIN seq b ON a.o_custkey = b.o_custkey AND b.k = a.k + 1 WHERE b.o_orderkey % 4 <> 0), g AS (SELECT *, k - row_number() OVER (PARTITION BY c ORDER BY k) AS run FROM e) SELECT arg_min(src, k) AS head, count(*) + 1 AS nodes FROM g GROUP BY c, run HAVING count(*) >= 2")
def dag_chains(spark, d):
    """Each customer's orders one after another, where an order of a key divisible by four begins anew."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    e = S.table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(before).alias("p")).filter("p is not null and o_orderkey % 4 <> 0")
    return G.chains(e.select(name("t", "p").alias("src"), name("t", "o_orderkey").alias("dst")))


@query("dag_rerun", f"WITH RECURSIVE {TASKS}, s AS (SELECT node, CASE WHEN {NUM.format('node')} % 97 = 5 THEN 'failed' WHEN {NUM.format('node')} % 2 = 0 THEN 'success' ELSE 'waiting' END AS state FROM tasks), t(root, node) AS (SELECT node, node FROM s WHERE state = 'failed' UNION SELECT root, dst FROM t JOIN deps ON src = node), o AS (SELECT node, count(DISTINCT root) AS origins FROM t WHERE node <> root GROUP BY 1) SELECT * FROM (SELECT node, CASE WHEN state = 'failed' THEN 'failed' WHEN origins IS NOT NULL AND state = 'success' THEN 'stale' WHEN origins IS NOT NULL THEN 'downstream' END AS reason, coalesce(origins, 0) AS origins FROM s LEFT JOIN o USING (node)) WHERE reason IS NOT NULL")
def dag_rerun(spark, d):
    states = tasks(spark, d).select("node", F.when(number() % 97 == 5, "failed").when(number() % 2 == 0, "success").otherwise("waiting").alias("state"))
    return G.rerun_plan(deps(spark, d), states)


@query("dag_slack", f"WITH RECURSIVE {TASKS}, goal AS (SELECT 't' || max(o_orderkey) AS node FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)), f(node, start) AS (SELECT node, CAST(0 AS DOUBLE) FROM tasks UNION SELECT e.dst, start + d.duration FROM f JOIN tasks d ON d.node = f.node JOIN deps e ON e.src = f.node), s AS (SELECT node, max(start) AS start FROM f GROUP BY 1), b(node, latest) AS (SELECT node, CAST(400 AS DOUBLE) FROM goal UNION SELECT e.src, latest - d.duration FROM b JOIN tasks d ON d.node = b.node JOIN deps e ON e.dst = b.node), l AS (SELECT node, min(latest) AS latest FROM b GROUP BY 1) SELECT node, start, start + duration AS finish, latest - start - duration AS slack FROM s JOIN tasks USING (node) LEFT JOIN l USING (node)")
def dag_slack(spark, d):
    """The goal is the last order of the first customer."""
    o = S.table(spark, d, "orders")
    goal = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).orderBy("o_custkey").first().k
    return G.schedule(deps(spark, d), tasks(spark, d), f"t{goal}", 400.0)


_RUNS = "runs AS (SELECT o_orderpriority AS dag, 'w' || o_custkey AS target, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS start, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 1 + o_orderkey % 2 AS finish FROM orders)"


def runs(spark, d):
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("dag"), name("w", "o_custkey").alias("target"), day.alias("start"), (day + 1 + F.col("o_orderkey") % 2).alias("finish"))


@query("dag_overlap", f"WITH {_RUNS} SELECT a.target, a.dag AS dag_a, b.dag AS dag_b, greatest(a.start, b.start) AS start, least(a.finish, b.finish) AS finish FROM runs a JOIN runs b ON a.target = b.target AND a.dag < b.dag AND a.start < b.finish AND b.start < a.finish")
def dag_overlap(spark, d):
    return G.write_overlaps(runs(spark, d))


@query("dag_peak", f"WITH {_RUNS}, e AS (SELECT dag, start AS t, 1 AS k, 1 AS d FROM runs UNION ALL SELECT dag, finish, 0, -1 FROM runs), s AS (SELECT dag, t, k, sum(d) AS d FROM e GROUP BY 1, 2, 3), r AS (SELECT dag, sum(d) OVER (PARTITION BY dag ORDER BY t, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s) SELECT dag, CAST(max(run) AS BIGINT) AS peak FROM r GROUP BY 1")
def dag_peak(spark, d):
    return G.peak_parallel(runs(spark, d), ["dag"])
