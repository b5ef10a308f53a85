"""Traversal and cycles over an edge table made from events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph
from ..session import table
from .catalog import query

EDGES = "e AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'error' AND value > 200) WHERE dst IS NOT NULL AND src <> dst)"


def edges(spark, d):
    """Users whose large errors follow each other."""
    e = table(spark, d, "events").where("event_type = 'error' and value > 200").withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    # The last of a day is followed by the first of the next day that has any.
    firsts = e.groupBy("day").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("f")).withColumn("next", F.lead("f.user_id").over(Window.orderBy("day")))
    followed = e.withColumn("to", F.lead("user_id").over(w)).join(firsts.select("day", "next"), "day")
    return followed.select(F.col("user_id").alias("src"), F.coalesce("to", "next").alias("dst")).where("dst is not null and src != dst").distinct()


def seed(spark, d):
    return edges(spark, d).agg(F.min("src").alias("node"))


@query(f"WITH RECURSIVE {EDGES}, r(node, depth) AS (SELECT min(src), 0 FROM e UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3) SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY 1")
def impact_bfs(spark, d):
    found = graph.bfs(edges(spark, d), seed(spark, d), 3)
    return found.withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH RECURSIVE {EDGES}, r(node, depth) AS (SELECT min(src), 0 FROM e UNION SELECT src, depth + 1 FROM r JOIN e ON dst = node WHERE depth < 2) SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY 1")
def reverse_reach(spark, d):
    found = graph.bfs(edges(spark, d), seed(spark, d), 2, "dst", "src")
    return found.withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH RECURSIVE {EDGES}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON src = b), c AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a), m AS (SELECT a, min(least(CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS component FROM c GROUP BY 1) SELECT component, count(*) AS size FROM m GROUP BY 1 HAVING count(*) > 1")
def import_cycles_scc(spark, d):
    return graph.cycles(edges(spark, d)).select("component", "size")


@query("WITH RECURSIVE e AS (SELECT concat('nation:', n_name) AS child, concat('region:', r_name) AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, concat('nation:', n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT c_name, concat('nation:', n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey), r(node, depth) AS (SELECT 'region:ASIA', 0 UNION ALL SELECT child, depth + 1 FROM r JOIN e ON parent = node) SELECT node, depth::BIGINT AS depth FROM r WHERE depth > 0")
def hierarchy_tree(spark, d):
    r, n, s, c = (table(spark, d, x) for x in ("region", "nation", "supplier", "customer"))
    nation = F.concat(F.lit("nation:"), "n_name")
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(nation.alias("child"), F.concat(F.lit("region:"), "r_name").alias("parent"))
    e = e.union(s.join(n, s.s_nationkey == n.n_nationkey).select("s_name", nation)).union(c.join(n, c.c_nationkey == n.n_nationkey).select("c_name", nation))
    return graph.hierarchy(e, "region:ASIA").withColumn("depth", F.col("depth").cast("long"))


@query("WITH refs AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_custkey % 3 = 0 AS loose FROM orders), s AS (SELECT concat('x::', c_name) AS qualname, c_custkey FROM customer) SELECT qualname, o_orderpriority AS kind, count(*) AS n FROM refs JOIN s ON c_custkey = o_custkey GROUP BY 1, 2")
def who_uses(spark, d):
    """Orders as references to customers, some by key and some by name only."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    symbols = c.select(F.concat(F.lit("x::"), "c_name").alias("qualname"))
    named = o.join(c, o.o_custkey == c.c_custkey)
    loose = F.col("o_custkey") % 3 == 0
    refs = named.select(F.col("o_orderkey").cast("string").alias("from_file"), F.lit(1).alias("from_line"), F.col("c_name").alias("to_name"), F.when(~loose, F.concat(F.lit("x::"), "c_name")).alias("to_symbol"), F.col("o_orderpriority").alias("kind"), F.when(loose, "heuristic").otherwise("resolved").alias("confidence"))
    return graph.inbound(refs, symbols).groupBy("qualname", "kind").agg(F.count("*").alias("n"))
