"""Joins, set operations, comparison of versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import diff, index, intervals
from ..session import table
from .catalog import query


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def files_symbols_join(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))


@query(
    """WITH names AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN (SELECT c_name FROM customer WHERE c_custkey = o_custkey) WHEN o_orderkey % 4 = 1 THEN concat('part ', o_custkey) WHEN o_orderkey % 4 = 2 THEN (SELECT s_name FROM supplier WHERE s_suppkey = o_orderkey % 100) ELSE 'nobody' END AS name FROM orders),
c AS (SELECT c_name AS name, concat('customer:', c_custkey) AS target FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT s_name AS name, concat('supplier:', s_suppkey) AS target FROM supplier), p AS (SELECT concat('part ', p_partkey) AS name, concat('part:', p_partkey) AS target FROM part)
SELECT o_orderkey, coalesce(c.target, CASE WHEN names.name LIKE 'Customer%' THEN NULL ELSE coalesce(s.target, p.target) END) AS target, CASE WHEN c.target IS NOT NULL THEN 'customer' WHEN names.name LIKE 'Customer%' THEN NULL WHEN s.target IS NOT NULL THEN 'supplier' WHEN p.target IS NOT NULL THEN 'part' END AS stage FROM names LEFT JOIN c USING (name) LEFT JOIN s USING (name) LEFT JOIN p USING (name)"""
)
def cascade_resolve(spark, d):
    """Names resolved among customers, suppliers and parts; a customer's name that fails stops the search."""
    o, c, s, p = (table(spark, d, x) for x in ("orders", "customer", "supplier", "part"))
    k = F.col("o_orderkey") % 4
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(s, o.o_orderkey % 100 == s.s_suppkey, "left")
    names = joined.select("o_orderkey", F.when(k == 0, F.col("c_name")).when(k == 1, F.concat(F.lit("part "), F.col("o_custkey").cast("string"))).when(k == 2, F.col("s_name")).otherwise("nobody").alias("name"))
    tag = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("target")
    stages = [
        ("customer", c.where("c_custkey % 2 = 0").select("c_name", tag("customer", "c_custkey")), F.col("name").startswith("Customer")),
        ("supplier", s.select("s_name", tag("supplier", "s_suppkey")), None),
        ("part", p.select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")), tag("part", "p_partkey")), None),
    ]
    return index.cascade(names, "name", stages).select("o_orderkey", "target", "stage")


@query("SELECT concat(p_type, p_brand, p_size) AS key, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1")
def unique_candidate(spark, d):
    return index.unique(table(spark, d, "part").select(F.concat("p_type", "p_brand", F.col("p_size").cast("string")).alias("key"), "p_partkey"), "key", "p_partkey")


@query("WITH n AS (SELECT DISTINCT regexp_extract(url, '[^/]*$') AS name FROM pages WHERE page_id % 10 = 0), p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages) SELECT name, page_id FROM n JOIN p ON path = name OR ends_with(path, concat('/', name))", part=True)
def suffix_join(spark, d):
    pages = table(spark, d, "pages")
    names = pages.where("page_id % 10 = 0").select(F.regexp_extract("url", "[^/]*$", 0).alias("name")).distinct()
    return index.suffix_join(names, "name", pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("path")), "path").select("name", "page_id")


@query("WITH n AS (SELECT DISTINCT regexp_extract(url, '[^/]*$') AS name FROM pages), p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages) SELECT name, page_id FROM n JOIN p ON path = name OR ends_with(path, concat('/', name))")
def suffix_join_all(spark, d):
    """suffix_join with the names of all pages."""
    pages = table(spark, d, "pages")
    names = pages.select(F.regexp_extract("url", "[^/]*$", 0).alias("name")).distinct()
    return index.suffix_join(names, "name", pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("path")), "path").select("name", "page_id")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey OR (s_nationkey = c_nationkey AND s_suppkey = c_custkey % 100 + 0 AND c_mktsegment = 'BUILDING')")
def or_join_union(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat_ws(":", "s_nationkey", "s_suppkey").alias("s_both"))
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.concat_ws(":", F.col("c_nationkey"), F.col("c_custkey") % 100)).alias("c_both"))
    return index.either_join(s, c, [("s_suppkey", "c_custkey"), ("s_both", "c_both")]).select("s_suppkey", "c_custkey")


@query("WITH c AS (SELECT o_orderkey, unnest([o_custkey * 7, o_custkey * 3, o_custkey]) AS p, unnest([0, 1, 2]) AS pos FROM orders WHERE o_orderkey < 2000) SELECT o_orderkey, arg_min(p, pos) AS p_partkey FROM c JOIN part ON p = p_partkey GROUP BY 1", part=True)
def first_candidate(spark, d):
    """The first of an ordered list of keys that exists."""
    o = table(spark, d, "orders").where("o_orderkey < 2000")
    k = F.col("o_custkey")
    return index.first_candidate(o, "o_orderkey", F.array(k * 7, k * 3, k), table(spark, d, "part"), "p_partkey")


@query("WITH c AS (SELECT o_orderkey, unnest([o_custkey * 7, o_custkey * 3, o_custkey]) AS p, unnest([0, 1, 2]) AS pos FROM orders) SELECT o_orderkey, arg_min(p, pos) AS p_partkey FROM c JOIN part ON p = p_partkey GROUP BY 1")
def first_candidate_all(spark, d):
    """first_candidate for all orders."""
    k = F.col("o_custkey")
    return index.first_candidate(table(spark, d, "orders"), "o_orderkey", F.array(k * 7, k * 3, k), table(spark, d, "part"), "p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size < 40 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_partkey % 10 = 0)")
def dead_code_anti(spark, d):
    """Rows that none of several key sets refers to."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    used = li.where("l_returnflag = 'R' and l_quantity > 45 or l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    brands = p.where("p_size = 50 and p_partkey % 10 = 0").select("p_brand").distinct()
    return p.where("p_size < 40").join(used, "p_partkey", "left_anti").join(brands, "p_brand", "left_anti").select("p_partkey")


@query("WITH c AS (SELECT l_partkey, count(*) AS n, max(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END) AS m FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1) SELECT p_partkey AS file, CASE WHEN n IS NULL THEN 'uncovered' WHEN m = 0 THEN 'stale' ELSE 'fresh' END AS state, coalesce(n, 0)::BIGINT AS n_tests FROM part LEFT JOIN c ON l_partkey = p_partkey")
def coverage_class(spark, d):
    """Parts as files, their line items as tests, of which some have changed."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem").where("l_partkey % 3 <> 0")
    tests = li.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", F.col("l_extendedprice").cast("string")).alias("test_file"), F.col("l_partkey").alias("target_file"), "l_returnflag", "l_quantity")
    changed = tests.where("l_returnflag = 'R' and l_quantity > 45").select("test_file")
    return index.coverage_class(p.select(F.col("p_partkey").alias("file")), tests, changed)


@query("WITH have AS (SELECT DISTINCT o_custkey, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey), want AS (SELECT DISTINCT p_brand FROM part WHERE p_size = 1 AND p_brand < 'Brand#2') SELECT o_custkey FROM have JOIN want USING (p_brand) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM want)")
def relational_division(spark, d):
    """Customers who bought every brand of a set."""
    o, li, p = (table(spark, d, x) for x in ("orders", "lineitem", "part"))
    have = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey).select("o_custkey", "p_brand")
    want = p.where("p_size = 1 and p_brand < 'Brand#2'").select("p_brand", F.lit(1).alias("set"))
    return index.division(have, want, "o_custkey", "p_brand", "set").select("o_custkey")


@query("WITH j AS (SELECT c_custkey, s_suppkey, (c_nationkey = s_nationkey)::INT AS same FROM customer JOIN supplier ON c_custkey % 5 = s_suppkey % 5 WHERE c_custkey < 200) SELECT c_custkey, s_suppkey FROM (SELECT *, max(same) OVER (PARTITION BY c_custkey) AS best FROM j) WHERE same = best", part=True)
def same_group_preference(spark, d):
    """Candidates of the same nation replace all others."""
    c, s = table(spark, d, "customer").where("c_custkey < 200"), table(spark, d, "supplier")
    joined = c.join(s, c.c_custkey % 5 == s.s_suppkey % 5)
    return index.prefer_same(joined, ["c_custkey"], F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "s_suppkey")


@query("WITH j AS (SELECT c_custkey, s_suppkey, (c_nationkey = s_nationkey)::INT AS same FROM customer JOIN supplier ON c_custkey % 5 = s_suppkey % 5) SELECT c_custkey, s_suppkey FROM (SELECT *, max(same) OVER (PARTITION BY c_custkey) AS best FROM j) WHERE same = best")
def same_group_preference_all(spark, d):
    """same_group_preference for all customers; candidates of other nations are joined only where there is no other."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("k"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).alias("k"), F.col("s_nationkey").alias("nation"))
    return index.prefer_same_join(c, s, "c_custkey", ["k"], "nation").select("c_custkey", "s_suppkey")


@query("WITH u AS (SELECT user_id, event_type, 0 AS rank, 'big' AS layer FROM events WHERE value > 300 UNION ALL SELECT user_id, event_type, 1, 'even' FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, 2, 'any' FROM events) SELECT user_id, event_type, min(rank)::BIGINT AS rank, arg_min(layer, rank) AS layer FROM u GROUP BY 1, 2")
def precedence_union(spark, d):
    e = table(spark, d, "events")
    layers = [("big", e.where("value > 300")), ("even", e.where("event_id % 2 = 0")), ("any", e)]
    return index.layered_union(layers, ["user_id", "event_type"]).withColumn("rank", F.col("rank").cast("long"))


def halves(spark, d, columns):
    e = table(spark, d, "events")
    cut = "ts < timestamp '2024-01-15 00:00:00'"
    return e.where(cut).select(*columns), e.where(f"not ({cut})").select(*columns)


A, B = ("SELECT user_id, event_type FROM events WHERE value > 100 AND ts < TIMESTAMP '2024-01-15 00:00:00'", "SELECT user_id, event_type FROM events WHERE value > 100 AND ts >= TIMESTAMP '2024-01-15 00:00:00'")


def half_pairs(spark, d):
    a, b = halves(spark, d, ["user_id", "event_type", "value"])
    return a.where("value > 100").drop("value"), b.where("value > 100").drop("value")


@query(f"{A} UNION {B}")
def union_distinct(spark, d):
    a, b = half_pairs(spark, d)
    return a.union(b).distinct()


@query(f"{A} EXCEPT {B}")
def difference(spark, d):
    a, b = half_pairs(spark, d)
    return a.subtract(b)


@query(f"{A} INTERSECT {B}")
def intersection(spark, d):
    a, b = half_pairs(spark, d)
    return a.intersect(b)


@query("WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE value > 200 AND ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE value > 200 AND ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id")
def full_outer_delta(spark, d):
    a, b = (x.where("value > 200").groupBy("user_id").agg(F.count("*").alias("n")) for x in halves(spark, d, ["user_id", "value"]))
    return diff.delta(a, b, ["user_id"], "n")


@query("WITH o AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 1) SELECT o.lang, o.doc_id AS old_key, n.doc_id AS new_key FROM o JOIN n ON o.lang = n.lang AND o.text = n.text AND o.k = n.k")
def symbol_rename_match(spark, d):
    """Removed and added texts that are equal, the k-th with the k-th."""
    docs = table(spark, d, "documents")
    return diff.renames(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "lang", "text")


@query(
    """WITH o AS (SELECT doc_id, n_chars AS s, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 10 IN (1, 2) THEN 1 ELSE 0 END AS s, CASE WHEN doc_id % 10 = 2 THEN md5(text) ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 3)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.s = n.s THEN 'unchanged' WHEN o.h = n.h THEN 'touched' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id"""
)
def incremental_change_set(spark, d):
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 10
    old = docs.where(k != 0).select("doc_id", F.col("n_chars").alias("stamp"), F.sha2("text", 256).alias("digest"))
    new = docs.where(k != 3).select("doc_id", (F.col("n_chars") + F.when(k.isin(1, 2), 1).otherwise(0)).alias("stamp"), F.when(k == 2, F.md5("text")).otherwise(F.sha2("text", 256)).alias("digest"))
    return index.change_set(old, new, "doc_id", "stamp", "digest")


@query("WITH s AS (SELECT user_id, list_sort(list_distinct(list(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN event_type END))) AS a, list_sort(list_distinct(list(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN event_type END))) AS b FROM events WHERE value > 150 GROUP BY 1) SELECT user_id, coalesce(array_to_string([x for x in a if NOT list_contains(b, x)], ','), '') AS gone, coalesce(array_to_string([x for x in b if NOT list_contains(a, x)], ','), '') AS come FROM s")
def array_delta(spark, d):
    e = table(spark, d, "events").where("value > 150")
    first = F.col("ts") < F.expr("timestamp '2024-01-15 00:00:00'")
    s = e.groupBy("user_id").agg(F.collect_set(F.when(first, F.col("event_type"))).alias("a"), F.collect_set(F.when(~first, F.col("event_type"))).alias("b"))
    gone, come = diff.array_delta(F.col("a"), F.col("b"))
    return s.select("user_id", F.array_join(gone, ",").alias("gone"), F.array_join(come, ",").alias("come"))


@query("SELECT CASE lang WHEN 'en' THEN 'germanic' WHEN 'de' THEN 'germanic' ELSE 'romance' END AS family, count(*) AS n FROM documents GROUP BY 1")
def lang_family_group(spark, d):
    family = t.lookup(F.col("lang"), {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"})
    return table(spark, d, "documents").groupBy(family.alias("family")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------- intervals

SPANS = "SELECT o_custkey AS k, o_orderkey AS id, (epoch(o_orderdate) // 86400)::BIGINT AS day FROM orders"


def order_days(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("day"))


def spans(spark, d):
    """For each customer a long span from the first order, and a short one from each order of an even id."""
    o = order_days(spark, d)
    long = o.groupBy("k").agg(F.min("day").alias("s")).select("k", "s", (F.col("s") + 700).alias("e"), F.lit("long").alias("name"))
    short = o.where("id % 2 = 0").select("k", F.col("day").alias("s"), (F.col("day") + 30).alias("e"), F.concat(F.lit("short"), F.col("id").cast("string")).alias("name"))
    return long.union(short)


SPAN_SQL = f"o AS ({SPANS}), spans AS (SELECT k, min(day) AS s, min(day) + 700 AS e, 'long' AS name FROM o GROUP BY 1 UNION ALL SELECT k, day, day + 30, concat('short', id) FROM o WHERE id % 2 = 0)"


@query(f"WITH {SPAN_SQL}, j AS (SELECT o.k, o.id, spans.name, row_number() OVER (PARTITION BY o.id ORDER BY s DESC, e - s, name) AS r FROM o JOIN spans ON o.k = spans.k AND day BETWEEN s AND e WHERE o.id % 3 = 0) SELECT k, id, name FROM j WHERE r = 1", part=True)
def innermost_interval(spark, d):
    """The innermost span around each order: equi-join on customer and bucket, then one window."""
    points = order_days(spark, d).where("id % 3 = 0")
    held = intervals.point_join(points, "day", spans(spark, d), "s", "e", ["k"], 400)
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy(F.desc("s"), F.col("e") - F.col("s"), "name")
    return held.withColumn("r", F.row_number().over(order)).where("r = 1").select("k", "id", "name")


@query(f"WITH {SPAN_SQL}, j AS (SELECT o.k, o.id, spans.name, row_number() OVER (PARTITION BY o.id ORDER BY s DESC, e - s, name) AS r FROM o JOIN spans ON o.k = spans.k AND day BETWEEN s AND e) SELECT k, id, name FROM j WHERE r = 1")
def innermost_interval_all(spark, d):
    """innermost_interval for all orders; the least of (latest start, shortest, name) is an aggregate, so no window sorts."""
    held = intervals.point_join(order_days(spark, d), "day", spans(spark, d), "s", "e", ["k"], 400)
    best = F.min_by(F.struct("k", "name"), F.struct(-F.col("s"), F.col("e") - F.col("s"), "name"))
    return held.groupBy("id").agg(best.alias("b")).select("b.k", "id", "b.name")


@query(f"WITH {SPAN_SQL} SELECT o.id, min(e - s)::BIGINT AS size FROM o JOIN spans ON o.k = spans.k AND day BETWEEN s AND e GROUP BY 1")
def smallest_interval(spark, d):
    best = intervals.innermost(order_days(spark, d), ["id"], "day", spans(spark, d), "s", "e", ["k"], 400, smallest=True)
    return best.select("id", (F.col("e") - F.col("s")).alias("size"))


@query(f"WITH {SPAN_SQL}, h AS (SELECT k, id, day AS a, day + 10 AS b FROM o WHERE id % 2 = 1) SELECT id FROM h WHERE EXISTS (SELECT 1 FROM spans WHERE spans.k = h.k AND name <> 'long' AND a <= e AND b >= s)")
def overlap_semi(spark, d):
    h = order_days(spark, d).where("id % 2 = 1").select("k", "id", F.col("day").alias("a"), (F.col("day") + 10).alias("b"))
    return intervals.overlapping(h, spans(spark, d).where("name <> 'long'"), "a", "b", "s", "e", ["k"], 400).select("id")


@query(f"WITH {SPAN_SQL}, h AS (SELECT k, id, day AS a, day + 10 AS b FROM o WHERE id % 2 = 1) SELECT id FROM h WHERE NOT EXISTS (SELECT 1 FROM spans WHERE spans.k = h.k AND name <> 'long' AND a <= e AND b >= s)")
def outside_all_intervals(spark, d):
    h = order_days(spark, d).where("id % 2 = 1").select("k", "id", F.col("day").alias("a"), (F.col("day") + 10).alias("b"))
    return intervals.overlapping(h, spans(spark, d).where("name <> 'long'"), "a", "b", "s", "e", ["k"], 400, anti=True).select("id")


@query(f"WITH {SPAN_SQL} SELECT spans.k, name, count(*) AS n FROM o JOIN spans ON o.k = spans.k AND day BETWEEN s AND e WHERE name = 'long' GROUP BY 1, 2")
def point_in_interval_count(spark, d):
    return intervals.point_join(order_days(spark, d), "day", spans(spark, d).where("name = 'long'"), "s", "e", ["k"], 400).groupBy("k", "name").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT p_partkey, p_name AS path, p_size > 45 AS public, p_size AS plus, p_partkey % 7 AS minus, CASE p_partkey % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'stale' ELSE 'uncovered' END AS coverage FROM part), f AS (SELECT 'public' AS flag, path FROM c WHERE public UNION ALL SELECT 'large', path FROM c WHERE plus + minus > 50 UNION ALL SELECT coverage, path FROM c WHERE coverage <> 'fresh' UNION ALL SELECT 'sensitive:red', path FROM c WHERE contains(lower(path), 'red') UNION ALL SELECT 'sensitive:green', path FROM c WHERE contains(lower(path), 'green')) SELECT flag, min(path) AS path, count(*) AS n FROM f GROUP BY 1")
def risk_flags(spark, d):
    k = F.col("p_partkey") % 3
    c = table(spark, d, "part").select(F.col("p_name").alias("path"), (F.col("p_size") > 45).alias("public"), F.col("p_size").alias("plus"), (F.col("p_partkey") % 7).alias("minus"), F.when(k == 0, "fresh").when(k == 1, "stale").otherwise("uncovered").alias("coverage"))
    return diff.risk_flags(c, ["red", "green"], 50)


@query("SELECT count_if(p_size % 2 = 1) AS files, round_even(100.0 * sum(CASE WHEN p_size % 2 = 1 THEN p_size + 3 ELSE 0 END) / sum(p_size + 3), 0)::BIGINT AS pct FROM part")
def unanalysed_share(spark, d):
    files = table(spark, d, "part").select(F.col("p_size").alias("plus"), F.lit(3).alias("minus"))
    return diff.unanalysed_share(files, F.col("plus") % 2 == 0)
