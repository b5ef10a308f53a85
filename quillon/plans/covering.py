"""Queries for operators that the other catalogs leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import blocks, budget, diff, index, tokens
from ..session import table
from .catalog import query
from .searching import HEADS, PATHS, doc_lines, heads, paths


@query(f"WITH p AS (SELECT string_split(concat('./', {PATHS}), '/') AS p FROM documents), b AS (SELECT array_to_string(p[1:k - 1], '/') AS parent, p[k] AS name FROM (SELECT p, unnest(range(2, least(len(p), 4) + 1)) AS k FROM p)), h AS (SELECT parent, name, count(*) AS n_files FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY n_files DESC, name) AS r FROM h) SELECT parent, name, n_files, 0::BIGINT AS n_more FROM r WHERE r <= 2 UNION ALL SELECT parent, NULL, sum(n_files)::BIGINT, count(*) FROM r WHERE r > 2 GROUP BY 1")
def directory_tree(spark, d):
    """Two entries of each folder, three levels deep, and a row for what is folded away."""
    return tokens.tree(paths(spark, d), "path", 3, 2)


@query("SELECT o_orderstatus AS section, count(*) AS files, sum(plus)::BIGINT AS plus, sum(minus)::BIGINT AS minus FROM (SELECT o_orderstatus, o_orderkey % 7 AS plus, o_custkey % 5 AS minus FROM orders) GROUP BY 1")
def section_sums(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("section"), (F.col("o_orderkey") % 7).alias("plus"), (F.col("o_custkey") % 5).alias("minus"))
    return o.groupBy("section").agg(F.count("*").alias("files"), F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))


@query("SELECT doc_id, len([x for x in l if starts_with(x, 'T')])::BIGINT AS plus, len([x for x in l if starts_with(x, 'A')])::BIGINT AS minus FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def array_condition_counts(spark, d):
    """Lines by how they begin, counted in the row."""
    rows = F.split("text", "\n")
    n = lambda c: F.size(F.filter(rows, lambda x: x.startswith(c))).cast("long")
    return table(spark, d, "documents").select("doc_id", n("T").alias("plus"), n("A").alias("minus"))


@query("WITH a AS (SELECT p_partkey, p_name AS name FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey, p_name AS name FROM part WHERE p_partkey % 5 <> 0) SELECT op, count_if(regexp_matches(name, '^test|^Test')) AS tests, count_if(NOT regexp_matches(name, '^test|^Test')) AS helpers FROM (SELECT CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'same' END AS op, coalesce(a.name, b.name) AS name FROM a FULL JOIN b ON a.p_partkey = b.p_partkey) GROUP BY 1")
def test_summary_counts(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    states = diff.delta(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 5 <> 0"), ["p_partkey", "name"], "name").withColumnRenamed("state", "op")
    return diff.test_summary(states)


@query(f"WITH {HEADS} SELECT h.doc_id, h.line_no::BIGINT AS line_no, max(x.line_no)::BIGINT AS sibling FROM heads h LEFT JOIN heads x ON x.doc_id = h.doc_id AND x.line_no < h.line_no AND x.level <= h.level GROUP BY 1, 2")
def earlier_sibling(spark, d):
    held = blocks.earlier_sibling(heads(spark, d), "doc_id", 3)
    return held.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("sibling").cast("long").alias("sibling"))


@query("SELECT doc_id, source, row_number() OVER (ORDER BY CASE WHEN source = 'src3' THEN 0 ELSE 1 END, n_chars DESC, doc_id)::BIGINT AS position FROM documents QUALIFY position <= 60")
def focus_first(spark, d):
    """One source ahead of all others, each by size."""
    order = [F.when(F.col("source") == "src3", 0).otherwise(1), F.desc("n_chars"), F.col("doc_id")]
    top, _ = tokens.top_and_rest(table(spark, d, "documents"), order, 60, "n_chars")
    return top.select("doc_id", "source", F.col("rank").alias("position"))


@query("SELECT (SELECT count(*) FROM events) AS total, count(*) AS listed, max(event_id) AS newest FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def listing_cap(spark, d):
    """The last thousand, and the exact total beside them."""
    e = table(spark, d, "events")
    listed = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).agg(F.count("*").alias("listed"), F.max("event_id").alias("newest"))
    return e.agg(F.count("*").alias("total")).crossJoin(listed)


@query("SELECT s_suppkey, coalesce(n, 0)::BIGINT AS n, coalesce(q, 0)::BIGINT AS q FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_linenumber) AS q FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_suppkey = s_suppkey")
def stats_lookup(spark, d):
    """Rows with the figures of another table, nothing where there are none."""
    per = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("q"))
    return table(spark, d, "supplier").select("s_suppkey").join(per, "s_suppkey", "left").na.fill(0, ["n", "q"])


@query("WITH n AS (SELECT DISTINCT doc_id % 50 AS id, lang AS family, concat('x.', source) AS name FROM documents WHERE doc_id % 3 = 0), s AS (SELECT DISTINCT lang AS family, concat('m::', source) AS qualname FROM documents WHERE doc_id % 5 = 0) SELECT id, name, s.qualname FROM n JOIN s ON n.family = s.family AND regexp_extract(name, '[^.]+$') = substr(qualname, 4)")
def family_scoped_names(spark, d):
    docs = table(spark, d, "documents")
    names = docs.where("doc_id % 3 = 0").select((F.col("doc_id") % 50).alias("id"), F.col("lang").alias("family"), F.concat(F.lit("x."), "source").alias("name")).distinct()
    symbols = docs.where("doc_id % 5 = 0").select(F.col("lang").alias("family"), F.concat(F.lit("m::"), "source").alias("qualname")).distinct()
    return index.family_join(names, "name", symbols).select("id", "name", "qualname")


@query("WITH o AS (SELECT doc_id, lang, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 = 2 THEN 'x' ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 <> 3) SELECT count_if(o.h IS NOT NULL AND n.h IS NOT NULL AND o.h <> n.h) AS stale, count_if(o.h IS NULL) AS new, count_if(n.h IS NULL) AS missing FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def freshness_counts(spark, d):
    docs = table(spark, d, "documents").withColumn("h", F.md5("text"))
    k = F.col("doc_id") % 10
    old = docs.where(k != 0).select("doc_id", F.lit(0).alias("stamp"), "h")
    new = docs.where(k != 3).select("doc_id", F.lit(1).alias("stamp"), F.when(k == 2, "x").otherwise(F.col("h")).alias("h"))
    return index.freshness(index.change_set(old, new, "doc_id", "stamp", "h"))


@query("SELECT CASE WHEN regexp_matches(path, '/(tests)/|/test_[^/]*$') THEN 'tests' ELSE 'src' END AS class, count(*) AS n FROM (SELECT " + PATHS + " AS path FROM documents) GROUP BY 1")
def outline_classes(spark, d):
    return paths(spark, d).where(F.lit(True)).groupBy(F.when(F.col("path").rlike("/tests/|/test_[^/]*$"), "tests").otherwise(F.regexp_replace(t.outline_class("path"), "^tests$", "tests")).alias("class")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT source, sum(strlen(text) + 1) AS cost FROM documents GROUP BY 1), s AS (SELECT sum(cost) AS cost FROM l) SELECT source, length(source)::BIGINT AS cost FROM l")
def render_ladder(spark, d):
    """Full texts don't fit, first lines don't either; the sources' names do."""
    docs = table(spark, d, "documents")
    full = docs.select("source", (t.octets("text") + 1).alias("cost"))
    first = docs.select("source", (F.octet_length(F.substring_index("text", "\n", 1)) + 1).alias("cost"))
    names = docs.select("source").distinct().select("source", F.length("source").cast("long").alias("cost"))
    return budget.ladder([full, first, names], "cost", 100)


@query("WITH l AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY 1) SELECT n::BIGINT AS n_lines, count(*) AS n_docs FROM l GROUP BY 1")
def line_histogram(spark, d):
    return doc_lines(spark, d).where("line != ''").groupBy("doc_id").agg(F.count("*").alias("n_lines")).groupBy("n_lines").agg(F.count("*").alias("n_docs"))
