"""Sources and sinks: rows of the tables written in a tool's form and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import extract, index, project, tokens
from ..session import checkpoint_folder, table
from ..sources import readers, sinks
from .catalog import query
from .logbooks import ITEMS, order_texts, sql_of
from .sourcetrees import PART_SYMBOLS, part_symbols, source_files


def scratch(spark) -> str:
    return f"{checkpoint_folder(spark)}/form-{uuid.uuid4().hex}"


# -------------------------------------------------------------- file formats


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def csv_scan(spark, d):
    """Customers written as CSV and read as cells."""
    path = scratch(spark)
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").write.option("header", "true").csv(path)
    return readers.read_csv(spark, path).select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")


@query("SELECT event_type, count_if(event_id % 7 <> 0) AS good, count_if(event_id % 7 = 0) AS bad FROM events GROUP BY 1")
def jsonl_scan(spark, d):
    """Events as JSON lines, every seventh torn: what parses and what doesn't."""
    value = F.concat(F.lit('{"t": "'), "event_type", F.lit('"'), F.when(F.col("event_id") % 7 != 0, "}").otherwise(""))
    lines = table(spark, d, "events").select("event_type", value.alias("value"))
    return readers.json_lines(lines).groupBy("event_type").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))


@query("SELECT lang, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_breaks FROM documents GROUP BY 1")
def text_scan(spark, d):
    """Documents as text files by language, read by line."""
    path = scratch(spark)
    docs = table(spark, d, "documents").select("lang", F.col("text").alias("value"))
    docs.write.partitionBy("lang").text(path)
    held = readers.read_text(spark, path).withColumn("lang", F.regexp_extract("path", r"lang=(\w+)", 1))
    return held.groupBy("lang").agg(F.count("*").alias("n_lines"), F.count("line_no").alias("n_breaks"))


@query("SELECT concat('f', CAST(p_partkey AS VARCHAR)) AS path, CASE p_partkey % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'toml' ELSE 'log' END AS format, CASE p_partkey % 3 WHEN 0 THEN concat('{\"k\":[', CAST(p_size AS VARCHAR), ']}') WHEN 1 THEN concat('{\"t\":{\"a\":', CAST(p_size AS VARCHAR), '}}') END AS doc FROM part")
def tree_formats(spark, d):
    """Documents with a tree by format; TOML that isn't falls back to a log."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit('{"k": ['), size, F.lit("]}"))).when(k == 1, F.concat(F.lit("[t]\na = "), size, F.lit("\n"))).otherwise(F.concat(F.lit("[x]\nnot = = "), size))
    files = table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), text.alias("text"), F.when(k == 0, "json").otherwise("toml").alias("format"))
    return readers.parse(files).select("path", "format", F.to_json("doc").alias("doc"))


@query("SELECT concat('c', CAST(p_partkey AS VARCHAR), '.toml') AS path, unnest(['top', 'a.b.size', 'a.list']) AS key, unnest([p_brand, CAST(p_size AS VARCHAR), concat('[1, ', CAST(p_size AS VARCHAR), ']')]) AS value FROM part")
def config_scan(spark, d):
    """Leaves of configuration files."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit('top = "'), "p_brand", F.lit('"\n[a]\nlist = [1, '), size, F.lit("]\n[a.b]\nsize = "), size, F.lit("\n"))
    files = table(spark, d, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string"), F.lit(".toml")).alias("path"), text.alias("text"), F.lit("toml").alias("format"))
    return readers.config_rows(files)


# ------------------------------------------------------------ tools' outputs


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'staged' WHEN 'F' THEN 'unstaged' ELSE 'untracked' END AS section, CASE o_orderstatus WHEN 'P' THEN '?' ELSE 'M' END AS code, concat('a b/', CAST(o_orderkey AS VARCHAR)) AS path FROM orders")
def status_scan(spark, d):
    """Entries of a status listing: orders as files."""
    path = F.concat(F.lit("a b/"), F.col("o_orderkey").cast("string"))
    s = F.col("o_orderstatus")
    value = F.when(s == "P", F.concat(F.lit("? "), path)).otherwise(F.concat(F.lit("1 "), F.when(s == "O", "M.").otherwise(".M"), F.lit(" N... 100644 100644 100644 h1 h2 "), path))
    return readers.status_rows(table(spark, d, "orders").select(value.alias("value")))


@query("SELECT concat('f', CAST(o_orderkey AS VARCHAR)) AS path, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey END::BIGINT AS plus, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 9 END::BIGINT AS minus, o_orderkey % 5 = 0 AS is_binary FROM orders")
def numstat_scan(spark, d):
    binary = F.col("o_orderkey") % 5 == 0
    number = lambda c: F.when(binary, "-").otherwise(c.cast("string"))
    value = F.concat_ws("\t", number(F.col("o_custkey")), number(F.col("o_orderkey") % 9), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")))
    found = readers.numstat_rows(table(spark, d, "orders").select(value.alias("value")))
    return found.select("path", F.col("plus").cast("long").alias("plus"), F.col("minus").cast("long").alias("minus"), "is_binary")


@query("SELECT o_orderkey AS position, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS sha, concat(o_orderpriority, ' (', o_orderstatus, ')') AS subject, concat('c', CAST(o_custkey AS VARCHAR)) AS author FROM orders")
def commit_scan(spark, d):
    """Commits out of log lines."""
    sha = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 7)
    value = F.concat(sha, F.lit(" "), "o_orderpriority", F.lit(" ("), "o_orderstatus", F.lit(") (c"), F.col("o_custkey").cast("string"), F.lit(")"))
    return readers.commit_rows(table(spark, d, "orders").select("o_orderkey", value.alias("value")), "o_orderkey")


@query(f"WITH {ITEMS} SELECT id, CASE WHEN n % 3 = 0 THEN 'R' WHEN n % 3 = 1 THEN 'M' ELSE 'A' END AS code, {sql_of('a/p{p}')} AS old_path, CASE WHEN n % 3 = 0 THEN {sql_of('b/s{s}')} ELSE {sql_of('a/p{p}')} END AS path FROM items")
def name_status_scan(spark, d):
    """Changed files with renames out of NUL-separated output: an order is a commit."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), (F.col("l_linenumber") % 3).alias("k"), F.concat(F.lit("a/p"), F.col("l_partkey").cast("string")).alias("p"), F.concat(F.lit("b/s"), F.col("l_suppkey").cast("string")).alias("s"))
    one = F.when(F.col("k") == 0, F.concat_ws("\0", F.lit("R100"), "p", "s")).otherwise(F.concat_ws("\0", F.when(F.col("k") == 1, "M").otherwise("A"), "p"))
    return readers.name_status_rows(items.groupBy("id").agg(F.array_join(F.collect_list(one), "\0").alias("value")), "id")


@query("WITH e AS (SELECT DISTINCT l_suppkey AS s, l_orderkey * 10 + l_linenumber AS n, l_linenumber % 2 = 0 AS is_match FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY s, is_match ORDER BY n) AS r FROM e) SELECT concat('src/s', CAST(s AS VARCHAR)) AS path, n::BIGINT AS line_no, concat('hit ', CAST(n AS VARCHAR)) AS text, is_match FROM r WHERE r <= CASE WHEN is_match THEN 3 ELSE 6 END")
def search_event_scan(spark, d):
    """A search tool's events, the first of each file: line items as hits."""
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("s"), n.cast("string").alias("n"), (F.col("l_linenumber") % 2 == 0).alias("m")).distinct()
    value = F.concat(F.lit('{"type":"'), F.when(F.col("m"), "match").otherwise("context"), F.lit('","data":{"path":{"text":"./src\\\\s'), "s", F.lit('"},"lines":{"text":"hit '), "n", F.lit('\\n"},"line_number":'), "n", F.lit("}}"))
    return readers.search_events(e.select(value.alias("value")), 3).select("path", F.col("line_no").cast("long").alias("line_no"), "text", "is_match")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT CAST(doc_id AS VARCHAR), '' FROM documents WHERE doc_id % 3 = 0")
def version_lookup(spark, d):
    """The texts of one version; a file that is empty there has none."""
    k = F.col("doc_id") % 3
    path = F.col("doc_id").cast("string").alias("path")
    docs = table(spark, d, "documents")
    versions = docs.select(F.when(k == 2, "old").otherwise("new").alias("rev"), path, F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.lit("﻿"), "text")).otherwise(F.col("text")).alias("text"))
    return readers.at_version(versions, "new")


# -------------------------------------------------------------------- sinks


@query("SELECT n_regionkey, concat('{\"title\":', CAST(n_regionkey AS VARCHAR), ',\"items\":[', string_agg(concat('{\"n_name\":\"', n_name, '\"}'), ',' ORDER BY n_name), ']}') AS value FROM nation GROUP BY 1")
def json_sink(spark, d):
    """A document a region with its nations."""
    n = table(spark, d, "nation").select("n_regionkey", "n_name")
    return sinks.as_json(n, "n_regionkey").select(F.get_json_object("value", "$.title").cast("int").alias("n_regionkey"), "value")


@query("SELECT 0::BIGINT AS position, '| n_nationkey | n_name |' AS value UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 2, concat('| ', CAST(n_nationkey AS VARCHAR), ' | ', n_name, ' |') FROM nation")
def markdown_sink(spark, d):
    return sinks.as_markdown(table(spark, d, "nation").select("n_nationkey", "n_name")).select(F.col("position").cast("long").alias("position"), "value")


@query("SELECT concat(rpad(CAST(s_suppkey AS VARCHAR), 20, ' '), '  ', rpad(s_name, 20, ' ')) AS value FROM supplier")
def table_sink(spark, d):
    """Cells padded to one width; refused as a whole if they are over the budget."""
    return sinks.refuse_over(sinks.as_table(table(spark, d, "supplier").select("s_suppkey", "s_name"), 20), 100_000_000)


@query("SELECT CAST(o_custkey AS VARCHAR) AS log_id, sum(strlen(o_orderpriority) + 1)::BIGINT - 1 AS bytes, count(*) AS n_lines FROM orders GROUP BY 1")
def raw_log_sink(spark, d):
    """Raw logs kept beside their report, and read again: a customer's orders are a log."""
    logs = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("log_id")).agg(F.array_join(F.collect_list("o_orderpriority"), "\n").alias("text"))
    path = scratch(spark)
    kept = sinks.keep_raw(logs, path)
    return kept.join(t.lines(spark.read.parquet(path), ["log_id"]).groupBy("log_id").agg(F.count("*").alias("n_lines")), "log_id")


# ------------------------------------------------- projections and functions


@query("SELECT event_id, CAST(regexp_extract(props, '\\d+') AS VARCHAR) AS text, concat('{\"a\":[', regexp_extract(props, '\\d+'), ',2]}') AS part, concat('[', regexp_extract(props, '\\d+'), ',2]') AS list, regexp_extract(props, '\\d+') AS first FROM events")
def json_subtree(spark, d):
    """Parts of a document by path: as text, as JSON, by index."""
    k = F.regexp_extract("props", r"\d+", 0)
    doc = F.concat(F.lit('{"t": "'), k, F.lit('", "z": {"a": ['), k, F.lit(", 2]}}"))
    held = project.subtree(table(spark, d, "events").select("event_id", doc.alias("doc"), doc.alias("whole")), "doc", "z")
    v = F.try_parse_json("whole")
    return held.select("event_id", project.raw(v, "t").alias("text"), F.col("doc").alias("part"), project.raw(v, "z.a").alias("list"), project.raw(v, "z.a[0]").alias("first"))


@query("SELECT p_partkey, printf('%g', p_retailprice * 1000) AS big, printf('%g', p_retailprice / 1000000) AS small FROM part")
def general_numbers(spark, d):
    price = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", tokens.general_number(price * 1000).alias("big"), tokens.general_number(price / 1000000).alias("small"))


@query("SELECT doc_id, CASE WHEN length(text) > 30 THEN concat(substr(text, 1, 29), '…') ELSE text END AS short FROM documents")
def shortened(spark, d):
    return table(spark, d, "documents").select("doc_id", t.shorten("text", 30).alias("short"))


@query("SELECT l_orderkey, l_linenumber, greatest(least(l_suppkey, CAST(l_quantity AS BIGINT)), 1) AS first, greatest(l_suppkey, CAST(l_quantity AS BIGINT), 1) AS last FROM lineitem")
def line_ranges(spark, d):
    """Ranges A-B in any order, from 1 on."""
    spec = F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    held = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.line_range(spec).alias("r"))
    return held.select("l_orderkey", "l_linenumber", F.col("r.start").cast("long").alias("first"), F.col("r.end").cast("long").alias("last"))


@query("SELECT doc_id, array_to_string(list_filter([trim(x) for x in string_split(text, chr(10))], lambda x: x <> ''), chr(10)) AS body FROM documents")
def body_forms(spark, d):
    """Texts without blank lines and margins: equal for bodies that differ in layout."""
    return table(spark, d, "documents").select("doc_id", t.body_lines("text").alias("body"))


@query(f"SELECT qualname, false AS ambiguous FROM ({PART_SYMBOLS}) WHERE p = 7")
def symbol_lookup(spark, d):
    """A symbol by the last part of its name."""
    return index.symbol_lookup(part_symbols(spark, d), "g7").select("qualname", "ambiguous")


@query(f"WITH {ITEMS} SELECT concat('src/m', id, '.py::', {sql_of('f{p}_{n}')}) AS qualname, concat('def ', {sql_of('f{p}_{n}')}, '(a, b)') AS signature FROM items")
def signatures(spark, d):
    """The head of every definition on one line."""
    files = source_files(spark, d, "python")
    held = extract.symbols(files).join(files, "path")
    return held.select("qualname", extract.signature_at("text", "line_start").alias("signature"))


@query("SELECT doc_id, doc_id % 4 = 0 AS is_binary FROM documents")
def binary_files(spark, d):
    """Content with a NUL byte, or mostly control bytes, is binary."""
    content = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a\0"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", tokens.binary_probe(F.encode(content, "utf-8")).alias("is_binary"))
