"""Profiles of columns, JSON, logs and markup; events as a call log."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import events, profile
from ..session import checkpoint_folder, table
from ..sources import readers, sinks
from ..streaming import fold
from .catalog import query

CELL_KIND = r"CASE WHEN cell = '' THEN 'null' WHEN regexp_matches(trim(cell), '^[+-]?\d+$') THEN 'int' WHEN regexp_matches(trim(cell), '^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$') AND regexp_matches(cell, '[.eE]') THEN 'float' WHEN lower(trim(cell)) IN ('true', 'false') THEN 'bool' WHEN regexp_matches(trim(cell), '^\d{4}-\d{2}-\d{2}') THEN 'date' ELSE 'str' END"
ORDERS = ["o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "mixed"]


def cells(*columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(CAST({e} AS VARCHAR), '') AS cell FROM orders" for c, e in (x.split("=", 1) if "=" in x else (x, x) for x in columns))


MIXED = "CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 10 < 4 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 10 < 6 THEN concat(CAST(o_orderkey AS VARCHAR), '.5') WHEN o_orderkey % 10 = 6 THEN 'true' ELSE o_orderpriority END"
ORDER_CELLS = cells("o_orderkey", "o_orderstatus", "o_orderdate=strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "o_orderpriority", f"mixed={MIXED}")
PROFILE = f"""WITH cells AS ({ORDER_CELLS}), k AS (SELECT *, {CELL_KIND} AS kind FROM cells),
n AS (SELECT "column", kind, count(*) AS n FROM k WHERE kind <> 'null' GROUP BY 1, 2),
ty AS (SELECT "column", string_agg(kind, '|' ORDER BY n DESC, kind) AS kinds, count(*) AS nk, bool_and(kind IN ('int', 'float')) AS num FROM n GROUP BY 1)
SELECT k."column", CASE WHEN nk IS NULL THEN 'null' WHEN nk = 1 THEN kinds WHEN num THEN 'float' ELSE concat('mixed(', kinds, ')') END AS type, count(*) AS n_rows, count_if(kind = 'null') AS nulls, round_even(100.0 * count_if(kind = 'null') / count(*), 0)::BIGINT AS null_pct,
min(CASE WHEN kind IN ('int', 'float') THEN CAST(cell AS DOUBLE) END) AS num_min, max(CASE WHEN kind IN ('int', 'float') THEN CAST(cell AS DOUBLE) END) AS num_max, min(CASE WHEN kind IN ('date', 'str') THEN cell END) AS str_min, max(CASE WHEN kind IN ('date', 'str') THEN cell END) AS str_max,
least(count(DISTINCT CASE WHEN kind <> 'null' THEN cell END), 256)::BIGINT AS distinct_capped, count(DISTINCT CASE WHEN kind <> 'null' THEN cell END) > 256 AS over_cap FROM k LEFT JOIN ty USING ("column") GROUP BY k."column", nk, kinds, num"""


def order_cells(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority", F.expr(MIXED.replace("VARCHAR", "STRING")).alias("mixed"))


@query(PROFILE)
def column_profile(spark, d):
    return profile.columns(order_cells(spark, d), ORDERS)


@query(f'WITH cells AS ({ORDER_CELLS}) SELECT "column", {CELL_KIND} AS kind, count(*) AS n FROM cells GROUP BY 1, 2')
def csv_cell_kinds(spark, d):
    return profile.kind_counts(order_cells(spark, d), ORDERS)


@query("SELECT 'l_partkey' AS \"column\", least(count(DISTINCT l_partkey), 256)::BIGINT AS n, count(DISTINCT l_partkey) > 256 AS over_cap FROM lineitem UNION ALL SELECT 'l_returnflag', least(count(DISTINCT l_returnflag), 256)::BIGINT, count(DISTINCT l_returnflag) > 256 FROM lineitem")
def capped_distinct(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    return profile.columns(li, li.columns).select("column", F.col("distinct_capped").cast("long").alias("n"), "over_cap")


@query("SELECT c_mktsegment, round_even(100.0 * count_if(o_orderkey IS NULL) / count(*), 0)::BIGINT AS null_pct, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1")
def null_presence_pct(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'P'")
    joined = c.join(o, c.c_custkey == o.o_custkey, "left")
    return joined.groupBy("c_mktsegment").agg(F.bround(100.0 * F.count_if(F.col("o_orderkey").isNull()) / F.count("*")).cast("long").alias("null_pct"), F.count("*").alias("n"))


# -------------------------------------------------------------------- json


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing, concat_ws(chr(9), CAST(event_id AS VARCHAR), event_type, coalesce(json_extract_string(props, '$.k'), '')) AS tsv FROM events")
def json_path_project(spark, d):
    """Fields by path; a missing one is null, and as a cell it is nothing."""
    from ..operators import project

    held = project.select(table(spark, d, "events"), "props", ["k", "missing"], ["event_id", "event_type"])
    row = F.concat_ws("\t", F.col("event_id").cast("string"), "event_type", F.coalesce("k", F.lit("")))
    return held.select("event_id", "k", "missing", row.alias("tsv"))


@query(
    """SELECT '$' AS path, count(*) AS n, 'object' AS kinds, NULL::BIGINT AS presence_pct FROM events
UNION ALL SELECT '$.k', count(json_extract(props, '$.k')), CASE WHEN bool_and(json_type(json_extract(props, '$.k')) LIKE '%INT%') THEN 'int' ELSE 'other' END, round_even(100.0 * count(json_extract(props, '$.k')) / count(*), 0)::BIGINT FROM events"""
)
def json_path_profile(spark, d):
    paths = profile.json_paths(table(spark, d, "events"), "props", ["event_id"], depth=3)
    return profile.path_profile(paths).select("path", "n", "kinds", "presence_pct")


@query("WITH v AS (SELECT json_extract_string(props, '$.k') AS v, min(event_id) AS first FROM events GROUP BY 1) SELECT '$.k' AS path, string_agg(v, ',' ORDER BY first) AS examples FROM (SELECT * FROM v ORDER BY first LIMIT 2)")
def json_examples(spark, d):
    paths = profile.json_paths(table(spark, d, "events"), "props", ["event_id"], depth=3)
    return profile.examples(paths, ["event_id"]).select("path", F.array_join("examples", ",").alias("examples"))


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS z FROM events) SELECT event_type, max(CASE WHEN a = 3 THEN event_id END) AS third, max(CASE WHEN z = 1 THEN event_id END) AS last FROM r GROUP BY 1")
def nth_record(spark, d):
    order, back = Window.partitionBy("event_type").orderBy("ts", "event_id"), Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    ranked = table(spark, d, "events").select("event_type", "event_id", F.row_number().over(order).alias("a"), F.row_number().over(back).alias("z"))
    return ranked.groupBy("event_type").agg(F.max(F.when(F.col("a") == 3, F.col("event_id"))).alias("third"), F.max(F.when(F.col("z") == 1, F.col("event_id"))).alias("last"))


@query("SELECT user_id, count(*) AS n_lines, arg_min(event_type, event_id) AS first_line, arg_max(event_type, event_id) AS last_line, min(event_id) AS first_no, max(event_id) AS last_no FROM events GROUP BY 1")
def first_last_row(spark, d):
    return profile.first_and_last(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


# --------------------------------------------------------------------- logs

LOG = "concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', upper(event_type), ' user ', user_id, ' took ', CAST(value AS VARCHAR), ' ms \"', props, '\"')"
LOG_TEMPLATE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}', ''), '''[^'']*''|\"[^\"]*\"', '<str>', 'g'), '\b\d+(?:\.\d+)?\b', '<n>', 'g'), '\s+', ' ', 'g'))".replace('\\"', '"')


def log_lines(spark, d):
    """Events as log lines."""
    e = table(spark, d, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.upper("event_type"), F.lit(" user "), F.col("user_id").cast("string"), F.lit(" took "), F.col("value").cast("string"), F.lit(' ms "'), "props", F.lit('"'))
    return e.select("event_id", text.alias("line"))


@query(f"SELECT template, count(*) AS n FROM (SELECT {LOG_TEMPLATE} AS template FROM (SELECT {LOG} AS line FROM events)) GROUP BY 1 ORDER BY n DESC, template LIMIT 5")
def line_templates_top(spark, d):
    lines = log_lines(spark, d)
    first = lines.agg(t.timestamp_format(F.min_by("line", "event_id")).alias("fmt"))
    held = profile.template_counts(lines.crossJoin(first), ["event_id"], format_name=F.col("fmt"))  # one row
    return held.select("template", "n").orderBy(F.desc("n"), "template").limit(5)


@query()
def log_templates_full(spark, d):
    """With every rule, hexadecimal numbers included, over the documents' lines."""
    lines = t.lines(table(spark, d, "documents"), ["doc_id"])
    return profile.template_counts(lines, ["doc_id", "line_no"]).where("n > 1").select("template", "n", "over_cap")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
p AS (SELECT regexp_replace(trim(regexp_replace(x[i], '\s+', ' ', 'g')), '\d+', '0', 'g') AS key, doc_id, i FROM l WHERE trim(x[i]) <> ''),
k AS (SELECT key, count(*) AS n, min(doc_id * 1000000 + i) AS first FROM p GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first) AS rank FROM k)
SELECT least(count(*), 512)::BIGINT AS templates, sum(CASE WHEN rank > 512 THEN n ELSE 0 END)::BIGINT AS overflow_lines, sum(n)::BIGINT AS lines FROM r"""
)
def template_cap_overflow(spark, d):
    lines = t.lines(table(spark, d, "documents"), ["doc_id"]).where(F.trim("line") != "")
    per = lines.groupBy(t.near_key("line").alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    # The first 512 by appearance, then the rest in one sum: no global numbering of all templates.
    kept = per.orderBy("first").limit(profile.TEMPLATE_CAP).agg(F.count("*").alias("templates"), F.sum("n").alias("held"))
    return kept.crossJoin(per.agg(F.sum("n").alias("lines"))).select("templates", (F.col("lines") - F.col("held")).alias("overflow_lines"), "lines")


# ------------------------------------------------------------------- markup


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1")
def xml_tag_counts(spark, d):
    return profile.tag_counts(table(spark, d, "pages"), "html")


@query("""WITH t AS (SELECT unnest(regexp_extract_all(html, '<[a-z][a-z0-9]*(?: [^<>]*)?>')) AS t FROM pages) SELECT tag, attribute, count(*) AS n FROM (SELECT regexp_extract(t, '^<([a-z0-9]+)', 1) AS tag, unnest(regexp_extract_all(t, ' ([a-z][a-z0-9-]*)="', 1)) AS attribute FROM t) GROUP BY 1, 2""")
def html_attr_counts(spark, d):
    return profile.attribute_counts(table(spark, d, "pages"), "html")


# ---------------------------------------------------------------- call log

CALLS = "SELECT event_type AS tool, octet_length(encode(props)) AS actual, CASE WHEN value < 20 THEN NULL WHEN value < 30 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS baseline, ts FROM events"
FOLD = f"SELECT tool, count(*) AS calls, count_if(baseline IS NOT NULL AND baseline <> 0) AS credited, sum(actual)::BIGINT AS actual, coalesce(sum(CASE WHEN baseline <> 0 THEN actual END), 0)::BIGINT AS credited_actual, coalesce(sum(CASE WHEN baseline <> 0 THEN baseline END), 0)::BIGINT AS baseline, max(ts) AS last_ts FROM ({CALLS}) GROUP BY 1"


def as_calls(e):
    """Events as calls: the tool, what it printed, what the plain command would have."""
    base = F.when(F.col("value") < 20, F.lit(None)).when(F.col("value") < 30, F.lit(0)).otherwise(F.floor("value")).cast("long")
    return e.select("ts", F.lit(3).alias("v"), F.col("event_type").alias("tool"), F.lit("").alias("argv"), t.octets("props").alias("actual_bytes"), base.alias("baseline_bytes"))


@query(FOLD)
def savings_fold(spark, d):
    return events.fold(as_calls(table(spark, d, "events")))


@query(f"WITH f AS ({FOLD}), dom AS (SELECT unnest(['click', 'error', 'purchase', 'unused', 'view']) AS tool) SELECT tool, coalesce(calls, 0)::BIGINT AS calls, coalesce(credited, 0)::BIGINT AS credited, coalesce(actual, 0)::BIGINT AS actual, coalesce(credited_actual, 0)::BIGINT AS credited_actual, coalesce(baseline, 0)::BIGINT AS baseline, last_ts FROM dom LEFT JOIN f USING (tool)")
def zero_fill(spark, d):
    domain = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "unused", "view")], "tool string")
    return events.zero_fill(events.fold(as_calls(table(spark, d, "events"))), domain)


@query(f"SELECT tool, (baseline - credited_actual)::BIGINT AS saved, round((baseline - credited_actual) / nullif(credited, 0), 6)::DOUBLE AS avg_saved FROM ({FOLD})")
def avg_saved(spark, d):
    held = events.saved(events.fold(as_calls(table(spark, d, "events"))))
    return held.select("tool", "saved", F.round("avg_saved", 6).alias("avg_saved"))


@query(f"WITH f AS (SELECT *, baseline - credited_actual AS saved FROM ({FOLD})) SELECT tool, row_number() OVER (ORDER BY calls > 0 DESC, credited > 0 DESC, saved DESC, calls DESC, tool)::BIGINT AS position, calls::BIGINT AS calls, saved::BIGINT AS saved FROM f UNION ALL SELECT 'total', 0, sum(calls)::BIGINT, sum(saved)::BIGINT FROM f")
def savings_report(spark, d):
    return events.report(events.fold(as_calls(table(spark, d, "events")))).select("tool", F.col("position").cast("long").alias("position"), "calls", "saved")


@query(FOLD)
def events_stream_fold(spark, d):
    """The same fold over a file stream, in micro-batches; it must equal the batch."""
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/event*.parquet")
    folder = checkpoint_folder(spark)
    name = f"fold_{uuid.uuid4().hex}"
    return fold.fold_stream(as_calls(stream), name, f"{folder}/{name}")


@query("SELECT CAST(user_id AS VARCHAR) AS session, arg_max(event_type, ts) AS model FROM events WHERE event_type <> 'view' GROUP BY 1 UNION ALL SELECT CAST(user_id AS VARCHAR), NULL FROM events GROUP BY 1 HAVING count_if(event_type <> 'view') = 0")
def session_model(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("model"), "ts")
    return events.last_model(e)


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events WHERE value > 200) SELECT CAST(user_id AS VARCHAR) AS session, event_id FROM r WHERE r = 1")
def once_per_session(spark, d):
    e = table(spark, d, "events").withColumn("session", F.col("user_id").cast("string"))
    return events.once_per_session(e, F.col("value") > 200).select("session", "event_id")


@query("SELECT concat_ws(chr(9), CAST(c_custkey AS VARCHAR), c_name, c_mktsegment) AS value FROM customer")
def tsv_sink(spark, d):
    return sinks.as_tsv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))
