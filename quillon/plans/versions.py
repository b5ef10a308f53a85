"""Two versions of things, histories, commands and formats, made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import diff, shell
from ..session import table
from ..sources import readers
from .catalog import query
from .logbooks import ITEMS, column_of, order_texts, quoted, sql_of

# ------------------------------------------------------------------ bodies

#: By part modulo 5: (path, old body, new body), and SQL for whether it is mechanical and its details.
BODIES = [
    ("a.h", "#define A {q}\nf()", "#define A {n}\nf()", "q = n", f"CASE WHEN q = n THEN [] ELSE [{sql_of('{q} -> {n}')}] END"),
    ("b.js", "go()", "if ok{p}:\n  go()\n  stop{p}()", "false", f"[{sql_of('+ if ok{p}:')}, {sql_of('calls stop{p}')}]"),
    ("c.js", "import a{p}\nimport b\nx()", "import b\nimport a{p}\nx()", "true", "[]"),
    ("d.py", "def f( a ):\n  return a + {p}", "def f(a):\n    return a + {p}  # as before", "true", "[]"),
    ("e.ts", "this.#n = {s}; // old", "this.#n = {s}; // new {q}", "true", "[]"),
]


@query(f"WITH {ITEMS} SELECT id, pos, CASE p % 5 " + " ".join(f"WHEN {i} THEN {b[3]}" for i, b in enumerate(BODIES)) + " END AS mechanical, array_to_string(CASE p % 5 " + " ".join(f"WHEN {i} THEN {b[4]}" for i, b in enumerate(BODIES)) + " END, ';') AS details FROM items")
def body_comparison(spark, d):
    """What changed between two bodies of every line item, and whether that is layout only."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q")).alias("x"))
    at = items.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("id", F.posexplode("xs").alias("pos", "x"))
    of = lambda i: F.element_at(F.array(*(column_of(b[i], F.col("x")) for b in BODIES)), (F.col("x.p") % 5 + 1).cast("int"))
    pairs = at.select(F.concat_ws(":", "id", (F.col("pos") + 1).cast("string")).alias("key"), of(1).alias("o"), of(2).alias("n"), of(0).alias("path"))
    found = diff.compare_bodies(pairs, "key", "o", "n", "path")
    return found.select(F.substring_index("key", ":", 1).alias("id"), F.substring_index("key", ":", -1).cast("long").alias("pos"), "mechanical", F.array_join(F.filter("details", lambda x: ~x.startswith("- ")), ";").alias("details"))


# ------------------------------------------------------------------- diffs

HUNK = "diff --git a/m{p}.py b/m{p}.py\nindex 1..2\n--- a/m{p}.py\n+++ b/m{p}.py\n@@ -{n},2 +{q},3 @@\n a\n-b{s}\n+c{s}\n+d"


def diffs(spark, d):
    return order_texts(spark, d, HUNK, foot="\n")


@query(f"WITH {ITEMS} SELECT id, pos, {sql_of('m{p}.py')} AS path, 2::BIGINT AS plus, 1::BIGINT AS minus, 1::BIGINT AS hunks, '' AS note FROM items")
def diff_numstat(spark, d):
    """Files of a unified diff with their figures."""
    found = diff.diff_files(diffs(spark, d), "id", "text")
    return found.select("id", "path", "note", *(F.col(c).cast("long").alias(c) for c in ("pos", "plus", "minus", "hunks")))


@query(f"WITH {ITEMS} SELECT id, n::BIGINT AS old_start, 2::BIGINT AS old_len, q::BIGINT AS new_start, 3::BIGINT AS new_len FROM items")
def hunk_ranges(spark, d):
    h = diffs(spark, d).select("id", F.explode(diff.hunk_ranges(F.col("text"))).alias("h"))
    return h.select("id", *(F.col(f"h.{c}").cast("long").alias(c) for c in ("old_start", "old_len", "new_start", "new_len")))


def _lines_of(level: int) -> str:
    held = [(0, HUNK.split("\n")[0]), (4, HUNK.split("\n")[4]), (5, " a"), (6, "-b{s}"), (7, "+c{s}"), (8, "+d")]
    kept = [(k, x) for k, x in held if k == 0 or level < 2 or (level == 2 and k == 4)]
    kept = [(k, x) for k, x in kept if not (level == 1 and k == 5)]
    return " UNION ALL ".join(f"SELECT id, 9 * (pos - 1) + {k} AS pos, {sql_of(x)} AS line FROM items" for k, x in kept)


def _add_view(level: int) -> None:
    def run(spark, d):
        return diff.hunk_view(diffs(spark, d), "id", "text", level).select("id", F.col("pos").cast("long").alias("pos"), "line")

    run.__doc__ = f"A diff at level {level} of detail."
    query(f"WITH {ITEMS} {_lines_of(level)}", name=f"hunk_view_{level}")(run)


for _level in range(4):
    _add_view(_level)


@query("SELECT row_number() OVER (ORDER BY o_orderkey DESC) AS position, concat(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7), ' ', o_orderpriority, ' by ', o_orderstatus, ' (c', CAST(o_custkey AS VARCHAR), ')') AS line FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey % 10 = 3 ORDER BY o_orderkey DESC LIMIT 20")
def log_view(spark, d):
    """The twenty newest commits with a word in their subject, of some authors: orders as commits."""
    o = table(spark, d, "orders")
    commits = o.select(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 7).alias("sha"), F.concat("o_orderpriority", F.lit(" by "), "o_orderstatus").alias("subject"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"), (-F.col("o_orderkey")).alias("position"))
    held = diff.log_view(commits, 20, "HIGH", "3$").orderBy("position")
    return held.select(F.expr("row_number() over (order by position)").cast("long").alias("position"), "line")  # twenty rows


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'staged' WHEN 'F' THEN 'unstaged' ELSE 'untracked' END AS section, count(*) AS files, sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 7 END)::BIGINT AS plus, sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 5 END)::BIGINT AS minus FROM orders GROUP BY 1")
def status_view(spark, d):
    """Sections of changed files with their sums; a third of the files has no figures."""
    o = table(spark, d, "orders")
    section = F.when(F.col("o_orderstatus") == "O", "staged").when(F.col("o_orderstatus") == "F", "unstaged").otherwise("untracked")
    path = F.col("o_orderkey").cast("string").alias("path")
    stats = o.where("o_orderkey % 3 != 0").select(path, (F.col("o_orderkey") % 7).alias("plus"), (F.col("o_custkey") % 5).alias("minus"))
    return diff.status_view(o.select(section.alias("section"), F.lit("M").alias("code"), path), stats)


@query(
    """WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN concat(text, chr(10), 'one more') WHEN doc_id % 10 = 4 THEN replace(text, 'the ', 'a ') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3),
b AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, o.text AS was, n.text AS now FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.text IS DISTINCT FROM n.text),
l AS (SELECT doc_id, line, sum(now) - sum(was) AS more FROM (SELECT doc_id, unnest(string_split(was, chr(10))) AS line, 1 AS was, 0 AS now, was AS t FROM b WHERE was <> '' UNION ALL SELECT doc_id, unnest(string_split(now, chr(10))), 0, 1, now FROM b WHERE now <> '') WHERE NOT (line = '' AND false) GROUP BY 1, 2),
e AS (SELECT doc_id, CASE WHEN ends_with(was, chr(10)) THEN 1 ELSE 0 END AS was_end, CASE WHEN ends_with(now, chr(10)) THEN 1 ELSE 0 END AS now_end FROM b),
x AS (SELECT l.doc_id, CASE WHEN line = '' THEN more - now_end + was_end ELSE more END AS more FROM l JOIN e USING (doc_id))
SELECT b.doc_id AS path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'modified' END AS state, coalesce(sum(CASE WHEN more > 0 THEN more END), 0)::BIGINT AS plus, coalesce(-sum(CASE WHEN more < 0 THEN more END), 0)::BIGINT AS minus FROM b LEFT JOIN x ON x.doc_id = b.doc_id GROUP BY 1, 2"""
)
def branch_view(spark, d):
    """Files of two versions that differ, with the lines that have come and gone: documents as files."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    k = F.col("path") % 10
    new = docs.where(k != 3).withColumn("text", F.when(k == 2, F.concat("text", F.lit("\none more"))).when(k == 4, F.replace("text", F.lit("the "), F.lit("a "))).otherwise(F.col("text")))
    found = diff.branch_view(docs.where(k != 0), new)
    return found.select("path", "state", F.col("plus").cast("long").alias("plus"), F.col("minus").cast("long").alias("minus"))


@query(f"WITH {ITEMS} SELECT id AS file, {sql_of('f{p}_{n}')} AS qualname FROM items WHERE p % 4 = 0 OR p % 4 = 1 GROUP BY ALL")
def deprecated_symbols(spark, d):
    """Symbols with a mark in their lines or in the two above: every fourth part above, every fourth inside."""
    lines = t.lines(order_texts(spark, d, "x = 1\n# note {p}\ndef f{p}_{n}():\n    pass {p}\ny = 2").withColumnRenamed("id", "file"), ["file"])
    k = F.regexp_extract("line", r"(\d+)$", 1).cast("long") % 4
    marked = lines.withColumn("line", F.when(F.startswith("line", F.lit("# note")) & (k == 0), "# @deprecated").when(F.trim("line").startswith("pass") & (k == 1), "    warn('deprecated')").otherwise(F.col("line")))
    name = F.regexp_extract("line", r"^def (\w+)", 1)
    symbols = lines.where(name != "").select("file", name.alias("qualname"), F.col("line_no").alias("line_start"), (F.col("line_no") + 1).alias("line_end"))
    return diff.deprecated_symbols(symbols, marked)


@query(f"WITH {ITEMS} SELECT id AS file, min(4 * pos)::BIGINT AS line FROM items WHERE s % 3 = 0 AND q <> n GROUP BY 1")
def module_changes(spark, d):
    """Code outside all symbols that changed, with its first line: the last of four lines for every third supplier."""
    new = t.lines(order_texts(spark, d, "def f{p}_{n}():\n    return {s}\n# {q}\nA{p}_{n}_{s}_{q} = {s}").withColumnRenamed("id", "file"), ["file"])
    parts = lambda i: F.regexp_extract("line", r"^A(\d+)_(\d+)_(\d+)_(\d+) =", i)
    changes = (parts(1) != "") & (parts(3).try_cast("long") % 3 == 0) & (parts(4) != parts(2))
    inside = F.startswith("line", F.lit("    return"))
    old = new.withColumn("line", F.when(changes, F.concat("line", F.lit(" + 1"))).when(inside, F.lit("    return 0")).when(F.startswith("line", F.lit("#")), F.lit("# other")).otherwise(F.col("line")))
    symbols = new.where(F.startswith("line", F.lit("def "))).select("file", F.col("line_no").alias("line_start"), (F.col("line_no") + 1).alias("line_end"))
    return diff.module_changes(old, new, symbols, symbols).select("file", F.col("line").cast("long").alias("line"))


# ---------------------------------------------------------------- commands

#: By order modulo 10: a command ({k} is the order's customer) and what it is.
COMMANDS = [
    ("grep -rn foo{k} .", "'search'"),
    ("grep -rn foo{k} . | head -5", "'ok'"),
    ("cat f{k}.json", "'read'"),
    ("sed -n '1,{k}p' a.py", "CASE WHEN k > 60 THEN 'range: long range' ELSE 'ok' END"),
    ("git log", "'git log'"),
    ("git log -n {k}", "'ok'"),
    ("git diff --stat HEAD~{k}; git diff", "'git diff'"),
    ("tail -n {k} x.log", "CASE WHEN k > 60 THEN 'range: long range' ELSE 'ok' END"),
    ("echo 'cat x{k}' && ls", "'ok'"),
    ("git log > out{k}.txt", "'ok'"),
]


def commands(spark, d):
    k = F.col("o_custkey").cast("string")
    texts = [F.concat(*(y for i, x in enumerate(c.split("{k}")) for y in ([k] if i else []) + [F.lit(x)])) for c, _ in COMMANDS]
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.element_at(F.array(*texts), (F.col("o_orderkey") % 10 + 1).cast("int")).alias("command"))


@query("SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {x}" for i, (_, x) in enumerate(COMMANDS)) + " END AS command_class FROM (SELECT o_orderkey, o_custkey AS k FROM orders)")
def shell_classes(spark, d):
    """Which commands would print much."""
    return shell.with_class(commands(spark, d)).select("o_orderkey", "command_class")


@query("SELECT o_orderkey, CASE o_orderkey % 10 WHEN 3 THEN concat('sed -n ''', repeat('_', length(k) + 3), ''' a.py') WHEN 8 THEN concat('echo ''', repeat('_', length(k) + 5), ''' && ls') END AS masked, CASE o_orderkey % 10 WHEN 3 THEN concat('sed|-n|1,', k, 'p|a.py') WHEN 8 THEN concat('echo|cat x', k) END AS words FROM (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS k FROM orders) WHERE o_orderkey % 10 IN (3, 8)")
def shell_words(spark, d):
    """Quoted text blanked at its length, and the words of the first simple command."""
    quoted_ = commands(spark, d).where(F.contains("command", F.lit("'")))
    return quoted_.select("o_orderkey", shell.mask("command").alias("masked"), F.array_join(shell.own_words("command"), "|").alias("words"))


# ----------------------------------------------------------------- formats

XML = "<item n='{n}'><part id='{p}' lang='x'>{q}</part><note/></item>"


@query(f"WITH {ITEMS}, o AS (SELECT count(DISTINCT id) AS files, count(*) AS n FROM items) SELECT element, attribute, n::BIGINT AS n, n_text::BIGINT AS n_text FROM (SELECT unnest([{{'element': 'order', 'attribute': NULL, 'n': files, 'n_text': 0}}, {{'element': 'order/item', 'attribute': NULL, 'n': n, 'n_text': 0}}, {{'element': 'order/item', 'attribute': 'n', 'n': n, 'n_text': 0}}, {{'element': 'order/item/part', 'attribute': NULL, 'n': n, 'n_text': n}}, {{'element': 'order/item/part', 'attribute': 'id', 'n': n, 'n_text': 0}}, {{'element': 'order/item/part', 'attribute': 'lang', 'n': n, 'n_text': 0}}, {{'element': 'order/item/note', 'attribute': NULL, 'n': n, 'n_text': 0}}], recursive := true) FROM o)")
def xml_element_profile(spark, d):
    """Elements of well-formed markup by path, with their attributes and texts: an order is a document."""
    files = order_texts(spark, d, XML, "<order>", "</order>", "").withColumnRenamed("id", "path")
    e = readers.xml_elements(files)
    return e.groupBy("element", "attribute").agg(F.count("*").alias("n"), F.count_if("has_text").alias("n_text"))


#: By document modulo 8: the end of its name, its text ({k} is its id), the format and what told it.
KINDS = [
    (".json", "x{k}", "json", "extension"),
    ("", '{"a": {k}}\n{"a": 2}\n', "jsonl", "content"),
    ("", "[project]\nname = {k}\n", "toml", "content"),
    ("", "a,b\n{k},2\n", "csv", "content"),
    ("", "a\tb\n{k}\t2\n", "tsv", "content"),
    ("", "<a>{k}</a>", "xml", "content"),
    (".yml", "{k}", "yaml", "extension"),
    ("", "plain words {k}\n", "log", "content"),
]


@query("SELECT concat('f', k, CASE id % 8 " + " ".join(f"WHEN {i} THEN {quoted(x[0])}" for i, x in enumerate(KINDS)) + " END) AS path, CASE id % 8 " + " ".join(f"WHEN {i} THEN {quoted(x[2])}" for i, x in enumerate(KINDS)) + " END AS format, CASE id % 8 " + " ".join(f"WHEN {i} THEN {quoted(x[3])}" for i, x in enumerate(KINDS)) + " END AS told_by FROM (SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS k FROM documents)")
def format_detection(spark, d):
    """Formats told from name or content: every document as a file of some kind."""
    k, at = F.col("doc_id").cast("string"), (F.col("doc_id") % 8 + 1).cast("int")
    texts = [F.concat(*(y for i, x in enumerate(kind[1].split("{k}")) for y in ([k] if i else []) + [F.lit(x)])) for kind in KINDS]
    files = table(spark, d, "documents").select(F.concat(F.lit("f"), k, F.element_at(F.array(*(F.lit(x[0]) for x in KINDS)), at)).alias("path"), F.element_at(F.array(*texts), at).alias("text"))
    return readers.detect(files).select("path", "format", "told_by")


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN '' ELSE event_type END AS text FROM events")
def response_text(spark, d):
    """The text of a tool's answer, whichever field holds it: events as answers."""
    field = F.element_at(F.array(*map(F.lit, ("stdout", "content", "result", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    answer = F.concat(F.lit('{"'), field, F.lit('": "'), "event_type", F.lit('", "k": 1}'))
    return table(spark, d, "events").select("event_id", t.flatten_response(F.try_parse_json(answer)).alias("text"))
