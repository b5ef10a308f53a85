"""Search, clusters, ranking, budgets, sizes, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import blocks, budget, graph, search, tokens
from ..session import table
from .catalog import query

LINES = "lines AS (SELECT doc_id, source, i AS line_no, l[i] AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE NOT (i = len(l) AND l[i] = ''))"
KEY = r"regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '\d+', '0', 'g')"
CLUSTERED = f"""{LINES}, hits AS (SELECT * FROM lines WHERE regexp_matches(line, '(?i)\\bthe\\b')),
clusters AS (SELECT source, {KEY} AS key, count(*) AS size, min(doc_id * 1000000 + line_no) AS first FROM hits GROUP BY 1, 2)"""
WEIGHT = "CASE WHEN source = 'src0' THEN 0.2 WHEN source = 'src1' THEN 0.5 ELSE 1.0 END"


def doc_lines(spark, d):
    return t.lines(table(spark, d, "documents"), ["doc_id", "source"])


def the_hits(spark, d):
    return search.hits(doc_lines(spark, d), search.pattern("the", word=True, ignore_case=True))


def weight():
    return F.when(F.col("source") == "src0", 0.2).when(F.col("source") == "src1", 0.5).otherwise(1.0)


@query(
    f"""WITH {CLUSTERED}, counts AS (SELECT source, count(*) AS n_hits FROM hits GROUP BY 1),
placed AS (SELECT source, n_hits, row_number() OVER (ORDER BY n_hits * ({WEIGHT}) DESC, source) AS position FROM counts),
reps AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, first) AS rank FROM clusters),
shown AS (SELECT position, source, n_hits, rank, size, key FROM reps JOIN placed USING (source) WHERE rank <= 3),
costed AS (SELECT *, sum(strlen(key) + 1) OVER (ORDER BY position, rank ROWS UNBOUNDED PRECEDING) AS used FROM shown)
SELECT position, source, n_hits, rank, size, key FROM costed WHERE floor(used / 4) <= 1500"""
)
def ranked_search(spark, d):
    """Lines with a word, clustered, three of each source, sources by weighted hits, cut to 1500 tokens."""
    found = the_hits(spark, d)
    per = search.clusters(found, "source", ["doc_id", "line_no"])
    hits_of = per.groupBy("source").agg(F.sum("size").alias("n_hits"))
    placed = search.rank_groups(hits_of, "source", weight(), (1500 + 1) * 4)
    shown = search.representatives(per, "source").join(F.broadcast(placed), "source")  # a row a source
    fitted = budget.fit(shown, [F.col("position"), F.col("rank")], t.octets("key") + 1, 1500)
    return fitted.select("position", "source", "n_hits", "rank", "size", "key")


@query(f"WITH {LINES} SELECT source, count(*) AS n_hits FROM lines WHERE regexp_matches(line, '(?i)\\bthe\\b') GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM lines WHERE regexp_matches(line, '(?i)\\bthe\\b')")
def search_counts(spark, d):
    per = the_hits(spark, d).rollup("source").agg(F.count("*").alias("n_hits"), F.grouping("source").alias("all"))
    return per.select(F.when(F.col("all") == 1, "total").otherwise(F.col("source")).alias("source"), "n_hits")


@query(f"WITH {LINES} SELECT DISTINCT doc_id FROM lines WHERE regexp_matches(line, '\\bidiot\\b')")
def search_files(spark, d):
    return search.hits(doc_lines(spark, d), search.pattern("idiot", word=True)).select("doc_id").distinct()


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE contains(line, 'token = ')")
def search_plain(spark, d):
    return search.hits(doc_lines(spark, d), search.pattern("token = ", fixed=True)).select("doc_id", "line_no", "line")


@query(f"WITH {LINES}, hit AS (SELECT doc_id, line_no FROM lines WHERE regexp_matches(line, '(?i)\\bclown\\b')) SELECT DISTINCT l.doc_id, l.line_no, l.line FROM lines l JOIN hit h ON l.doc_id = h.doc_id AND abs(l.line_no - h.line_no) <= 2 WHERE NOT EXISTS (SELECT 1 FROM hit x WHERE x.doc_id = l.doc_id AND x.line_no = l.line_no)")
def search_context(spark, d):
    return search.context(table(spark, d, "documents"), ["doc_id"], search.pattern("clown", word=True, ignore_case=True), 2)


@query(f"WITH {LINES}, hits AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS rank FROM lines WHERE regexp_matches(line, '(?i)\\bthe\\b')) SELECT source, rank, doc_id, line_no FROM hits WHERE rank <= 5")
def search_no_collapse_topn(spark, d):
    return search.first_hits(the_hits(spark, d), "source", ["doc_id", "line_no"], 5).select("source", "rank", "doc_id", "line_no")


@query(f"WITH {LINES} SELECT {KEY} AS key, count(*) AS n, min(doc_id) AS first_doc FROM lines GROUP BY 1 HAVING count(*) > 1")
def near_dup_lines(spark, d):
    return doc_lines(spark, d).groupBy(t.near_key("line").alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"WITH {CLUSTERED}, reps AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, first) AS rank FROM clusters) SELECT source, count(*) AS n_unshown FROM reps WHERE rank > 3 GROUP BY 1")
def unshown_clusters(spark, d):
    per = search.clusters(the_hits(spark, d), "source", ["doc_id", "line_no"])
    return search.unshown(per, search.representatives(per, "source"), "source")


@query(f"WITH {LINES} SELECT count_if(regexp_matches(line, '\\bthe\\b')) AS word, count_if(contains(line, 'the')) AS fixed, count_if(regexp_matches(line, '(?i)the')) AS any_case, count_if(regexp_matches(line, '^[A-Z][a-z]+ .*\\.$')) AS regex FROM lines")
def match_kinds(spark, d):
    c = F.col("line")
    kinds = {"word": search.pattern("the", word=True), "fixed": search.pattern("the", fixed=True), "any_case": search.pattern("the", ignore_case=True), "regex": r"^[A-Z][a-z]+ .*\.$"}
    return doc_lines(spark, d).agg(*(F.count_if(c.rlike(rx)).alias(k) for k, rx in kinds.items()))


PATHS = "concat('repo/', CASE WHEN doc_id % 7 = 0 THEN 'tests/' WHEN doc_id % 11 = 0 THEN 'node_modules/' ELSE 'src/' END, lang, '/', CASE WHEN doc_id % 13 = 0 THEN 'test_' ELSE '' END, source, '_', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.py' WHEN doc_id % 5 = 1 THEN '.json' WHEN doc_id % 5 = 2 THEN '.min.js' WHEN doc_id % 5 = 3 THEN '.go' ELSE '' END)"


def paths(spark, d):
    """Documents under made-up paths."""
    return table(spark, d, "documents").withColumn("path", F.expr(PATHS))


@query(
    f"SELECT class, count(*) AS n, sum(w) AS weighted FROM (SELECT CASE WHEN path LIKE '%/node_modules/%' OR regexp_matches(path, '\\.min\\.') THEN 'generated' WHEN path LIKE '%/tests/%' OR regexp_matches(path, '/test_[^/]*$') THEN 'tests' ELSE 'src' END AS class, CASE WHEN path LIKE '%/node_modules/%' OR regexp_matches(path, '\\.min\\.') THEN 0.2 WHEN path LIKE '%/tests/%' OR regexp_matches(path, '/test_[^/]*$') THEN 0.5 ELSE 1.0 END::DECIMAL(3,1) AS w FROM (SELECT {PATHS} AS path FROM documents)) GROUP BY 1"
)
def path_classes(spark, d):
    kind = t.path_class("path")
    return paths(spark, d).groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.sum(t.class_weight(kind).cast("decimal(3,1)")).alias("weighted"))


@query(f"SELECT ext, stem_head, lang_of, limit_bytes::BIGINT AS limit_bytes, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(path, '\\.[a-z]+$') THEN regexp_extract(path, '\\.[a-z]+$') ELSE '' END AS ext, left(regexp_extract(path, '[^/]*$'), 4) AS stem_head, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.go' THEN 'go' END AS lang_of, CASE WHEN path LIKE '%.json' THEN 8000 WHEN path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%.go' THEN 20000 ELSE 50000 END AS limit_bytes FROM (SELECT {PATHS} AS path FROM documents)) GROUP BY 1, 2, 3, 4")
def path_parts(spark, d):
    p = paths(spark, d)
    return p.groupBy(t.extension("path").alias("ext"), F.substring(t.basename("path"), 1, 4).alias("stem_head"), t.language_of("path").alias("lang_of"), t.read_limit("path").cast("long").alias("limit_bytes")).agg(F.count("*").alias("n"))


@query(f"SELECT count_if(path LIKE 'repo/src/en/%') AS under_en, count_if(path LIKE '%.py') AS glob_py, count_if(regexp_matches(path, '^repo/.*/src1_[0-9]$')) AS glob_set FROM (SELECT {PATHS} AS path FROM documents)")
def path_predicates(spark, d):
    return paths(spark, d).agg(F.count_if(t.under("path", "repo/src/en")).alias("under_en"), F.count_if(t.matches_glob("path", "*.py")).alias("glob_py"), F.count_if(t.matches_glob("path", "repo/*/src1_[0-9]")).alias("glob_set"))


# ------------------------------------------------------------------- sizes


@query("SELECT doc_id, round_even(strlen(text) / 3.7, 0)::BIGINT AS tokens, floor((strlen(text) + 1) / 4)::BIGINT AS line_tokens, length(text)::BIGINT AS chars FROM documents")
def token_cost(spark, d):
    return table(spark, d, "documents").select("doc_id", t.tokens_of_bytes(t.octets("text")).alias("tokens"), t.tokens_of_lines(t.octets("text") + 1).alias("line_tokens"), F.length("text").cast("long").alias("chars"))


@query("SELECT coalesce(source, 'total') AS source, sum(round_even(strlen(text) / 3.7, 0))::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), ())")
def token_total(spark, d):
    docs = table(spark, d, "documents").select("source", t.tokens_of_bytes(t.octets("text")).alias("tokens"))
    return docs.rollup("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).withColumn("source", F.coalesce("source", F.lit("total")))


@query(
    """WITH f AS (SELECT regexp_replace(url, '^https?://', '') AS path, round_even(strlen(html) / 3.7, 0)::BIGINT AS tokens FROM pages),
parts AS (SELECT path, tokens, string_split(path, '/') AS p FROM f),
above AS (SELECT concat(array_to_string(p[1:i], '/'), '/') AS path, tokens FROM (SELECT *, unnest(range(1, len(p))) AS i FROM parts))
SELECT path, sum(tokens)::BIGINT AS total, count(*) AS n_files FROM (SELECT path, tokens FROM f UNION ALL SELECT * FROM above) GROUP BY 1"""
)
def token_rollup_dir(spark, d):
    pages = table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"), t.tokens_of_bytes(t.octets("html")).alias("tokens"))
    return tokens.rollup_paths(pages, "path", "tokens")


@query(
    """WITH t AS (SELECT doc_id, round_even(strlen(text) / 3.7, 0)::BIGINT AS tokens FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY tokens DESC, doc_id) AS rank FROM t), w AS (SELECT sum(tokens) AS whole FROM t)
SELECT doc_id, rank, tokens, round(100.0 * tokens / whole, 1)::DOUBLE AS share_pct FROM r, w WHERE rank <= 40
UNION ALL SELECT NULL, NULL, sum(tokens)::BIGINT, round(100.0 * sum(tokens) / max(whole), 1)::DOUBLE FROM r, w WHERE rank > 40"""
)
def token_share_topn(spark, d):
    """The forty largest with their share, and one row for the rest."""
    docs = table(spark, d, "documents").select("doc_id", t.tokens_of_bytes(t.octets("text")).alias("tokens"))
    top, rest = tokens.top_and_rest(docs, [F.desc("tokens"), F.col("doc_id")], 40, "tokens")
    both = top.unionByName(rest, allowMissingColumns=True)
    return both.crossJoin(docs.agg(F.sum("tokens").alias("whole"))).select("doc_id", "rank", "tokens", F.round(100.0 * F.col("tokens") / F.col("whole"), 1).alias("share_pct"))


LINT = """WITH s AS (SELECT doc_id, PATH AS path, strlen(text) AS size, round_even(strlen(text) / 3.7, 0)::BIGINT AS tokens, list_max([length(x) for x in l]) AS max_line, length(text) / len(l) AS mean_line FROM (SELECT doc_id, lang, source, text, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents))
SELECT * FROM (SELECT doc_id, tokens, CASE WHEN regexp_matches(path, '(\\.min\\.js|\\.min\\.css|\\.min\\.mjs|\\.bundle\\.js)$') THEN 'MINIFIED' WHEN max_line > 500 AND mean_line > 200 THEN 'MINIFIED' WHEN path LIKE '%.json' AND tokens > 1000 THEN 'BIG-DATA' WHEN tokens > 1000 THEN 'BIG-FILE' END AS rule FROM s) WHERE rule IS NOT NULL""".replace("PATH", PATHS)


@query(LINT)
def lint_rules(spark, d):
    """The first rule each document breaks, under its made-up path."""
    stats = tokens.line_stats("text")
    once = paths(spark, d).select("doc_id", "path", t.octets("text").alias("size"), F.length("text").alias("chars"), F.struct(stats["max_line"].alias("max_line"), stats["n_lines"].alias("n_lines")).alias("s"))
    held = once.select("doc_id", "path", "size", t.tokens_of_bytes(F.col("size")).alias("tokens"), F.col("s.max_line").alias("max_line"), (F.col("chars") / F.col("s.n_lines")).alias("mean_line"))
    rule = tokens.lint(F.col("path"), F.col("size"), F.col("tokens"), F.col("max_line"), F.col("mean_line"), threshold=1000)
    return held.select("doc_id", "tokens", rule.alias("rule")).where("rule is not null")


@query("SELECT source, sum(round_even(strlen(text) / 3.7, 0))::BIGINT AS tokens, sum(round_even(strlen(text) / 3.7, 0)) > 15000 AS over_budget FROM documents GROUP BY 1")
def over_budget_groups(spark, d):
    per = table(spark, d, "documents").groupBy("source").agg(F.sum(t.tokens_of_bytes(t.octets("text"))).alias("tokens"))
    return per.withColumn("over_budget", F.col("tokens") > 15000)


@query(
    """WITH b AS (SELECT doc_id, substr(h, 2 * i - 1, 2) AS b FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(1, strlen(text) + 1)) AS i FROM documents)),
c AS (SELECT doc_id, b, count(*) AS c FROM b GROUP BY 1, 2) SELECT doc_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 4) AS bits FROM c GROUP BY 1"""
)
def byte_entropy(spark, d):
    return tokens.byte_entropy(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT sum(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS n_lines, max(list_max([length(x) for x in string_split(text, chr(10))]))::BIGINT AS longest FROM documents")
def line_lengths(spark, d):
    longest = F.array_max(F.transform(t.line_array("text"), lambda x: F.length(x)))
    return table(spark, d, "documents").agg(F.sum(t.line_count("text")).cast("long").alias("n_lines"), F.max(longest).cast("long").alias("longest"))


@query("SELECT name, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'))) AS name FROM documents) GROUP BY 1")
def doc_frequency(spark, d):
    return table(spark, d, "documents").select(F.explode(t.identifiers("text")).alias("name")).groupBy("name").agg(F.count("*").alias("df"))


NAMES = "SELECT doc_id, name FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'))[1:2] AS l, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'))[1:2]) AS name FROM documents)"


@query(
    """WITH toks AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS name FROM documents),
names AS (SELECT doc_id, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]{2,}') AS name FROM documents WHERE regexp_matches(text, '[A-Za-z_][A-Za-z0-9_]{2,}')),
df AS (SELECT name, count(*) AS df FROM toks GROUP BY 1)
SELECT doc_id, (2 * (df - 1))::BIGINT AS score FROM names JOIN df USING (name)"""
)
def reference_rank(spark, d):
    """In how many other documents the first name of each occurs, twice weighted."""
    docs = table(spark, d, "documents")
    first = F.regexp_extract("text", t.IDENTIFIER, 0)
    names = docs.select("doc_id", first.alias("name"), F.lit(2).cast("long").alias("weight")).where("name != ''")
    return graph.reference_rank(docs, names, "doc_id", "text")


# ------------------------------------------------------------------ blocks

SCORE = """WITH w AS (SELECT doc_id, n, 20 * k + 1 AS start, least(20 * k + 20, n) AS stop, l FROM (SELECT doc_id, len(l) AS n, l, unnest(range(0, (len(l) + 19) // 20)) AS k FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents))),
b AS (SELECT doc_id, start, stop, lower(array_to_string(l[start:stop], chr(10))) AS body FROM w)"""


@query(
    SCORE
    + """, s AS (SELECT doc_id, start, stop, (len(body) - len(replace(body, 'the', ''))) / 3 + (len(body) - len(replace(body, 'idiot', ''))) / 5 AS hits, CASE WHEN regexp_matches(body, '\\bthe\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(body, '\\bidiot\\b') THEN 1 ELSE 0 END AS matched FROM b)
SELECT doc_id, start::BIGINT AS start, round(hits * greatest(matched, 1) / 2 / sqrt(stop - start + 1), 4) AS score FROM s ORDER BY round(hits * greatest(matched, 1) / 2 / sqrt(stop - start + 1), 4) DESC, doc_id, start LIMIT 25"""
)
def block_scores_topk(spark, d):
    lines = t.line_array("text")
    held = table(spark, d, "documents").select("doc_id", lines.alias("l")).withColumn("w", F.explode(blocks.windows(F.size("l"))))
    body = F.array_join(F.slice("l", F.col("w.start"), F.col("w.end") - F.col("w.start") + 1), "\n")
    scored = held.select("doc_id", F.col("w.start").cast("long").alias("start"), F.round(blocks.score(body, ["the", "idiot"], F.col("w.end") - F.col("w.start") + 1), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id", "start").limit(25)


@query(SCORE + " SELECT doc_id, start::BIGINT AS start, stop::BIGINT AS stop FROM b")
def line_windows(spark, d):
    held = table(spark, d, "documents").select("doc_id", F.explode(blocks.windows(F.size(t.line_array("text")))).alias("w"))
    return held.select("doc_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("stop"))


HEADS = f"""{LINES}, n AS (SELECT doc_id, max(line_no) AS n_lines FROM lines GROUP BY 1),
heads AS (SELECT doc_id, line_no, n_lines, CASE WHEN line LIKE 'The%' THEN 1 WHEN line LIKE 'A%' THEN 2 ELSE 3 END AS level, regexp_extract(line, '^[A-Z][a-z]*') AS title FROM lines JOIN n USING (doc_id) WHERE regexp_matches(line, '^[A-Z][a-z]'))"""


def heads(spark, d):
    """Lines that begin with a capital, as headings of three levels."""
    every = doc_lines(spark, d)
    sizes = table(spark, d, "documents").select("doc_id", F.size(t.line_array("text")).alias("n_lines"))
    line = F.col("line")
    level = F.when(line.startswith("The"), 1).when(line.startswith("A"), 2).otherwise(3)
    return blocks.headings(every, line.rlike("^[A-Z][a-z]"), level, F.regexp_extract("line", "^[A-Z][a-z]*", 0)).join(sizes, "doc_id")


@query(f"WITH {HEADS} SELECT h.doc_id, h.line_no::BIGINT AS line_no, h.level::BIGINT AS level, coalesce(min(x.line_no) - 1, max(h.n_lines))::BIGINT AS end_line FROM heads h LEFT JOIN heads x ON x.doc_id = h.doc_id AND x.line_no > h.line_no AND x.level <= h.level GROUP BY 1, 2, 3")
def section_spans(spark, d):
    ended = blocks.section_ends(heads(spark, d), "doc_id", "n_lines", 3)
    return ended.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("line_no", "level", "end_line")))


@query(f"WITH {HEADS} SELECT doc_id, line_no::BIGINT AS line_no, title, row_number() OVER (PARTITION BY doc_id, level, title ORDER BY line_no) AS occurrence FROM heads")
def occurrence_index(spark, d):
    return blocks.occurrence(heads(spark, d), ["doc_id"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "title", F.col("occurrence").cast("long").alias("occurrence"))


@query()
def symbol_blocks(spark, d):
    """Headings as spans, and windows over the lines between them, tiling each document."""
    spans = blocks.section_ends(heads(spark, d), "doc_id", "n_lines", 3).select("doc_id", F.col("line_no").alias("start"), F.least(F.col("end_line"), F.col("line_no") + 4).alias("end"), "n_lines")
    return blocks.blocks(spans, "doc_id", "n_lines").select("doc_id", "start", "end", "kind")


# ----------------------------------------------------------------- budgets

COST = "SELECT doc_id, strlen(text) + 1 AS cost, sum(strlen(text) + 1) OVER (ORDER BY strlen(text) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents"


def costed(spark, d):
    return table(spark, d, "documents").select("doc_id", (t.octets("text") + 1).alias("cost"))


def by_cost():
    return [F.desc("cost"), F.col("doc_id")]


@query(f"SELECT doc_id, cost::BIGINT AS cost, used::BIGINT AS used FROM ({COST}) WHERE floor(used / 4) <= 30000")
def running_budget(spark, d):
    return budget.fit(costed(spark, d), by_cost(), F.col("cost"), 30000)


@query(f"SELECT count_if(floor(used / 4) <= 30000) AS shown, count_if(floor(used / 4) > 30000) AS omitted, coalesce(sum(CASE WHEN floor(used / 4) > 30000 THEN cost END), 0)::BIGINT AS omitted_cost FROM ({COST})")
def residual_row(spark, d):
    return budget.residual(costed(spark, d), by_cost(), F.col("cost"), 30000, ["cost"])


@query(f"WITH {LINES}, levels AS (SELECT 0 AS level, sum(strlen(line) + 1) AS cost FROM lines UNION ALL SELECT 1, sum(least(strlen(line), 40) + 1) FROM lines UNION ALL SELECT 2, sum(strlen(source) + 8) FROM (SELECT DISTINCT doc_id, source FROM lines) UNION ALL SELECT 3, sum(strlen(source) + 8) FROM (SELECT DISTINCT source FROM lines)) SELECT coalesce(min(CASE WHEN floor(cost / 4) <= 4000 THEN level END), max(level))::BIGINT AS level FROM levels")
def level_pick(spark, d):
    """The most detailed of four renderings that fits: lines, short lines, documents, sources."""
    every = doc_lines(spark, d)
    head = F.octet_length("source") + 8
    sums = [
        every.agg(F.sum(t.octets("line") + 1).alias("cost")),
        every.agg(F.sum(F.least(t.octets("line"), F.lit(40)) + 1).alias("cost")),
        every.select("doc_id", "source").distinct().agg(F.sum(head).alias("cost")),
        every.select("source").distinct().agg(F.sum(head).alias("cost")),
    ]
    levels = None
    for i, s in enumerate(sums):
        row = s.select(F.lit(i).cast("long").alias("level"), F.floor(F.col("cost") / 4).alias("cost"))
        levels = row if levels is None else levels.union(row)
    return budget.pick_level(levels, 4000)


@query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT unnest(range(0, (SELECT max(n) + 1 FROM s))) AS cap), x AS (SELECT cap, sum(least(n, cap)) AS rows FROM s, c GROUP BY 1) SELECT max(cap)::BIGINT AS cap FROM x WHERE rows <= 300")
def uniform_cap(spark, d):
    """The largest number of rows that every source may show within 300."""
    return budget.uniform_cap(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n", 300)


@query("WITH t AS (SELECT doc_id, strlen(text) + 1 AS cost FROM documents), k AS (SELECT sum(cost) AS kept FROM t WHERE doc_id % 97 = 0), r AS (SELECT doc_id, cost, sum(cost) OVER (ORDER BY cost DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM t WHERE doc_id % 97 <> 0) SELECT doc_id, cost::BIGINT AS cost FROM r, k WHERE floor((used + kept) / 4) <= 60000 UNION ALL SELECT doc_id, cost::BIGINT FROM t WHERE doc_id % 97 = 0")
def protected_tail(spark, d):
    return budget.protect_tail(costed(spark, d), by_cost(), F.col("cost"), F.col("doc_id") % 97 == 0, 60000)
