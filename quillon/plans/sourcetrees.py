"""Source files and code indexes made from the tables, with what must be found in them.

Each order is a source file with a definition for every line item; parts, suppliers
and line items are the files, symbols, imports and tests of made-up projects. The
SQL says the same of the rows themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import diff, extract, graph, index
from ..session import table
from .catalog import query
from .logbooks import ITEMS, order_texts, quoted, sql_of

# ------------------------------------------------------------- extraction


@dataclass(frozen=True)
class Source:
    """How a definition looks, its name, kind and lines within ``step`` lines behind ``skip``, and where it calls."""

    end: str
    item: str
    name: str
    kind: str
    step: int
    lines: int
    call_at: int | None = 1
    head: str = ""
    skip: int = 0


SOURCES = {
    "python": Source(".py", "def f{p}_{n}(a, b):\n    return g{s}(a) + b\n", "f{p}_{n}", "func", 3, 2),
    "script": Source(".ts", "export function f{p}_{n}(a, b) {\n  return g{s}(a) + b(a);\n}", "f{p}_{n}", "func", 3, 3),
    "go": Source(".go", "func F{p}_{n}(a int, b func(int) int) int {\n\treturn g{s}(a) + b(a)\n}", "F{p}_{n}", "func", 3, 3, 1, "package m\n\n", 2),
    "rust": Source(".rs", "pub fn f{p}_{n}(a: u32) -> u32 {\n    a\n}", "f{p}_{n}", "func", 3, 3, None),
    "c": Source(".c", "int f{p}_{n}(int a)\n{\n  return a;\n}", "f{p}_{n}", "func", 4, 4, None),
    "ruby": Source(".rb", "def f{p}_{n}(a)\n  a\nend", "f{p}_{n}", "func", 3, 3, None),
    "java": Source(".java", "public final class C{p}_{n} {\n  int a;\n}", "C{p}_{n}", "class", 3, 3, None, "package a;\n", 1),
    "shell": Source(".sh", "f{p}_{n}() {\n  ls\n}", "f{p}_{n}", "func", 3, 3, None, "#!/bin/sh\n", 1),
}


def source_files(spark, d, name: str):
    s = SOURCES[name]
    return order_texts(spark, d, s.item, s.head).select(F.concat(F.lit("src/m"), "id", F.lit(s.end)).alias("path"), "text")


def _add_symbols(name: str) -> None:
    s = SOURCES[name]

    def run(spark, d):
        return extract.symbols(source_files(spark, d, name)).select("path", "qualname", "kind", *(F.col(c).cast("long").alias(c) for c in ("line_start", "line_end", "exported", "depth")))

    run.__doc__ = f"Definitions of {name} files, one file an order."
    path = f"concat('src/m', id, '{s.end}')"
    sql = f"SELECT {path} AS path, concat({path}, '::', {sql_of(s.name)}) AS qualname, '{s.kind}' AS kind, {s.step} * (pos - 1) + {s.skip + 1} AS line_start, {s.step} * (pos - 1) + {s.skip + s.lines} AS line_end, 1::BIGINT AS exported, 0::BIGINT AS depth FROM items"
    query(f"WITH {ITEMS} {sql}", name=f"extract_symbols_{name}")(run)


def _add_calls(name: str) -> None:
    s = SOURCES[name]

    def run(spark, d):
        found = extract.relations(source_files(spark, d, name)).where("relation = 'call'")
        return found.select("path", F.col("line").cast("long").alias("line"), "name")

    run.__doc__ = f"Calls in {name} files; those of parameters are dynamic."
    path = f"concat('src/m', id, '{s.end}')"
    line = f"{s.step} * (pos - 1) + {s.skip + 1 + (s.call_at or 0)}"
    rows = f"SELECT {path} AS path, {line} AS line, {sql_of('g{s}')} AS name FROM items"
    if name != "python":
        rows += f" UNION ALL SELECT {path}, {line}, '<dynamic>' FROM items"
    query(f"WITH {ITEMS} {rows}", name=f"extract_calls_{name}")(run)


for _name, _source in SOURCES.items():
    _add_symbols(_name)
    if _source.call_at is not None:
        _add_calls(_name)


@query(f"WITH {ITEMS} SELECT concat('docs/m', id, '.md::', {sql_of('P{p}')}) AS qualname, 4 * pos - 3 AS line_start, 4 * pos AS line_end, 1::BIGINT AS depth FROM items UNION ALL SELECT concat('docs/m', id, '.md::', {sql_of('S{s}')}), 4 * pos - 1, 4 * pos, 2 FROM items")
def extract_sections(spark, d):
    """Sections of Markdown files, two for every line item."""
    files = order_texts(spark, d, "# P{p}\ntext\n## S{s} ##\nmore").select(F.concat(F.lit("docs/m"), "id", F.lit(".md")).alias("path"), "text")
    return extract.symbols(files).select("qualname", *(F.col(c).cast("long").alias(c) for c in ("line_start", "line_end", "depth")))


SECTIONS = "SELECT id, title, row_number() OVER (PARTITION BY id, title ORDER BY pos) AS occurrence, body FROM (SELECT id, pos, concat('P', CAST(p AS VARCHAR)) AS title, concat('# P', CAST(p AS VARCHAR), chr(10), 'q', CAST({q} AS VARCHAR)) AS body FROM items WHERE {where})"


@query(f"WITH {ITEMS}, o AS ({SECTIONS.format(q='q', where='true')}), n AS ({SECTIONS.format(q='CASE WHEN n = 2 THEN q + 100 ELSE q END', where='n <> 3')}) SELECT concat('docs/m', coalesce(o.id, n.id), '.md') AS path, coalesce(o.title, n.title) AS title, coalesce(o.occurrence, n.occurrence) AS occurrence, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.body = n.body THEN 'same' ELSE 'modified' END AS state FROM o FULL JOIN n ON o.id = n.id AND o.title = n.title AND o.occurrence = n.occurrence")
def section_changes(spark, d):
    """Sections of two versions of every document by level, title and occurrence."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q")).alias("x"))

    def version(rows, q):
        line = lambda x: F.concat(F.lit("# P"), x.p.cast("string"), F.lit("\nq"), q(x).cast("string"))
        files = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), line), "\n").alias("text"))
        return extract.sections(files.select(F.concat(F.lit("docs/m"), F.col("id").cast("string"), F.lit(".md")).alias("path"), "text"))

    old = version(items, lambda x: x.q)
    new = version(items.where("x.n != 3"), lambda x: F.when(x.n == 2, x.q + 100).otherwise(x.q))
    return diff.section_delta(old, new, ["path", "level", "title", "occurrence"], "body").select("path", "title", F.col("occurrence").cast("long").alias("occurrence"), "state")


# ------------------------------------------------------------- resolution

#: For each language: file of a part, another file of the same symbol (every third part), an importing file, and how it names the module.
TREES = {
    "python": ("lib/p{p}.py", "alt/p{p}.py", "app/o{o}.py", "lib.p{p}", "f{p}"),
    "script": ("lib/p{p}.ts", "alt/p{p}.ts", "app/sub/o{o}.ts", "../../lib/p{p}", "f{p}"),
    "go": ("lib/p{p}/x.go", "alt/p{p}/x.go", "app/o{o}.go", "example.org/mod/lib/p{p}", "f{p}"),
}


def _named(template: str, **columns):
    out = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        out.append(F.lit(piece) if i % 2 == 0 else F.col(columns[piece]).cast("string"))
    return F.concat(*out)


def _sql_named(template: str, **columns) -> str:
    pieces = template.replace("}", "{").split("{")
    return "concat(" + ", ".join(quoted(x) if i % 2 == 0 else f"CAST({columns[x]} AS VARCHAR)" for i, x in enumerate(pieces)) + ")"


def _add_resolution(name: str) -> None:
    own, other, user, module, symbol = TREES[name]

    def run(spark, d):
        parts = table(spark, d, "part").select(F.col("p_partkey").alias("p"))
        uses = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("o"), F.col("l_partkey").alias("p")).distinct()
        files = parts.select("p", _named(own, p="p").alias("file")).unionByName(parts.where("p % 3 = 0").select("p", _named(other, p="p").alias("file")))
        symbols = files.select(F.concat("file", F.lit("::"), _named(symbol, p="p")).alias("qualname"), F.lit("func").alias("kind"), "file", F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.lit(1).alias("exported"))
        refs = uses.select(_named(user, o="o").alias("from_file"), F.lit(1).alias("from_line"), _named(symbol, p="p").alias("to_name"), F.lit(None).cast("string").alias("to_symbol"), F.lit("call").alias("kind"), F.lit("heuristic").alias("confidence"), "p")
        imports = uses.where("p % 2 = 0").select(_named(user, o="o").alias("file"), F.lit(1).alias("line"), _named(module, p="p").alias("module"), _named(symbol, p="p").alias("symbol"), F.lit(None).cast("string").alias("alias"), "p")
        if name == "go":
            refs = refs.withColumn("qualifier", F.concat(F.lit("p"), F.col("p").cast("string")))
            modules = spark.createDataFrame([("", "example.org/mod")], "dir string, name string")
            found = index.resolve_refs(refs.drop("p"), symbols, imports.drop("p").withColumn("symbol", F.lit(None).cast("string")), None, modules)
        else:
            found = index.resolve_refs(refs.drop("p"), symbols, imports.drop("p"))
        return found.select("from_file", "to_name", "to_symbol", "confidence")

    run.__doc__ = f"Uses in {name} files: an import decides, else the only symbol of the name."
    target = f"concat({_sql_named(own, p='p')}, '::', {_sql_named(symbol, p='p')})"
    known = "p % 2 = 0 OR p % 3 <> 0"
    sql = f"WITH u AS (SELECT DISTINCT l_orderkey % 100 AS o, l_partkey AS p FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)) SELECT {_sql_named(user, o='o')} AS from_file, {_sql_named(symbol, p='p')} AS to_name, CASE WHEN {known} THEN {target} END AS to_symbol, CASE WHEN {known} THEN 'resolved' ELSE 'heuristic' END AS confidence FROM u"
    query(sql, name=f"resolved_refs_{name}")(run)


for _name in TREES:
    _add_resolution(_name)


# ------------------------------------------------------------ index queries


@query("SELECT concat('T', CAST(s AS VARCHAR)) AS owner, concat('I', CAST(k AS VARCHAR)) AS interface FROM (SELECT DISTINCT s_suppkey AS s FROM supplier), (SELECT unnest(range(2, 8)) AS k) WHERE s % k = 0 AND s % (k + 1) = 0")
def interface_implementations(spark, d):
    """Go types whose methods hold every method of an interface: type s has method m where m divides s, interface k wants k and k + 1."""
    owners = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"))
    methods = F.array_join(F.transform(F.filter(F.sequence(F.lit(2), F.lit(8)), lambda m: F.col("s") % m == 0), lambda m: F.concat(F.lit("func (t *T"), F.col("s").cast("string"), F.lit(") M"), m.cast("string"), F.lit("() {\n}\n"))), "")
    types = owners.select(F.concat(F.lit("m/t"), F.col("s").cast("string"), F.lit(".go")).alias("path"), F.concat(F.lit("package m\n\ntype T"), F.col("s").cast("string"), F.lit(" struct{}\n\n"), methods).alias("text"))
    wanted = F.concat(F.lit("package m\n\ntype I"), F.col("id").cast("string"), F.lit(" interface {\n\tM"), F.col("id").cast("string"), F.lit("()\n\tM"), (F.col("id") + 1).cast("string"), F.lit("()\n}\n"))
    interfaces = spark.range(2, 8).select(F.concat(F.lit("m/i"), F.col("id").cast("string"), F.lit(".go")).alias("path"), wanted.alias("text"))
    files = types.unionByName(interfaces)
    folder = t.dirname("path")
    local = F.split_part("qualname", F.lit("::"), F.lit(2))
    have = extract.symbols(files).where("kind = 'method'").select(folder.alias("dir"), F.split_part(local, F.lit("."), F.lit(1)).alias("owner"), t.last_segment("qualname").alias("method"))
    want = extract.relations(files).where("relation = 'iface-method'").select(folder.alias("dir"), F.col("name").alias("interface"), F.col("target").alias("method"))
    return index.division(have, want, "owner", "method", "interface", ["dir"]).select("owner", "interface")


def part_symbols(spark, d):
    """A function for each part, forty files, ten lines each; odd ones are exported."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("p"))
    file = F.concat(F.lit("src/f"), (F.col("p") % 40).cast("string"), F.lit(".py"))
    start = (F.floor(F.col("p") / 40) * 10 + 1).cast("int")
    return p.select(F.concat(file, F.lit("::g"), F.col("p").cast("string")).alias("qualname"), F.lit("func").alias("kind"), file.alias("file"), start.alias("line_start"), (start + 7).alias("line_end"), (F.col("p") % 2).cast("int").alias("exported"), "p")


PART_SYMBOLS = "SELECT concat('src/f', CAST(p_partkey % 40 AS VARCHAR), '.py') AS file, concat('src/f', CAST(p_partkey % 40 AS VARCHAR), '.py::g', CAST(p_partkey AS VARCHAR)) AS qualname, p_partkey // 40 * 10 + 1 AS a, p_partkey // 40 * 10 + 8 AS b, p_partkey AS p FROM part"


@query(f"SELECT qualname FROM ({PART_SYMBOLS}) s WHERE p % 2 = 0 AND p NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey % 3 <> 0) AND p NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3 AND l_partkey % 3 = 0) AND p % 40 <> 8")
def dead_symbols(spark, d):
    """Symbols that nothing uses: by target, by name, and outside tests; exported ones are left out."""
    symbols = part_symbols(spark, d)
    items = table(spark, d, "lineitem")
    name = F.concat(F.lit("g"), F.col("l_partkey").cast("string"))
    resolved = items.where("l_quantity > 45 and l_partkey % 3 != 0").select(F.concat(F.lit("src/f"), (F.col("l_partkey") % 40).cast("string"), F.lit(".py::"), name).alias("to_symbol"), name.alias("to_name"))
    loose = items.where("l_quantity < 3 and l_partkey % 3 = 0").select(F.lit(None).cast("string").alias("to_symbol"), F.concat(F.lit("x."), name).alias("to_name"))
    none = spark.createDataFrame([], "parent string, interface string")
    tests = spark.createDataFrame([("src/f8.py",)], "file string")
    return index.dead_symbols(symbols.drop("p"), resolved.unionByName(loose), none, none, tests).select("qualname")


@query(f"SELECT qualname, 'func' AS kind FROM ({PART_SYMBOLS}) WHERE p % 2 = 1")
def public_api_listing(spark, d):
    return index.public_api(part_symbols(spark, d), "src").select("qualname", "kind")


@query(f"SELECT qualname FROM ({PART_SYMBOLS}) WHERE p % 2 = 1 AND p % 40 NOT IN (SELECT s_suppkey % 40 FROM supplier WHERE s_suppkey % 3 = 0)")
def untested_symbols(spark, d):
    """Exported symbols of files that no test covers."""
    k = (F.col("s_suppkey") % 40).cast("string")
    tests = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("t/test_f"), k, F.lit(".py")).alias("test_file"), F.concat(F.lit("src/f"), k, F.lit(".py")).alias("target_file"))
    return index.untested(part_symbols(spark, d), tests).select("qualname")



@query(f"SELECT qualname FROM ({PART_SYMBOLS}) s WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT concat('src/f', CAST(l_suppkey % 40 AS VARCHAR), '.py') AS file, l_linenumber * CAST(l_quantity AS BIGINT) AS x FROM lineitem) h WHERE h.file = s.file AND h.x <= s.b AND h.x + 3 >= s.a)")
def changed_symbols(spark, d):
    """Symbols that a changed range touches, each once."""
    at = (F.col("l_linenumber") * F.col("l_quantity").cast("long")).cast("int")
    hunks = table(spark, d, "lineitem").select(F.concat(F.lit("src/f"), (F.col("l_suppkey") % 40).cast("string"), F.lit(".py")).alias("file"), at.alias("from_line"), (at + 3).alias("to_line"))
    return diff.changed_symbols(hunks.distinct(), part_symbols(spark, d).select("file", "line_start", "line_end", "qualname")).select("qualname")


@query("SELECT concat('tests/test_m', p, '.py') AS test_file, concat('src/m', p, '.py') AS target_file, 'convention' AS source FROM (SELECT CAST(p_partkey AS VARCHAR) AS p FROM part WHERE p_partkey % 3 = 0) UNION ALL SELECT concat('src/m', p, '_test.go'), concat('src/m', p, '.go'), 'convention' FROM (SELECT CAST(p_partkey AS VARCHAR) AS p FROM part WHERE p_partkey % 5 = 0) UNION ALL SELECT concat('web/m', p, '.spec.ts'), concat('src/m', p, '.js'), 'convention' FROM (SELECT CAST(p_partkey AS VARCHAR) AS p FROM part WHERE p_partkey % 7 = 0)")
def convention_tests(spark, d):
    """Tests and the sources that their names point to, within a language family."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("p"))
    sources = p.select(F.explode(F.array(*(F.concat(F.lit("src/m"), "p", F.lit(e)) for e in (".py", ".go", ".js")))).alias("path"))
    tests = [(3, "tests/test_m", ".py"), (5, "src/m", "_test.go"), (7, "web/m", ".spec.ts")]
    for k, a, b in tests:
        sources = sources.unionByName(p.where(F.col("p_partkey") % k == 0).select(F.concat(F.lit(a), "p", F.lit(b)).alias("path")))
    return index.convention_tests(sources)


def supplier_edges(spark, d):
    """Each supplier s from 2 on points at s // 2."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"))
    return s, s.where("s >= 2").select("s", F.floor(F.col("s") / 2).cast("long").alias("to"))


def _file(column: str, before: str = "f", after: str = ".py"):
    return F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after))


TREE = "WITH RECURSIVE r AS (SELECT 1::BIGINT AS s, 0 AS depth UNION ALL SELECT c.s_suppkey, depth + 1 FROM r JOIN supplier c ON c.s_suppkey // 2 = r.s AND c.s_suppkey >= 2 WHERE depth < 3)"


def _impact(spark, d):
    s, edges = supplier_edges(spark, d)
    symbols = s.select(F.concat(_file("s"), F.lit("::s"), F.col("s").cast("string")).alias("qualname"), F.lit("func").alias("kind"), _file("s").alias("file"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"))
    refs = edges.select(_file("s").alias("from_file"), F.lit(3).alias("from_line"), F.concat(F.lit("s"), F.col("to").cast("string")).alias("to_name"), F.concat(_file("to"), F.lit("::s"), F.col("to").cast("string")).alias("to_symbol"), F.lit("call").alias("kind"), F.lit("resolved").alias("confidence"))
    tests = s.where("s % 2 = 0").select(_file("s", "test_").alias("test_file"), _file("s").alias("target_file"), F.lit("coverage").alias("source"))
    return graph.impact("s1", refs, symbols, spark.createDataFrame([], "child string, parent string"), tests)


@query(f"{TREE} SELECT concat('f', CAST(s AS VARCHAR), '.py::s', CAST(s AS VARCHAR)) AS node, min(depth)::BIGINT AS depth FROM r GROUP BY 1")
def impact_of_change(spark, d):
    """What a change of one function reaches, three levels deep."""
    return _impact(spark, d)[0].select("node", F.col("depth").cast("long").alias("depth"))


@query(f"{TREE} SELECT DISTINCT concat('test_', CAST(s AS VARCHAR), '.py') AS test_file FROM r WHERE s % 2 = 0")
def impact_tests(spark, d):
    return _impact(spark, d)[1]


@query(
    """WITH changed AS (SELECT s_suppkey AS s FROM supplier WHERE s_suppkey % 10 = 0),
kids AS (SELECT c.s_suppkey AS s FROM supplier c JOIN changed ON c.s_suppkey // 2 = changed.s AND c.s_suppkey >= 2),
tests AS (SELECT s_suppkey AS s, s_suppkey % 3 = 0 AS covers, s_suppkey % 2 = 0 AS named FROM supplier),
all_ AS (SELECT t.s, 0 AS rank FROM tests t JOIN changed USING (s) WHERE covers UNION ALL SELECT t.s, 2 FROM tests t JOIN changed USING (s) WHERE named
UNION ALL SELECT s, 3 FROM (SELECT s FROM changed UNION SELECT s FROM kids) x WHERE s % 5 = 0 AND (s % 3 = 0 OR s % 2 = 0))
SELECT concat('t', CAST(s AS VARCHAR), '.py') AS test_file, min(rank)::BIGINT AS rank FROM all_ GROUP BY 1"""
)
def tests_for_change(spark, d):
    """Tests of changed files by layer of trust: recorded coverage, names, imports that lead to a test."""
    s, edges = supplier_edges(spark, d)
    of = lambda kind: F.lit(kind).alias("source")
    tests = s.where("s % 3 = 0").select(_file("s", "t").alias("test_file"), _file("s").alias("target_file"), of("coverage")).unionByName(s.where("s % 2 = 0").select(_file("s", "t").alias("test_file"), _file("s").alias("target_file"), of("convention")))
    imports = edges.select(_file("s").alias("src"), _file("to").alias("dst")).unionByName(s.where("s % 5 = 0").select(_file("s", "t").alias("src"), _file("s").alias("dst")))
    found = graph.tests_for(s.where("s % 10 = 0").select(_file("s").alias("path")), tests, imports)
    return found.select("test_file", F.col("rank").cast("long").alias("rank"))


@query("SELECT DISTINCT concat('tests.t', s, '.C', n, '.m') AS context, CASE WHEN n = '1' AND CAST(s AS BIGINT) % 4 = 0 THEN concat('tests/t', s, '/C1.py') ELSE concat('tests/t', s, '.py') END AS path FROM (SELECT CAST(l_suppkey AS VARCHAR) AS s, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem)")
def context_prefixes(spark, d):
    """The test file whose dotted name is the longest beginning of a recorded context."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"))
    files = s.select(F.concat(F.lit("tests/t"), F.col("s").cast("string"), F.lit(".py")).alias("path")).unionByName(s.where("s % 4 = 0").select(F.concat(F.lit("tests/t"), F.col("s").cast("string"), F.lit("/C1.py")).alias("path")))
    contexts = table(spark, d, "lineitem").select(F.concat(F.lit("tests.t"), F.col("l_suppkey").cast("string"), F.lit(".C"), F.col("l_linenumber").cast("string"), F.lit(".m")).alias("context")).distinct()
    return index.longest_prefix(contexts, "context", files, "path").select("context", "path")


def dated_imports(spark, d, module: str, symbol: str | None):
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 50).alias("k")).distinct()
    name = F.lit(None).cast("string") if symbol is None else F.concat(F.lit(symbol), F.col("line").cast("string"))
    return items.select(F.concat(F.lit("a/m"), F.col("s").cast("string"), F.lit(".py")).alias("file"), "line", F.concat(F.lit(module), F.col("k").cast("string")).alias("module"), name.alias("symbol"), "k")


@query("SELECT concat('a/m', CAST(s AS VARCHAR), '.py') AS src, concat(CASE WHEN k % 2 = 0 THEN 'a/h' ELSE 'b/h' END, CAST(k AS VARCHAR), '.py') AS dst, min(line)::BIGINT AS line FROM (SELECT l_suppkey AS s, l_linenumber AS line, l_partkey % 50 AS k FROM lineitem) GROUP BY 1, 2")
def import_edges(spark, d):
    """Modules to files by their last name, those of the importer's folder first."""
    k = spark.range(50).select(F.col("id").alias("k"))
    files = k.where("k % 2 = 0").select(_file("k", "a/h").alias("path")).unionByName(k.select(_file("k", "b/h").alias("path")))
    return index.import_edges(dated_imports(spark, d, "pkg.h", None), files).select("src", "dst", F.col("line").cast("long").alias("line"))


PACKAGES = "SELECT DISTINCT concat('a/m', CAST(l_suppkey AS VARCHAR), '.py') AS file, concat('pkg', CAST(l_partkey % 50 AS VARCHAR)) AS module, concat('x', CAST(l_linenumber AS VARCHAR)) AS symbol, l_partkey % 50 AS k, l_linenumber AS n FROM lineitem"


@query(f"WITH i AS ({PACKAGES}) SELECT file, module, symbol, concat(CASE WHEN k % 2 = 0 THEN 'a/' WHEN k % 3 = 0 THEN '' ELSE 'z/' END, module, '/__init__.py') AS target_file FROM i WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0 UNION ALL SELECT file, module, symbol, concat('a/', module, '/x1.py') FROM i WHERE k % 2 = 0 AND n = 1")
def package_targets(spark, d):
    """What an import of a package names: beside the importer, from the root, or the only one with that end."""
    k = spark.range(50).select(F.col("id").alias("k"))
    init = "/__init__.py"
    parts = [k.where("k % 2 = 0").select(_file("k", "a/pkg", init).alias("path")), k.where("k % 3 = 0").select(_file("k", "pkg", init).alias("path")), k.where("k % 5 = 0 and k % 2 != 0 and k % 3 != 0").select(_file("k", "z/pkg", init).alias("path")), k.where("k % 2 = 0").select(_file("k", "a/pkg", "/x1.py").alias("path"))]
    files = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return index.package_targets(dated_imports(spark, d, "pkg", "x").drop("k"), files).select("file", "module", "symbol", "target_file")


@query("SELECT 'python' AS family, concat('pytest ', string_agg(concat('tests/test_', n_name, '.py'), ' ' ORDER BY concat('tests/test_', n_name, '.py'))) AS command FROM nation UNION ALL SELECT 'go', concat('go test ', string_agg(DISTINCT concat('./r', CAST(n_regionkey AS VARCHAR)), ' ' ORDER BY concat('./r', CAST(n_regionkey AS VARCHAR)))) FROM nation")
def run_commands(spark, d):
    """One command a language family over its test files."""
    n = table(spark, d, "nation")
    files = n.select(F.concat(F.lit("tests/test_"), "n_name", F.lit(".py")).alias("path")).unionByName(n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name", F.lit("_test.go")).alias("path")))
    return index.run_commands(files)


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'vitest' WHEN 1 THEN 'jest' WHEN 2 THEN 'pytest' WHEN 3 THEN 'go test' WHEN 4 THEN 'jest' END AS runner FROM orders")
def test_runners(spark, d):
    """The runner that config files or a manifest name."""
    k = (F.col("o_orderkey") % 6 + 1).cast("int")
    kinds = [("vitest.config.ts", "jest.config.js"), ("jest.config.js",), ("conftest.py",), ("go.mod",), (), ()]
    names = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in kinds)), k)
    manifest = F.when(k == 5, '{"jest": {}}').when(k == 6, "{}")
    return table(spark, d, "orders").select("o_orderkey", index.test_runner(names, manifest).alias("runner"))
