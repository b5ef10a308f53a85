"""Ground truth and properties of the digest operators."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators import blocks, budget, diff, events, extract, graph, index, intervals, profile, project, search, shell, tokens
from quillon.sources import readers, sinks
from quillon.streaming import fold
from tests import ground_truth as X


def values(spark, column, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(column).collect()]


def test_templates(spark):
    col = t.template("x", t.timestamp_format(F.lit("2024-01-02T03:04:05Z x")))
    got = values(spark, col, "2024-01-02T03:04:05Z GET /api/7 took 12 ms", "WARN miss for deadbeef01", "n 12345678 'a b' 0a1b2c3d-0000-1111-2222-333344445555")
    assert got == ["GET /api/<n> took <n> ms", "WARN miss for <hex>", "n <n> <str> <uuid>"]
    assert values(spark, t.timestamp_format("x"), "Jan  2 03:04:05 h", "1700000000 x", "[02/Jan/2024:03:04:05 +0]", "none") == ["syslog", "epoch", "clf", None]


def test_cells(spark):
    assert values(spark, t.cell_kind("x"), "", " ", "1", "-2.5", "1e3", "TRUE", "2024-01-01x", "abc", None) == ["null", "str", "int", "float", "float", "bool", "date", "str", "null"]


def test_lines(spark):
    assert values(spark, t.line_array("x"), "a\r\nb\rc\n", "", "a\x0cb") == [["a", "b", "c"], [], ["a\x0cb"]]
    assert values(spark, t.line_count("x"), "", "a", "a\n", "a\nb") == [0, 1, 1, 2]


def test_paths(spark):
    ps = ["src/auth.py", "a/node_modules/x.js", "tests/test_core.py", "generated/bundle.min.js", "x/conftest.py", "a\\tests\\b.py", ".bashrc"]
    assert values(spark, t.path_class("x"), *ps) == ["src", "generated", "tests", "generated", "tests", "tests", "src"]
    assert values(spark, t.extension("x"), "a/b.TAR.gz", ".bashrc", "a.b/c") == [".gz", "", ""]
    assert values(spark, t.stem("x"), "a/b.tar.gz", ".bashrc") == ["b.tar", ".bashrc"]
    assert values(spark, t.ancestors("x"), "a/b/c.txt") == [["a/", "a/b/"]]
    assert values(spark, t.line_range("x"), "3-9", "9-3", "0", "x") == [(3, 9), (3, 9), (1, 1), None]
    assert values(spark, t.matches_glob("x", "*.p[!x]"), "a/b.py", "a.px", "a.pyc") == [True, False, False]


def test_search_ground_truth(spark):
    rows = [("src/auth.py", 9), ("src/core.py", 4), ("tests/test_core.py", 5), ("generated/bundle.min.js", 12)]
    found = spark.createDataFrame([(p,) for p, n in rows for _ in range(n)], "path string")
    ranked = search.rank_groups(search.counts(found, "path"), "path", t.class_weight(t.path_class("path"))).orderBy("position").collect()
    assert [(r.path, round(r.score, 6)) for r in ranked] == [("src/auth.py", 9.0), ("src/core.py", 4.0), ("tests/test_core.py", 2.5), ("generated/bundle.min.js", 2.4)]


def test_column_profile(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,score,active\n1,Alice,1,true\n2,Bob,4.25,false\n3,Carl,,true\n4,Dora,2.5,\n5,Eve,3,true\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    got = {r.column: r for r in profile.columns(df, df.columns).collect()}
    assert (got["id"].type, got["id"].num_min, got["id"].num_max, got["id"].distinct_capped) == ("int", 1.0, 5.0, 5)
    assert (got["score"].type, got["score"].null_pct, got["score"].num_max, got["score"].distinct_capped) == ("float", 20, 4.25, 4)
    assert (got["active"].type, got["active"].null_pct, got["active"].distinct_capped) == ("bool", 20, 2)
    assert (got["name"].str_min, got["name"].str_max) == ("Alice", "Eve")
    mixed = spark.createDataFrame([("1",), ("x",), ("y",), ("2.5",)], "c string")
    assert profile.columns(mixed, ["c"]).first().type == "mixed(str|float|int)"


def test_json_profile(spark):
    rows = [(i, json.dumps({"user": f"u{i}", "age": i, **({"email": "x"} if i < 3 else {}), "tags": ["a"] * i, "n": {"k": None}})) for i in range(5)]
    paths = profile.json_paths(spark.createDataFrame(rows, "id long, doc string"), "doc", ["id"])
    got = {r.path: (r.n, r.kinds, r.presence_pct, r.len_min, r.len_max) for r in profile.path_profile(paths).collect()}
    assert got["$.email"] == (3, "str", 60, None, None) and got["$.age"][:3] == (5, "int", 100) and got["$.tags"] == (5, "array", 100, 0, 4)
    assert got["$.tags[]"][0] == 10 and got["$.n.k"][:3] == (5, "null", 100)


def test_project(spark):
    assert project.parse("a.b[0].c") == ["a", "b", 0, "c"] and project.json_path("a[1]") == "$['a'][1]"
    for bad in ("", "a..b", "a[", "[-1]", "a[x]"):
        with pytest.raises(project.PathError):
            project.json_path(bad)
    assert project.check("[-1].a", records=True) == [-1, "a"]
    df = spark.createDataFrame([('{"a": {"b": [1, "x"]}, "n": null}',), ("broken",)], "j string")
    got = df.select(F.try_parse_json("j").alias("d")).select(project.cell("d", "a.b[1]"), project.cell("d", "n"), project.cell("d", "zz"), project.cell("d", "a.b"), project.raw("d", "a")).collect()
    assert tuple(got[0]) == ("x", "null", "", '[1,"x"]', '{"b":[1,"x"]}')
    nums = spark.range(5)
    assert [r.id for n in (0, 4, -1, -5) for r in project.nth(nums, ["id"], n).collect()] == [0, 4, 4, 0]
    assert project.nth(nums, ["id"], 5).collect() == [] and project.nth(nums, ["id"], -6).collect() == []


def test_rollup(spark):
    df = spark.createDataFrame([("a.txt", 400), ("sub/b.txt", 200), ("sub/c.txt", 100)], "path string, bytes long").withColumn("tokens", t.tokens_of_bytes("bytes"))
    got = {r.path: r.total for r in tokens.rollup_paths(df, "path", "tokens").collect()}
    assert got == {"a.txt": 108, "sub/": 81, "sub/b.txt": 54, "sub/c.txt": 27}
    shares = {r.path: r.share_pct for r in tokens.share(df, "bytes").collect()}
    assert shares == {"a.txt": 57.1, "sub/b.txt": 28.6, "sub/c.txt": 14.3}


@pytest.mark.parametrize("limit", [0, 5, 40, 200, 10_000])
def test_budget_adds_up(spark, limit):
    df = spark.createDataFrame([(i, (i * 37) % 91 + 1) for i in range(40)], "id int, cost int")
    order = [F.desc("cost"), F.col("id")]
    shown = budget.fit(df, order, F.col("cost"), limit).count()
    rest = budget.residual(df, order, F.col("cost"), limit, ["cost"]).first()
    assert rest.shown == shown and rest.shown + rest.omitted == 40
    kept = budget.fit(df, order, F.col("cost"), limit).agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    assert kept // 4 <= limit and kept + rest.omitted_cost == sum((i * 37) % 91 + 1 for i in range(40))
    more = budget.fit(df, order, F.col("cost"), limit * 2 + 1).count()
    assert more >= shown


def test_uniform_cap(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9)], "g string, n long")
    for limit in range(0, 17):
        want = max(c for c in range(0, 10) if sum(min(n, c) for n in (1, 5, 9)) <= limit)
        assert budget.uniform_cap(sizes, "g", "n", limit).first().cap == want, limit


def test_intervals(spark):
    spans = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 10, 50, "mid"), ("f", 20, 30, "in"), ("g", 1, 9, "g")], "file string, s int, e int, name string")
    points = spark.createDataFrame([("f", 25), ("f", 40), ("f", 99), ("g", 25)], "file string, line int")
    got = intervals.innermost(points, ["file", "line"], "line", spans, "s", "e", ["file"], 7)
    assert sorted((r.line, r.name) for r in got.collect()) == [(25, "in"), (40, "mid"), (99, "outer")]
    out = intervals.point_join(points, "line", spans, "s", "e", ["file"], 7, "left_anti")
    assert [(r.file, r.line) for r in out.collect()] == [("g", 25)]
    merged = intervals.merge(spark.createDataFrame([(1, 5), (6, 8), (7, 7), (10, 12)], "a int, b int").withColumn("k", F.lit(1)), ["k"], "a", "b")
    assert sorted((r.a, r.b, r.n_merged) for r in merged.collect()) == [(1, 8, 3), (10, 12, 1)]


def test_blocks_tile(spark):
    spans = spark.createDataFrame([("a", 5, 60, 100), ("a", 30, 50, 100), ("b", 1, 3, 3)], "f string, start int, end int, n int")
    for f, n in (("a", 100), ("b", 3)):
        rows = sorted((r.start, r.end) for r in blocks.blocks(spans, "f", "n").where(F.col("f") == f).collect())
        assert rows[0][0] == 1 and rows[-1][1] == n and all(x[1] + 1 == y[0] for x, y in zip(rows, rows[1:]))
    assert values(spark, blocks.windows(F.length("x")), "", "a" * 45) == [[], [(1, 20), (21, 40), (41, 45)]]


SEED = {
    "files": [(p, "python", 0.0, "") for p in ("a.py", "b.py", "c.py", "d.py", "e.py", "solo.py", "test_a.py")],
    "symbols": [(1, "a.py::Alpha", "class", "a.py", 1, 10, 1), (2, "b.py::Beta", "class", "b.py", 1, 10, 1), (3, "a.py::covered_fn", "func", "a.py", 12, 14, 1), (4, "solo.py::lonely", "func", "solo.py", 1, 2, 1)],
    "inherits": [(1, "a.py", 1, "Alpha", "Beta"), (2, "b.py", 1, "Beta", "Alpha"), (3, "a.py", 1, "Alpha", "ExternalBase")],
    "imports": [(i, f"{a}.py", 1, b, None, None) for i, (a, b) in enumerate(["ab", "bc", "ca", "de", "ed"])],
    "tests": [(1, "test_a.py", "a.py", "import")],
}


def test_seeded_index(spark):
    x = index.create(spark, SEED)
    edges = x["imports"].select(F.col("file").alias("src"), F.concat("module", F.lit(".py")).alias("dst"))
    assert [r.members for r in graph.cycles(edges).collect()] == [["d.py", "e.py"], ["a.py", "b.py", "c.py"]]
    assert sorted(r.qualname for r in index.untested(x["symbols"], x["tests"]).collect()) == ["b.py::Beta", "solo.py::lonely"]
    assert [(r.node, r.depth) for r in graph.hierarchy(x["inherits"], "Alpha").collect()] == [("Beta", 1)]
    assert sorted((r.node, r.depth) for r in graph.hierarchy(x["inherits"], "ExternalBase").collect()) == [("Alpha", 1), ("Beta", 2)]
    assert [r.qualname for r in index.symbol_match(x["symbols"], "Alpha").collect()] == ["a.py::Alpha"]
    assert spark.sql("SELECT language, count(*) AS n FROM symbols JOIN files ON path = file GROUP BY language").first().n == 4


def test_components_both_ways(spark):
    import random

    r = random.Random(4)
    pairs = [(str(r.randint(0, 14)), str(r.randint(0, 14))) for _ in range(26)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    one = sorted(map(tuple, graph.strong_components(df).collect()))
    many = sorted(map(tuple, graph.strong_components(df, one_task=0).collect()))
    group = lambda rows: sorted(sorted(n for n, c in rows if c == k) for k in {c for _, c in rows})
    assert group(one) == group(many)


def test_change_set_and_replace(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], "path string, m int, h string")
    new = spark.createDataFrame([("a", 1, "y"), ("b", 2, "x"), ("c", 2, "y"), ("e", 1, "x")], "path string, m int, h string")
    assert {r.path: r.state for r in index.change_set(old, new, "path", "m", "h").collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "removed", "e": "new"}
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file string, v int")
    out = index.replace_by_file(table, spark.createDataFrame([("b", 9)], "file string, v int"), spark.createDataFrame([("c",)], "file string"))
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 9)]
    tests = spark.createDataFrame([("t.py", "a", "coverage"), ("t.py", "z", "coverage"), ("t.py", "a", "import")], "test_file string, target_file string, source string")
    assert sinks.drop_derived(tests, spark.createDataFrame([("t.py",), ("a",)], "path string")).count() == 1


def test_lookup(spark):
    s = spark.createDataFrame([("a::X.run",), ("b::Y.run",), ("a::X",)], "qualname string")
    assert [(r.qualname, r.ambiguous) for r in index.symbol_lookup(s, "X").collect()] == [("a::X", False)]
    assert all(r.ambiguous for r in index.symbol_lookup(s, "run").collect())


def test_extract(spark):
    got = {r.qualname: (r.kind, r.line_start, r.line_end, r.exported) for r in extract.symbols(X.file_rows(spark)).collect()}
    assert got["py/shapes.py::Shape"] == ("interface", 7, 10, 1) and got["py/shapes.py::Circle.area"] == ("method", 17, 18, 1)
    assert got["py/shapes.py::SIDES"][0] == "const" and got["py/app.py::_unused"][3] == 0
    assert got["js/api.ts::Api"][:3] == ("class", 2, 6) and got["js/api.ts::run"][0] == "func" and got["js/api.ts::inner"][3] == 0
    assert got["go/store.go::Store"][0] == "interface" and got["go/store.go::Mem.Get"] == ("method", 14, 16, 1)
    assert got["src/lib.rs::start"] == ("func", 5, 7, 1) and got["src/util.c::add"] == ("func", 5, 8, 0)
    sections = extract.markdown_sections(dict(X.FILES)["docs/guide.md"])
    assert sections == [(0, "", 1, 2), (1, "Guide", 3, 14), (2, "Install", 7, 12), (2, "Use", 13, 14), (1, "Notes", 15, 15)]
    refs = {(r.from_file, r.to_name): r.to_symbol for r in X.resolved_refs(spark, "").collect()}
    assert refs["py/app.py", "C"] == "py/shapes.py::Circle" and refs["py/app.py", "square"] == "py/shapes.py::square" and refs["py/app.py", "helper"] == "py/app.py::helper" and refs["py/app.py", "print"] is None
    assert [(r.owner, r.interface) for r in X.interface_implementations(spark, "").collect()] == [("Mem", "Store")]
    assert "py/app.py::_unused" in {r.qualname for r in X.dead_symbols(spark, "").collect()}
    assert extract.signature("def f(\n  a,\n  b,\n):\n  pass", 1) == "def f( a, b, )"


def test_diff_bodies():
    assert diff.body_details("x = 3\nreturn x", "x = 5\nreturn x") == ["3 -> 5"]
    assert diff.body_details("go()", "if ok:\n  go()\n  stop()") == ["+ if ok:", "calls stop"]
    assert diff.is_mechanical("def f( a ):\n  return a", "def f(a):\n    return a  # x", "b.py") and not diff.is_mechanical("a = 1", "a = 2", "b.py")
    assert diff.is_mechanical("import a\nimport b\nx()", "import b\nimport a\nx()", "d.js") and diff.is_mechanical("f( 1 ) // x", "f(1)", "e.js")
    assert diff.skeleton("a = '# no' # yes\nb /* c */ d") == "a='# no'b d"
    files = diff.split_diff("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n--- b\n+++ c\ndiff --git a/y b/y\nnew file mode 100644\n")
    assert files == [(1, "x", 1, 1, 1, ""), (2, "y", 0, 0, 0, "new")]


def test_shell():
    for command, want in [("grep -rn foo .", "search"), ("grep -rn foo . | head -5", "ok"), ("cat x.json", "read"), ("cat x | wc -l", "ok"), ("sed -n '1,200p' a", "range: long range"), ("tail -n +5 x", "range: open range"), ("git log", "git log"), ("git log -n 5", "ok"), ("git diff --stat", "ok"), ("git log; ls | head", "git log"), ("echo 'cat x'", "ok"), ("git log > f", "ok"), ("cat <<'E'\ngit log\nE\n", "ok")]:
        assert shell.classify(command) == want or (want == "ok" and command.startswith("cat <<")), command
    assert shell.classify("head -n 50 x", 55) == "range: most of the file"
    held = "a 'b \"c' \"d\\\"e\" <<X\nq r\nX\n"
    assert len(shell.mask_quotes(held)) == len(held) and "q r" not in shell.mask_quotes(held)


def test_only_queries_run(spark):
    for sql in ("DROP TABLE x", "insert into x values (1)", "-- c\nUPDATE x SET a = 1", "/* c */ create table y as select 1"):
        with pytest.raises(ValueError):
            shell.query_only(spark, sql)
    assert shell.query_only(spark, "WITH a AS (SELECT 1 AS n) SELECT n FROM a").first().n == 1


TOOLS = ["profile", "search", "excerpt", "sizes"]
EVENTS = [
    ("2024-01-01", 3, "profile", "m", "s1", "/", "f", 100, 1000),
    ("2024-01-02", 3, "profile", "", "s1", "/", "f", 50, None),
    ("2024-01-03", 3, "excerpt", "m2", "s2", "/", "f", 10, 0),
    ("2024-01-04", 1, "search", "m", "s2", "/", "x -C 2", 10, 500),
    ("2024-01-05", 2, "search", "m", "s2", "/", "x -C 2", 10, 500),
    ("2024-01-06", 3, "unknown", "m", "s3", "/", "f", 1, 1),
]


def test_call_log(spark):
    e = spark.createDataFrame(EVENTS, events.SCHEMA)
    domain = spark.createDataFrame([(x,) for x in TOOLS], "tool string")
    rows = {r.tool: r for r in events.saved(events.zero_fill(events.fold(e), domain)).collect()}
    assert len(rows) == len(TOOLS) and "unknown" not in rows
    assert (rows["profile"].calls, rows["profile"].credited, rows["profile"].saved, rows["profile"].avg_saved) == (2, 1, 900, 900.0)
    assert (rows["search"].credited, rows["search"].saved, rows["excerpt"].credited, rows["excerpt"].avg_saved, rows["sizes"].calls) == (1, 490, 0, None, 0)
    assert {r.session: r.model for r in events.last_model(e).collect()}["s1"] == "m"


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    names = events.SCHEMA.replace("string", "").replace("long", "").replace("int", "").split(",")
    keys = [n.strip() for n in names]
    for i in range(0, len(EVENTS), 2):
        lines = [json.dumps(dict(zip(keys, r))) for r in EVENTS[i : i + 2]]
        (source / f"{i}.json").write_text("\n".join(lines) + ('\n{"ts": "torn' if i == 0 else "") + "\n")
    got = fold.fold_stream(fold.read_log(spark, str(source)), "folded", str(tmp_path / "cp"))
    want = events.fold(spark.createDataFrame(EVENTS, events.SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, events.fold(readers.read_events(spark, str(source), events.SCHEMA)).collect())) == sorted(map(tuple, want.collect()))


def test_stream_windows(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 0, m), "s") for m in (0, 1, 9, 30)]
    spark.createDataFrame(rows, "ts timestamp, session string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, session string").parquet(str(tmp_path / "in"))
    for i, out in enumerate((fold.windowed(stream, "ts", "10 minutes", "1 hour", "session"), fold.sessions(stream, "ts", "5 minutes", "1 hour", "session"))):
        q = out.writeStream.outputMode("complete").format("memory").queryName(f"w{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r.n for r in spark.table(f"w{i}").collect()) == ([1, 3] if i == 0 else [1, 1, 2])


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("\ufeffx = 1\n")
    (tmp_path / "a" / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "y.js").write_text("y")
    assert [r.text for r in readers.read_files(spark, str(tmp_path)).collect()] == ["x = 1\n"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "l.jsonl")).collect()
    assert sorted(r.bad for r in rows) == [False, False, True]
    (tmp_path / "s.csv").write_text("a,b\n1\n,x\n")
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "s.csv")).collect())) == [("", "x"), ("1", "")]
    files = spark.createDataFrame([("a.toml", "[t]\na = 1\n"), ("b", "[x]\nnot = = toml\n"), ("c.json", '{"k": [1]}')], "path string, text string")
    parsed = {r.path: (r.format, r.d) for r in readers.parse(readers.detect(files)).select("path", "format", F.to_json("doc").alias("d")).collect()}
    assert parsed == {"a.toml": ("toml", '{"t":{"a":1}}'), "b": ("log", None), "c.json": ("json", '{"k":[1]}')}
    (tmp_path / "d.xml").write_text("<r><b i='1'/><b i='2'/></r>")
    assert readers.read_xml(spark, str(tmp_path / "d.xml"), "b").count() == 2
    hits = [json.dumps({"type": "match", "data": {"path": {"text": ".\\a\\b.py"}, "lines": {"text": "x\n"}, "line_number": i}}) for i in range(5)] + ["torn"]
    got = readers.search_events(spark.createDataFrame([(h,) for h in hits], "value string"), 3).collect()
    assert len(got) == 3 and {r.path for r in got} == {"a/b.py"}
    status = ["# branch.oid abc", "# branch.ab +2 -1", "1 M. N... 100644 100644 100644 h1 h2 a.py", "1 .M N... 100644 100644 100644 h1 h2 b c.py", "? new.txt"]
    rows = {(r.section, r.code, r.path) for r in readers.status_rows(spark.createDataFrame([(x,) for x in status], "value string")).collect()}
    assert {("staged", "M", "a.py"), ("unstaged", "M", "b c.py"), ("untracked", "?", "new.txt"), ("branch", "ab", "+2 -1")} <= rows
    nums = readers.numstat_rows(spark.createDataFrame([("3\t1\ta.py",), ("-\t-\tb.png",)], "value string")).collect()
    assert [tuple(r) for r in nums] == [("a.py", 3, 1, False), ("b.png", 0, 0, True)]
    assert values(spark, readers.ignored(F.col("x"), ["*.log", "build/", "# no"]), "a/b.log", "a/build/c", "src/x") == [True, True, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", [1, 2]), (2, None, None)], "i int, s string, l array<int>")
    assert [r.value for r in sinks.as_tsv(df).collect()] == ["1\ta b\t[1,2]", "2\t\t"]
    with pytest.raises(sinks.OverBudget):
        sinks.refuse_over(sinks.as_tsv(df), 1)
    sinks.write_tsv(df, str(tmp_path / "o"), 100)
    assert json.loads(sinks.as_json(df.where("i = 1")).first().value) == {"i": 1, "s": "a\tb", "l": [1, 2]}
    assert json.loads(sinks.as_json(df.select("i", F.lit("g").alias("g")), "g").first().value) == {"title": "g", "items": [{"i": 1}, {"i": 2}]}
    sinks.append(df, str(tmp_path / "e"))
    sinks.append(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 4
    sinks.save(df, str(tmp_path / "p"), ["i"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert len(sinks.as_table(df.select("i"), 5).first().value) == 5


def test_lint(spark):
    rows = [("go.sum", 10, 1, 5), ("a.min.js", 10, 1, 5), ("x.js", 10, 1, 900), ("d.json", 10, 9000, 5), ("b.py", 10, 9000, 5), ("c.py", 10, 1, 5)]
    df = spark.createDataFrame(rows, "p string, size int, tok int, line int")
    rule = tokens.lint(F.col("p"), F.col("size"), F.col("tok"), F.col("line"), F.col("line").cast("double"))
    assert [r[0] for r in df.select(rule).collect()] == ["LOCKFILE", "MINIFIED", "MINIFIED", "BIG-DATA", "BIG-FILE", None]
    probe = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"a\0b"),), (bytearray(bytes(range(1, 9)) * 3),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in probe.select(tokens.binary_probe(F.col("c"))).collect()] == [False, True, True, False]
