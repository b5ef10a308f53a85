"""Comparing versions, reading logs and resolving names: cases whose answers are known."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pytest

import __spark_entry__ as entry
from quillon import session
from quillon.operators import budget, diff, extract, graph, index, intervals, logs, profile, search, tokens
from quillon.plans import catalog


def test_skeleton_knows_languages():
    same = lambda a, b, path: diff.is_mechanical(a, b, path)
    assert not same("#define A 1", "#define A 2", "x.c") and not same("this.#count = 1", "this.#count = 99", "a.js")
    assert same("a = 1 # x", "a  =  1 # y", "a.rb") and not same("a = 1 # x", "a = 1 # y", "a.go")
    assert not same('u = "https://a"', 'u = "https://b"', "a.ts") and same("f(1) // a", "f( 1 ) /* b */", "a.java")
    assert not same("s.match(/a \\/\\/ b/)", "s.match(/a \\/\\/ c/)", "a.js") and not same("return /[/ ]x/", "return /[/]x/", "a.ts")
    assert same("y / 2 // half", "y / 2 // other", "a.js") and not same("int x", "intx", "a.c")
    assert same("select 1 -- a", "select 1 -- b", "a.sql") and not same("a -- b", "a -- c", "a.js")


def test_cargo_log():
    noise = "warning: build failed, waiting for other jobs to finish...\nerror[E0308]: mismatched types\n --> src/a.rs:1:2\n".split("\n")
    assert [p[:2] for p in logs.cargo_log(noise)] == [("error[E0308]: mismatched types", "src/a.rs:1")]
    inner = "---- t::x stdout ----\nerror: printed by the test\nthread 't::x' panicked at src/b.rs:3:4:\nno\n\nfailures:\n    t::x\n\nerror: test failed, to rerun pass `--lib`\n".split("\n")
    assert [p[:2] for p in logs.cargo_log(inner)] == [("FAIL t::x", "src/b.rs:3")]


def test_cc_notes():
    rows = ["m.c:1:2: error: a", "  1 | x", "m.h:3:1: note: here", "  3 | y", "", "m.h:9:1: note: alone", "1 error generated."]
    assert logs.cc_log(rows) == [("error: a", "m.c:1", ["  1 | x", "m.h:3:1: note: here", "  3 | y"]), ("note: alone", "m.h:9", [])]
    assert len(logs.cc_log(["m.c:1:2: error: a", *["  x"] * 20])[0][2]) == logs.CONTEXT


def test_warnings_and_failures(spark):
    lines = spark.createDataFrame([("a", x) for x in ("0 warnings", "no warnings", "warn: x", "2 Warnings", "prewarned")], "k string, line string")
    assert logs.warnings_in(lines, "k").first().n_warnings == 2
    assert logs.FAILURE.match("FAIL x") and logs.FAILURE.match("FAILED x") and not logs.FAILURE.match("FAILOVER is off")


def test_overlapping_on_repeated_and_open_rows(spark):
    left = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (1, 300, 900), (2, 1, 5), (1, None, 5), (3, 7, 7)], "k int, a int, b int")
    right = spark.createDataFrame([(1, 5, 6), (1, 880, 890), (3, 8, 9)], "k int, c int, d int")
    got = lambda anti: sorted(map(tuple, intervals.overlapping(left, right, "a", "b", "c", "d", ["k"], 100, anti).collect()), key=str)
    assert got(False) == [(1, 1, 5), (1, 1, 5), (1, 300, 900)] and got(True) == [(1, None, 5), (2, 1, 5), (3, 7, 7)]


def test_uniform_cap(spark):
    r = random.Random(4)
    for _ in range(12):
        sizes = [r.randint(1, 30) for _ in range(r.randint(1, 12))]
        limit = r.randint(0, 200)
        df = spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(sizes)], "g string, n long")
        want = max(c for c in range(max(sizes) + 1) if sum(min(n, c) for n in sizes) <= limit)
        assert budget.uniform_cap(df, "g", "n", limit).first().cap == want


def test_entropy_and_context(spark):
    texts = ["", "aaaa", "abab", "é\n", "".join(map(chr, range(256))), None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.bits for r in tokens.byte_entropy(df, "k", "text").collect()}

    def bits(raw):
        n = np.array([raw.count(bytes([b])) for b in set(raw)]) / len(raw)
        return round(float(-(n * np.log2(n)).sum()), 4) + 0.0

    assert got == {i: bits(x.encode()) for i, x in enumerate(texts) if x}
    lines = ["a", "hit", "b", "c", "hit", "hit", "d", "e", "f"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "none"), (3, None), (4, "hit")], "k int, text string")
    assert sorted(map(tuple, search.context(df, ["k"], "hit", 1).collect())) == [(1, 1, "a"), (1, 3, "b"), (1, 4, "c"), (1, 7, "d")]


def test_deep_json(spark):
    doc = '{"a":{"b":[{"c":{"d":{"e":{"f":{"g":"]}}"}}}}}]}}'
    df = spark.createDataFrame([(1, doc), (2, "[]"), (3, None)], "k int, j string")
    paths = {r.path for r in profile.json_paths(df, "j", ["k"]).collect()}
    assert "$.a.b[].c.d.e.f.g" in paths and len(paths) == 9


def test_hierarchy_has_no_depth(spark):
    edges = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(60)], "child string, parent string")
    assert graph.hierarchy(edges, "n0").count() == 60


def test_module_names(spark):
    rows = [("a/b/x.py", "m.n"), ("a/b/x.py", ".m"), ("a/b/x.py", "..m.n"), ("x.py", "m"), ("a/b/x.ts", "../c/./d"), ("a/x.js", "react"), ("a/x.go", "y/z")]
    df = spark.createDataFrame(rows, "f string, m string")
    got = [r.x for r in df.select(index.module_files(df.f, df.m).alias("x")).collect()]
    assert got[:4] == [["a/b/m/n.py", "m/n.py"], ["a/b/m.py"], ["a/m/n.py"], ["m.py", "m.py"]]
    assert got[4] == ["a/c/d" + e for e in index.SCRIPT_ENDS] and got[5:] == [[], []]


def test_resolution_in_three_languages(spark):
    files = [
        ("lib/http.ts", "export function get(u) {\n  return u;\n}\nexport function post(u) {\n  return u;\n}\n"),
        ("app/api.ts", "import { get, post as send } from '../lib/http';\nimport * as http from '../lib/http';\nexport function load(id, cb) {\n  cb(id);\n  get(id);\n  send(id);\n  http.post(id);\n}\n"),
        ("pkg/log/log.go", "package log\n\nfunc Info(s string) {\n}\n"),
        ("pkg/other/o.go", "package other\n\nfunc Info(s string) {\n}\n"),
        ("cmd/main.go", 'package main\n\nimport (\n\tl "ex.org/m/pkg/log"\n)\n\nfunc main() {\n\tl.Info("x")\n\tl.Gone()\n}\n'),
        ("src/deep/tool.py", "def run():\n    pass\n"),
        ("app/main.py", "import deep.tool as dt\nfrom deep.tool import run as go\n\ndef main():\n    go()\n    dt.run()\n"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    symbols = extract.symbols(df).withColumnRenamed("path", "file")
    rel = extract.relations(df)
    last = "substring_index(name, '.', -1)"
    refs = rel.where("relation = 'call'").selectExpr("path as from_file", "line as from_line", f"{last} as to_name", "if(contains(name, '.'), substring(name, 1, length(name) - length(" + last + ") - 1), null) as qualifier", "cast(null as string) as to_symbol", "'call' as kind", "'heuristic' as confidence")
    imports = rel.where("relation = 'import'").selectExpr("path as file", "line", "name as module", "target as symbol", "alias")
    modules = spark.createDataFrame([("", "ex.org/m")], "dir string, name string")
    got = {(r.from_file, r.from_line): r.to_symbol for r in index.resolve_refs(refs, symbols, imports, None, modules).collect()}
    assert got == {
        ("app/api.ts", 4): None,
        ("app/api.ts", 5): "lib/http.ts::get",
        ("app/api.ts", 6): "lib/http.ts::post",
        ("app/api.ts", 7): "lib/http.ts::post",
        ("cmd/main.go", 8): "pkg/log/log.go::Info",
        ("cmd/main.go", 9): None,
        ("app/main.py", 5): "src/deep/tool.py::run",
        ("app/main.py", 6): "src/deep/tool.py::run",
    }


def test_local_names():
    calls = lambda found: [x[2] for x in found[1] if x[1] == "call"]
    js = "function f(a, {b, c: d}, e = g()) {\n  a(); b(); e(); outer();\n  const k = make(); k.go();\n  try { x(); } catch (err) { err(); }\n}\nitems.map((v) => v());\nif (ok) { ok(); }\nclass A {\n  m(cb) {\n    cb(); this.m();\n  }\n}\n"
    assert calls(extract.js_source(js)) == ["<dynamic>", "<dynamic>", "<dynamic>", "outer", "make", "<dynamic>", "x", "<dynamic>", "items.map", "<dynamic>", "ok", "<dynamic>", "this.m"]
    go = "package a\n\nfunc (m *T) Get(k string, f func(int) int) {\n\tx, err := open(k)\n\tx(); f(1); m.put(err)\n\tfor _, y := range all() {\n\t\ty()\n\t}\n}\n"
    assert calls(extract.go_source(go)) == ["open", "<dynamic>", "<dynamic>", "m.put", "all", "<dynamic>"]


def test_generic_outline():
    got = extract.source("a.rb", "# x\nmodule M\n  def y\n  end\nend\n\ndef top(a)\n  1\nend\n")[0]
    assert got == [("M", "module", 2, 5, 1, 0), ("top", "func", 7, 9, 1, 0)]
    assert extract.source("a.kt", "private class A {\n}\nfun f() = 1\n")[0] == [("A", "class", 1, 2, 0, 0), ("f", "func", 3, 3, 1, 0)]
    assert extract.source("a.bin", "class A\n") == ([], [])


def test_module_change_and_deprecation(spark):
    lines = lambda text: spark.createDataFrame([("a.py", i + 1, x) for i, x in enumerate(text)], "file string, line_no int, line string")
    symbols = spark.createDataFrame([("a.py", "f", 3, 4)], "file string, qualname string, line_start int, line_end int")
    old = lines(["import a", "X = 1", "def f():", "    return 1", "# c"])
    assert diff.module_changes(old, lines(["import b", "X = 1", "def f():", "    return 2", "# d"]), symbols, symbols).collect() == []
    assert [tuple(r) for r in diff.module_changes(old, lines(["import a", "X = 2", "def f():", "    return 1", "# c"]), symbols, symbols).collect()] == [("a.py", 2)]
    assert [tuple(r) for r in diff.module_changes(old, lines(["import a", "", "def f():", "    return 1", "# c"]), symbols, symbols).collect()] == [("a.py", None)]
    assert diff.deprecated_symbols(symbols, lines(["# Deprecated", "", "def f():", "    pass"])).count() == 1
    assert diff.deprecated_symbols(symbols, lines(["", "", "def f():", "    pass", "# deprecated"])).count() == 0


def test_a_cluster_must_name_a_shared_folder():
    made = []
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    told = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, other: None))
    with pytest.raises(RuntimeError):
        session.checkpoint_folder(told)
    assert made == []


def test_registered_queries_are_whole():
    assert set(catalog.queries()) - set(entry.queries()) == {"first_candidate", "same_group_preference", "suffix_sums", "innermost_interval", "suffix_join"}
    assert {f"{x}_all" for x in set(catalog.queries()) - set(entry.queries())} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
