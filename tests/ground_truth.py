"""Small fixed inputs whose results are known, and the operators over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators import diff, extract, graph, index, logs, shell

TSC_LOG = "src/auth/login.ts(24,7): error TS2322: Type 'string' is not assignable to type 'number'.\nsrc/http/client.ts:41:12 - error TS2339: Property 'foo' does not exist on type 'Bar'.\nFound 2 errors.\n"
ESLINT_LOG = "/app/src/login.ts\n  12:5  error  'mfa' is not defined  no-undef\n  30:1  warning  Unexpected console statement  no-console\n\n/app/src/api.ts\n  7:10  error  Missing return type\n\n✖ 3 problems (2 errors, 1 warning)\n"
PYTEST_LOG = "=================== test session starts ===================\n======================= FAILURES =======================\n______________ test_login ______________\n\n    def test_login():\n>       assert 1 == 2\nE       assert 1 == 2\n\ntests/test_auth.py:12: AssertionError\n______________ test_logout ______________\ntests/test_auth.py:30: in test_logout\n    go()\nsrc/auth.py:8: ValueError\n=============== short test summary info ===============\nFAILED tests/test_auth.py::test_login - assert 1 == 2\n"
GO_LOG = "--- FAIL: TestAdd (0.00s)\n    add_test.go:14: got 3, want 4\n--- FAIL: TestSub (0.01s)\n    sub_test.go:9: bad\nFAIL\nmain.go:7:2: undefined: foo\n"
CARGO_LOG = "   Compiling app v0.1.0\nerror[E0308]: mismatched types\n  --> src/main.rs:10:5\n   |\n10 |     1\n\nwarning: unused variable: `x`\n --> src/lib.rs:3:9\n\n---- tests::retry_count stdout ----\nthread 'tests::retry_count' panicked at src/client.rs:41:9:\nassertion failed\n\nfailures:\n    tests::retry_count\nerror: test failed, to rerun pass `--lib`\n"
CC_LOG = "main.c:3:10: fatal error: foo.h: No such file or directory\n    3 | #include <foo.h>\n      |          ^~~~~~~\ncompilation terminated.\nutil.c:9:5: warning: unused variable 'x'\nutil.c:8:1: note: declared here\n"
JEST_LOG = "FAIL src/sum.test.js\n  ● adds numbers\n\n    expect(received).toBe(expected)\n\n      at Object.<anonymous> (src/sum.test.js:5:17)\n\nTests:       1 failed, 1 total\nTest Suites: 1 failed, 1 total\n"
NEXT_LOG = "▲ Next.js 15.0.0\n   Creating an optimized production build ...\n./app/page.tsx:10:3\nType error: Property 'x' does not exist.\n\n  10 | x\n"
MIXED_LOG = "\n".join([*(f"step {i} done" for i in range(25)), "warning: deprecated thing 1", "warning: deprecated thing 2", "ERROR: build broke at tools/run.sh:88", "bye"]) + "\n"
LOGS = [("tsc", "npx tsc --noEmit", 2, TSC_LOG), ("eslint", "eslint .", 1, ESLINT_LOG), ("pytest", "python -m pytest -x", 1, PYTEST_LOG), ("go", "go test ./...", 1, GO_LOG), ("cargo", "cargo test", 101, CARGO_LOG), ("cc", "make", 2, CC_LOG), ("jest", "npx jest", 1, JEST_LOG), ("next", "next build", 1, NEXT_LOG), ("mixed", "./build.sh", 1, MIXED_LOG), ("passed", "pytest", 0, PYTEST_LOG)]

PY_TRACE = 'Traceback (most recent call last):\n  File "/app/src/db.py", line 10, in get\n    raise KeyError(k)\nKeyError: 7\n\nDuring handling of the above exception, another exception occurred:\n\nTraceback (most recent call last):\n  File "/app/src/api.py", line 20, in handle\n    get(7)\n  File "/usr/lib/python3.12/json/decoder.py", line 5, in decode\n    x\nValueError: bad 7\n'
JAVA_TRACE = 'Exception in thread "main" java.lang.IllegalStateException: no\n\tat com.acme.App.run(App.java:12)\n\tat java.base/java.lang.Thread.run(Thread.java:833)\nCaused by: java.io.IOException: disk\n\tat com.acme.Disk.read(Disk.java:40)\n\t... 2 more\njava.lang.RuntimeException: other\n\tat com.acme.Other.go(Other.java:3)\n'
NODE_TRACE = "TypeError: x is not a function\n    at run (/app/src/index.js:10:5)\n    at node:internal/main:5:3\n"
GO_TRACE = "panic: boom\n\ngoroutine 1 [running]:\nmain.work(0x1)\n\t/app/main.go:12 +0x1d\nmain.main()\n\t/app/main.go:5 +0x20\n"
RUST_TRACE = "thread 'main' panicked at src/calc.rs:9:5:\ndivide by zero\nstack backtrace:\n   0: rust_begin_unwind\n             at /rustc/abc/library/std/src/panicking.rs:645:5\n   1: calc::div\n             at ./src/calc.rs:9:5\n"
GROUP_TRACE = '  + Exception Group Traceback (most recent call last):\n  |   File "/app/a.py", line 3, in main\n  |     x()\n  | ExceptionGroup: two (2 sub-exceptions)\n  +-+---------------- 1 ----------------\n    | Traceback (most recent call last):\n    |   File "/app/b.py", line 4, in one\n    |     y()\n    | ValueError: one\n    +---------------- 2 ----------------\n    | TypeError: never raised\n    +------------------------------------\n'
TRACES = [("python", PY_TRACE), ("java", JAVA_TRACE), ("node", NODE_TRACE), ("go", GO_TRACE), ("rust", RUST_TRACE), ("group", GROUP_TRACE), ("python again", PY_TRACE), ("none", "all fine\n")]


def log_rows(spark):
    return spark.createDataFrame(LOGS, "log_id string, command string, exit_code int, text string")


def log_lines(spark, which):
    return t.lines(log_rows(spark).where(F.col("log_id") == which), ["log_id"])


def log_problems_tsc(spark, d):
    return logs.tsc_problems(log_lines(spark, "tsc")).select(F.col("line_no").cast("long").alias("line_no"), "title", "ref")


def log_problems_generic(spark, d):
    return logs.generic_problems(log_lines(spark, "mixed")).select(F.col("line_no").cast("long").alias("line_no"), "title", "ref")


def log_problems_eslint(spark, d):
    return logs.eslint_problems(log_lines(spark, "eslint"), "log_id", "line_no")


def log_problems_all(spark, d):
    return logs.problems(log_rows(spark))


def log_problems_folded(spark, d):
    return logs.fold_repeats(logs.problems(log_rows(spark)), "log_id")


def log_tail(spark, d):
    return logs.tail(log_lines(spark, "mixed"), "log_id", "line_no").select(F.col("line_no").cast("long").alias("line_no"), "line")


def trace_rows(spark):
    return spark.createDataFrame(TRACES, "trace_id string, text string")


def traces_frames(spark, d):
    return logs.traces(trace_rows(spark))


def traces_shown_frames(spark, d):
    return logs.shown_frames(logs.traces(trace_rows(spark)))


def traces_folded(spark, d):
    return logs.fold_traces(logs.traces(trace_rows(spark)))


FILES = [
    ("py/shapes.py", "import abc\nfrom math import pi\n\nSIDES = 4\n\n\nclass Shape(abc.ABC):\n    @abc.abstractmethod\n    def area(self) -> float:\n        ...\n\n\nclass Circle(Shape):\n    def __init__(self, r: float):\n        self.r = r\n\n    def area(self) -> float:\n        return pi * square(self.r)\n\n\ndef square(x):\n    return x * x\n"),
    ("py/app.py", "from py.shapes import Circle as C, square\nimport os\n\n\ndef main(size):\n    c = C(size)\n    print(c.area(), square(2), helper())\n\n\ndef helper():\n    return os.getcwd()\n\n\ndef _unused():\n    return 1\n"),
    ("js/api.ts", "import { get, post as send } from './http';\nexport class Api extends Base implements Client {\n  load(id: string) {\n    return get(id);\n  }\n}\nexport const run = async (x) => {\n  send(x);\n};\nfunction inner() { return 1; }\n"),
    ("go/store.go", 'package store\n\nimport (\n\t"fmt"\n\tlog "app/log"\n)\n\ntype Store interface {\n\tGet(k string) string\n}\n\ntype Mem struct{}\n\nfunc (m *Mem) Get(k string) string {\n\treturn fmt.Sprint(k)\n}\n\nfunc open() {}\n'),
    ("src/lib.rs", "pub struct Job {\n    id: u32,\n}\n\npub fn start(j: Job) -> u32 {\n    j.id\n}\n\nfn hidden() {}\n"),
    ("src/util.c", "struct pair {\n  int a;\n};\n\nstatic int add(int a, int b)\n{\n  return a + b;\n}\n"),
    ("docs/guide.md", "Intro\n\n# Guide\n\ntext\n\n## Install\n\n```\n# not a heading\n```\n\n## Use\n\n# Notes\n"),
]


def file_rows(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def extract_symbols(spark, d):
    return extract.symbols(file_rows(spark))


def extract_relations(spark, d):
    return extract.relations(file_rows(spark))


def resolved_refs(spark, d):
    """Calls of the source texts resolved over their symbols and imports."""
    symbols = extract.symbols(file_rows(spark)).withColumnRenamed("path", "file")
    rel = extract.relations(file_rows(spark))
    refs = rel.where("relation = 'call'").select(F.col("path").alias("from_file"), F.col("line").alias("from_line"), t.last_segment("name").alias("to_name"), F.lit(None).cast("string").alias("to_symbol"), F.lit("call").alias("kind"), F.lit("heuristic").alias("confidence"))
    imports = rel.where("relation = 'import'").select(F.col("path").alias("file"), "line", F.col("name").alias("module"), F.col("target").alias("symbol"), "alias")
    return index.resolve_refs(refs, symbols, imports)


def interface_implementations(spark, d):
    """Types whose methods hold every method of an interface in the same folder."""
    symbols, rel = extract.symbols(file_rows(spark)), extract.relations(file_rows(spark))
    folder = t.dirname("path")
    have = symbols.where("kind = 'method' and path like '%.go'").select(folder.alias("dir"), F.split_part(F.split_part("qualname", F.lit("::"), F.lit(2)), F.lit("."), F.lit(1)).alias("owner"), t.last_segment("qualname").alias("method"))
    want = rel.where("relation = 'iface-method'").select(folder.alias("dir"), F.col("name").alias("interface"), F.col("target").alias("method"))
    return index.division(have, want, "owner", "method", "interface", ["dir"])


def dead_symbols(spark, d):
    symbols = extract.symbols(file_rows(spark)).withColumnRenamed("path", "file")
    refs = resolved_refs(spark, d)
    rel = extract.relations(file_rows(spark))
    parents = rel.where("relation = 'inherits'").select(F.col("target").alias("parent"))
    interfaces = rel.where("relation = 'implements'").select(F.col("target").alias("interface"))
    return index.dead_symbols(symbols, refs, parents, interfaces, spark.createDataFrame([], "file string")).select("qualname", "kind")


def convention_tests(spark, d):
    rows = [(p,) for p in ("py/foo.py", "tests/test_foo.py", "go/store.go", "go/store_test.go", "js/api.ts", "js/api.spec.ts", "tests/test_other.py")]
    return index.convention_tests(spark.createDataFrame(rows, "path string"))


def import_cycles_small(spark, d):
    rows = [("a.py", "b.py"), ("b.py", "c.py"), ("c.py", "a.py"), ("d.py", "e.py"), ("e.py", "d.py"), ("solo.py", "a.py")]
    return graph.cycles(spark.createDataFrame(rows, "src string, dst string"))


def body_comparison(spark, d):
    rows = [("a", "x = 3\nreturn x", "x = 5\nreturn x", "a.py"), ("b", "def f( a ):\n  return a", "def f(a):\n    return a  # same", "b.py"), ("c", "go()", "if ok:\n  go()\n  stop()", "c.py"), ("d", "import a\nimport b\nx()", "import b\nimport a\nx()", "d.js"), ("e", "timeout(30)", "timeout(60)", "e.js")]
    return diff.compare_bodies(spark.createDataFrame(rows, "key string, o string, n string, p string"), "key", "o", "n", "p")


def diff_numstat(spark, d):
    text = "diff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n-b\n+c\n+d\ndiff --git a/y.png b/y.png\nnew file mode 100644\nBinary files /dev/null and b/y.png differ\n"
    return diff.diff_files(spark.createDataFrame([("d1", text)], "id string, diff string"), "id", "diff")


def shell_classes(spark, d):
    commands = ["grep -rn foo .", "grep -rn foo . | head -5", "cat big.json", "cat a | wc -l", "sed -n '1,200p' a.py", "sed -n '1,20p' a.py", "git log", "git log -n 5", "git diff --stat", "git diff", "echo 'cat x' && ls", "tail -n 500 x.log", "git log > out.txt", "jq . data.json", "rg -l foo"]
    df = spark.createDataFrame([(c,) for c in commands], "command string")
    return shell.with_class(df).select("command", "command_class", shell.mask("command").alias("masked"), shell.own_words("command").alias("words"))


# ------------------------------------------------ small index, fixed inputs

INDEX = {
    "symbols": [(1, "lib.py::core", "func", "lib.py", 1, 5, 1), (2, "app.py::use", "func", "app.py", 1, 9, 1), (3, "top.py::main", "func", "top.py", 1, 9, 1), (4, "lib.py::Base", "class", "lib.py", 7, 9, 1), (5, "kid.py::Kid", "class", "kid.py", 1, 9, 0)],
    "refs": [(1, "app.py", 3, "core", "lib.py::core", "call", "resolved"), (2, "top.py", 4, "use", "app.py::use", "call", "resolved"), (3, "raw.py", 2, "core", "lib.py::core", "call", "resolved")],
    "inherits": [(1, "kid.py", 1, "Kid", "Base")],
    "tests": [(1, "test_app.py", "app.py", "convention"), (2, "test_lib.py", "lib.py", "coverage"), (3, "test_far.py", "zzz.py", "import")],
    "imports": [(1, "app.py", 1, "lib", None, None), (2, "top.py", 1, "pkg.app", None, None), (3, "test_far.py", 1, "top", None, None)],
}


def small(spark, name):
    return spark.createDataFrame(INDEX[name], index.SCHEMAS[name])


def impact_small(spark, d):
    """What a change of one function reaches, level by level."""
    parents = small(spark, "inherits").select("child", "parent")
    reached, _ = graph.impact("core", small(spark, "refs"), small(spark, "symbols"), parents, small(spark, "tests"))
    return reached


def impact_tests_small(spark, d):
    parents = small(spark, "inherits").select("child", "parent")
    return graph.impact("core", small(spark, "refs"), small(spark, "symbols"), parents, small(spark, "tests"))[1]


def tests_for_change(spark, d):
    files = spark.createDataFrame([(x,) for x in ("lib.py", "app.py", "top.py", "test_far.py", "test_app.py", "test_lib.py")], "path string")
    edges = index.import_edges(small(spark, "imports"), files)
    return graph.tests_for(spark.createDataFrame([("app.py",), ("lib.py",)], "path string"), small(spark, "tests"), edges)


def import_edges_small(spark, d):
    files = spark.createDataFrame([(x,) for x in ("lib.py", "a/lib.py", "app.py", "top.py")], "path string")
    return index.import_edges(small(spark, "imports"), files)


def package_targets_small(spark, d):
    files = spark.createDataFrame([(x,) for x in ("a/pkg/__init__.py", "a/pkg/mod.py", "b/other/__init__.py")], "path string")
    rows = [(1, "a/main.py", 1, "pkg", "mod", None), (2, "c/x.py", 2, "other", None, None), (3, "c/x.py", 3, "none", None, None)]
    return index.package_targets(spark.createDataFrame(rows, index.SCHEMAS["imports"]), files).select("file", "module", "target_file")


def context_prefixes(spark, d):
    files = spark.createDataFrame([("tests/test_a.py",), ("tests/test_a/sub.py",), ("other.py",)], "path string")
    contexts = spark.createDataFrame([("tests.test_a.TestX.test_y",), ("tests.test_a.sub.test_z",), ("nope.x",)], "context string")
    return index.longest_prefix(contexts, "context", files, "path")


def public_api_listing(spark, d):
    return index.public_api(small(spark, "symbols"), "lib.py").select("qualname", "kind")


def run_commands_small(spark, d):
    rows = [("tests/test_b.py",), ("tests/test_a.py",), ("go/x_test.go",), ("go/y_test.go",), ("js/a.test.ts",)]
    return index.run_commands(spark.createDataFrame(rows, "path string"))


def changed_symbols_small(spark, d):
    hunks = spark.createDataFrame([("lib.py", 4, 4), ("app.py", 20, 30)], "file string, from_line int, to_line int")
    return diff.changed_symbols(hunks, small(spark, "symbols")).select("qualname")


def section_delta_small(spark, d):
    """Sections of two versions of a document by level, title and occurrence."""
    def sections(text):
        rows = text.split("\n")
        held, seen = [], {}
        for level, title, a, b in extract.markdown_sections(text):
            seen[level, title] = seen.get((level, title), 0) + 1
            held.append((level, title, seen[level, title], "\n".join(rows[a - 1 : b])))
        return spark.createDataFrame(held, "level int, title string, occurrence int, body string")

    old, new = "# A\nx\n## B\ny\n## B\nz\n", "# A\nx\n## B\ny2\n## C\nq\n"
    return diff.section_delta(sections(old), sections(new), ["level", "title", "occurrence"], "body")


def response_text(spark, d):
    rows = [('{"stdout": "a"}',), ('{"content": "b"}',), ('{"x": 1}',)]
    return spark.createDataFrame(rows, "j string").select("j", t.flatten_response(F.try_parse_json("j")).alias("text"))


def test_runners(spark, d):
    rows = [(["vitest.config.ts", "jest.config.js"], ""), ([], '{"jest": {}}'), (["conftest.py"], None), (["go.mod"], None), ([], None)]
    df = spark.createDataFrame(rows, "names array<string>, manifest string")
    return df.select("names", index.test_runner(F.col("names"), F.col("manifest")).alias("runner"))
