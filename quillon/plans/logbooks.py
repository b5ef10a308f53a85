"""Build logs and stack traces of every order, and what must be found in them.

A log is written from an order's line items, one problem or trace each, in the form
of one tool. The SQL says from the same rows what the problems are, without a log.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import logs
from ..session import table
from .catalog import query
from .searching import LINES, doc_lines

#: Line items of an order in a fixed order: n, p, s, q (line number, part, supplier, quantity) and pos.
ITEMS = "items AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_of(template: str) -> str:
    """A template with {n}, {p}, {s}, {q} as SQL over items."""
    pieces = re.split(r"\{([npsq])\}", template)
    return "concat(" + ", ".join([*(quoted(x) if i % 2 == 0 else f"CAST({x} AS VARCHAR)" for i, x in enumerate(pieces)), "''"]) + ")"


def column_of(template: str, item):
    pieces = re.split(r"\{([npsq])\}", template)
    return F.concat(*(F.lit(x) if i % 2 == 0 else item[x].cast("string") for i, x in enumerate(pieces)))


def order_texts(spark, d, template: str, head: str = "", foot: str = "", between: str = "\n"):
    """(id, text): the template for each item of an order, between a head and a foot."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: column_of(template, x)), between)
    return items.groupBy("id").agg(F.concat(F.lit(head), body, F.lit(foot)).alias("text"))


@dataclass(frozen=True)
class Log:
    """A tool's command, how its log looks, and the problem of each item."""

    tool: str
    command: str
    item: str
    title: str
    ref: str
    detail: str = ""
    head: str = ""
    foot: str = ""


LOGS = {
    "pytest": Log(
        "pytest",
        "python -m pytest -x",
        "______________ test_p{p}_{n} ______________\n\n    def test():\n>       assert {q} == {s}\nE       assert {q} == {s}\n\ntests/test_m{s}.py:{n}: AssertionError",
        "FAIL test_p{p}_{n}",
        "tests/test_m{s}.py:{n}",
        "    def test():\n>       assert {q} == {s}\nE       assert {q} == {s}\n\ntests/test_m{s}.py:{n}: AssertionError",
        "=================== test session starts ===================\n======================= FAILURES =======================\n",
        "\n=============== short test summary info ===============\nFAILED tests/test_x.py::test_y - no\n",
    ),
    "go": Log("go test", "go test ./...", "--- FAIL: TestP{p}N{n} (0.00s)\n    m{s}_test.go:{n}: got {q}, want {p}", "FAIL TestP{p}N{n}", "m{s}_test.go:{n}", "    m{s}_test.go:{n}: got {q}, want {p}", "", "\nFAIL\nexit status 1\n"),
    "cargo": Log(
        "cargo",
        "cargo build",
        "error[E0{n}]: mismatched part {p}\n  --> src/m{s}.rs:{n}:{q}\n   |\n{n} |     {q}\n",
        "error[E0{n}]: mismatched part {p}",
        "src/m{s}.rs:{n}",
        "  --> src/m{s}.rs:{n}:{q}\n   |\n{n} |     {q}",
        "   Compiling app v0.1.0\nwarning: build failed, waiting for other jobs to finish...\n",
        "\nerror: could not compile `app` (bin) due to previous errors\n",
    ),
    "tsc": Log("tsc", "npx tsc --noEmit", "src/m{s}.ts({n},7): error TS{p}: part {p} is not {q}.", "error TS{p}: part {p} is not {q}.", "src/m{s}.ts:{n}", foot="\nFound errors.\n"),
    "eslint": Log("eslint", "eslint .", "/app/src/m{s}.ts\n  {n}:5  error  part {p} is not defined  no-undef\n", "error: part {p} is not defined (no-undef)", "/app/src/m{s}.ts:{n}", foot="\n✖ 9 problems\n"),
    "cc": Log(
        "cc",
        "make",
        "m{s}.c:{n}:{q}: error: part {p} undeclared\n   {n} | x{p};\n      | ^~~\nm{s}.h:{q}:1: note: declared here",
        "error: part {p} undeclared",
        "m{s}.c:{n}",
        "   {n} | x{p};\n      | ^~~\nm{s}.h:{q}:1: note: declared here",
        foot="\n9 errors generated.\nmake: *** [all] 1\n",
    ),
    "jest": Log(
        "jest/vitest",
        "npx jest",
        "  ● suite › part {p} case {n}\n\n    expect(received).toBe(expected)\n\n      at Object.<anonymous> (src/m{s}.test.js:{n}:5)\n",
        "FAIL suite › part {p} case {n}",
        "src/m{s}.test.js:{n}",
        "    expect(received).toBe(expected)\n\n      at Object.<anonymous> (src/m{s}.test.js:{n}:5)",
        foot="\nTest Suites: 1 failed, 1 total\n",
    ),
    "next": Log("next build", "npx next build", "./app/m{s}.tsx:{n}:5\nType error: part {p} is not assignable.\n", "Type error: part {p} is not assignable.", "./app/m{s}.tsx:{n}", head="   ▲ Next.js 15\n   Creating an optimized production build ...\n"),
    "generic": Log("generic", "./build.sh", "step {n} of part {p}\nERROR: part {p} broke at tools/m{s}.sh:{q}", "ERROR: part {p} broke at tools/m{s}.sh:{q}", "tools/m{s}.sh:{q}", head="begin\n", foot="\nend\n"),
}


def log_texts(spark, d, name: str, exit_code=None):
    log = LOGS[name]
    code = F.lit(1) if exit_code is None else exit_code
    return order_texts(spark, d, log.item, log.head, log.foot).select(F.col("id").alias("log_id"), F.lit(log.command).alias("command"), code.alias("exit_code"), "text")


def shown(found):
    return found.select("log_id", "format", F.col("pos").cast("long").alias("pos"), "title", "ref", F.array_join("detail", "\n").alias("detail"))


def expected(name: str) -> str:
    log = LOGS[name]
    return f"SELECT id AS log_id, {quoted(log.tool)} AS format, pos, {sql_of(log.title)} AS title, {sql_of(log.ref)} AS ref, {sql_of(log.detail)} AS detail FROM items"


def _add(name: str) -> None:
    def run(spark, d):
        return shown(logs.problems(log_texts(spark, d, name)))

    run.__doc__ = f"Problems in a log of {LOGS[name].tool} for every order."
    query(f"WITH {ITEMS} {expected(name)}", name=f"log_problems_{name}")(run)


for _name in LOGS:
    _add(_name)


@query(f"WITH {ITEMS} {expected('generic')} WHERE CAST(id AS BIGINT) % 2 = 1")
def log_passing_runs(spark, d):
    """Lines that speak of errors are none where an unknown tool has succeeded."""
    return shown(logs.problems(log_texts(spark, d, "generic", (F.col("id").cast("long") % 2).cast("int"))))


@query(f"WITH {ITEMS} {expected('pytest')} WHERE CAST(id AS BIGINT) % 3 > 0")
def log_passing_tests(spark, d):
    """A run that has succeeded has no failed test."""
    return shown(logs.problems(log_texts(spark, d, "pytest", (F.col("id").cast("long") % 3).cast("int"))))


@query(f"WITH {ITEMS}, f AS (SELECT id, n, p, s, q, pos, count(*) OVER (PARTITION BY id) AS n_similar FROM items) SELECT id AS log_id, pos, {sql_of(LOGS['tsc'].title)} AS title, {sql_of(LOGS['tsc'].ref)} AS ref, n_similar FROM f WHERE pos = 1")
def log_problems_folded(spark, d):
    """Problems that differ in numbers only, as the first of them with a count."""
    folded = logs.fold_repeats(logs.problems(log_texts(spark, d, "tsc")), "log_id")
    return folded.select("log_id", F.col("pos").cast("long").alias("pos"), "title", "ref", "n_similar")


def log_lines(spark, d, name: str):
    return t.lines(log_texts(spark, d, name), ["log_id"])


@query(f"WITH {ITEMS} SELECT id AS log_id, pos AS line_no, {sql_of(LOGS['tsc'].title)} AS title, {sql_of(LOGS['tsc'].ref)} AS ref FROM items")
def log_lines_tsc(spark, d):
    """The same as expressions over lines."""
    return logs.tsc_problems(log_lines(spark, d, "tsc")).select("log_id", F.col("line_no").cast("long").alias("line_no"), "title", "ref")


@query(f"WITH {ITEMS} SELECT id AS log_id, 3 * pos - 1 AS line_no, {sql_of(LOGS['eslint'].title)} AS title, {sql_of(LOGS['eslint'].ref)} AS ref FROM items")
def log_lines_eslint(spark, d):
    """Problems of the file named last above them."""
    return logs.eslint_problems(log_lines(spark, d, "eslint"), "log_id", "line_no").select("log_id", F.col("line_no").cast("long").alias("line_no"), "title", "ref")


@query(f"WITH {ITEMS} SELECT id AS log_id, 2 * pos + 1 AS line_no, {sql_of(LOGS['generic'].title)} AS title, {sql_of(LOGS['generic'].ref)} AS ref FROM items")
def log_lines_generic(spark, d):
    return logs.generic_problems(log_lines(spark, d, "generic")).select("log_id", F.col("line_no").cast("long").alias("line_no"), "title", "ref")


@query(f"WITH {LINES}, r AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS back FROM lines) SELECT doc_id, line_no::BIGINT AS line_no, line FROM r WHERE back <= 3")
def log_tail(spark, d):
    """The last three lines of every document."""
    return logs.tail(doc_lines(spark, d).select("doc_id", "line_no", "line"), "doc_id", "line_no", 3).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"WITH {ITEMS} SELECT id AS log_id, count_if(p % 5 IN (0, 3)) AS n_warnings FROM items GROUP BY 1")
def log_warnings(spark, d):
    """Lines that warn, but for those that say there are no warnings."""
    word = F.element_at(F.array(*map(F.lit, ("warning: old", "0 warnings", "no warnings here", "WARN: slow", "all is well"))), (F.regexp_extract("line", r"p(\d+)", 1).cast("int") % 5) + 1)
    lines = t.lines(order_texts(spark, d, "p{p}").withColumnRenamed("id", "log_id"), ["log_id"])
    return logs.warnings_in(lines.withColumn("line", word), "log_id")


# ------------------------------------------------------------------ traces

#: For each language: the text of a trace, and its frames (section, kind, header, number, ref, function, whether the project's).
TRACES = {
    "python": (
        'Traceback (most recent call last):\n  File "/app/src/m{s}.py", line {n}, in f{p}\n    go()\n  File "/usr/lib/python3.12/json/x.py", line {q}, in load\n    y\nValueError: bad {p}\n',
        [(1, "raised", "ValueError: bad {p}", 1, "/usr/lib/python3.12/json/x.py:{q}", "load", False), (1, "raised", "ValueError: bad {p}", 2, "/app/src/m{s}.py:{n}", "f{p}", True)],
    ),
    "python_chain": (
        'Traceback (most recent call last):\n  File "/app/src/db.py", line {n}, in get\n    raise KeyError(k)\nKeyError: {p}\n\nThe above exception was the direct cause of the following exception:\n\nTraceback (most recent call last):\n  File "/app/src/m{s}.py", line {q}, in f{p}\n    get()\nValueError: bad {p}\n',
        [(1, "raised", "ValueError: bad {p}", 1, "/app/src/m{s}.py:{q}", "f{p}", True), (2, "direct cause of", "KeyError: {p}", 1, "/app/src/db.py:{n}", "get", True)],
    ),
    "java": (
        "java.lang.IllegalStateException: part {p}\n\tat com.acme.M{s}.run(M{s}.java:{n})\n\tat java.util.List.of(List.java:{q})\nCaused by: java.io.IOException: disk {q}\n\tat com.acme.Disk.read(Disk.java:{n})\n\t... 2 more\n",
        [
            (1, "raised", "java.lang.IllegalStateException: part {p}", 1, "M{s}.java:{n}", "com.acme.M{s}.run", True),
            (1, "raised", "java.lang.IllegalStateException: part {p}", 2, "List.java:{q}", "java.util.List.of", False),
            (2, "caused by", "java.io.IOException: disk {q}", 1, "Disk.java:{n}", "com.acme.Disk.read", True),
        ],
    ),
    "node": (
        "TypeError: part {p}\n    at run{p} (/app/src/m{s}.js:{n}:5)\n    at node:internal/main:{q}:3\n",
        [(1, "raised", "TypeError: part {p}", 1, "/app/src/m{s}.js:{n}", "run{p}", True), (1, "raised", "TypeError: part {p}", 2, "node:internal/main:{q}", "", False)],
    ),
    "go": (
        "panic: part {p}\n\ngoroutine 1 [running]:\nmain.work{p}(0x1)\n\t/app/m{s}.go:{n} +0x1d\nruntime.main()\n\t/usr/local/go/src/runtime/proc.go:{q} +0x20\n",
        [(1, "raised", "panic: part {p}", 1, "/app/m{s}.go:{n}", "main.work{p}", True), (1, "raised", "panic: part {p}", 2, "/usr/local/go/src/runtime/proc.go:{q}", "runtime.main", False)],
    ),
    "rust": (
        "thread 'main' panicked at src/m{s}.rs:{n}:5:\npart {p}\nstack backtrace:\n   0: core::panicking\n             at /rustc/abc/library/core/src/panicking.rs:{q}:5\n   1: calc::f{p}\n             at ./src/m{s}.rs:{n}:5\n",
        [(1, "raised", "panicked: part {p}", 1, "/rustc/abc/library/core/src/panicking.rs:{q}", "core::panicking", False), (1, "raised", "panicked: part {p}", 2, "./src/m{s}.rs:{n}", "calc::f{p}", True)],
    ),
}


def trace_texts(spark, d, name: str):
    return order_texts(spark, d, TRACES[name][0]).select(F.col("id").alias("trace_id"), "text")


def _add_trace(name: str) -> None:
    def run(spark, d):
        found = logs.traces(trace_texts(spark, d, name))
        return found.select("trace_id", "lang", *(F.col(c).cast("long").alias(c) for c in ("trace_no", "section_no")), "kind", "header", F.col("frame_no").cast("long").alias("frame_no"), "ref", "func", "project")

    run.__doc__ = f"Frames of {name} traces, one for every line item."
    rows = " UNION ALL ".join(f"SELECT id AS trace_id, {quoted(name.split('_')[0])} AS lang, pos AS trace_no, {section}::BIGINT AS section_no, {quoted(kind)} AS kind, {sql_of(header)} AS header, {no}::BIGINT AS frame_no, {sql_of(ref)} AS ref, {sql_of(func)} AS func, {project} AS project FROM items" for section, kind, header, no, ref, func, project in TRACES[name][1])
    query(f"WITH {ITEMS} {rows}", name=f"traces_{name}")(run)


for _name in TRACES:
    _add_trace(_name)


@query(f"WITH {ITEMS} SELECT id AS trace_id, pos AS trace_no, 1::BIGINT AS section_no, 1::BIGINT AS frame_no, NULL AS ref, NULL AS func, 1::BIGINT AS n FROM items UNION ALL SELECT id, pos, 1, 2, {sql_of('/app/src/m{s}.py:{n}')}, {sql_of('f{p}')}, 1 FROM items")
def traces_shown_frames(spark, d):
    """Frames of the project, and runs of others as one row."""
    shown_ = logs.shown_frames(logs.traces(trace_texts(spark, d, "python")))
    return shown_.select("trace_id", *(F.col(c).cast("long").alias(c) for c in ("trace_no", "section_no", "frame_no")), "ref", "func", F.col("n").cast("long").alias("n"))


@query(f"WITH {ITEMS} SELECT 'python' AS lang, first(id ORDER BY id, pos) AS trace_id, first(pos ORDER BY id, pos) AS trace_no, count(*) AS n_equal FROM items GROUP BY s, n, q")
def traces_folded(spark, d):
    """Traces that differ in numbers of their headers only, as the first of them with a count."""
    folded = logs.fold_traces(logs.traces(trace_texts(spark, d, "python")))
    return folded.select("lang", "trace_id", F.col("trace_no").cast("long").alias("trace_no"), "n_equal")
