"""Databases, configuration, histories and sinks."""

from __future__ import annotations

import json
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators import tokens
from quillon.plans import catalog
from quillon.session import table
from quillon.sources import readers, sinks

DATA = "/root/testdata/sf0.001"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as held:
        held.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        held.execute("CREATE TABLE none (a INTEGER)")
        held.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"v{i}" if i % 3 else None) for i in range(1000)])
        held.execute("DELETE FROM t WHERE a BETWEEN 100 AND 700")
    got = sorted(map(tuple, readers.read_sqlite(spark, path, "t", "a long, b string", 7).collect()))
    assert got == [(i, f"v{i}" if i % 3 else None) for i in range(1000) if not 100 <= i <= 700]
    assert readers.read_sqlite(spark, path, "none", "a long").collect() == []


def test_coverage(spark, tmp_path):
    path = str(tmp_path / ".coverage")
    with sqlite3.connect(path) as held:
        held.execute("CREATE TABLE file (id INTEGER PRIMARY KEY, path TEXT)")
        held.execute("CREATE TABLE context (id INTEGER PRIMARY KEY, context TEXT)")
        held.execute("CREATE TABLE line_bits (file_id INTEGER, context_id INTEGER, numbits BLOB)")
        held.executemany("INSERT INTO file VALUES (?, ?)", [(1, "a.py"), (2, "b.py")])
        held.executemany("INSERT INTO context VALUES (?, ?)", [(1, ""), (2, "tests.t.test_x")])
        held.executemany("INSERT INTO line_bits VALUES (?, ?, ?)", [(1, 1, b"\x01"), (1, 2, b"\x01"), (2, 2, b"\x02")])
    assert sorted(map(tuple, readers.read_coverage(spark, path).collect())) == [("tests.t.test_x", "a.py"), ("tests.t.test_x", "b.py")]


def test_config_and_names(spark):
    files = spark.createDataFrame([("a.toml", "x = 1\n[t.u]\ny = 'z'\n", "toml"), ("b.json", '{"k": {"l": [1, null]}}', "json"), ("c.json", "[1]", "json"), ("d.json", "no", "json")], "path string, text string, format string")
    assert sorted(map(tuple, readers.config_rows(files).collect())) == [("a.toml", "t.u.y", "z"), ("a.toml", "x", "1"), ("b.json", "k.l", "[1, null]")]
    out = spark.createDataFrame([("c1", "M\0a b\0R090\0old\0new\0D\0gone\0"), ("c2", ""), ("c3", "A\0R100\0")], "k string, value string")
    assert sorted(map(tuple, readers.name_status_rows(out, "k").collect())) == [("c1", "D", "gone", "gone"), ("c1", "M", "a b", "a b"), ("c1", "R", "old", "new"), ("c3", "A", "R100", "R100")]
    log = spark.createDataFrame([(0, "abc1234 Fix (a) thing (Ann B)"), (1, "no commit")], "n int, value string")
    assert [tuple(r) for r in readers.commit_rows(log, "n").collect()] == [(0, "abc1234", "Fix (a) thing", "Ann B")]


def test_bad_documents_are_marked(spark):
    files = spark.createDataFrame([("a", "{", "json"), ("b", "{}", "json"), ("c", "x", "log"), ("d", "[t]\n", "toml")], "path string, text string, format string")
    assert {r.path: r.bad for r in readers.parse(files).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_left_out(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, body in (("a.py", b"x"), ("b.bin", b"a\0b"), ("big.txt", b"y" * 99), ("node_modules/c.js", b"z")):
        (tmp_path / name).write_bytes(body)
    assert {r.reason: (r.files, r.bytes) for r in readers.left_out(spark, str(tmp_path), 50).collect()} == {"binary": (1, 3), "size": (1, 99), "folder": (1, 1)}
    assert [r.text for r in readers.read_files(spark, str(tmp_path), 50).collect()] == ["x"]


def test_exact_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = P.path("byte_bpe_50k.tiktoken")
    use = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    texts = ["", None, "It's 12 été\n\n x", "<|endoftext|>", "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    got = [r.n for r in df.orderBy("k").select(tokens.exact_tokens(F.col("x"), path, P.PATTERN).alias("n")).collect()]
    assert got == [len(use.encode_ordinary(x or "")) for x in texts]


def test_audit_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b")], "i int, s string")
    sinks.audit(df, str(tmp_path / "audit"), "rule-1")
    sinks.audit(df, str(tmp_path / "audit"), "rule-2")
    rows = spark.read.json(str(tmp_path / "audit")).collect()
    assert sorted(r.rule for r in rows) == ["rule-1", "rule-2"] and all(r["at"] for r in rows)
    assert [r.value for r in sinks.as_markdown(df).orderBy("position").collect()] == ["| i | s |", "|---|---|", "| 1 | a\\|b |"]
    assert json.loads(sinks.as_json(df).first().value) == {"i": 1, "s": "a|b"}


def test_blocks_of_documents(spark):
    """symbol_blocks against a walk over the lines: headings of up to five lines, windows of twenty between."""
    got = {}
    for r in catalog.queries()["symbol_blocks"](spark, DATA).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.kind))
    for r in table(spark, DATA, "documents").collect():
        lines = r.text.split("\n")
        if lines[-1] == "":
            lines.pop()
        level = lambda x: 1 if x.startswith("The") else 2 if x.startswith("A") else 3
        heads = [i + 1 for i, x in enumerate(lines) if len(x) > 1 and "A" <= x[0] <= "Z" and "a" <= x[1] <= "z"]
        if not heads:
            continue
        spans = []
        for i, at in enumerate(heads):
            end = next((b - 1 for b in heads[i + 1 :] if level(lines[b - 1]) <= level(lines[at - 1])), len(lines))
            spans.append((at, min(end, at + 4)))
        want, at = [], 1
        for (start, end), following in zip(spans, [*(b for b, _ in spans[1:]), len(lines) + 1]):
            want += [(k, min(k + 19, start - 1), "window") for k in range(at, start, 20)]
            want.append((start, min(end, following - 1), "symbol"))
            at = want[-1][1] + 1
        want += [(k, min(k + 19, len(lines)), "window") for k in range(at, len(lines) + 1, 20)]
        assert sorted(got[r.doc_id]) == want, r.doc_id


def test_templates_of_documents(spark):
    """log_templates_full against counting the templates line by line."""
    lines = t.lines(table(spark, DATA, "documents"), ["doc_id"]).select("doc_id", "line_no", "line", t.template("line").alias("x")).collect()
    first, n = {}, Counter()
    for r in sorted(lines, key=lambda r: (r.doc_id, r.line_no)):
        if r.line.strip(" "):
            first.setdefault(r.x, len(first))
            n[r.x] += 1
    want = sorted((x, k, first[x] >= 512) for x, k in n.items() if k > 1)
    assert sorted(map(tuple, catalog.queries()["log_templates_full"](spark, DATA).collect())) == want != []
