"""Ground truth of the index and graph queries over fixed inputs."""

from __future__ import annotations

from tests import ground_truth as C


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_impact(spark):
    assert rows(C.impact_small(spark, ""), "node", "depth") == [("app.py::use", 1), ("lib.py::core", 0), ("raw.py::<module>", 1), ("top.py::main", 2)]
    assert rows(C.impact_tests_small(spark, ""), "test_file") == [("test_app.py",), ("test_lib.py",)]


def test_tests_for_change(spark):
    assert rows(C.import_edges_small(spark, ""), "src", "dst", "line") == [("app.py", "lib.py", 1), ("test_far.py", "top.py", 1), ("top.py", "app.py", 1)]
    assert rows(C.tests_for_change(spark, ""), "test_file", "layer") == [("test_app.py", "convention"), ("test_far.py", "import"), ("test_lib.py", "coverage")]


def test_candidates(spark):
    assert rows(C.package_targets_small(spark, ""), "file", "target_file") == [("a/main.py", "a/pkg/__init__.py"), ("a/main.py", "a/pkg/mod.py"), ("c/x.py", "b/other/__init__.py")]
    assert rows(C.context_prefixes(spark, ""), "context", "path") == [("tests.test_a.TestX.test_y", "tests/test_a.py"), ("tests.test_a.sub.test_z", "tests/test_a/sub.py")]


def test_small_listings(spark):
    assert rows(C.public_api_listing(spark, ""), "qualname") == [("lib.py::Base",), ("lib.py::core",)]
    assert rows(C.run_commands_small(spark, ""), "command") == [("go test ./go",), ("npx vitest run js/a.test.ts",), ("pytest tests/test_a.py tests/test_b.py",)]
    assert rows(C.changed_symbols_small(spark, ""), "qualname") == [("lib.py::core",)]
    assert rows(C.section_delta_small(spark, ""), "title", "occurrence", "state") == [("A", 1, "modified"), ("B", 1, "modified"), ("B", 2, "removed"), ("C", 1, "added")]
    assert rows(C.response_text(spark, ""), "text") == [("",), ("a",), ("b",)]
    assert [r.runner for r in C.test_runners(spark, "").collect()] == ["vitest", "jest", "pytest", "go test", None]
