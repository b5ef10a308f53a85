"""The library works without the training-data folder, and nothing else names it."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_it():
    for path in (ROOT / "quillon").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_entry_without_it():
    code = "import sys; sys.modules['quillon.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq = e.queries(); assert 'ranked_search' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
