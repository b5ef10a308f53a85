"""Folders for checkpoints and stages."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from quillon.llm import common


def told(master, named):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, other: named)), made


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError):
        common.ensure_checkpoint_dir(told("spark://host:7077", None)[0])
    for master, named, want in (("spark://host:7077", "/shared", "/shared"), ("local[4]", None, "/tmp/checkpoints"), ("local[4]", "/shared", "/shared")):
        spark, made = told(master, named)
        common.ensure_checkpoint_dir(spark)
        assert made == [want]


def test_written_and_forgotten(spark):
    df = common.written(spark.range(10))
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert df.count() == 10
    common.forget(df)
    import os

    assert not os.path.exists(folder)
    common.forget(spark.range(3))


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batches = common.returning(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert next(batches) == 2 and not given
    assert list(batches) == [4] and given == [1]


def test_redacting_maps_arrow_batches(spark):
    from quillon.llm import secretscan

    df = secretscan.redact(spark.createDataFrame([(1, "plain")], "doc_id long, text string"), None)
    plan = df._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
