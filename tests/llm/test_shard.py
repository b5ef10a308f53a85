"""One law: sizes near equal; slots gapless; equal texts together where sizes allow."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillon.llm import shard


def test_buckets():
    r = np.random.default_rng(1)
    points = sorted(int(x) for x in r.integers(0, 9, 12))
    bounds = [(p // 3, p % 3) for p in points]
    arrays = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    first, second = r.integers(0, 4, 200), r.integers(0, 4, 200)
    got = shard.buckets(first, second, arrays)
    assert got.tolist() == [sum(b <= (x, y) for b in bounds) for x, y in zip(first.tolist(), second.tolist())]


@pytest.mark.parametrize("hot", [0, 700])
def test_sizes(spark, hot):
    r = random.Random(1)
    rows = [(i, "w" * r.randint(0, 400) + str(i)) for i in range(2000)] + [(10_000 + i, "the same text " * 30) for i in range(hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard.histogram_sort(df, shards=8, piece_rows=40).collect()
    assert sorted((g.doc_id, g.text, g["size"], g.text_crc32) for g in got) == sorted((d, t, len(t) + 1, zlib.crc32(t.encode())) for d, t in rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for g in got:
        sizes[g.shard] += g["size"]
        slots[g.shard].append(g.slot)
        assert g.law == "bytes" and g.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(x - mean) for x in sizes.values()) < 0.02 * mean + 800
    # Order holds over shards and slots.
    keys = [(g.shard, g.slot) for g in sorted(got, key=lambda g: (g.shard, g.slot))]
    assert keys == sorted(keys)


def test_copies_stay_together(spark):
    rows = [(i, f"text {i % 50} " * (i % 50 + 1)) for i in range(1000)]
    got = shard.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    held = defaultdict(set)
    for g in got:
        held[g.text].add(g.shard)
    assert sum(len(x) > 1 for x in held.values()) <= 3


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é"), (3, "é"), (None, "x"), (4, "w" * 300_000)]
    df = spark.createDataFrame([(*r, "a", 5) for r in rows], "doc_id long, text string, shard string, lang int")
    got = shard.histogram_sort(df).collect()
    assert sorted((str(g.doc_id), g["size"]) for g in got) == sorted((str(d), len((t or "").encode()) + 1) for d, t in rows)
    assert all(g.lang == 5 and 0 <= g.shard < 16 for g in got)
    empty = shard.histogram_sort(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and "slot" in empty.columns


def test_write(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(100)]
    shard.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


def test_order_against_a_full_sort(spark):
    """Slots and shards against sorting all keys in one list."""
    from pyspark.sql import functions as F

    r = random.Random(6)
    rows = [(i, "v" * r.randint(0, 300) + str(i % 700)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {x.doc_id: (x.a, x.b) for x in df.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "doc_id").alias("b")).collect()}
    placed = shard.histogram_sort(df, shards=5, piece_rows=60)
    assert dict(placed.dtypes)["slot"] == "bigint" and dict(placed.dtypes)["size"] == "bigint"
    got = [x.doc_id for x in sorted(placed.collect(), key=lambda g: (g.shard, g.slot))]
    assert got == sorted(keys, key=keys.get)
