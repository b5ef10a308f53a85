"""Queries over all rows: answers for rows that the filtered ones leave out, and the operators on odd rows."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from quillon.operators import budget, index
from quillon.plans import catalog
from quillon.session import table

DATA = "/root/testdata/sf0.001"


def test_all_rows_are_answered(spark):
    q = catalog.queries()
    size = lambda name: table(spark, DATA, name).count()
    assert q["suffix_sums_all"](spark, DATA).count() == size("customer")
    ids = lambda name: sorted(r.id for r in q[name](spark, DATA).select("id").collect())
    assert ids("innermost_interval_all") == ids("smallest_interval")
    left = q["first_candidate"](spark, DATA).count(), q["first_candidate_all"](spark, DATA).where("o_orderkey < 2000").count()
    assert left[0] == left[1]
    pages = table(spark, DATA, "pages").select("page_id")
    assert pages.join(q["suffix_join_all"](spark, DATA), "page_id", "left_anti").count() == 0


def test_suffix_sum(spark):
    r = random.Random(1)
    rows = [(k, r.choice([None, r.randint(-9, 9)])) for k in r.sample(range(10_000), 500)] + [(None, 5)]
    df = spark.createDataFrame(rows, "k long, v long")
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    for parts in (1, 2, 7, 600):
        got = {x.k: x.s for x in budget.suffix_sum(df, "k", F.col("v"), "s", parts).collect()}
        assert got == {k: sum(v or 0 for _, v in order[i:]) for i, (k, _) in enumerate(order)}
    assert budget.suffix_sum(df.limit(0), "k", F.col("v"), "s").collect() == []


def test_prefer_same_join(spark):
    r = random.Random(2)
    side = lambda n, name: spark.createDataFrame([(i, r.randint(0, 3), r.choice([None, *range(9)])) for i in range(n)], f"{name} int, k int, g int")
    a, b = side(60, "a"), side(25, "b")
    joined = a.withColumnRenamed("g", "ga").join(b.withColumnRenamed("g", "gb"), "k")
    want = index.prefer_same(joined, ["a"], F.col("ga") == F.col("gb")).select("a", "b")
    got = index.prefer_same_join(a, b, "a", ["k"], "g").select("a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_interval_merge_half_seconds_and_nulls(spark, tmp_path):
    """Half seconds of either sign and parity, rows without a time, a user with no time at all and no user."""
    times = [f"{day} 00:{m:02}:0{s}" for day in ("1969-12-31", "2024-01-01") for m in (0, 1) for s in ("0.5", "1.5", "2.500001", "3.499999")]
    rows = [*((times[i % len(times)], i // len(times) or None) for i in range(4 * len(times))), (None, 1), (None, 1), (None, 9), (None, 9), ("2024-01-01 02:00:04.5", 1)]
    made = spark.createDataFrame(rows, "ts string, user_id long").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    queries, sql = catalog.whole()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(c.execute(sql["interval_merge"]).fetchall(), key=repr)
    got = queries["interval_merge"](spark, str(tmp_path)).select("user_id", "a", "b", "n_merged").collect()
    assert sorted(map(tuple, got), key=repr) == want
