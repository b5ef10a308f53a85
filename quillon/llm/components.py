"""Connected components of an edge table: in slices that a task holds, then by alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpoint, forget, returning

#: Links that a task contracts at once.
SLICE_LINKS = 50_000


def _values(column: pa.Array) -> list:
    return list(zip(*(x.to_pylist() for x in column.flatten()))) if pa.types.is_struct(column.type) else column.to_pylist()


def stars(links: list[tuple]) -> list[tuple]:
    """(node, smallest node that the links tie it to) for all nodes but the smallest ones."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(x, least) for x in root if (least := find(x)) != x]


def _in_slices(edges: DataFrame, tasks: int, slice_links: int) -> DataFrame:
    """The edges as stars of each slice, which tie the same nodes; files that are small meet in few tasks."""
    arrow = to_arrow_schema(edges.schema)

    @returning
    def run(batches):
        def close():
            columns = zip(*made) if (made := stars(held)) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

        held: list[tuple] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, slice_links - len(held))
                held += zip(*map(_values, part.columns))
                at += part.num_rows
                if len(held) == slice_links:
                    yield close()
                    held = []
        yield close()

    return edges.coalesce(tasks).mapInArrow(run, edges.schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node on the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.where("b < a")
    # Written, so that the join has exchanges alone below it and the rows of a hot node can be split.
    least = checkpoint(side.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    joined = side.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other that hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("n")).union(edges.select("b", F.lit(0)).distinct())
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.count("*").alias("ends")).where("n > 1 or (n = 1 and ends > 1)").isEmpty()


def components(edges: DataFrame, slice_links: int = SLICE_LINKS) -> DataFrame:
    """(a, b) links to (node, root), root the smallest node of each component.

    Nodes without a link are not in the result. Slices of the links become stars
    first; a graph that is one slice is done then. Of any other, each round is a few
    joins with partial aggregation, until stars stand; the number of rounds grows
    with the logarithm of the longest chain. Stars end as (node, root) rows.
    """
    edges = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = -(-edges.count() // slice_links)
    if tasks:
        old, edges = edges, checkpoint(_in_slices(edges, tasks, slice_links))
        forget(old)
    while tasks > 1 and not _is_stars(edges):
        old, edges = edges, checkpoint(_star(_star(edges, True), False))
        forget(old)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
