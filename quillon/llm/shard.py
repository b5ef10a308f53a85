"""Sharding: histogram sort.

Documents are put in the order of (hash of the text, hash of doc_id) and cut into
shards of near equal bytes. The cuts are found without sorting: every round counts,
over all partitions, the exact bytes below candidate keys inside each interval
that still holds a cut, and keeps the two candidates around the aim, until every
splitter meets the tolerance. Only then are rows exchanged, once.

Equal texts have equal hashes and lie side by side, so they share a shard, unless
one group of copies spans an aim by more than the tolerance; it is then cut by
the second key, since near equal sizes are the law.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SHARDS, TOLERANCE = 16, 0.002
#: Candidate keys of one round, shared by the open splitters; at least two for each.
PROBES = 4096
#: Rows that one task numbers, and the fewest pieces of a shard.
PIECE_ROWS, LEAST_PIECES = 100_000, 4
HALF, SPAN = 1 << 63, 1 << 128


def split_keys(points: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """Points of the 128-bit key line as two signed 64-bit columns."""
    points = list(points)
    first = np.array([(p >> 64) - HALF for p in points], np.int64)
    second = np.array([(p & ((1 << 64) - 1)) - HALF for p in points], np.int64)
    return first, second


def buckets(first: np.ndarray, second: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted bounds are at or below each key."""
    low, high = np.searchsorted(bounds[0], first, "left"), np.searchsorted(bounds[0], first, "right")
    tied = np.flatnonzero(low < high)
    out, begin = low.copy(), low[tied]
    for at in np.unique(begin):
        rows = tied[begin == at]
        out[rows] = at + np.searchsorted(bounds[1][at : high[rows[0]]], second[rows], "right")
    return out


def count_between(keys: DataFrame, points: list[int]) -> list[tuple[int, int]]:
    """Exact bytes and rows between neighbouring points: a vector a task, summed."""
    bounds, n = split_keys(points), len(points) + 1

    def run(batches):
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            if batch.num_rows:
                first, second, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                at = buckets(first, second, bounds)
                rows += np.bincount(at, minlength=n)
                np.add.at(size, at, own)
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(size[held]), pa.array(rows[held])], ["bucket", "bytes", "rows"])

    told = keys.select("__k1", "__k2", "size").mapInArrow(run, "bucket long, bytes long, rows long")
    out = [(0, 0)] * n
    for r in told.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect():
        out[r.bucket] = (r.bytes, r.rows)
    return out


def find_splitters(keys: DataFrame, total: int, aims: list[int], slack: list[int]) -> list[int]:
    """A point for each aim with bytes below it within the slack, or as near as any point comes."""
    low = [(0, 0)] * len(aims)  # point, bytes below
    high = [(SPAN, total)] * len(aims)
    found: list[int | None] = [None] * len(aims)
    while open_ := [j for j, x in enumerate(found) if x is None]:
        spans = {(low[j][0], high[j][0]) for j in open_}
        each = max(2, PROBES // len(spans))
        points = sorted({a + (b - a) * i // (each + 1) for a, b in spans for i in range(1, each + 1)} - {0, SPAN})
        below = dict(zip(points, np.cumsum([x for x, _ in count_between(keys, points)])[:-1].tolist(), strict=True))
        at = np.array(list(below.values()))
        for j in open_:
            i = int(np.searchsorted(at, aims[j], "right"))
            low[j] = max(low[j], (points[i - 1], int(at[i - 1]))) if i else low[j]
            high[j] = min(high[j], (points[i], int(at[i]))) if i < len(points) else high[j]
            best = min(low[j], high[j], key=lambda x: abs(x[1] - aims[j]))
            if abs(best[1] - aims[j]) <= slack[j] or high[j][0] - low[j][0] <= 1:
                found[j] = best[0]
    return found


def histogram_sort(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The documents with size, text_crc32, law, shard, slot and grown_shard.

    Size is the UTF-8 bytes of the text plus one; a null text has none and counts
    as equal to the empty one. Rows that repeat a doc_id and text keep one order
    but any of them may come first. Columns of ``docs`` that have one of the new
    names are replaced; other columns pass. An empty table gives no rows.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.drop(*new, "__k1", "__k2", "__at", "__piece", "__base").withColumns(
        {
            "size": F.octet_length(text).cast("long") + 1,
            "text_crc32": F.crc32(text.cast("binary")),
            "__k1": F.xxhash64(text),
            "__k2": F.xxhash64(F.lit(1), F.col("doc_id")),
        }
    )
    keys = checkpoint(keyed.select("__k1", "__k2", "size"))
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = max(LEAST_PIECES, -(-rows // (piece_rows * shards)))
    aims = [total * j // (shards * pieces) for j in range(1, shards * pieces)]
    fine, rough = tolerance * total / shards, 0.25 * total / (shards * pieces)
    cuts = [j % pieces == 0 for j in range(1, shards * pieces)]
    points = find_splitters(keys, total, aims, [fine if c else rough for c in cuts]) if rows else []
    # A cut between shards keeps its place among equal points; pieces may be empty.
    ordered = sorted(zip(points, cuts, strict=True)) if rows else []
    points = [p for p, _ in ordered]
    counted = count_between(keys, points)
    shard_of = np.concatenate([[0], np.cumsum([c for _, c in ordered])]).astype(np.int32) if ordered else np.zeros(1, np.int32)
    base, held = np.zeros(len(counted), np.int64), dict.fromkeys(range(shards), 0)
    for i, (_, n) in enumerate(counted):
        base[i] = held[int(shard_of[i])]
        held[int(shard_of[i])] += n
    bounds = split_keys(points)

    @F.pandas_udf("piece int, shard int, base long")
    def place(first: pd.Series, second: pd.Series) -> pd.DataFrame:
        at = buckets(first.to_numpy(), second.to_numpy(), bounds)
        return pd.DataFrame({"piece": at.astype(np.int32), "shard": shard_of[at], "base": base[at]})

    placed = keyed.withColumn("__at", place("__k1", "__k2")).withColumns({"__piece": F.col("__at.piece"), "shard": F.col("__at.shard"), "__base": F.col("__at.base")})
    order = Window.partitionBy("__piece").orderBy("__k1", "__k2", "doc_id")
    return placed.withColumns(
        {
            "law": F.lit("bytes"),
            "slot": (F.col("__base") + F.row_number().over(order) - 1).cast("long"),
            "grown_shard": F.lit(None).cast("int"),
        }
    ).drop("__k1", "__k2", "__at", "__piece", "__base")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder a shard, rows in slot order within each file."""
    histogram_sort(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
