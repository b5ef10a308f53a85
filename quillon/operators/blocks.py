"""Blocks of lines: sections, windows, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

WINDOW = 20


def headings(lines: DataFrame, is_heading: Column, level: Column, title: Column) -> DataFrame:
    return lines.where(is_heading).withColumns({"level": level, "title": title})


def occurrence(heads: DataFrame, by: list[str]) -> DataFrame:
    """Which one of equal headings it is, from 1."""
    return heads.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by, "level", "title").orderBy("line_no")))


def section_ends(heads: DataFrame, by: str, n_lines: str, levels: int = 6) -> DataFrame:
    """A section ends before the next heading of its own or a higher level: one window a level, no self join."""
    ahead = Window.partitionBy(by).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    nexts = {k: F.min(F.when(F.col("level") <= k, F.col("line_no"))).over(ahead) for k in range(1, levels + 1)}
    upcoming = F.coalesce(*(F.when(F.col("level") == k, w) for k, w in nexts.items()))
    return heads.withColumn("end_line", F.coalesce(upcoming - 1, F.col(n_lines)))


def windows(n_lines: Column, size: int = WINDOW) -> Column:
    """Array of struct(start, end): fixed stretches of lines that tile a text."""
    return F.when(n_lines > 0, F.transform(F.sequence(F.lit(1), n_lines, F.lit(size)), lambda s: F.struct(s.alias("start"), F.least(s + size - 1, n_lines).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def blocks(spans: DataFrame, by: str, n_lines: str, size: int = WINDOW) -> DataFrame:
    """Spans clamped to the next start, and windows over the lines between them."""
    order = Window.partitionBy(by).orderBy("start", "end")
    clamped = spans.withColumn("end", F.least(F.col("end"), F.coalesce(F.lead("start").over(order) - 1, F.col(n_lines))))
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = clamped.select(by, (reach + 1).alias("from"), (F.col("start") - 1).alias("to"), n_lines)
    tails = clamped.groupBy(by).agg((F.max("end") + 1).alias("from"), F.max(n_lines).alias("to"), F.max(n_lines).alias(n_lines))
    open_ = gaps.unionByName(tails).where("`from` <= `to`")
    filled = open_.select(by, F.explode(F.sequence("from", "to", F.lit(size))).alias("start"), "to", n_lines).select(by, "start", F.least(F.col("start") + size - 1, F.col("to")).alias("end"), n_lines, F.lit("window").alias("kind"))
    return clamped.select(by, "start", "end", n_lines, F.lit("symbol").alias("kind")).unionByName(filled)


def score(text: Column, words: list[str], n_lines: Column) -> Column:
    """hits * max(matched, 1) / words / sqrt(lines): plain occurrences, and words found as whole words."""
    low = F.lower(text)
    hits = sum((t.occurrences(low, w.lower()) for w in words), F.lit(0))
    matched = sum((F.when(low.rlike(rf"\b{w.lower()}\b"), 1).otherwise(0) for w in words), F.lit(0))
    return hits * F.greatest(matched, F.lit(1)) / F.lit(len(words)) / F.sqrt(n_lines)


def earlier_sibling(heads: DataFrame, by: str, levels: int = 6) -> DataFrame:
    """Adds ``sibling``: the nearest earlier heading of the same or a higher level."""
    behind = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    above = {k: F.last(F.when(F.col("level") <= k, F.col("line_no")), ignorenulls=True).over(behind) for k in range(1, levels + 1)}
    return heads.withColumn("sibling", F.coalesce(*(F.when(F.col("level") == k, w) for k, w in above.items())))
