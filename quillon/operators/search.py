"""Search over lines: match, cluster near-duplicates, rank by weight, cut to a budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

SHOW_ALL, REPRESENTATIVES, STORED = 5, 3, 200


def pattern(what: str, fixed: bool = False, word: bool = False, ignore_case: bool = False) -> str:
    """A regular expression from a search string and its flags."""
    rx = re.escape(what) if fixed else what
    rx = rf"\b(?:{rx})\b" if word else rx
    return f"(?i){rx}" if ignore_case else rx


def hits(lines: DataFrame, rx: str, line: str = "line") -> DataFrame:
    return lines.where(F.col(line).rlike(rx))


def counts(found: DataFrame, by: str) -> DataFrame:
    return found.groupBy(by).agg(F.count("*").alias("n_hits"))


def clusters(found: DataFrame, by: str, order: list[str], line: str = "line") -> DataFrame:
    """(by, key, size, first, line): lines that differ in digits and spaces only, with the first of them."""
    return found.groupBy(by, t.near_key(line).alias("key")).agg(F.count("*").alias("size"), F.min(F.struct(*order, F.col(line).alias("line"))).alias("first"))


def representatives(grouped: DataFrame, by: str, most: int = REPRESENTATIVES) -> DataFrame:
    """The largest clusters of each group, ties by first line."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("size"), "first"))
    return grouped.withColumn("rank", rank).where(F.col("rank") <= most)


def rank_groups(per_group: DataFrame, by: str, weight: Column, most: int = 10_000) -> DataFrame:
    """Position of the first groups by count times weight, ties by name: a top-k, then numbers.

    A budget of b tokens shows at most 4 (b + 1) rows, so a caller with a budget
    loses nothing if ``most`` is that many; others must say how many they want.
    """
    scored = per_group.withColumn("score", F.col("n_hits") * weight)
    order = [F.desc("score"), F.col(by)]
    return scored.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def first_hits(found: DataFrame, by: str, order: list[str], most: int = STORED) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def context(texts: DataFrame, keys: list[str], rx: str, radius: int, text: str = "text") -> DataFrame:
    """(keys, line_no, line): lines around hits that are no hits themselves, found within each text's row.

    Texts without a hit go first; nothing is exchanged.
    """
    matching = F.transform("l", lambda x, i: F.when(x.rlike(rx), i + 1))
    around = lambda at: F.sequence(F.greatest(at - radius, F.lit(1)), F.least(at + radius, F.size("l")))
    held = texts.where(F.col(text).rlike(rx)).select(*keys, t.line_array(text).alias("l"))
    placed = held.select(*keys, "l", F.filter(matching, lambda at: at.isNotNull()).alias("hits"))
    near = F.array_except(F.flatten(F.transform("hits", around)), "hits")
    return placed.select(*keys, "l", F.explode(near).alias("line_no")).select(*keys, "line_no", F.element_at("l", F.col("line_no")).alias("line"))


def unshown(grouped: DataFrame, shown: DataFrame, by: str) -> DataFrame:
    """Clusters of each group without a representative."""
    return grouped.join(shown.select(by, "key"), [by, "key"], "left_anti").groupBy(by).agg(F.count("*").alias("n_unshown"))
