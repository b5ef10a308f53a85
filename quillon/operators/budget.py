"""Budgets: keep the best rows within a size, and always say what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: list[Column], cost: Column, by: list[str] | None = None) -> DataFrame:
    """Adds ``used``: the cost of a row and of all ahead of it in its group."""
    window = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(cost).over(window))


def suffix_sum(df: DataFrame, order: str, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` from each row to the last one by ``order``, over the whole table.

    Two levels: the table is cut at quantiles of the numeric ``order`` into ranges
    (as many as shuffle partitions), a window sums within a range, and the total of
    all later ranges, one row a range, is added. The cuts move work, never results.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    at = F.col(order)
    # Nulls are last, as in the SQL.
    part = F.when(at.isNull(), len(cuts)).otherwise(F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + (at > c).cast("int"))) if cuts else F.lit(0)
    held = df.withColumns({"__part": part, "__value": value})
    later = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ahead = held.groupBy("__part").agg(F.sum("__value").alias("__sum")).select("__part", F.sum("__sum").over(later).alias("__ahead"))
    within = Window.partitionBy("__part").orderBy(at.asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    own = held.withColumn("__own", F.sum("__value").over(within)).join(F.broadcast(ahead), "__part")
    total = F.coalesce(F.col("__own") + F.coalesce("__ahead", F.lit(0)), "__ahead")
    return own.withColumn(name, total).drop("__part", "__value", "__own", "__ahead")


def fit(df: DataFrame, order: list[Column], cost: Column, budget: int, per_unit: int = 4, by: list[str] | None = None) -> DataFrame:
    """The rows whose running cost stays within the budget (in units of ``per_unit``).

    A row costs 1 at least, so without groups only the first (budget + 1) * per_unit
    rows can matter: they are picked by a distributed top-k, and the running sum
    is over that many rows, whatever the table.
    """
    if not by:
        df = df.orderBy(*order).limit((budget + 1) * per_unit)
    return running(df, order, cost, by).where(F.floor(F.col("used") / per_unit) <= budget)


def residual(df: DataFrame, order: list[Column], cost: Column, budget: int, sums: list[str] = (), per_unit: int = 4) -> DataFrame:
    """One row: rows shown and omitted, and the sums of the omitted ones. shown + omitted is the total."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    whole = df.agg(F.count("*").alias("__n"), *(total(c, f"__{c}") for c in sums))
    shown = fit(df, order, cost, budget, per_unit).agg(F.count("*").alias("shown"), *(total(c, f"__shown_{c}") for c in sums))
    both = whole.crossJoin(shown)  # a row each
    return both.select("shown", (F.col("__n") - F.col("shown")).alias("omitted"), *((F.col(f"__{c}") - F.col(f"__shown_{c}")).alias(f"omitted_{c}") for c in sums))


def pick_level(levels: DataFrame, budget: int, level: str = "level", cost: str = "cost") -> DataFrame:
    """The most detailed level that fits, else the least detailed one."""
    fits = F.min(F.when(F.col(cost) <= budget, F.col(level)))
    return levels.agg(F.coalesce(fits, F.max(level)).alias("level"))


def uniform_cap(sizes: DataFrame, group: str, n: str, budget: int, floor: int = 0) -> DataFrame:
    """The largest cap that lets all groups show so many rows each within a number of rows.

    Caps are judged at the group sizes and between them in closed form: with sizes in
    order, a cap c costs the smaller groups' sizes plus c for each larger one. Sizes
    are counted first, all that no budget can hold as one, so the running sums are
    over budget + 2 rows at most.
    """
    size = F.least(F.col(n), F.lit(budget + 1)).cast("long")
    held = sizes.groupBy(size.alias("n")).agg(F.count(group).alias("groups"))
    smaller = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("n").rowsBetween(0, Window.unboundedFollowing)
    placed = held.select("n", F.coalesce(F.sum(F.col("n") * F.col("groups")).over(smaller), F.lit(0)).alias("below"), F.sum("groups").over(rest).alias("left"))
    cap = F.floor((F.lit(budget) - F.col("below")) / F.col("left"))
    # The first size that is larger than the cap it would get decides; if none is, all fit.
    decided = placed.agg(F.min(F.when(cap < F.col("n"), F.struct("n", cap.alias("cap")))).alias("x"), F.max("n").alias("most"))
    return decided.select(F.greatest(F.coalesce("x.cap", "most"), F.lit(floor)).cast("long").alias("cap"))


def protect_tail(df: DataFrame, order: list[Column], cost: Column, tail: Column, budget: int, per_unit: int = 4) -> DataFrame:
    """Rows within what the budget leaves beside the protected ones, which always stay."""
    held = df.withColumn("__tail", tail)
    kept = held.agg(F.coalesce(F.sum(F.when(F.col("__tail"), cost)), F.lit(0)).alias("__kept"))
    most = held.where("not __tail").orderBy(*order).limit((budget + 1) * per_unit)
    rows = running(most, order, cost).crossJoin(kept)  # one row
    shown = rows.where(F.floor((F.col("used") + F.col("__kept")) / per_unit) <= budget).drop("used", "__kept")
    return shown.unionByName(held.where("__tail")).drop("__tail")


def ladder(levels: list[DataFrame], cost: str, budget: int, per_unit: int = 4) -> DataFrame:
    """The first of several renderings, from full to brief, that fits; the last one if none does.

    Each is measured by one aggregate, and only until one fits. The last one must be bounded by itself.
    """
    for level in levels[:-1]:
        used = level.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
        if used // per_unit <= budget:
            return level
    return levels[-1]
