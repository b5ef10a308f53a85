"""The call log: what each tool saved. The batch fold and the stream use the same expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "ts string, v int, tool string, model string, session string, cwd string, argv string, actual_bytes long, baseline_bytes long"
#: The tool whose early calls with context lines had no fair baseline.
SEARCH_TOOL = "search"


def credited(search_tool: str = SEARCH_TOOL) -> Column:
    """A baseline to hold against; early searches with context had none that was fair."""
    unfair = (F.coalesce("v", F.lit(1)) < 2) & (F.col("tool") == search_tool) & F.col("argv").rlike(r"(^|\s)-C")
    return F.coalesce(F.col("baseline_bytes").isNotNull() & (F.col("baseline_bytes") != 0) & ~unfair, F.lit(False))


def fold(events: DataFrame, by: str = "tool", ok: Column | None = None) -> DataFrame:
    """Calls, credited calls, sums of bytes and the last time of each tool."""
    good = credited() if ok is None else ok
    zero = F.lit(0).cast("long")
    return events.groupBy(by).agg(
        F.count("*").alias("calls"),
        F.count_if(good).alias("credited"),
        F.sum("actual_bytes").alias("actual"),
        F.coalesce(F.sum(F.when(good, F.col("actual_bytes"))), zero).alias("credited_actual"),
        F.coalesce(F.sum(F.when(good, F.col("baseline_bytes"))), zero).alias("baseline"),
        F.max("ts").alias("last_ts"),
    )


def zero_fill(folded: DataFrame, domain: DataFrame, by: str = "tool") -> DataFrame:
    """A row for every tool of the domain, and for no other."""
    out = domain.join(folded, by, "left")
    counts = [c for c in folded.columns if c not in (by, "last_ts")]
    return out.select(by, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), "last_ts")


def saved(folded: DataFrame, by: str = "tool") -> DataFrame:
    """What was saved, and the mean for each credited call; null where none was credited."""
    return folded.withColumn("saved", F.col("baseline") - F.col("credited_actual")).withColumn("avg_saved", F.when(F.col("credited") > 0, F.col("saved") / F.col("credited")))


def report(filled: DataFrame, by: str = "tool") -> DataFrame:
    """Used tools first, then those with credit, by what they saved, by calls, by name; and a total row."""
    rows = saved(filled, by)
    order = Window.orderBy(F.desc(F.col("calls") > 0), F.desc(F.col("credited") > 0), F.desc("saved"), F.desc("calls"), by)
    placed = rows.withColumn("position", F.row_number().over(order))
    sums = ["calls", "credited", "actual", "credited_actual", "baseline", "saved"]
    total = rows.agg(*(F.sum(c).alias(c) for c in sums), F.max("last_ts").alias("last_ts"))
    total = total.select(F.lit("total").alias(by), *sums, "last_ts", (F.col("saved") / F.when(F.col("credited") > 0, F.col("credited"))).alias("avg_saved"), F.lit(0).alias("position"))
    return placed.unionByName(total.select(*placed.columns))


def last_model(events: DataFrame, by: str = "session", order: str = "ts") -> DataFrame:
    """The last model that a session names."""
    named = F.when(F.coalesce("model", F.lit("")) != "", F.col("model"))
    return events.groupBy(by).agg(F.max_by("model", F.when(named.isNotNull(), F.col(order))).alias("model"))


def once_per_session(events: DataFrame, rule: Column) -> DataFrame:
    """The first event of each session that a rule holds for."""
    rank = F.row_number().over(Window.partitionBy("session").orderBy("ts"))
    return events.where(rule).withColumn("__r", rank).where("__r = 1").drop("__r")


def read_limits(whole_read: Column, size: Column, results: Column, limit: Column, one_file: Column) -> Column:
    """Which nudge a call earns: a whole read of 6,000 bytes or more, or 8 result lines or more without a narrow limit."""
    narrow = F.coalesce(limit.between(1, 25), F.lit(False)) | F.coalesce(one_file, F.lit(False))
    return F.when(whole_read & (size >= 6000), "read").when((results >= 8) & ~narrow, "search")
