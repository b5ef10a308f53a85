"""Windows, runs and merged ranges; events in time as a stream extension."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import budget, intervals
from ..session import table
from .catalog import query


@query(
    """WITH s AS (SELECT user_id, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + 3600 AS b FROM events),
r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM r)
SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS n_merged FROM g GROUP BY user_id, grp"""
)
def interval_merge(spark, d):
    """Half seconds go to the even second, as the SQL's cast takes them."""
    e = table(spark, d, "events").select("user_id", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("a")).withColumn("b", F.col("a") + 3600)
    return intervals.merge(e, ["user_id"], "a", "b")


@query("WITH p AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS run FROM conversations) SELECT conv_id, role, min(pos)::BIGINT AS first_pos, count(*) AS length FROM p GROUP BY conv_id, role, run")
def run_collapse(spark, d):
    runs = intervals.runs(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role")
    return runs.withColumn("first_pos", F.col("first_pos").cast("long"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def window_rank(spark, d):
    loose, full = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    cols = {"rank": F.rank().over(loose), "dense": F.dense_rank().over(loose), "rn": F.row_number().over(full), "quarter": F.ntile(4).over(full)}
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", *(c.cast("long").alias(n) for n, c in cols.items()))


@query("SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2) OVER w AS after2, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type", 2).over(w).alias("after2"), F.first("event_id").over(w).alias("first_id"))


@query("SELECT o_orderkey, sum(o_totalprice::DECIMAL(15,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DECIMAL(18,2) AS last3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM orders")
def frame_sum(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice").cast("decimal(15,2)")
    return table(spark, d, "orders").select("o_orderkey", F.sum(price).over(w.rowsBetween(-2, 0)).cast("decimal(18,2)").alias("last3"), F.count("*").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("ahead"))


@query("SELECT c_custkey, sum(c_acctbal::DECIMAL(15,2)) OVER (ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DECIMAL(18,2) AS left_sum FROM customer WHERE c_custkey < 200", part=True)
def suffix_sums(spark, d):
    """What is left from each row on, for the row that stands for the rest."""
    w = Window.orderBy("c_custkey").rowsBetween(0, Window.unboundedFollowing)
    return table(spark, d, "customer").where("c_custkey < 200").select("c_custkey", F.sum(F.col("c_acctbal").cast("decimal(15,2)")).over(w).cast("decimal(18,2)").alias("left_sum"))


@query("SELECT c_custkey, sum(c_acctbal::DECIMAL(15,2)) OVER (ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DECIMAL(18,2) AS left_sum FROM customer")
def suffix_sums_all(spark, d):
    """suffix_sums over all customers, in two levels."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    left = budget.suffix_sum(c, "c_custkey", F.col("c_acctbal").cast("decimal(15,2)"), "left_sum")
    return left.select("c_custkey", F.col("left_sum").cast("decimal(18,2)").alias("left_sum"))


@query("SELECT event_id, last_value(CASE WHEN value > 100 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_big FROM events")
def last_non_empty(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("value") > 100, F.col("event_id")), ignorenulls=True).over(w).alias("last_big"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    w = F.window("ts", "1 day")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS begun, count(*) AS n FROM s GROUP BY user_id, s"""
)
def session_windows(spark, d):
    w = F.session_window("ts", "6 hours")
    return table(spark, d, "events").groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begun"), "n")
