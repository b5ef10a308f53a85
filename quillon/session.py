"""The session and the tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; on a cluster the master comes from submission."""
    builder = SparkSession.builder.appName("quillon")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views over the tables, for plain SQL."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def local_cpus() -> str:
    return os.environ.get("BENCH_CPUS", "8")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names, set where none is; one of this machine only where all of Spark is on it, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints")
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows in files that all executors share, and nothing of the plan behind them."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
