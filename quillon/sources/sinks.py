"""Sinks: rows as text, JSON, tables; refusing instead of cutting; replacing by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell_text(df: DataFrame, name: str) -> Column:
    """A value as one cell: containers as JSON, tabs and line breaks as spaces, null as nothing."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    text = F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else c.cast("string")
    return F.coalesce(F.regexp_replace(text, "[\t\r\n]", " "), F.lit(""))


def as_tsv(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *(cell_text(df, c) for c in df.columns)).alias("value"))


def size_in_tokens(lines: DataFrame, value: str = "value") -> int:
    return int(lines.agg(F.coalesce(F.floor(F.sum(F.octet_length(value) + 1) / 4), F.lit(0))).first()[0])


class OverBudget(ValueError):
    pass


def refuse_over(lines: DataFrame, budget: int) -> DataFrame:
    """The lines if all of them fit, else an error: rows are never dropped."""
    need = size_in_tokens(lines)
    if budget and need > budget:
        raise OverBudget(f"{need} tokens, the budget is {budget}")
    return lines


def write_tsv(df: DataFrame, path: str, budget: int = 0) -> None:
    refuse_over(as_tsv(df), budget).write.mode("overwrite").text(path)


def as_json(df: DataFrame, group: str | None = None) -> DataFrame:
    """A JSON document a row, or one a group with its items."""
    if group is None:
        return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    rest = [c for c in df.columns if c != group]
    held = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("items"))
    return held.select(F.to_json(F.struct(F.col(group).alias("title"), "items")).alias("value"))


def as_table(df: DataFrame, width: int = 40) -> DataFrame:
    """Cells padded to one width."""
    return df.select(F.concat_ws("  ", *(F.rpad(cell_text(df, c), width, " ") for c in df.columns)).alias("value"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def create_table(df: DataFrame, name: str) -> None:
    df.write.mode("ignore").format("parquet").saveAsTable(name)


def drop_derived(tests: DataFrame, files: DataFrame) -> DataFrame:
    """Derived links go, those from coverage stay while both their files do."""
    known = files.select("path")
    kept = tests.where("source = 'coverage'")
    kept = kept.join(known.withColumnRenamed("path", "test_file"), "test_file", "left_semi")
    return kept.join(known.withColumnRenamed("path", "target_file"), "target_file", "left_semi").select(*tests.columns)


def as_markdown(df: DataFrame) -> DataFrame:
    """(position, value): a Markdown table; the head and its rule are rows 0 and 1, rows of data share 2."""
    cells = [F.replace(cell_text(df, c), F.lit("|"), F.lit("\\|")) for c in df.columns]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    spark = df.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "position int, value string")
    return head.unionByName(df.select(F.lit(2).alias("position"), row.alias("value")))


def keep_raw(logs: DataFrame, path: str, key: str = "log_id", text: str = "text") -> DataFrame:
    """Appends raw logs, a row each, to a table beside their reports; returns (key, bytes) of what was kept."""
    logs.select(key, text).write.mode("append").parquet(path)
    return logs.select(key, F.octet_length(text).cast("long").alias("bytes"))


def audit(df: DataFrame, path: str, rule: str) -> None:
    """Appends what a rule has decided, with the rule's name and the time, to a log that is never rewritten."""
    append(df.withColumns({"rule": F.lit(rule), "at": F.current_timestamp()}), path)
