"""Profiles: columns, JSON paths, log templates, markup tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

DISTINCT_CAP, TEMPLATE_CAP, EXAMPLES = 256, 512, 2


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, cell): every cell as text, null as the empty cell."""
    cells = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("cell")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.column", "x.cell")


def type_name(counts: Column) -> Column:
    """From struct(kind, n) of the kinds but null: one kind, float for int and float, else mixed(a|b) by count and name."""
    ranked = F.transform(F.array_sort(F.transform(counts, lambda x: F.struct((-x.n).alias("n"), x.kind.alias("kind")))), lambda x: x.kind)
    return (
        F.when(F.size(ranked) == 0, "null")
        .when(F.size(ranked) == 1, F.element_at(ranked, 1))
        .when(F.array_sort(ranked) == F.array(F.lit("float"), F.lit("int")), "float")
        .otherwise(F.concat(F.lit("mixed("), F.array_join(ranked, "|"), F.lit(")")))
    )


def columns(df: DataFrame, names: list[str], cap: int = DISTINCT_CAP) -> DataFrame:
    """One row a column: type, rows, nulls, null_pct, numeric and text bounds, distinct cells up to the cap.

    One pass over unpivoted cells; the exact distinct count is capped in the answer,
    not in the work, and partial aggregation keeps the shuffle at distinct cells.
    """
    cells = unpivot(df, names).withColumn("kind", t.cell_kind("cell"))
    number = F.when(F.col("kind").isin("int", "float"), F.col("cell").try_cast("double"))
    word = F.when(F.col("kind").isin("date", "str"), F.col("cell"))
    # By distinct cell first, so that the counts per column are sums of few rows.
    by_cell = cells.groupBy("column", "cell", "kind").agg(F.count("*").alias("n"))
    kinds = "int float bool date str".split()
    out = by_cell.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("kind") == "null", F.col("n"))), F.lit(0)).alias("nulls"),
        F.min(number).alias("num_min"),
        F.max(number).alias("num_max"),
        F.min(word).alias("str_min"),
        F.max(word).alias("str_max"),
        F.count_if(F.col("kind") != "null").alias("n_cells"),
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"__{k}") for k in kinds),
    )
    counts = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"__{k}").alias("n")) for k in kinds)), lambda x: x.n > 0)
    return out.select(
        "column",
        type_name(counts).alias("type"),
        "n_rows",
        "nulls",
        F.bround(F.lit(100.0) * F.col("nulls") / F.col("n_rows")).cast("long").alias("null_pct"),
        "num_min",
        "num_max",
        "str_min",
        "str_max",
        F.least(F.col("n_cells"), F.lit(cap)).alias("distinct_capped"),
        (F.col("n_cells") > cap).alias("over_cap"),
    )


def kind_counts(df: DataFrame, names: list[str]) -> DataFrame:
    return unpivot(df, names).groupBy("column", t.cell_kind("cell").alias("kind")).agg(F.count("*").alias("n"))


def nesting(json: Column | str) -> Column:
    """How deep brackets are nested in a JSON text; those in strings don't count."""
    bare = F.regexp_replace(F.regexp_replace(t.col(json), r'"(?:\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    step = lambda now, c: F.struct((now.at + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("at"), F.greatest(now.most, now.at + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda now: now.most)


def json_paths(df: DataFrame, column: str, order: list[str], depth: int | None = None) -> DataFrame:
    """Schema paths of a JSON column: kinds, counts, presence within the parent, array lengths, first examples.

    Levels of the document are unfolded one at a time with VARIANT functions, as many
    as the deepest document has (one number, asked first) unless ``depth`` says to
    stop above; null counts as present, a missing key doesn't.
    """
    if depth is None:
        depth = 1 + (df.agg(F.max(nesting(column))).first()[0] or 0)
    level = df.select(*order, F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("v")).where("v is not null")
    found = None
    for _ in range(depth):
        kind = F.lower(F.regexp_extract(F.schema_of_variant("v"), r"^(\w+)", 1))
        now = level.withColumn("kind", F.when(kind.isin("bigint", "decimal", "long"), F.when(F.schema_of_variant("v").rlike(r"^DECIMAL\(\d+,[1-9]"), "float").otherwise("int")).when(kind == "void", "null").when(kind == "string", "str").when(kind == "boolean", "bool").when(kind == "double", "float").otherwise(kind))
        rows = now.select(*order, "path", "kind", F.when(kind.isin("object", "array"), F.lit(None)).otherwise(F.try_variant_get("v", "$", "string")).alias("value"), F.when(kind == "array", F.size(F.try_variant_get("v", "$", "array<variant>"))).alias("length"))
        found = rows if found is None else found.unionByName(rows)
        as_map = now.where("kind = 'object'").select(*order, "path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "v")).select(*order, F.concat("path", F.lit("."), "key").alias("path"), "v")
        as_list = now.where("kind = 'array'").select(*order, "path", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v")).select(*order, F.concat("path", F.lit("[]")).alias("path"), "v")
        level = as_map.unionByName(as_list)
    return found


def path_profile(paths: DataFrame) -> DataFrame:
    """From json_paths: path, n, each kind's count as text, n of the parent object, presence in percent, lengths."""
    per = paths.groupBy("path", "kind").agg(F.count("*").alias("n"), F.min("length").alias("least"), F.max("length").alias("most"))
    whole = per.groupBy("path").agg(
        F.sum("n").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind"))), lambda x: x.kind), "|").alias("kinds"),
        F.sum(F.when(F.col("kind") == "object", F.col("n"))).alias("objects"),
        F.min("least").alias("len_min"),
        F.max("most").alias("len_max"),
    )
    parent = whole.select(F.col("path").alias("parent"), F.col("objects").alias("parent_n"))
    keyed = whole.withColumn("parent", F.when(F.col("path").rlike(r"\.[^.\[\]]+$"), F.regexp_replace("path", r"\.[^.\[\]]+$", "")))
    joined = keyed.join(parent, "parent", "left")
    return joined.select("path", "n", "kinds", F.bround(100.0 * F.col("n") / F.col("parent_n")).cast("long").alias("presence_pct"), "len_min", "len_max")


def examples(paths: DataFrame, order: list[str], most: int = EXAMPLES) -> DataFrame:
    """The first distinct values of each path in order of appearance."""
    first = paths.where("value is not null").groupBy("path", "value").agg(F.min(F.struct(*order)).alias("at"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("at", "value"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x.value).alias("examples"))


def template_counts(lines: DataFrame, order: list[str], cap: int = TEMPLATE_CAP, line: str = "line", format_name: Column | None = None) -> DataFrame:
    """(template, n, first, over_cap): templates in order of first appearance; beyond the cap they only count."""
    per = lines.where(F.trim(F.col(line)) != "").groupBy(t.template(line, format_name).alias("template")).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    last = per.orderBy("first").limit(cap).agg(F.max("first").alias("__last"))  # a top-k, then one row
    return per.crossJoin(last).withColumn("over_cap", F.col("first") > F.col("__last")).drop("__last")


def first_and_last(lines: DataFrame, by: list[str], order: str, line: str = "line") -> DataFrame:
    """Of each group: number of lines, the first and the last that isn't blank, with their numbers."""
    shown = F.when(F.trim(F.col(line)) != "", F.col(order))
    return lines.groupBy(*by).agg(F.count("*").alias("n_lines"), F.min(shown).alias("first_no"), F.min_by(line, shown).alias("first_line"), F.max(shown).alias("last_no"), F.max_by(line, shown).alias("last_line"))


def tag_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of opening tags in markup."""
    return df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def attribute_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of (tag, attribute) in markup with quoted values."""
    tags = df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit("<[a-z][a-z0-9]*(?: [^<>]*)?>"), 0)).alias("tag"))
    return tags.select(F.regexp_extract("tag", "^<([a-z0-9]+)", 1).alias("tag"), F.explode(F.regexp_extract_all(F.col("tag"), F.lit(' ([a-z][a-z0-9-]*)="'), 1)).alias("attribute")).groupBy("tag", "attribute").agg(F.count("*").alias("n"))
