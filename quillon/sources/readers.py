"""Sources: files of any format as DataFrames, with the format told from name or content."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.tokens import binary_probe

# Formats by extension.
EXTENSIONS = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".yaml": "yaml", ".yml": "yaml", ".csv": "csv", ".tsv": "tsv", ".xml": "xml", ".log": "log", ".toml": "toml"}
HEAD = 8192
SKIPPED = ".git .hg .svn node_modules dist build __pycache__ .venv venv .tox target .next .nuxt .cache coverage .pytest_cache .mypy_cache .ruff_cache vendor .idea".split()
TOML_TABLE = r"^\[\[?[A-Za-z0-9_.\"'-]+\]\]?\s*(#.*)?$"
TOML_VALUE = r"^[A-Za-z0-9_.\"'-]+\s*=\s*([\"'\[{+-]|\d|true\b|false\b)"


def format_by_name(path: Column | str) -> Column:
    return t.lookup(t.extension(path), EXTENSIONS)


def is_json(line: str) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def sniff(head: str) -> str:
    """The format of a text by its beginning; ``binary`` and ``empty`` have none."""
    if "\0" in head:
        return "binary"
    rows = [x for x in head.splitlines() if x.strip()]
    if not rows:
        return "empty"
    first = head.lstrip("﻿").lstrip()
    if first.startswith("<"):
        return "xml"
    meant = next((x.strip() for x in rows if not x.strip().startswith("#")), "")
    listed = first[0] == "[" and is_json(rows[0])
    if not listed and (re.match(TOML_TABLE, meant) or re.match(TOML_VALUE, meant)):
        return "toml"
    if first[0] in "{[":
        return "jsonl" if len(rows) > 1 and is_json(rows[0]) and is_json(rows[1]) else "json"
    for mark, name in (("\t", "tsv"), (",", "csv")):
        counts = {x.count(mark) for x in rows[:5]}
        if len(rows) > 1 and len(counts) == 1 and counts != {0}:
            return name
    return "yaml" if rows[0].startswith("---") or re.match(r"^[\w.-]+:(?:\s|$)", rows[0]) else "log"


def format_by_content(head: Column) -> Column:
    def run(held: pd.Series) -> pd.Series:
        return held.map(lambda x: sniff(x or ""))

    return F.pandas_udf(run, "string")(head)


def detect(files: DataFrame) -> DataFrame:
    """Adds ``format`` and ``told_by`` to (path, text)."""
    named = format_by_name("path")
    return files.withColumn("told_by", F.when(named.isNotNull(), "extension").otherwise("content")).withColumn("format", F.coalesce(named, format_by_content(F.substring("text", 1, HEAD))))


def read_files(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """(path, text, size) of the text files below a folder; skipped folders, large and binary files are counted by left_out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split(raw.path, "/")
    kept = raw.where(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED)))).where(F.col("length") <= most)
    text = kept.where(~binary_probe(F.col("content")))
    return text.select("path", F.regexp_replace(F.decode("content", "utf-8"), "^﻿", "").alias("text"), F.col("length").alias("size"))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Root ignore patterns against a path's name, its whole and any of its folders."""
    clean = [p.strip().rstrip("/") for p in patterns if p.strip() and not p.startswith("#")]
    parts = F.split(path, "/")

    def named(p: str) -> Column:
        rx = t.glob_regex(p)
        return F.exists(parts, lambda x: x.rlike(rx))

    tests = [named(p) | path.rlike(t.glob_regex(p)) | path.rlike(t.glob_regex("*/" + p)) for p in clean]
    out = F.lit(False)
    for x in tests:
        out = out | x
    return out


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text and log files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return t.lines(whole, ["path"])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc) of whole JSON documents; a broken one is null."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))


def json_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``doc`` and ``bad``; blank lines are left out, broken ones stay and count."""
    held = lines.where(F.trim(F.col(value)) != "")
    return held.withColumn("doc", F.try_parse_json(value)).withColumn("bad", F.col("doc").isNull())


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark.read.text(path))


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All cells as text; the empty cell stays the empty text, short rows are filled with it."""
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=True, mode="PERMISSIVE", nullValue="\u0000", emptyValue="", escape='"')
    return raw.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t")


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


ELEMENTS = "path string, element string, attribute string, has_text boolean"


def xml_elements(files: DataFrame) -> DataFrame:
    """(path, element path, attribute, has_text): one row an element, and one an attribute."""
    import io
    from xml.etree import ElementTree

    def run(frames):
        for frame in frames:
            rows = []
            for path, text in frame.itertuples(index=False):
                stack: list[str] = []
                try:
                    for event, node in ElementTree.iterparse(io.StringIO(text or ""), ("start", "end")):
                        if event == "start":
                            stack.append(re.sub(r"^\{.*\}", "", node.tag))
                        else:
                            name = "/".join(stack)
                            rows.append((path, name, None, bool((node.text or "").strip())))
                            rows += [(path, name, re.sub(r"^\{.*\}", "", a), None) for a in node.attrib]
                            stack.pop()
                            node.clear()
                except ElementTree.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "element", "attribute", "has_text"])

    return files.select("path", "text").mapInPandas(run, ELEMENTS)


def toml_as_json(text: Column | str) -> Column:
    """JSON of a TOML document, dates as text; null where it is none."""

    def one(x):
        import tomllib

        try:
            return json.dumps(tomllib.loads(x or ""), default=str)
        except (tomllib.TOMLDecodeError, ValueError):
            return None

    def run(held: pd.Series) -> pd.Series:
        return held.map(one)

    return F.pandas_udf(run, "string")(text)


def yaml_as_json(text: Column | str) -> Column:
    """JSON of a YAML document where PyYAML is installed, else null."""

    def run(held: pd.Series) -> pd.Series:
        try:
            import yaml
        except ImportError:
            return pd.Series([None] * len(held), dtype=object)

        def one(x):
            try:
                return json.dumps(yaml.safe_load(x or ""), default=str)
            except yaml.YAMLError:
                return None

        return held.map(one)

    return F.pandas_udf(run, "string")(text)


def parse(files: DataFrame) -> DataFrame:
    """Adds ``doc`` and ``bad`` to (path, text, format) for formats with a tree; TOML that isn't falls back to a log.

    A document that doesn't parse, or that nothing here can parse (YAML without its library), is bad.
    """
    toml = F.when(F.col("format") == "toml", toml_as_json("text"))
    held = files.withColumn("__toml", toml).withColumn("format", F.when((F.col("format") == "toml") & F.col("__toml").isNull(), "log").otherwise(F.col("format")))
    raw = F.when(F.col("format") == "json", F.col("text")).when(F.col("format") == "yaml", yaml_as_json("text")).otherwise(F.col("__toml"))
    parsed = held.withColumn("doc", F.try_parse_json(raw)).drop("__toml")
    return parsed.withColumn("bad", F.col("format").isin("json", "yaml", "toml") & F.col("doc").isNull())


def search_stream(spark: SparkSession, path: str, stored: int = 200) -> DataFrame:
    """(path, line_no, text, is_match) of a search tool's JSON events, the first matches of each file."""
    return search_events(spark.read.text(path), stored)


def search_events(lines: DataFrame, stored: int = 200, value: str = "value") -> DataFrame:
    from pyspark.sql import Window

    ddl = "type string, data struct<path:struct<text:string>,lines:struct<text:string>,line_number:int>"
    e = lines.select(F.from_json(value, ddl).alias("e")).where("e.type in ('match', 'context')")
    rows = e.select(t.plain_path("e.data.path.text").alias("path"), F.col("e.data.line_number").alias("line_no"), F.regexp_replace("e.data.lines.text", "[\r\n]+$", "").alias("text"), (F.col("e.type") == "match").alias("is_match"))
    rank = F.row_number().over(Window.partitionBy("path", "is_match").orderBy("line_no"))
    return rows.withColumn("__r", rank).where(F.col("__r") <= F.when(F.col("is_match"), stored).otherwise(2 * stored)).drop("__r")


def status_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """(section, code, path) of a version tool's porcelain v2 status, and branch rows."""
    v = F.col(value)
    part = lambda rx, i: F.regexp_extract(v, rx, i)
    entry = r"^(?:(1) (..) (?:\S+ ){6}|(2) (..) (?:\S+ ){7}|(u) (..) (?:\S+ ){8})([^\t]+)(?:\t.*)?$"
    either = lambda *i: F.concat(*(part(entry, k) for k in i))
    tracked = lines.where(v.rlike("^[12u] ")).select(either(1, 3, 5).alias("kind"), either(2, 4, 6).alias("xy"), part(entry, 7).alias("path"))
    staged = tracked.where("kind != 'u' and substring(xy, 1, 1) != '.'").select(F.lit("staged").alias("section"), F.substring("xy", 1, 1).alias("code"), "path")
    unstaged = tracked.where("kind != 'u' and substring(xy, 2, 1) != '.'").select(F.lit("unstaged").alias("section"), F.substring("xy", 2, 1).alias("code"), "path")
    unmerged = tracked.where("kind = 'u'").select(F.lit("unmerged").alias("section"), F.col("xy").alias("code"), "path")
    untracked = lines.where(v.rlike(r"^\? ")).select(F.lit("untracked").alias("section"), F.lit("?").alias("code"), F.substring(v, 3, 1 << 20).alias("path"))
    branch = lines.where(v.rlike("^# branch")).select(F.lit("branch").alias("section"), part(r"^# branch\.(\S+)", 1).alias("code"), part(r"^# branch\.\S+ (.*)$", 1).alias("path"))
    return staged.union(unstaged).union(unmerged).union(untracked).union(branch)


def numstat_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """(path, plus, minus, is_binary)"""
    p = F.split(F.col(value), "\t")
    return lines.where(F.col(value).contains("\t")).select(p[2].alias("path"), F.coalesce(p[0].try_cast("int"), F.lit(0)).alias("plus"), F.coalesce(p[1].try_cast("int"), F.lit(0)).alias("minus"), (p[0] == "-").alias("is_binary"))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSON log; torn records are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def at_version(versions: DataFrame, rev: str) -> DataFrame:
    """(path, text) of one version of a (rev, path, text) table."""
    return versions.where(F.col("rev") == rev).select("path", F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", "").alias("text"))


def commit_rows(lines: DataFrame, order: str, value: str = "value") -> DataFrame:
    """(position, sha, subject, author) of log lines ``sha subject (author)``; other lines are none."""
    rx = r"^([0-9a-f]{4,40}) (.*) \(([^()]*)\)$"
    part = lambda i: F.regexp_extract(value, rx, i)
    return lines.where(F.col(value).rlike(rx)).select(F.col(order).alias("position"), part(1).alias("sha"), part(2).alias("subject"), part(3).alias("author"))


def name_status_rows(outputs: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, code, old_path, path) of NUL-separated name-status output; renames and copies have two paths.

    A field is a status if an even walk from the start meets it, so each output is
    walked in its row: the state says how many paths are still to come.
    """
    step = lambda held, x: (
        F.when(held.left > 0, F.struct((held.left - 1).alias("left"), F.concat(held.out, F.array(F.struct(held.code.alias("code"), x.alias("path"), held.left.alias("left")))).alias("out"), held.code.alias("code")))
        .otherwise(F.struct(F.when(x.rlike("^[RC]"), 2).otherwise(1).alias("left"), held.out.alias("out"), x.alias("code")))
    )
    kind = "array<struct<code:string,path:string,left:int>>"
    start = F.struct(F.lit(0).alias("left"), F.array().cast(kind).alias("out"), F.lit("").alias("code"))
    fields = F.filter(F.split(F.col(value), "\0"), lambda x: x != "")
    rows = outputs.select(key, F.posexplode(F.aggregate(fields, start, step, lambda held: held.out)).alias("pos", "x"), F.aggregate(fields, start, step, lambda held: held.out).alias("all"))
    moved = F.col("x.code").rlike("^[RC]")
    old = F.when(moved, F.element_at("all", F.col("pos")).path).otherwise(F.col("x.path"))
    return rows.where("x.left = 1").select(key, F.substring("x.code", 1, 1).alias("code"), old.alias("old_path"), F.col("x.path").alias("path"))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """Rows of a table of a SQLite file that all executors see, read by ranges of its row numbers."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as held:
        low, high = held.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // parts)
    ranges = spark.range(0, parts, 1, parts).select((F.lit(low) + F.col("id") * step).alias("first"))

    def run(frames):
        for frame in frames:
            for first in frame["first"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as held:
                    rows = held.execute(f'SELECT * FROM "{table}" WHERE rowid >= ? AND rowid < ?', (int(first), int(first) + step))
                    names = [x[0] for x in rows.description]
                    while chunk := rows.fetchmany(10_000):
                        yield pd.DataFrame(chunk, columns=names)

    return ranges.mapInPandas(run, schema)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(context, file) of a coverage database: which recorded context has run lines of which file."""
    files = read_sqlite(spark, path, "file", "id long, path string")
    contexts = read_sqlite(spark, path, "context", "id long, context string")
    bits = read_sqlite(spark, path, "line_bits", "file_id long, context_id long, numbits binary")
    seen = bits.select("file_id", "context_id").distinct()
    named = seen.join(files.withColumnRenamed("id", "file_id"), "file_id").join(contexts.withColumnRenamed("id", "context_id"), "context_id")
    return named.where("context != ''").select("context", F.col("path").alias("file"))


def config_rows(files: DataFrame) -> DataFrame:
    """(path, key, value) of the leaves of configuration files (path, text, format), keys joined by dots; lists as JSON."""

    def leaves(doc, prefix=""):
        for k, v in doc.items():
            if isinstance(v, dict):
                yield from leaves(v, f"{prefix}{k}.")
            else:
                yield f"{prefix}{k}", v if isinstance(v, str) else json.dumps(v)

    def run(frames):
        for frame in frames:
            held = [(p, *x) for p, doc in frame.itertuples(index=False) if doc and isinstance(d := json.loads(doc), dict) for x in leaves(d)]
            yield pd.DataFrame(held, columns=["path", "key", "value"])

    return parse(files).select("path", F.to_json("doc").alias("doc")).mapInPandas(run, "path string, key string, value string")


def left_out(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """(reason, files, bytes) of what read_files leaves out: skipped folders, large files, binary ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    skipped = F.arrays_overlap(F.split(raw.path, "/"), F.array(*map(F.lit, SKIPPED)))
    reason = F.when(skipped, "folder").when(F.col("length") > most, "size").when(binary_probe(F.col("content")), "binary")
    return raw.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
