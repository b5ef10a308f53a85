"""Sizes: token estimates, roll-ups over directories, entropy, lint rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Names and limits of the lint rules.
LOCKFILES = (
    "package-lock.json",
    "yarn.lock",
    "pnpm-lock.yaml",
    "npm-shrinkwrap.json",
    "Cargo.lock",
    "poetry.lock",
    "Pipfile.lock",
    "uv.lock",
    "composer.lock",
    "Gemfile.lock",
    "go.sum",
    "flake.lock",
    "packages.lock.json",
)
MINIFIED = r"(\.min\.js|\.min\.css|\.min\.mjs|\.bundle\.js)$"
LONG_LINE, LONG_MEAN, ENTROPY_BITS, ENTROPY_LEAST, THRESHOLD = 500, 200, 5.5, 1024, 4000


def rollup_paths(df: DataFrame, path: str, value: str) -> DataFrame:
    """(path, total, n_files): every file and every directory above it."""
    files = df.select(F.col(path).alias("path"), F.col(value).alias("total"), F.lit(1).alias("n"))
    above = files.where(F.col("path").contains("/")).select(F.explode(t.ancestors("path")).alias("path"), "total", "n")
    return files.union(above).groupBy("path").agg(F.sum("total").alias("total"), F.sum("n").cast("long").alias("n_files"))


def share(df: DataFrame, value: str, digits: int = 1) -> DataFrame:
    whole = df.agg(F.sum(value).alias("__whole"))
    return df.crossJoin(whole).withColumn("share_pct", F.round(100.0 * F.col(value) / F.col("__whole"), digits)).drop("__whole")  # one row


def top_and_rest(df: DataFrame, order: list[Column], most: int, value: str) -> tuple[DataFrame, DataFrame]:
    """The first rows with their rank, and one row with the sum of the rest."""
    top = df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    held = top.agg(F.coalesce(F.sum(value), F.lit(0)).alias("__held"))
    rest = df.agg(F.sum(value).alias("__whole")).crossJoin(held).select((F.col("__whole") - F.col("__held")).alias(value))  # a row each
    return top, rest


def entropy_bits(content: Column) -> Column:
    """Bits per byte of binary content, from a histogram of its 256 byte values; null where there is no byte.

    Counted in Arrow batches, a number a row: as rows, a text's bytes would be far
    more than the text.
    """

    def run(held: pd.Series) -> pd.Series:
        def bits(raw: bytes | None) -> float | None:
            if not raw:
                return None
            counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            counts = counts[counts > 0]
            return float(np.log2(len(raw)) - (counts * np.log2(counts)).sum() / len(raw))

        return held.map(bits).astype("float64")

    return F.pandas_udf(run, "double")(content)


def byte_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """Bits per byte of each text that has any; nothing is exchanged."""
    bits = df.where(F.octet_length(text) > 0).select(key, entropy_bits(F.encode(F.col(text), "utf-8")).alias("bits"))
    return bits.select(key, F.round("bits", 4).alias("bits"))


_ENCODINGS: dict[str, object] = {}


def exact_tokens(text: Column, vocabulary: str, pattern: str) -> Column:
    """Tokens of a text by a byte-level vocabulary file that all executors see; special tokens count as text."""

    def run(held: pd.Series) -> pd.Series:
        if vocabulary not in _ENCODINGS:
            import base64

            import tiktoken

            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
            _ENCODINGS[vocabulary] = tiktoken.Encoding("meter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        use = _ENCODINGS[vocabulary]
        return held.map(lambda x: 0 if x is None else len(use.encode_ordinary(x))).astype("int64")

    return F.pandas_udf(run, "long")(text)


def general_number(x: Column) -> Column:
    """A number with six significant digits, without zeros at the end, as C writes it in its general form."""

    def run(held: pd.Series) -> pd.Series:
        return held.map(lambda v: None if pd.isna(v) else f"{v:.6g}")

    return F.pandas_udf(run, "string")(x.cast("double"))


def line_stats(text: Column | str) -> dict[str, Column]:
    lines = t.line_array(text)
    return {"n_lines": F.size(lines), "max_line": F.array_max(F.transform(lines, lambda x: F.length(x)))}


def binary_probe(content: Column) -> Column:
    """A NUL byte, or over 30 percent of other control bytes, in the first 8192 bytes."""
    head = F.hex(F.substring(content, 1, 8192))
    odd = F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)"), 1), lambda b: b.rlike("^(0[0-8BCEF]|1.|7F)$")))
    n = F.length(head) / 2
    return F.coalesce(F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)"), 1), lambda b: b == "00")) > 0, F.lit(False)) | F.coalesce(F.when(n > 0, odd / n > 0.30), F.lit(False))


def lint(name: Column, size: Column, tokens: Column, max_line: Column, mean_line: Column, bits: Column | None = None, binary: Column | None = None, threshold: int = THRESHOLD) -> Column:
    """The first rule that a file breaks, or null."""
    data = t.extension(name).isin(*t.DATA_EXTENSIONS)
    rules = [] if binary is None else [F.when(binary, "BINARY")]
    rules += [
        F.when(t.basename(name).isin(*LOCKFILES), "LOCKFILE"),
        F.when(name.rlike(MINIFIED), "MINIFIED"),
        F.when((max_line > LONG_LINE) & (mean_line > LONG_MEAN), "MINIFIED"),
    ]
    if bits is not None:
        rules.append(F.when((size >= ENTROPY_LEAST) & (bits > ENTROPY_BITS), "HIGH-ENTROPY"))
    rules += [F.when(data & (tokens > threshold), "BIG-DATA"), F.when(tokens > threshold, "BIG-FILE")]
    return F.coalesce(*rules)


def tree(files: DataFrame, path: str, depth: int, entries: int) -> DataFrame:
    """Entries of each folder down to a depth with the files below them; what is over the cap is one row.

    (parent, name, n_files, n_more): ``name`` is null in the row that stands for ``n_more`` entries.
    """
    parts = F.split(F.concat(F.lit("./"), F.col(path)), "/")
    level = F.explode(F.sequence(F.lit(2), F.least(F.size(parts), F.lit(depth + 1))))
    below = files.select(parts.alias("p"), level.alias("k")).select(F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), "/").alias("parent"), F.element_at("p", F.col("k")).alias("name"))
    held = below.groupBy("parent", "name").agg(F.count("*").alias("n_files"))
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("n_files"), "name")))
    shown = ranked.where(F.col("r") <= entries).select("parent", "name", "n_files", F.lit(0).cast("long").alias("n_more"))
    rest = ranked.where(F.col("r") > entries).groupBy("parent").agg(F.sum("n_files").alias("n_files"), F.count("*").alias("n_more"))
    return shown.unionByName(rest.select("parent", F.lit(None).cast("string").alias("name"), "n_files", "n_more"))
