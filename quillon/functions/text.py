"""Scalar functions of text, as Column expressions that stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- lines

NEWLINE = "\r\n|\r|\n"


def line_array(text: Column | str) -> Column:
    """Lines of a text: only CR LF, CR and LF end a line; one empty line at the end is none."""
    lines = F.split(col(text), NEWLINE)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a line: keys, line_no from 1, line."""
    return df.select(*keys, F.posexplode(line_array(text)).alias("__pos", "line")).select(*keys, (F.col("__pos") + 1).alias("line_no"), "line")


def line_count(text: Column | str) -> Column:
    """Lines of a text; a last line without a line break counts."""
    t = col(text)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return breaks + F.when((t != "") & ~F.endswith(t, F.lit("\n")), 1).otherwise(0)


# -------------------------------------------------------- normal forms


def squeeze(x: Column | str) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


def near_key(x: Column | str) -> Column:
    """Equal for lines that differ in white space and digits only."""
    return F.regexp_replace(squeeze(x), r"\d+", "0")


def problem_shape(x: Column | str) -> Column:
    """Numbers and quoted values become #."""
    return F.regexp_replace(col(x), "\\d+|'[^']*'|\"[^\"]*\"", "#")


def body_lines(x: Column | str) -> Column:
    """Stripped lines without the blank ones, joined: equal for bodies that differ in layout."""
    return F.array_join(F.filter(F.transform(line_array(x), lambda s: F.trim(s)), lambda s: s != ""), "\n")


# What stands in for the varying parts of a log line, in this order.
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
HEX = r"\b(?=[0-9a-f]*[a-f])[0-9a-f]{8,}\b"
QUOTED = "\"[^\"]*\"|'[^']*'"
NUMBER = r"\b\d+(?:\.\d+)?\b"
# Timestamp formats by name, tried in this order on the first line that isn't blank.
TIMESTAMPS = {
    "iso-8601": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "syslog": r"^[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}",
    "clf": r"\[\d{2}/[A-Z][a-z]{2}/\d{4}(?::\d{2}){3}",
    "epoch": r"^\d{10}(?:\.\d+)?\b",
}


def timestamp_format(line: Column | str) -> Column:
    """Name of the first timestamp format found in a line, or null."""
    return F.coalesce(*(F.when(col(line).rlike(p), name) for name, p in TIMESTAMPS.items()))


def drop_first(x: Column, pattern: str) -> Column:
    """Without the first match."""
    at = F.regexp_instr(x, F.lit(pattern))
    found = F.regexp_extract(x, f"({pattern})", 1)
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + F.length(found), F.length(x)))).otherwise(x)


def template(line: Column | str, format_name: Column | None = None) -> Column:
    """The line with its varying parts replaced; the timestamp of the given format goes first."""
    x = col(line)
    if format_name is not None:
        whole = x
        x = F.coalesce(*(F.when(format_name == name, drop_first(whole, p)) for name, p in TIMESTAMPS.items()), whole)
    for pattern, mark in ((UUID, "<uuid>"), (HEX, "<hex>"), (QUOTED, "<str>"), (NUMBER, "<n>")):
        x = F.regexp_replace(x, pattern, mark)
    return squeeze(x)


# --------------------------------------------------------------- cells

# What counts as a whole and as a decimal number.
INT = r"^[+-]?\d+$"
FLOAT = r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"


def cell_kind(cell: Column | str) -> Column:
    """null, int, float, bool, date or str, decided in this order; only the empty cell is null."""
    raw = col(cell)
    c = F.trim(raw)
    return (
        F.when(raw.isNull() | (raw == ""), "null")
        .when(c.rlike(INT), "int")
        .when(c.rlike(FLOAT) & c.rlike("[.eE]"), "float")
        .when(F.lower(c).isin("true", "false"), "bool")
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), "date")
        .otherwise("str")
    )


def shorten(x: Column | str, most: int) -> Column:
    c = col(x)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


# -------------------------------------------------------------- tokens

BYTES_PER_TOKEN = 3.7


def octets(x: Column | str) -> Column:
    return F.octet_length(col(x)).cast("long")


def tokens_of_bytes(n: Column | str) -> Column:
    """Bytes over 3.7, half to even."""
    return F.bround(col(n) / F.lit(BYTES_PER_TOKEN)).cast("long")


def tokens_of_lines(total: Column) -> Column:
    """A quarter of the bytes (or characters) of lines with their line breaks."""
    return F.floor(total / 4).cast("long")


# Fixed value: an identifier of three characters or more.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{2,}"


def identifiers(x: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(x), F.lit(IDENTIFIER), 0))


def occurrences(x: Column, word: str) -> Column:
    """Non-overlapping plain occurrences."""
    return F.regexp_count(x, F.lit(re.escape(word)))


# --------------------------------------------------------------- paths


def basename(p: Column | str) -> Column:
    return F.substring_index(col(p), "/", -1)


def dirname(p: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(p), r"[^/]*$", ""), "/$", "")


def extension(p: Column | str) -> Column:
    return F.lower(F.regexp_extract(basename(p), r"[^.](\.[^.]*)$", 1))


def stem(p: Column | str) -> Column:
    return F.regexp_replace(basename(p), r"(?<=[^.])\.[^.]*$", "")


def plain_path(p: Column | str) -> Column:
    return F.regexp_replace(F.replace(col(p), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def last_segment(name: Column | str) -> Column:
    """What stands behind the last :: and the last dot."""
    return F.substring_index(F.substring_index(col(name), "::", -1), ".", -1)


def ancestors(p: Column | str) -> Column:
    """Every directory above a path, each with a slash at its end."""
    parts = F.split(col(p), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))


def under(p: Column | str, prefix: str) -> Column:
    return (col(p) == prefix) | F.startswith(col(p), F.lit(prefix.rstrip("/") + "/"))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression for a whole string; * crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 1)) > 0:
            body = glob[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def matches_glob(p: Column | str, glob: str) -> Column:
    return col(p).rlike(glob_regex(glob))


# Path classes and their weights in ranked search.
GENERATED_PARTS = ("node_modules", "dist", "build", "vendor", "__pycache__", "coverage", "target", "generated", ".next", ".nuxt", ".cache", ".git")
GENERATED_NAME = r"\.min\.|\.bundle\.|\.lock$|^package-lock\.json$|^go\.sum$|\.map$|_pb2\.py$|\.generated\."
TEST_PARTS = ("test", "tests", "__tests__", "spec", "testdata")
TEST_NAME = r"^test_|_test\.\w+$|\.test\.\w+$|\.spec\.\w+$|^conftest\.py$"
WEIGHTS = {"src": 1.0, "tests": 0.5, "generated": 0.2}


def path_class(p: Column | str, generated: list[str] = (), tests: list[str] = ()) -> Column:
    """generated, tests or src, the first that holds; globs may add to the first two."""
    path = F.replace(col(p), F.lit("\\"), F.lit("/"))
    name = basename(path)
    dirs = F.split(F.lower(dirname(path)), "/")
    has = lambda parts, rx, globs: F.arrays_overlap(dirs, F.array(*map(F.lit, parts))) | name.rlike(rx) | (F.greatest(*(matches_glob(path, g) for g in globs), F.lit(False), F.lit(False)))
    return F.when(has(GENERATED_PARTS, GENERATED_NAME, generated), "generated").when(has(TEST_PARTS, TEST_NAME, tests), "tests").otherwise("src")


def class_weight(kind: Column, weights: dict[str, float] | None = None) -> Column:
    held = WEIGHTS | (weights or {})
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in held.items()), F.lit(1.0))


# Languages by extension, and the families names are resolved in.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go"}
FAMILIES = {"python": "python", "javascript": "js", "typescript": "js", "go": "go"}


def lookup(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def language_of(p: Column | str) -> Column:
    return lookup(extension(p), LANGUAGES)


def family_of(language: Column) -> Column:
    return F.coalesce(lookup(language, FAMILIES), language)


# Read limits in bytes by kind of file.
DATA_EXTENSIONS = (".json", ".jsonl", ".ndjson", ".yaml", ".yml", ".csv", ".tsv", ".xml", ".log", ".toml")
CODE_EXTENSIONS = (
    *(".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".c", ".h", ".cc", ".cpp", ".hpp"),
    *(".rb", ".php", ".kt", ".swift", ".scala", ".sh"),
)
READ_LIMITS = {"data": 8_000, "code": 20_000, "other": 50_000}


def read_limit(p: Column | str) -> Column:
    e = extension(p)
    return F.when(e.isin(*DATA_EXTENSIONS), READ_LIMITS["data"]).when(e.isin(*CODE_EXTENSIONS), READ_LIMITS["code"]).otherwise(READ_LIMITS["other"])


def is_dunder(name: Column | str) -> Column:
    return last_segment(name).rlike("^__.*__$")


# Lines that speak of trouble, and a place in a file.
ERRORISH = "(?i)error|fail|fatal|exception|traceback|panic|assert|warning"
FILE_LINE = r"([A-Za-z0-9_.\\/-]+\.[A-Za-z][A-Za-z0-9]*):(\d+)"


def file_line(x: Column | str) -> Column:
    """The first path:line in a text, or the empty string."""
    return F.regexp_extract(col(x), FILE_LINE, 0)


def line_range(spec: Column | str) -> Column:
    """A-B, A or B-A as struct(start, end), at least 1 and in order; null if it is none."""
    s = col(spec)
    a = F.regexp_extract(s, r"^\s*(\d+)", 1).try_cast("int")
    b = F.coalesce(F.regexp_extract(s, r"-\s*(\d+)\s*$", 1).try_cast("int"), a)
    ok = s.rlike(r"^\s*\d+\s*(-\s*\d+\s*)?$")
    return F.when(ok, F.struct(F.greatest(F.least(a, b), F.lit(1)).alias("start"), F.greatest(F.greatest(a, b), F.lit(1)).alias("end")))


def outline_class(p: Column | str) -> Column:
    """fixtures, tests or src: the classes that weigh in an outline's ranking."""
    dirs = F.split(F.lower(dirname(p)), "/")
    fixed = F.arrays_overlap(dirs, F.array(*map(F.lit, ("fixtures", "__fixtures__", "testdata", "golden", "snapshots"))))
    return F.when(fixed, "fixtures").when(path_class(p) == "tests", "tests").otherwise("src")


def flatten_response(doc: Column) -> Column:
    """The text of a tool's answer, whichever field holds it."""
    return F.coalesce(*(F.try_variant_get(doc, f"$.{k}", "string") for k in ("stdout", "output", "result", "text", "content")), F.lit(""))
