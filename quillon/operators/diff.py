"""Comparing two versions: keys, bodies, hunks, risk."""

from __future__ import annotations

import difflib
import io
import re
import tokenize

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def delta(old: DataFrame, new: DataFrame, key: list[str], body: str) -> DataFrame:
    """added, removed, modified or same for every key of either side."""
    a = old.select(*key, F.col(body).alias("__old"), F.lit(1).alias("__o"))
    b = new.select(*key, F.col(body).alias("__new"), F.lit(1).alias("__n"))
    both = a.join(b, key, "full_outer")
    state = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("modified")
    return both.select(*key, state.alias("state"))


def renames(removed: DataFrame, added: DataFrame, key: str, kind: str, body: str) -> DataFrame:
    """Removed and added rows of one kind with the same body, the k-th with the k-th, each once."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.trim(F.col(body)) != "").select(F.col(key).alias(name), kind, F.sha2(body, 256).alias("__h"))
        return rows.withColumn("__k", F.row_number().over(Window.partitionBy(kind, "__h").orderBy(name)))

    return numbered(removed, "old_key").join(numbered(added, "new_key"), [kind, "__h", "__k"]).select(kind, "old_key", "new_key")


def array_delta(old: Column, new: Column) -> tuple[Column, Column]:
    """(gone, come)"""
    return F.array_sort(F.array_except(old, new)), F.array_sort(F.array_except(new, old))


HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunk_ranges(diff: Column) -> Column:
    """Array of struct(old_start, old_len, new_start, new_len) of a unified diff."""
    heads = F.regexp_extract_all(diff, F.lit(f"(?m)^{HUNK}"), 0)
    number = lambda h, i: F.coalesce(F.when(F.regexp_extract(h, HUNK, i) != "", F.regexp_extract(h, HUNK, i)).cast("int"), F.lit(1))
    return F.transform(heads, lambda h: F.struct(number(h, 1).alias("old_start"), number(h, 2).alias("old_len"), number(h, 3).alias("new_start"), number(h, 4).alias("new_len")))


def diff_files(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, path, plus, minus, hunks, note) for each file of unified diffs, in order."""
    ddl = f"{key} string, pos int, path string, plus int, minus int, hunks int, note string"

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(k, *r) for k, text in zip(frame.iloc[:, 0], frame.iloc[:, 1]) for r in split_diff(text or "")]
            yield pd.DataFrame(rows, columns=[key, "pos", "path", "plus", "minus", "hunks", "note"])

    return diffs.select(F.col(key).cast("string"), diff).mapInPandas(run, ddl)


def split_diff(text: str) -> list[tuple]:
    """(pos, path, plus, minus, hunks, note) of one unified diff."""
    found, path, plus, minus, hunks, note = [], None, 0, 0, 0, ""

    def close():
        if path is not None:
            found.append((len(found) + 1, path, plus, minus, hunks, note))

    left = (0, 0)
    for line in text.split("\n"):
        if line.startswith("diff --git "):
            close()
            path, plus, minus, hunks, note, left = line.rpartition(" b/")[2], 0, 0, 0, "", (0, 0)
        elif (m := re.match(HUNK, line)) and path is not None:
            hunks += 1
            left = int(m[2] or 1), int(m[4] or 1)
        elif left != (0, 0):
            if line.startswith("+"):
                plus, left = plus + 1, (left[0], left[1] - 1)
            elif line.startswith("-"):
                minus, left = minus + 1, (left[0] - 1, left[1])
            elif not line.startswith("\\"):
                left = left[0] - 1, left[1] - 1
            left = max(0, left[0]), max(0, left[1])
        elif path is not None:
            for begin, said in (("Binary files ", "binary"), ("new file mode", "new"), ("deleted file mode", "deleted"), ("rename from", "renamed"), ("old mode", "mode")):
                if line.startswith(begin) and not note:
                    note = said
    close()
    return found


# ---------------------------------------------------------- body details

LITERAL = re.compile(r"\d+(?:\.\d+)?|'[^'\n]*'|\"[^\"\n]*\"")
CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
CONDITION = re.compile(r"^\s*(?:if|elif|else if|while|case|when)\b")
NOT_CALLS = {"if", "elif", "while", "for", "return", "def", "class", "with", "and", "or", "not", "in", "lambda", "function", "switch", "catch"}
DETAILS = 3


# How comments begin, by extension; block comments are those of C. Of a name without one nothing is known.
COMMENTS = (
    ((".py", ".pyi", ".rb", ".sh", ".bash", ".yml", ".yaml", ".toml", ".pl", ".r", ".mk"), ("#",), False),
    ((".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".go", ".java", ".kt", ".scala", ".swift", ".cs", ".rs", ".dart", ".prisma"), ("//",), True),
    ((".c", ".h", ".cc", ".cpp", ".hpp", ".cxx", ".m", ".css", ".scss"), ("//",), True),
    ((".php",), ("#", "//"), True),
    ((".sql",), ("--",), True),
    ((".lua", ".hs"), ("--",), False),
    (("",), ("#", "//"), True),
)
SCRIPTS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")
STRING = r"""'(?:\\.|[^'\\])*'?|"(?:\\.|[^"\\])*"?|`(?:\\.|[^`\\])*`?"""
#: In a script a slash divides only behind a value; elsewhere it begins a regular expression.
DIVIDES = re.compile(r"[\w$)\]}'\"`]$")
NO_VALUE = re.compile(r"(?:^|[^\w$.])(?:return|typeof|case|do|else|in|of|new|delete|void|throw|yield|await)$")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")


def skeleton(source: str, path: str = "") -> str:
    """The source without comments and layout; text in quotes and regular expressions stays as it is.

    Comments are those of the path's language, so a preprocessor line or a private
    field is none; a language that isn't known loses nothing but layout.
    """
    end = re.search(r"(?:[^./])(\.[^./]*)$|$", path)[1] or ""
    marks, blocks = next(((m, b) for ends, m, b in COMMENTS if end.lower() in ends and (end or not path)), ((), False))
    skip = [re.escape(m) + r"[^\n]*" for m in marks] + [r"/\*.*?(?:\*/|\Z)"] * blocks
    piece = re.compile(rf"(?P<skip>{'|'.join(skip) or '(?!)'})|(?P<text>{STRING})|(?P<space>\s+)|(?P<word>[\w$]+)|(?P<one>.)", re.S)
    out: list[str] = []
    at, gap = 0, False
    while at < len(source):
        found = piece.match(source, at)
        told = found.group()
        if found.lastgroup == "one" and told == "/" and end.lower() in SCRIPTS:
            before = "".join(out[-2:])
            if (not DIVIDES.search(before) or NO_VALUE.search(before)) and (literal := REGEX.match(source, at)):
                told = literal.group()
        at += len(told)
        if found.lastgroup == "skip":
            continue
        if found.lastgroup == "space":
            gap = True
            continue
        if gap and found.lastgroup == "word" and out and re.match(r"[\w$]", out[-1][-1]):
            out.append(" ")
        gap = False
        out.append(told)
    return "".join(out)


def body_details(old: str, new: str) -> list[str]:
    """What changed between two bodies: literals, conditions, calls; at most three of each."""
    a, b = [x for x in old.splitlines() if x.strip()], [x for x in new.splitlines() if x.strip()]
    gone, come, pairs = [], [], []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        if op == "replace" and j - i == m - k:
            for x, y in zip(a[i:j], b[k:m]):
                p, q = LITERAL.findall(x), LITERAL.findall(y)
                if LITERAL.sub("#", x) == LITERAL.sub("#", y) and len(p) == len(q):
                    pairs += [(u, v) for u, v in zip(p, q) if u != v]
        gone += a[i:j]
        come += b[k:m]
    calls = lambda rows: {c for r in rows for c in CALL.findall(r) if c not in NOT_CALLS}
    out = [f"{u} -> {v}" for u, v in pairs[:DETAILS]]
    out += [f"+ {x.strip()}" for x in come if CONDITION.match(x)][:DETAILS]
    out += [f"- {x.strip()}" for x in gone if CONDITION.match(x)][:DETAILS]
    out += [f"calls {x}" for x in sorted(calls(come) - calls(gone))][:DETAILS]
    return out + [f"no longer calls {x}" for x in sorted(calls(gone) - calls(come))][:DETAILS]


def is_mechanical(old: str, new: str, path: str = "") -> bool:
    """Same code in another layout: equal tokens in Python, else an equal skeleton, or only imports in another order."""
    if path.endswith(".py"):
        kinds = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING)
        try:
            mine, yours = ([(x.type, x.string) for x in tokenize.generate_tokens(io.StringIO(s).readline) if x.type not in kinds] for s in (old, new))
            if mine == yours:
                return True
        except (tokenize.TokenError, SyntaxError):
            pass
    elif skeleton(old, path) == skeleton(new, path):
        return True
    imports = re.compile(r"^\s*(?:import|from|require|use|#include)\b")
    split = lambda s: ([x for x in s.splitlines() if x.strip() and not imports.match(x)], sorted(x.strip() for x in s.splitlines() if imports.match(x)))
    return split(old) == split(new)


def compare_bodies(pairs: DataFrame, key: str, old: str, new: str, path: str | None = None) -> DataFrame:
    """(key, mechanical, details) for pairs of bodies; Arrow batches, nothing gathered."""
    ddl = f"{key} string, mechanical boolean, details array<string>"
    columns = [F.col(key).cast("string").alias(key), F.coalesce(old, F.lit("")).alias("o"), F.coalesce(new, F.lit("")).alias("n"), (F.col(path) if path else F.lit("")).alias("p")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(k, is_mechanical(o, n, p or ""), body_details(o, n)) for k, o, n, p in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[key, "mechanical", "details"])

    return pairs.select(*columns).mapInPandas(run, ddl)


def section_delta(old: DataFrame, new: DataFrame, key: list[str], body: str) -> DataFrame:
    """delta over document sections, keyed by level, title and occurrence."""
    return delta(old, new, key, body)


# Fixed value: what marks a symbol as deprecated, in it or in the lines above it.
DEPRECATED = r"(?i)\bdeprecat(?:ed|ion)\b|@deprecated"
ABOVE = 2


def deprecated_symbols(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, qualname) of symbols with a mark in their lines or the two above, where comments and decorators stand.

    ``symbols`` has file, qualname, line_start, line_end; ``lines`` has file, line_no, line.
    """
    from . import intervals

    marked = lines.where(F.col("line").rlike(DEPRECATED)).select("file", "line_no")
    reach = symbols.select("file", "qualname", F.greatest(F.col("line_start") - ABOVE, F.lit(1)).alias("from_line"), F.col("line_end").alias("to_line"))
    return intervals.point_join(marked, "line_no", reach, "from_line", "to_line", ["file"], 200).select("file", "qualname").distinct()


# Lines that are no code outside symbols, by language.
COMMENT_LINE = r"^\s*(?:#|//|/\*|\*)"
IMPORT_LINE = r"^\s*(?:import|from|require|use|#include|package)\b|^\s*(?:const|let|var)\s.*\brequire\("


def module_changes(old: DataFrame, new: DataFrame, old_symbols: DataFrame, new_symbols: DataFrame) -> DataFrame:
    """(file, line): files whose code outside all symbols changed, with the first such line of the new side.

    ``old`` and ``new`` have (file, line_no, line). Blank, comment and import lines
    are no code. A line counts as kept as often as both sides have it outside symbols;
    where lines are only gone, the line is null.
    """
    from . import intervals

    def loose(lines: DataFrame, symbols: DataFrame) -> DataFrame:
        code = lines.withColumn("code", F.trim("line")).where((F.col("code") != "") & ~F.col("line").rlike(COMMENT_LINE) & ~F.col("line").rlike(IMPORT_LINE))
        points = code.select("file", "code", F.col("line_no").alias("no"), F.col("line_no").alias("to_no"))
        free = intervals.overlapping(points, symbols.select("file", "line_start", "line_end"), "no", "to_no", "line_start", "line_end", ["file"], 200, anti=True)
        return free.select("file", "code", "no", F.row_number().over(Window.partitionBy("file", "code").orderBy("no")).alias("k"))

    a, b = loose(old, old_symbols), loose(new, new_symbols)
    come = b.join(a.select("file", "code", "k"), ["file", "code", "k"], "left_anti").select("file", F.col("no").alias("line"))
    gone = a.join(b.select("file", "code", "k"), ["file", "code", "k"], "left_anti").select("file", F.lit(None).cast("int").alias("line"))
    return come.unionByName(gone).groupBy("file").agg(F.min("line").alias("line"))


# Views of a version history: rows of commits (sha, subject, author, position) and of unified diffs.


def log_view(commits: DataFrame, most: int, grep: str | None = None, author: str | None = None) -> DataFrame:
    """(position, line): the newest matching commits as ``sha subject (author)``; position 1 is the newest."""
    held = commits
    if grep:
        held = held.where(F.col("subject").rlike(grep))
    if author:
        held = held.where(F.col("author").rlike(author))
    line = F.concat("sha", F.lit(" "), "subject", F.lit(" ("), "author", F.lit(")"))
    return held.orderBy("position").limit(most).select("position", line.alias("line"))


def status_view(entries: DataFrame, stats: DataFrame) -> DataFrame:
    """(section, files, plus, minus) of (section, code, path) entries with (path, plus, minus) figures; files without any count as 0."""
    held = entries.join(stats, "path", "left").na.fill(0, ["plus", "minus"])
    return held.groupBy("section").agg(F.count("*").alias("files"), F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))


def branch_view(old: DataFrame, new: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, state, plus, minus) for files of two versions that differ: lines come and gone as multisets, so a move within a file is none."""
    states = delta(old, new, [key], text).where("state != 'same'")

    def counted(df: DataFrame, name: str) -> DataFrame:
        lines = df.join(states.select(key), key, "left_semi").select(key, F.explode(t.line_array(text)).alias("line"))
        return lines.groupBy(key, "line").agg(F.count("*").alias(name))

    both = counted(old, "was").join(counted(new, "now"), [key, "line"], "full_outer").na.fill(0, ["was", "now"])
    per = both.groupBy(key).agg(F.sum(F.greatest(F.col("now") - F.col("was"), F.lit(0))).alias("plus"), F.sum(F.greatest(F.col("was") - F.col("now"), F.lit(0))).alias("minus"))
    return states.join(per, key, "left").na.fill(0, ["plus", "minus"])


def hunk_view(diffs: DataFrame, key: str, diff: str, level: int) -> DataFrame:
    """(key, pos, line): a unified diff at a level of detail.

    0 keeps all lines, 1 drops lines of context, 2 keeps headers of hunks and files,
    3 headers of files only. Headers that name the two sides or their blobs go.
    """
    rows = diffs.select(key, F.posexplode(t.line_array(diff)).alias("pos", "line"))
    line = F.col("line")
    file_line, hunk = line.startswith("diff --git "), line.rlike(f"^{HUNK}")
    within = F.max(F.when(hunk, 2).when(file_line, 1)).over(Window.partitionBy(key, "file").orderBy("pos"))
    numbered = rows.withColumn("file", F.sum(file_line.cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    body = numbered.withColumn("in_hunk", within == 2).where(file_line | F.col("in_hunk"))
    shown = {0: F.lit(True), 1: file_line | hunk | line.rlike(r"^[-+\\]"), 2: file_line | hunk, 3: file_line}[level]
    return body.where(shown).select(key, "pos", "line")


def risk_flags(changes: DataFrame, keywords: list[str], large: int) -> DataFrame:
    """(flag, path, n): sensitive paths, public interfaces, large deltas, stale and uncovered files.

    ``changes`` has path, public (boolean), plus, minus and coverage (fresh, stale, uncovered).
    """
    words = F.explode(F.filter(F.array(*map(F.lit, keywords)), lambda w: F.contains(F.lower(F.col("path")), w)))
    sensitive = changes.select(words.alias("word"), "path").groupBy("word").agg(F.min("path").alias("path"), F.count("*").alias("n")).select(F.concat(F.lit("sensitive:"), "word").alias("flag"), "path", "n")
    other = [
        ("public", F.col("public")),
        ("large", F.col("plus") + F.col("minus") > large),
        ("stale", F.col("coverage") == "stale"),
        ("uncovered", F.col("coverage") == "uncovered"),
    ]
    tagged = changes.select(F.explode(F.filter(F.array(*(F.when(c, n) for n, c in other)), lambda x: x.isNotNull())).alias("flag"), "path")
    return sensitive.unionByName(tagged.groupBy("flag").agg(F.min("path").alias("path"), F.count("*").alias("n")))


def unanalysed_share(files: DataFrame, analysed: Column) -> DataFrame:
    lines = F.col("plus") + F.col("minus")
    return files.agg(F.count_if(~analysed).alias("files"), F.bround(100.0 * F.sum(F.when(~analysed, lines).otherwise(0)) / F.sum(lines)).cast("long").alias("pct"))


SECTIONS = ["api", "behavior", "docs", "removed", "tests", "mechanical"]


def in_section_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")), "path", "line", "text")


def normalised_body(x: Column | str) -> Column:
    return t.body_lines(x)


def changed_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that a changed range (file, from_line, to_line) touches, each once."""
    from . import intervals

    return intervals.overlapping(symbols, hunks, "line_start", "line_end", "from_line", "to_line", ["file"], 200)


def test_summary(changes: DataFrame) -> DataFrame:
    """Added, removed and modified tests and helpers: (op, tests, helpers)."""
    is_test = F.col("name").rlike(r"^test|^Test|^it\b|^describe\b")
    return changes.groupBy("op").agg(F.count_if(is_test).alias("tests"), F.count_if(~is_test).alias("helpers"))


def line_signs(diff: Column) -> tuple[Column, Column]:
    """(plus, minus): lines added and removed in a unified diff without its file headers."""
    rows = F.split(diff, "\n")
    plus = F.size(F.filter(rows, lambda x: x.startswith("+") & ~x.startswith("+++")))
    return plus, F.size(F.filter(rows, lambda x: x.startswith("-") & ~x.startswith("---")))
