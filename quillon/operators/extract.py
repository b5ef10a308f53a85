"""Symbols, references and sections out of source text: (path, text) rows in, rows out.

Parsing needs the whole file, so each file is one row of an Arrow batch. Nothing
is gathered: what comes out are ordinary rows for the index operators.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "path string, qualname string, kind string, line_start int, line_end int, exported int, depth int"
RELATIONS = "path string, line int, relation string, name string, target string, alias string"

Symbol = tuple[str, str, int, int, int, int]
Relation = tuple[int, str, str, str | None, str | None]


# ----------------------------------------------------------------- python


def dotted(node: ast.AST) -> str | None:
    """The dotted name of an expression, if it is one."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


class _Python(ast.NodeVisitor):
    def __init__(self) -> None:
        self.symbols: list[Symbol] = []
        self.relations: list[Relation] = []
        self.stack: list[str] = []
        self.in_class: list[bool] = []
        self.bound: list[set[str]] = []

    def name(self, own: str) -> str:
        return ".".join([*self.stack, own])

    def add(self, node, own: str, kind: str) -> None:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        public = not any(x.startswith("_") and not (x.startswith("__") and x.endswith("__")) for x in [*self.stack, own])
        self.symbols.append((self.name(own), kind, first, node.end_lineno, int(public and not any(x == "<locals>" for x in self.stack)), len(self.stack)))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add(node, node.name, "class")
        bases = [b for b in map(dotted, node.bases) if b]
        abstract = any(b.rpartition(".")[2] in ("ABC", "Protocol") for b in bases)
        for b in bases:
            self.relations.append((node.lineno, "inherits", self.name(node.name), b, None))
        if abstract:
            self.symbols[-1] = (self.symbols[-1][0], "interface", *self.symbols[-1][2:])
        self.inside(node, node.name, True)

    def function(self, node) -> None:
        self.add(node, node.name, "method" if self.in_class and self.in_class[-1] else "func")
        a = node.args
        self.bound.append({x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]} | {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)})
        self.inside(node, node.name, False)
        self.bound.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def inside(self, node, own: str, is_class: bool) -> None:
        self.stack.append(own)
        self.in_class.append(is_class)
        self.generic_visit(node)
        self.stack.pop()
        self.in_class.pop()

    def visit_Assign(self, node: ast.Assign) -> None:
        if not self.stack:
            for target in node.targets:
                if isinstance(target, ast.Name):
                    self.add(node, target.id, "const")
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self.relations.append((node.lineno, "import", x.name, None, x.asname))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for x in node.names:
            self.relations.append((node.lineno, "import", "." * node.level + (node.module or ""), x.name, x.asname))

    def visit_Call(self, node: ast.Call) -> None:
        if name := dotted(node.func):
            first = name.split(".")[0]
            shadowed = first not in ("self", "cls") and any(first in b for b in self.bound)
            self.relations.append((node.lineno, "call", "<dynamic>" if shadowed else name, None, None))
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        kind = "read" if isinstance(node.ctx, ast.Load) else "write"
        if not any(node.id in b for b in self.bound):
            self.relations.append((node.lineno, kind, node.id, None, None))

    def annotation(self, node) -> None:
        if node is not None and (name := dotted(node)):
            self.relations.append((node.lineno, "type-use", name, None, None))

    def visit_arg(self, node: ast.arg) -> None:
        self.annotation(node.annotation)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.annotation(node.annotation)
        if not self.stack and isinstance(node.target, ast.Name):
            self.add(node, node.target.id, "const")
        if node.value:
            self.visit(node.value)


def python_source(text: str) -> tuple[list[Symbol], list[Relation]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], []
    seen = _Python()
    seen.visit(tree)
    return seen.symbols, seen.relations


# ------------------------------------------------------- brace languages


def masked(text: str) -> str:
    """The same length with strings and comments blanked, so that braces can be counted."""

    def blank(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m[0])

    return re.sub(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", blank, text, flags=re.S)


def block_end(rows: list[str], at: int) -> int:
    """The last line of the braces that open at or behind a line."""
    depth, opened = 0, False
    for i in range(at, len(rows)):
        for c in rows[i]:
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
        if (opened and depth <= 0) or (not opened and (rows[i].rstrip().endswith(";") or i - at > 10)):
            return i
    return len(rows) - 1


JS_DEFINES = [
    (re.compile(r"^(export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+([\w$]+)"), "func"),
    (re.compile(r"^(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)"), "class"),
    (re.compile(r"^(export\s+)?interface\s+([\w$]+)"), "interface"),
    (re.compile(r"^(export\s+)?(?:type|enum)\s+([\w$]+)"), "type"),
    (re.compile(r"^(export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"), "func"),
    (re.compile(r"^(export\s+)?(?:const|let|var)\s+([\w$]+)"), "const"),
]
JS_METHOD = re.compile(r"^\s+(?:public |private |protected |static |async |get |set |readonly )*([\w$]+)\s*\([^;]*\)\s*(?::[^{;]+)?\{")
JS_IMPORT = re.compile(r"""^\s*import\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+([\w$]+))?\s*(?:from\s*)?['"]([^'"]+)['"]""")
JS_REQUIRE = re.compile(r"""(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\(\s*['"]([^'"]+)['"]""")
JS_CALL = re.compile(r"(?<![\w$.])((?:[\w$]+\.)*[\w$]+)\s*\(")
JS_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "constructor", "import", "require", "async"}


JS_ARROW = re.compile(r"(?<![\w$.])([\w$]+)\s*=>")
JS_BODY = re.compile(r"\s*(?:(?::[^={;]*)?=>\s*(\{)?|(?::[^={;()]*)?(\{))")
JS_CONTROL = re.compile(r"(?<![\w$.])(?:if|for|while|switch|with|return|typeof|await)\s*$")
JS_LOCAL = re.compile(r"(?<![\w$.])(?:const|let|var)\s+(?:([\w$]+)|[{\[]([^}\]=]*)[}\]])|(?<![\w$.])(?:function\*?|class)\s+([\w$]+)")
JS_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def closing(text: str, at: int) -> int:
    """Where the parenthesis that opens at a place closes; the end of the text if it doesn't."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in "([{") - (text[i] in ")]}")
        if depth == 0:
            return i
    return len(text)


def parameter_names(inside: str) -> set[str]:
    """Names that a parameter list binds: defaults and annotations are left out at its own level."""
    out, depth, skip, piece = set(), 0, False, ""
    for c in inside + ",":
        if c == "," and depth <= (1 if "{" in piece or "[" in piece else 0):
            out.update(JS_NAME.findall(piece))
            skip, piece = False, ""
            continue
        depth += (c in "([{<") - (c in ")]}>")
        skip = skip or (depth == 0 and c in "=:?")
        piece += "" if skip else c
    return out


def js_bound(rows: list[str]) -> list[tuple[int, int, set[str]]]:
    """(first line, last line, names): what functions bind for their lines: parameters, locals, caught errors.

    A function is a parameter list with a body or an arrow behind it, or a name with an arrow.
    """
    whole = "\n".join(rows)
    starts = [0, *(m.end() for m in re.finditer("\n", whole))]
    line_at = lambda at: bisect.bisect_right(starts, at) - 1
    heads = [(m.start(), m.end(1), {m[1]}) for m in JS_ARROW.finditer(whole)]
    for m in re.finditer(r"\(", whole):
        if not JS_CONTROL.search(whole, max(0, m.start() - 12), m.start()):
            stop = closing(whole, m.start())
            heads.append((m.start(), stop + 1, parameter_names(whole[m.end() : stop])))
    found: list[tuple[int, int, set[str]]] = []
    for begin, end, names in heads:
        if body := JS_BODY.match(whole, end):
            stop = closing(whole, body.end() - 1) if body[1] or body[2] else whole.find("\n", body.end())
            stop = len(whole) - 1 if stop < 0 else min(stop, len(whole) - 1)
            for local in JS_LOCAL.finditer(whole, end, stop):
                names |= set(JS_NAME.findall(local[1] or local[2] or local[3] or ""))
            found.append((line_at(begin), line_at(stop), names))
    return found


def unbound(name: str, line: int, scopes: list[tuple[int, int, set[str]]]) -> str:
    """The name, or that it is a local one's, of which nothing is known."""
    first = name.split(".")[0]
    return "<dynamic>" if first not in ("this", "super") and any(a <= line <= b and first in names for a, b, names in scopes) else name


def js_source(text: str) -> tuple[list[Symbol], list[Relation]]:
    plain, rows = text.split("\n"), masked(text).split("\n")
    symbols: list[Symbol] = []
    relations: list[Relation] = []
    scopes = js_bound(rows)
    for i, row in enumerate(rows):
        for pattern, kind in JS_DEFINES:
            if m := pattern.match(row):
                end = block_end(rows, i)
                symbols.append((m[2], kind, i + 1, end + 1, int(bool(m[1])), 0))
                if kind == "class":
                    head = row[m.end() :]
                    if b := re.search(r"\bextends\s+([\w$.]+)", head):
                        relations.append((i + 1, "inherits", m[2], b[1], None))
                    if b := re.search(r"\bimplements\s+([\w$., ]+)", head):
                        relations += [(i + 1, "implements", m[2], x.strip(), None) for x in b[1].split(",") if x.strip()]
                    for k in range(i + 1, end):
                        if (x := JS_METHOD.match(rows[k])) and x[1] not in JS_WORDS - {"constructor"}:
                            symbols.append((f"{m[2]}.{x[1]}", "method", k + 1, block_end(rows, k) + 1, int(bool(m[1])), 1))
                break
        if m := JS_IMPORT.match(plain[i]):
            held = [(x.split(" as ")[0].strip(), x.split(" as ")[-1].strip()) for x in (m[2] or "").split(",") if x.strip()]
            relations += [(i + 1, "import", m[4], a, b if b != a else None) for a, b in held]
            relations += [(i + 1, "import", m[4], s, x) for s, x in (("default", m[1]), ("*", m[3])) if x]
            if not (held or m[1] or m[3]):
                relations.append((i + 1, "import", m[4], None, None))
        elif m := JS_REQUIRE.search(plain[i]):
            relations += [(i + 1, "import", m[3], x.strip(), None) for x in (m[2] or m[1] or "").split(",") if x.strip()]
        # A method's head is no call of it.
        head = JS_METHOD.match(row)
        calls = JS_CALL.findall(row[head.end(1) + 1 :] if head else row)
        relations += [(i + 1, "call", unbound(x, i, scopes), None, None) for x in calls if x not in JS_WORDS and not re.match(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function", row)]
    return symbols, relations


GO_FUNC = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)")
GO_TYPE = re.compile(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)?")
GO_VALUE = re.compile(r"^(const|var)\s+(\w+)")
GO_IMPORT = re.compile(r'^\s*(?:import\s+)?(?:(\w+|\.|_)\s+)?"([^"]+)"')
GO_METHOD = re.compile(r"^\s+(\w+)\s*\(")


GO_LOCAL = re.compile(r"\b([\w, ]+?)\s*:=|\bvar\s+([\w, ]+?)\s+[\w*\[\]]")
GO_LITERAL = re.compile(r"\bfunc\s*\(")


def go_bound(rows: list[str]) -> list[tuple[int, int, set[str]]]:
    """(first line, last line, names): parameters and locals of each function; the receiver is its own."""
    found = []
    for i, row in enumerate(rows):
        if m := GO_FUNC.match(row):
            end = block_end(rows, i)
            body = "\n".join(rows[i : end + 1])
            heads = [m.end(), *(x.end() - 1 for x in GO_LITERAL.finditer(body, m.end()))]
            lists = [body[a + 1 : closing(body, a)] for h in heads if (a := body.find("(", h)) >= 0]
            names = {w[0] for x in lists for part in x.split(",") if (w := part.split()) and re.match(r"\w+$", w[0])}
            for local in GO_LOCAL.finditer(body):
                names |= set(re.findall(r"\w+", local[1] or local[2]))
            found.append((i, end, names - {"for", "if", "switch", "range", "_"}))
    return found


def go_source(text: str) -> tuple[list[Symbol], list[Relation]]:
    plain, rows = text.split("\n"), masked(text).split("\n")
    symbols: list[Symbol] = []
    relations: list[Relation] = []
    importing = False
    scopes = go_bound(rows)
    for i, row in enumerate(rows):
        public = lambda x: int(x[:1].isupper())
        if m := GO_FUNC.match(row):
            name = f"{m[1]}.{m[2]}" if m[1] else m[2]
            symbols.append((name, "method" if m[1] else "func", i + 1, block_end(rows, i) + 1, public(m[2]), int(bool(m[1]))))
        elif m := GO_TYPE.match(row):
            end = block_end(rows, i) if m[2] else i
            symbols.append((m[1], m[2] or "type", i + 1, end + 1, public(m[1]), 0))
            if m[2] == "interface":
                relations += [(k + 1, "iface-method", m[1], x[1], None) for k in range(i + 1, end) if (x := GO_METHOD.match(rows[k]))]
        elif m := GO_VALUE.match(row):
            symbols.append((m[2], m[1], i + 1, i + 1, public(m[2]), 0))
        if row.startswith("import"):
            importing = "(" in row
            if not importing and (m := GO_IMPORT.match(plain[i])):
                relations.append((i + 1, "import", m[2], None, m[1]))
        elif importing:
            if row.strip() == ")":
                importing = False
            elif m := GO_IMPORT.match(plain[i]):
                relations.append((i + 1, "import", m[2], None, m[1]))
        if not GO_FUNC.match(row):
            relations += [(i + 1, "call", unbound(x, i, scopes), None, None) for x in JS_CALL.findall(row) if x not in JS_WORDS | {"make", "len", "append", "func"}]
    return symbols, relations


C_FUNC = re.compile(r"^(?!typedef|return|else|#)[A-Za-z_][\w\s\*&:<>,~]*?\b([A-Za-z_~][\w:]*)\s*\([^;]*$")
C_TYPE = re.compile(r"^(?:typedef\s+)?(struct|class|enum|union)\s+(\w+)")
RUST_ITEM = re.compile(r"^(pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|type|mod|static|const)\s+(\w+)")


def outline_source(text: str, pattern: Callable[[str], tuple[str, str, int] | None]) -> list[Symbol]:
    rows = masked(text).split("\n")
    out = []
    for i, row in enumerate(rows):
        if found := pattern(row):
            out.append((found[0], found[1], i + 1, block_end(rows, i) + 1, found[2], 0))
    return out


def c_item(row: str) -> tuple[str, str, int] | None:
    if m := C_TYPE.match(row):
        return m[2], m[1], 1
    m = C_FUNC.match(row)
    return (m[1], "func", int(not row.startswith("static"))) if m and "=" not in row.split("(")[0] else None


def rust_item(row: str) -> tuple[str, str, int] | None:
    m = RUST_ITEM.match(row)
    return (m[3], {"fn": "func", "trait": "interface", "static": "const"}.get(m[2], m[2]), int(bool(m[1]))) if m else None


def prisma_item(row: str) -> tuple[str, str, int] | None:
    m = re.match(r"^(model|enum|type|view|datasource|generator)\s+(\w+)\s*\{", row)
    return (m[2], m[1], 1) if m else None


# Words that may stand before a definition, and what each word that defines makes; other languages are outlined by these.
BEFORE = ("public", "private", "protected", "static", "export", "async", "final", "abstract", "pub", "open", "inline", "local", "override", "sealed", "partial", "internal")
DEFINES = {
    "def": "func",
    "function": "func",
    "fn": "func",
    "func": "func",
    "fun": "func",
    "sub": "func",
    "proc": "func",
    "class": "class",
    "module": "module",
    "interface": "interface",
    "struct": "struct",
    "trait": "trait",
    "object": "object",
    "enum": "enum",
}
GENERIC_ITEM = re.compile(rf"(?:(?:{'|'.join(BEFORE)})\s+)*({'|'.join(DEFINES)})\s+([A-Za-z_][\w:.$!?]*)")
SHELL_ITEM = re.compile(r"([A-Za-z_]\w*)\s*\(\)\s*\{")


def generic_symbols(text: str) -> list[Symbol]:
    """Definitions at the margin; each reaches to the line before the next one that is at the margin and no closing."""
    rows = text.split("\n")
    margin = [i for i, x in enumerate(rows) if x[:1].strip() and not re.match(r"(?:end|fi|done|[})\]])\b|[})\]]", x)] + [len(rows)]
    out: list[Symbol] = []
    for at, following in zip(margin, margin[1:]):
        m, shell = GENERIC_ITEM.match(rows[at]), SHELL_ITEM.match(rows[at])
        if m or shell:
            end = max((i for i in range(at, following) if rows[i].strip()), default=at)
            hidden = bool(re.match(r"(?:\w+\s+)*?(?:private|protected|local)\b", rows[at]))
            out.append((m[2], DEFINES[m[1]], at + 1, end + 1, int(not hidden), 0) if m else (shell[1], "func", at + 1, end + 1, 1, 0))
    return out


# Fixed value: the kinds of files that are outlined by definitions at the margin.
GENERIC_ENDS = ("rb", "php", "kt", "kts", "swift", "java", "scala", "sh", "bash", "zsh", "cs", "lua", "pl", "pm", "ex", "exs", "dart", "groovy", "jl", "nim", "tcl")


def markdown_sections(text: str) -> list[tuple[int, str, int, int]]:
    """(level, title, first line, last line); headings in fences are none; lines before the first are level 0."""
    rows = re.split("\r\n|\r|\n", text)
    if rows and rows[-1] == "":
        rows.pop()
    heads, fence = [], ""
    for i, row in enumerate(rows):
        mark = re.match(r"^ {0,3}(`{3,}|~{3,})", row)
        if mark and (not fence or (mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not row.strip(" `~"))):
            fence = "" if fence else mark[1]
        elif not fence and (m := re.match(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", row)):
            heads.append((len(m[1]), m[2], i + 1))
    out = [(0, "", 1, heads[0][2] - 1)] if heads and heads[0][2] > 1 and any(x.strip() for x in rows[: heads[0][2] - 1]) else []
    for n, (level, title, at) in enumerate(heads):
        end = next((x - 1 for k, _, x in heads[n + 1 :] if k <= level), len(rows))
        out.append((level, title, at, end))
    return out


def markdown_source(text: str) -> tuple[list[Symbol], list[Relation]]:
    return [(title, "section", a, b, 1, level) for level, title, a, b in markdown_sections(text)], []


def source(path: str, text: str) -> tuple[list[Symbol], list[Relation]]:
    """Dispatch by extension; files of other kinds have no symbols."""
    end = path.lower().rpartition(".")[2]
    if end in ("py", "pyi"):
        return python_source(text)
    if end in ("js", "jsx", "mjs", "cjs", "ts", "tsx"):
        return js_source(text)
    if end == "go":
        return go_source(text)
    if end in ("md", "markdown"):
        return markdown_source(text)
    items = {"rs": rust_item, "prisma": prisma_item} | dict.fromkeys("c h cc cpp hpp cxx".split(), c_item)
    if end in items:
        return outline_source(text, items[end]), []
    return (generic_symbols(text) if end in GENERIC_ENDS else []), []


def _table(files: DataFrame, ddl: str, rows_of: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([(p, *r) for p, text in frame.itertuples(index=False) for r in rows_of(p, text or "")], columns=names)

    return files.select("path", "text").mapInPandas(run, ddl)


def symbols(files: DataFrame) -> DataFrame:
    return _table(files, SYMBOLS, lambda p, x: ((f"{p}::{s[0]}", *s[1:]) for s in source(p, x)[0]))


def relations(files: DataFrame) -> DataFrame:
    """Imports, calls, reads, writes, type uses, bases and interface methods with their lines."""
    return _table(files, RELATIONS, lambda p, x: iter(source(p, x)[1]))


SECTIONS = "path string, level int, title string, occurrence int, body string"


def sections(files: DataFrame) -> DataFrame:
    """(path, level, title, occurrence, body) of Markdown files; equal titles of a level are numbered from 1."""

    def rows_of(_: str, text: str) -> Iterator[tuple]:
        seen: dict[tuple[int, str], int] = {}
        rows = re.split("\r\n|\r|\n", text)
        for level, title, first, last in markdown_sections(text):
            seen[level, title] = seen.get((level, title), 0) + 1
            yield level, title, seen[level, title], "\n".join(rows[first - 1 : last])

    return _table(files, SECTIONS, rows_of)


def outline(files: DataFrame, depth: int) -> DataFrame:
    """Symbols no deeper than a level."""
    return symbols(files).where(F.col("depth") <= depth)


def signature(text: str, line: int) -> str:
    """From a definition's line to the end of its parentheses, ten lines at most, on one line."""
    out, depth, opened = [], 0, False
    for row in text.split("\n")[line - 1 : line + 9]:
        out.append(row.strip())
        for c in row:
            depth += (c == "(") - (c == ")")
            opened |= c == "("
        if depth <= 0 and (opened or row.rstrip().endswith((":", "{", ";"))):
            break
    return re.sub(r"\s*[{:]\s*$", "", " ".join(out))


def signature_at(text: Column | str, line: Column | str) -> Column:
    """signature as a column."""

    def run(texts: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([signature(x, int(n)) for x, n in zip(texts, lines)], dtype=object)

    return F.pandas_udf(run, "string")(text, line)
