"""Chat formatting: a template compiler.

A small, sandboxed template language (text, ``{{ expression }}``, ``{% if %}``,
``{% for %}``, ``{% set %}``, ``{% generation %}``) is parsed into a syntax tree,
constants are folded, and the rest becomes Python closures. There is no attribute
access on Python objects, no call, no import and no ``eval``: an expression sees
keys of mappings, literals, comparisons, ``+``, ``and``/``or``/``not``, a test for
``loop.first``/``loop.last``/``loop.index`` and the named filters.

Text under ``{% generation %}`` is what a model is trained to produce; rendering
returns those spans beside the output. The ``escape`` filter makes it impossible
for a message to contain a control string, and ``unescape`` takes it back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import schema_of

START, END = "<|im_start|>", "<|im_end|>"
#: Marks each turn; only the words of an assistant are under the loss mask.
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|im_start|>' + (m.role | escape_line) + '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\\n' }}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Puts one more backslash between ``<`` and ``|``, so that ``<|`` never occurs."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def escape_line(text: str) -> str:
    """For names that end at a line break."""
    return escape(text.replace("%", "%25").replace("\n", "%0A"))


def unescape_line(text: str) -> str:
    return unescape(text).replace("%0A", "\n").replace("%25", "%")


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "escape_line": escape_line,
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
}

# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: object
    key: object


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class Block:
    parts: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: object
    other: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: object


@dataclass(frozen=True)
class Set:
    name: str
    of: object


@dataclass(frozen=True)
class Generation:
    body: object


#: What a tag holds: strings whole, so that a mark inside one doesn't end it.
INSIDE = r"""(?:'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^'"])*?"""
TAG = re.compile(rf"\{{\{{-?(?P<out>{INSIDE})-?\}}\}}|\{{%-?(?P<tag>{INSIDE})-?%\}}|\{{\#.*?\#\}}", re.S)
TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+<>|.()\[\]]))")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unexpected {source[at:at + 10]!r} in {source!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.at, self.source = 0, source

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.source!r} ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, value: str) -> None:
        if self.take()[1] != value:
            raise TemplateError(f"{value!r} is missing in {self.source!r}")

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over in {self.source!r}")
        return node

    def either(self):
        node = self.both()
        while self.peek("or"):
            self.take()
            node = Binary("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = Binary("and", node, self.negated())
        return node

    def negated(self):
        if self.peek("not"):
            self.take()
            return Not(self.negated())
        return self.compared()

    def compared(self):
        node = self.added()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            op = self.take()[1]
            node = Binary(op, node, self.added())
        return node

    def added(self):
        node = self.filtered()
        while self.peek("+"):
            self.take()
            node = Binary("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.member()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Filter(node, name)
        return node

    def member(self):
        node = self.atom()
        while self.peek(".", "["):
            if self.take()[1] == ".":
                kind, name = self.take()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"{name!r} is not a key")
                node = Key(node, Const(name))
            else:
                node = Key(node, self.either())
                self.expect("]")
        return node

    def atom(self):
        kind, value = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return Const(int(value))
        if kind == "name":
            if value in ("true", "false", "none"):
                return Const({"true": True, "false": False, "none": None}[value])
            if value.startswith("_"):
                raise TemplateError(f"{value!r} is not a name")
            return Name(value)
        if value == "(":
            node = self.either()
            self.expect(")")
            return node
        raise TemplateError(f"unexpected {value!r} in {self.source!r}")


def parse(source: str) -> Block:
    """The syntax tree. A dash at the edge of a tag takes the white space on that side with it."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False

    def text(body: str) -> None:
        if strip:
            body = body.lstrip()
        if found := re.search(r"\{[{%#]", body):
            raise TemplateError(f"{found[0]!r} is not closed")
        if body:
            pieces.append(("text", body))

    for found in TAG.finditer(source):
        body = source[at : found.start()]
        text(body.rstrip() if found[0][2:3] == "-" else body)
        if found["out"] is not None:
            pieces.append(("out", found["out"]))
        elif found["tag"] is not None:
            pieces.append(("tag", found["tag"].strip()))
        at, strip = found.end(), found[0][-3:-2] == "-"
    text(source[at:])
    place = 0

    def block(*ends: str) -> tuple[Block, str]:
        nonlocal place
        parts: list = []
        while place < len(pieces):
            kind, body = pieces[place]
            place += 1
            if kind == "text":
                parts.append(Output(Const(body)))
            elif kind == "out":
                parts.append(Output(_Expression(body).whole()))
            else:
                word = body.split(None, 1)[0] if body else ""
                if word in ends:
                    return Block(tuple(parts)), body
                parts.append(tag(word, body[len(word) :].strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return Block(tuple(parts)), ""

    def tag(word: str, rest: str):
        if word == "if":
            then, ended = block("elif", "else", "endif")
            other = Block(())
            if ended.startswith("elif"):
                other = Block((tag("if", ended[4:].strip()),))
            elif ended == "else":
                other, _ = block("endif")
            return If(_Expression(rest).whole(), then, other)
        if word == "for":
            found = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
            if not found:
                raise TemplateError(f"for {rest!r}")
            body, _ = block("endfor")
            return For(found[1], _Expression(found[2]).whole(), body)
        if word == "set":
            found = re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)\s*(.+)", rest, re.S)
            if not found:
                raise TemplateError(f"set {rest!r}")
            return Set(found[1], _Expression(found[2]).whole())
        if word == "generation":
            body, _ = block("endgeneration")
            return Generation(body)
        raise TemplateError(f"no tag {word!r}")

    return block()[0]


def combine(op: str, a, b):
    if op == "+":
        return str(a) + str(b) if isinstance(a, str) or isinstance(b, str) else a + b
    if op == "in":
        return a in b
    return {"==": a == b, "!=": a != b}[op] if op in ("==", "!=") else {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def fold(node):
    """The same tree with everything that has no name in it worked out."""
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        if node.op in ("and", "or"):
            if isinstance(left, Const):
                return right if bool(left.value) == (node.op == "and") else left
        elif isinstance(left, Const) and isinstance(right, Const):
            return Const(combine(node.op, left.value, right.value))
        elif node.op == "+" and isinstance(right, Const) and isinstance(left, Binary) and left.op == "+" and isinstance(left.right, Const) and isinstance(left.right.value, str) and isinstance(right.value, str):
            return Binary("+", left.left, Const(left.right.value + right.value))
        return Binary(node.op, left, right)
    if isinstance(node, Not):
        of = fold(node.of)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Key):
        return Key(fold(node.of), fold(node.key))
    if isinstance(node, Output):
        of = fold(node.of)
        if isinstance(of, Binary) and of.op == "+" and any(isinstance(x, Const) and isinstance(x.value, str) for x in (of.left, of.right)):
            return fold(Block((Output(of.left), Output(of.right))))
        return Output(Const(str(of.value))) if isinstance(of, Const) and of.value is not None else Output(of)
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.of))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Block):
        parts: list = []
        for part in map(fold, node.parts):
            for x in part.parts if isinstance(part, Block) else (part,):
                if isinstance(x, Output) and isinstance(x.of, Const) and parts and isinstance(parts[-1], Output) and isinstance(parts[-1].of, Const):
                    parts[-1] = Output(Const(str(parts[-1].of.value) + str(x.of.value)))
                else:
                    parts.append(x)
        return Block(tuple(parts))
    return node


# ------------------------------------------------------------------- closures


@dataclass
class Rendered:
    """Pieces of output, their length so far, and the spans under the loss mask."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def lookup(of, key):
    if isinstance(of, dict):
        return of.get(key, "")
    if isinstance(of, (list, tuple)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else ""
    raise TemplateError(f"{key!r} is looked up in something that is no mapping or list")


def value_of(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda names, v=node.value: v
    if isinstance(node, Name):
        return lambda names, n=node.name: names.get(n, "")
    if isinstance(node, Key):
        of, key = value_of(node.of), value_of(node.key)
        return lambda names: lookup(of(names), key(names))
    if isinstance(node, Filter):
        of, use = value_of(node.of), FILTERS[node.name]
        return lambda names: use(of(names))
    if isinstance(node, Not):
        of = value_of(node.of)
        return lambda names: not of(names)
    left, right, op = value_of(node.left), value_of(node.right), node.op
    if op == "and":
        return lambda names: left(names) and right(names)
    if op == "or":
        return lambda names: left(names) or right(names)
    return lambda names: combine(op, left(names), right(names))


def writer_of(node) -> Callable[[dict, Rendered], None]:
    if isinstance(node, Output):
        if isinstance(node.of, Const):
            text = "" if node.of.value is None else str(node.of.value)
            return lambda names, out: out.add(text)
        of = value_of(node.of)

        def write(names, out):
            value = of(names)
            out.add("" if value is None else value if isinstance(value, str) else str(value))

        return write
    if isinstance(node, Block):
        steps = [writer_of(x) for x in node.parts]

        def every(names, out):
            for step in steps:
                step(names, out)

        return every
    if isinstance(node, If):
        test, then, other = value_of(node.test), writer_of(node.then), writer_of(node.other)
        return lambda names, out: (then if test(names) else other)(names, out)
    if isinstance(node, For):
        over, body, name = value_of(node.over), writer_of(node.body), node.name

        def each(names, out):
            items = list(over(names) or ())
            for i, item in enumerate(items):
                body({**names, name: item, "loop": {"first": i == 0, "last": i == len(items) - 1, "index": i + 1}}, out)

        return each
    if isinstance(node, Set):
        of, name = value_of(node.of), node.name
        return lambda names, out: names.__setitem__(name, of(names))
    if isinstance(node, Generation):
        body = writer_of(node.body)

        def mark(names, out):
            begin = out.length
            body(names, out)
            if out.length > begin:
                out.spans.append((begin, out.length))

        return mark
    raise TemplateError(f"{type(node).__name__} can't be written")


class Template:
    def __init__(self, source: str) -> None:
        self.tree = fold(parse(source))
        self.write = writer_of(self.tree)

    def render(self, messages: list[dict], **names) -> Rendered:
        out = Rendered()
        self.write({**names, "messages": messages}, out)
        return out


# ------------------------------------------------------------------ operators

TURN = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """The roles and texts in formatted output; raises if anything else is in it."""
    turns, at = [], 0
    for found in TURN.finditer(text):
        if found.start() != at:
            raise ValueError("text between turns")
        turns.append((unescape_line(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(text):
        raise ValueError("text behind the last turn")
    return turns


def format_conversations(rows: DataFrame, source: str = TEMPLATE, project=None, ddl: str = "conv_id long, formatted string, spans array<struct<start:long,end:long>>") -> DataFrame:
    """Renders each conversation, its rows in order of turn.

    One exchange brings the rows of a conversation together, sorted, and they are
    streamed: a task holds one conversation at a time, never a partition. A
    conversation's output is one string, so one conversation is never split; its
    turns are its own bound. Null texts and roles are empty, a null conv_id is a
    conversation of its own, rows of one turn follow each other by role and text,
    repeated rows are repeated turns, other columns are not read.
    """
    arrow = to_arrow_schema(schema_of(ddl))

    def run(batches):
        template = Template(source)
        rows_out: list[tuple] = []
        current, messages, begun = None, [], False

        def close():
            out = template.render(messages)
            spans = [{"start": a, "end": b} for a, b in out.spans]
            rows_out.append((current, *(project(out.text, out.spans) if project else (out.text, spans))))

        def flush():
            cols = list(zip(*rows_out, strict=True)) if rows_out else [[] for _ in arrow]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            rows_out.clear()
            return made

        for row in (row for batch in batches for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist()):
            if begun and row["conv_id"] != current:
                close()
                messages = []
                if len(rows_out) >= 256:
                    yield flush()
            current, begun = row["conv_id"], True
            messages.append({"role": row["role"] or "", "text": row["text"] or ""})
        if begun:
            close()
        yield flush()

    needed = rows.select("conv_id", "turn", "role", "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = needed.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return dealt.mapInArrow(run, ddl)


def digest(text: str, spans: list[tuple[int, int]]) -> tuple[int, str, int, str, int]:
    """Everything is read back from the output, not from the rows."""
    turns = read_back(text)
    under = "".join(unescape(text[a:b]) for a, b in spans)
    return (
        len(turns),
        hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest(),
        len(under),
        hashlib.sha256(under.encode("utf-8", "surrogatepass")).hexdigest(),
        len(text),
    )
