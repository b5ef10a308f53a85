"""Token counts that follow edits.

A document's pre-tokens are kept in a segment tree: leaves hold a stretch of
pre-tokens with their characters and tokens, inner nodes the sums. An edit walks
down to the leaves it touches, cuts the text again from a safe point before the
edit until the new cuts meet the old ones, counts only what lies between, and adds
the differences up the path. The total is then exactly what counting the edited
text from the start would give, for the price of the edited stretch.

Where a cut depends on what follows: the pattern looks at most two characters past
the end of a match (white space before a word, and the contractions), and never
back. So matches that end LOOK characters before an edit stand, and from the first
new cut behind the edit that equals an old one all later cuts are the old ones.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable

import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import map_columns

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOK = 3
LEAF = 32
CACHED = 400_000


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHED:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n


class Node:
    """A stretch of pre-tokens; leaves hold (characters, tokens) of each."""

    __slots__ = ("chars", "height", "leaves", "left", "pieces", "right", "tokens")

    def __init__(self, pieces: list[tuple[int, int]] | None = None, left=None, right=None) -> None:
        self.pieces, self.left, self.right = pieces, left, right
        self.sum()

    def sum(self) -> None:
        if self.pieces is not None:
            self.chars = sum(c for c, _ in self.pieces)
            self.tokens = sum(t for _, t in self.pieces)
            self.height, self.leaves = 0, 1
        else:
            self.chars = self.left.chars + self.right.chars
            self.tokens = self.left.tokens + self.right.tokens
            self.height = 1 + max(self.left.height, self.right.height)
            self.leaves = self.left.leaves + self.right.leaves


def build(pieces: list[tuple[int, int]]) -> Node:
    nodes = [Node(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [Node([])]
    while len(nodes) > 1:
        nodes = [Node(left=nodes[i], right=nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def balanced(node: Node) -> Node:
    """The same tree, built anew where edits at one place have made it too high; each rebuilding is paid for by the edits before it."""
    if node.height <= 2 * node.leaves.bit_length() + 16:
        return node
    pieces, open_ = [], [node]
    while open_:
        node = open_.pop()
        if node.pieces is not None:
            pieces += node.pieces
        else:
            open_ += [node.right, node.left]
    return build(pieces)


def replace(node: Node, start: int, end: int, pieces: list[tuple[int, int]]) -> Node:
    """The tree with the pre-tokens that cover characters start to end replaced; only touched nodes are new."""
    if node.pieces is not None:
        kept_left, kept_right, at = [], [], 0
        for piece in node.pieces:
            if at + piece[0] <= start:
                kept_left.append(piece)
            elif at >= end:
                kept_right.append(piece)
            at += piece[0]
        held = kept_left + pieces + kept_right
        return Node(held) if len(held) <= 2 * LEAF else build(held)
    middle = node.left.chars
    if end <= middle:
        left, right = replace(node.left, start, end, pieces), node.right
    elif start >= middle:
        left, right = node.left, replace(node.right, start - middle, end - middle, pieces)
    else:
        left, right = replace(node.left, start, middle, pieces), replace(node.right, 0, end - middle, [])
    if left.chars == 0:
        return right
    if right.chars == 0:
        return left
    return Node(left=left, right=right)


def pieces_from(node: Node, at: int, base: int = 0) -> Iterable[tuple[int, int]]:
    """(start, end) of the pre-tokens that end behind a character, in order."""
    if base + node.chars <= at:
        return
    if node.pieces is not None:
        for chars, _ in node.pieces:
            if base + chars > at:
                yield base, base + chars
            base += chars
        return
    yield from pieces_from(node.left, at, base)
    yield from pieces_from(node.right, at, base + node.left.chars)


class EditedText:
    """A text, its tree, and how many characters were cut and counted again."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter = text, counter
        self.recounted = 0
        self.tree = build([(len(p), counter.count(p)) for p in counter.cut.findall(text)])

    @property
    def tokens(self) -> int:
        return self.tree.tokens

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (start, end, new text) against the text as it is, not overlapping.

        Taken from the left: what lies before an edit is final, what lies behind it
        is the old text moved by the growth so far.
        """
        edits = sorted(edits)
        parts, at = [], 0
        for a, b, new in edits:
            if not at <= a <= b <= len(self.text):
                raise ValueError("edits overlap or lie outside the text")
            parts += [self.text[at:a], new]
            at = b
        self.text = "".join([*parts, self.text[at:]])
        moved, i = 0, 0
        while i < len(edits):
            moved, i = self._recount(edits, i, moved)

    def _recount(self, edits: list[tuple[int, int, str]], i: int, moved: int) -> tuple[int, int]:
        """Cuts again around edit i, and around those behind it that the new cuts run into."""
        a, b, new = edits[i]
        first = next(iter(pieces_from(self.tree, max(0, a + moved - LOOK))), None)
        start = first[0] if first else self.tree.chars
        grown, i = len(new) - (b - a), i + 1
        need = a + moved + len(new)
        ends = self._ends(b + moved)
        old_end = next(ends, None)
        made, at, stop = [], start, self.tree.chars
        for found in self.counter.cut.finditer(self.text, start):
            made.append((found.end() - at, self.counter.count(found.group())))
            at = found.end()
            while i < len(edits) and edits[i][0] + moved + grown - LOOK < at:
                a, b, new = edits[i]
                need = a + moved + grown + len(new)
                grown, i = grown + len(new) - (b - a), i + 1
                ends = self._ends(b + moved)
                old_end = next(ends, None)
            if at >= need:
                while old_end is not None and old_end + grown < at:
                    old_end = next(ends, None)
                if old_end is not None and old_end + grown == at:
                    stop = old_end
                    break
        else:
            i = len(edits) if at == len(self.text) else i
        self.recounted += at - start
        self.tree = balanced(replace(self.tree, start, stop, made)) if self.tree.chars else build(made)
        return moved + grown, i

    def _ends(self, least: int) -> Iterable[int]:
        """Ends of the tree's pre-tokens from a place on."""
        for _, end in pieces_from(self.tree, max(0, least - 1)):
            if end >= least:
                yield end


DIGITS = re.compile(r"[0-9]{6,}")


def masking_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of a clean-up: long numbers are masked, lines that repeat an earlier one go."""
    gone, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line) + 1
        if line.strip() and line in seen:
            gone.append((at, min(end, len(text)), ""))
        seen.add(line)
        at = end
    inside = iter(gone)
    now = next(inside, None)
    out = list(gone)
    for found in DIGITS.finditer(text):
        while now is not None and now[1] <= found.start():
            now = next(inside, None)
        if now is None or found.end() <= now[0]:
            out.append((found.start(), found.end(), "<num>"))
    return sorted(out)


_COUNTERS: dict[int, Counter] = {}


def count_edits(docs: DataFrame, vocabulary_path: str, edits=masking_edits) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after and n_recounted (characters cut again).

    ``edits(text)`` names the edits of a document. Null and empty texts have no
    tokens and no edits; repeated rows give repeated results; other columns are
    not read. A map without a shuffle; memory follows one document.
    """
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary

    def make():
        raw = shared.value
        key = hash(raw)
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(raw)
        counter = _COUNTERS[key]

        def work(doc_ids, texts):
            rows = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                held = EditedText(text or "", counter)
                before = held.tokens
                asked = edits(text) if text else []
                if asked:
                    held.apply(asked)
                rows.append((doc_id, before, len(asked), held.tokens, len(held.text), held.recounted))
            return list(zip(*rows, strict=True)) if rows else [[]] * 6

        return work

    return map_columns(docs, ["doc_id", "text"], make, "doc_id long, n_tokens long, n_edits int, n_tokens_after long, n_chars_after long, n_recounted long", rows=64)
