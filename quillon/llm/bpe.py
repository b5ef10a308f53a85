"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token there is exactly one token that can end its
encoding. A suffix-link automaton over the vocabulary reports, in one pass, every
token that ends at a position; a candidate is the last token of the prefix exactly
if the token stored for the prefix before it may stand in front of it. Following
the stored tokens back from the end gives the ids, without running any merge.

Two neighbours are compatible if no merge would have crossed their boundary while
both were being built, which depends only on the right spine of the left token's
merge tree and the left spine of the right token's. Time is linear in the text
whatever the text is (one run of a million letters included).
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import map_columns

#: Entries of a worker's cache of pre-tokens, and of its cache of pairs.
WORDS_CACHED, PAIRS_CACHED = 400_000, 2_000_000
FOREVER = 1 << 60


def char_ranges(holds: Callable[[str], object], points: range) -> str:
    """The inside of a character class: the code points for which something holds."""
    runs: list[list[int]] = []
    for i in points:
        if holds(chr(i)):
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def unassigned(char: str) -> bool:
    return unicodedata.category(char) == "Cn"


# A class of `re` is a table for the first 65,536 code points and a list, gone through one by one, for those above.
TABLED, ABOVE = range(0x10000), range(0x10000, sys.maxunicode + 1)
HIGH = "\\U00010000-\\U0010ffff"
#: Code points without a category in this Python's tables: libraries follow different versions of Unicode for these only.
UNSURE = re.compile(f"[{char_ranges(unassigned, TABLED)}]|(?=[{HIGH}])[{char_ranges(unassigned, ABOVE)}]")
#: All others are known and in the tables of a class.
RARE = re.compile(f"[{char_ranges(unassigned, TABLED)}{HIGH}]")


# How the file cuts for which Encoder has a way of its own; texts under other rules are cut by the library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@dataclass(frozen=True)
class Rules:
    """What the vocabulary file says, in a form that is cheap to send to workers."""

    key: str
    tokens: tuple[str, ...]
    merges: tuple[tuple[int, int, int], ...]
    unreachable: frozenset[int]
    specials: tuple[tuple[str, int], ...]
    end: str
    cutting: str  # the file without its vocabulary: how text is normalised and cut
    known: bool  # whether it is cut by NORMALIZER and PRE_TOKENIZER


def byte_chars() -> list[str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    chars = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


def merge_plainly(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """BPE as it is defined: lowest rank first, leftmost first. For building and tests only."""
    symbols = list(symbols)
    while len(symbols) > 1:
        rank, at = min((ranks.get(pair, (FOREVER, 0))[0], i) for i, pair in enumerate(zip(symbols, symbols[1:])))
        if rank == FOREVER:
            break
        symbols[at : at + 2] = [ranks[symbols[at], symbols[at + 1]][1]]
    return symbols


def load_rules(path: str) -> Rules:
    """Reads a tokenizers JSON file of byte-level BPE, with or without an end-of-word suffix.

    Refuses a file that asks for more than is done here, so that no id is silently wrong.
    """
    with open(path, "rb") as f:
        raw = f.read()
    told = json.loads(raw)
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if told["model"].get(k)]
    odd += [k for k in ("decoder", "truncation", "padding") if told.get(k)]
    odd += [k for x in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if x.get(k)]
    if told["model"]["type"] != "BPE" or odd:
        raise ValueError(f"{path} asks for {odd or told['model']['type']}, which is not supported")
    vocab: dict[str, int] = told["model"]["vocab"]
    end = told["model"].get("end_of_word_suffix") or ""
    added = tuple((x["content"], x["id"]) for x in told["added_tokens"])
    tokens = [""] * (max([*vocab.values(), *(i for _, i in added)]) + 1)
    for text, i in [*vocab.items(), *added]:
        tokens[i] = text
    merges = []
    for pair in told["model"]["merges"]:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((vocab[left], vocab[right], vocab[left + right]))
    ranks = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
    base = [vocab.get(c) for c in byte_chars()], [vocab.get(c + end) for c in byte_chars()]
    unreachable, made = set(), {c for _, _, c in merges}
    plain = {c: i for i, c in enumerate(byte_chars())}
    for text, i in vocab.items():
        if i in made:
            closed = bool(end) and text.endswith(end)
            body = text[: -len(end)] if closed else text
            ids = [base[closed and k == len(body) - 1][plain[c]] for k, c in enumerate(body)]
            if merge_plainly(ids, ranks) != [i]:
                unreachable.add(i)
    cutting = json.dumps(told | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})
    known = told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER
    return Rules(hashlib.sha256(raw).hexdigest(), tuple(tokens), tuple(merges), frozenset(unreachable), added, end, cutting, known)


class Encoder:
    """Encodes and decodes; built once in each worker from the rules."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.tokens = rules, rules.tokens
        self.merge_rank = {(a, b): rank for rank, (a, b, _) in enumerate(rules.merges)}
        self.made_of = {c: (rank, a, b) for rank, (a, b, c) in enumerate(rules.merges)}
        plain = {c: i for i, c in enumerate(byte_chars())}
        special = {i for _, i in rules.specials}
        self.automaton = ahocorasick.Automaton()
        for i, text in enumerate(rules.tokens):
            if text and i not in special and i not in rules.unreachable:
                closed = bool(rules.end) and text.endswith(rules.end) and len(text) > len(rules.end)
                body = text[: -len(rules.end)] if closed else text
                if all(c in plain for c in body):
                    symbols = [plain[c] for c in body]
                    symbols[-1] += 256 * closed
                    self.automaton.add_word("".join(map(chr, symbols)), (i, len(symbols)))
        self.automaton.make_automaton()
        self.right_spine: dict[int, list] = {}
        self.left_spine: dict[int, list] = {}
        self.follows = _Follows(self.compatible)
        self.at_start, self.nowhere = bytes([1]) * len(rules.tokens), bytes(len(rules.tokens))
        self.words = _Words(self.encode_word)
        self.library = None
        self.ids_as_text = [str(i) for i in range(len(rules.tokens))]
        self.special = regex.compile("|".join(regex.escape(x) for x, _ in sorted(rules.specials, key=lambda x: -len(x[0])))) if rules.specials else None
        self.special_ids = dict(rules.specials)
        # The letters first: no other branch starts with one, so the matches are those of the file's own order.
        self.split = regex.compile(r"\p{L}+|'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+").findall
        # The same with regex's own classes written out, where they fit the tables of `re`, which is twice as fast.
        letter, number, space = (char_ranges(regex.compile(x).match, TABLED) for x in (r"\p{L}", r"\p{N}", r"\s"))
        self.split_tabled = re.compile(f"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{number}]|[^{space}{letter}{number}]+").findall

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token's merge tree, each with the rank at which it is used up."""
        known = (self.left_spine, self.right_spine)[side]
        if (found := known.get(token)) is None:
            found, until, at = [], FOREVER, token
            while True:
                found.append((at, until))
                if at not in self.made_of:
                    break
                until, *parts = self.made_of[at]
                at = parts[side]
            known[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        rank = self.merge_rank.get
        for a, a_until in self.spine(left, 1):
            for b, b_until in self.spine(right, 0):
                m = rank((a, b))
                # Of equal pairs side by side the left one is merged first.
                if m is not None and m < a_until and m <= b_until:
                    return False
        return True

    def encode_word(self, word: str) -> tuple[int, ...]:
        return self.encode_bytes(word.encode("utf-8", "surrogatepass"))

    def encode_bytes(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("latin-1")
        if self.rules.end:
            text = text[:-1] + chr(ord(text[-1]) + 256)
        # For each prefix, by where it ends: its last token, and what may stand behind that. Behind the end: the empty prefix.
        nowhere, follows = self.nowhere, self.follows
        last: list = [None] * len(text)
        may_follow: list = [nowhere] * len(text) + [self.at_start]
        for end, found in self.automaton.iter(text):
            if may_follow[end] is nowhere:
                token, n = found
                if may_follow[end - n][token]:
                    last[end], may_follow[end] = found, follows[token]
        ids, at = [], len(text) - 1
        while at >= 0:
            if last[at] is None:
                raise ValueError("the vocabulary has no token for some byte")
            token, n = last[at]
            ids.append(token)
            at -= n
        ids.reverse()
        return tuple(ids)

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each letter by itself: no final form
                text = text.replace("Σ", "σ")
        return text.lower()

    def encode_unsure(self, text: str) -> list[int]:
        """For characters that this Python doesn't know yet, and for other rules, the library itself normalises and cuts."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.rules.cutting)
            self.byte_of = {c: i for i, c in enumerate(byte_chars())}
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        pieces = self.library.pre_tokenizer.pre_tokenize_str(normal) if self.library.pre_tokenizer else [(normal, None)] * bool(normal)
        return [i for piece, _ in pieces for i in self.encode_bytes(bytes(map(self.byte_of.__getitem__, piece)))]

    def encode_plain(self, text: str) -> list[int]:
        """A text without special tokens."""
        if not self.rules.known:
            return self.encode_unsure(text)
        normal, split = self.normalize(text), self.split_tabled
        # What is unassigned stays as it is when it is normalised, and nothing becomes it.
        if not normal.isascii() and RARE.search(normal):
            if UNSURE.search(normal):
                return self.encode_unsure(text)
            split = self.split
        ids: list[int] = []
        for entry in map(self.words.__getitem__, split(normal)):
            ids.extend(entry)
        return ids

    def encode(self, text: str) -> list[int]:
        if not any(x in text for x in self.special_ids):
            return self.encode_plain(text)
        ids, at = [], 0
        for found in self.special.finditer(text):
            ids += self.encode_plain(text[at : found.start()])
            ids.append(self.special_ids[found.group()])
            at = found.end()
        return ids + self.encode_plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so the tokens are joined by a space, as the library does."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


class _Words(dict):
    """Pre-token to ids. Memory is bounded: when full, it forgets the words not met since it was last full."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.older.pop(word, None)
        if found is None:
            found = self.encode(word)
        if len(word) <= 64:
            if len(self) >= WORDS_CACHED // 2:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class _Follows(dict):
    """Left token to the pairs known of it; forgets all when full, so a worker's memory is bounded."""

    def __init__(self, compatible: Callable[[int, int], bool]) -> None:
        super().__init__()
        self.compatible, self.pairs = compatible, 0

    def __missing__(self, left: int) -> _Pairs:
        found = self[left] = _Pairs(self, left)
        return found


class _Pairs(dict):
    """Right token to whether it may stand behind one left token."""

    __slots__ = ("left", "of")

    def __init__(self, of: _Follows, left: int) -> None:
        super().__init__()
        self.of, self.left = of, left

    def __missing__(self, right: int) -> bool:
        if self.of.pairs >= PAIRS_CACHED:
            self.of.clear()
            self.of.pairs = 0
        self.of.pairs += 1
        found = self[right] = self.of.compatible(self.left, right)
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(rules: Rules) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    if rules.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[rules.key] = Encoder(rules)
    return _ENCODERS[rules.key]


def encode_documents(docs: DataFrame, path: str, project=None, ddl: str = "doc_id long, ids array<int>, decoded string") -> DataFrame:
    """Ids and decoded text of every whole text, one row a document, in one pass without a shuffle.

    ``project(encoder, ids, decoded)`` may turn the two into the columns of ``ddl``
    behind doc_id; without it they are returned. A null text counts as empty and has
    no ids; repeated rows give repeated results; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_rules(path))  # as large as the vocabulary, whatever the data

    def make():
        use = encoder(shared.value)

        def work(doc_ids, texts):
            out = [[] for _ in range(ddl.count(",") + 1)] if project else [[], [], []]
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = use.encode(text or "")
                decoded = use.decode(ids)
                row = project(use, ids, decoded) if project else (ids, decoded)
                for column, value in zip(out, (doc_id, *row), strict=True):
                    column.append(value)
            return out

        return work

    return map_columns(docs, ["doc_id", "text"], make, ddl, rows=64)


def digest(use: Encoder, ids: list[int], decoded: str) -> tuple[int, str, str]:
    shown = use.ids_as_text
    joined = " ".join([shown[i] for i in ids])
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()
