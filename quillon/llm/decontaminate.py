"""Benchmark decontamination by greedy string tiling.

Seeds of MATCH tokens that a document shares with a benchmark item are joined
first; they are all that a tile can be made of. Where the seeds alone could cover
enough of an item, the item is tiled: the longest matches of tokens that neither
side has used yet are marked, again and again, found by running Karp-Rabin hashes
of a search length that shrinks. Tiles may lie in any order, so a reordered
passage is covered like a straight one; each token counts once, so a phrase that
a document repeats doesn't.

Items too short to be tiled are held against documents exactly: an item of a tile's
length or more must occur as one piece, a shorter one must be the whole document.

The benchmark is a query set: it is read in blocks of bounded size, and each block
is held against all documents in one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from .common import filter_rows, map_columns

#: The shortest tile, the share of an item's tokens that tiles must cover, and the shortest item that is tiled.
MATCH, COVERAGE, SHORTEST_ITEM = 4, 0.6, 8
BLOCK_TOKENS = 400_000
TOKEN = re.compile(r"[^\W_]+").findall
#: Scripts without spaces (Thai, Lao, Burmese, Khmer, kana, Han): each character is a token.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
HAS_UNSPACED = re.compile(f"[{UNSPACED}]").search
MIXED_TOKEN = re.compile(rf"(?![_\W])[{UNSPACED}]|[^\W_{UNSPACED}]+").findall
MODULUS, RADIX = (1 << 61) - 1, 1_000_003
RESULT = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int, n_item_tokens int, tiles array<struct<doc_token:int,item_token:int,length:int>>"


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased; characters of scripts without spaces one by one."""
    if not text:
        return []
    low = text.lower()
    return TOKEN(low) if low.isascii() or not HAS_UNSPACED(low) else MIXED_TOKEN(low)


def running_hashes(ids: list[int], used: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(position, hash) of each window of unused tokens, each from the one before."""
    top = pow(RADIX, length - 1, MODULUS)
    value = run = 0
    for i, token in enumerate(ids):
        if used[i] or token < 0:
            value = run = 0
            continue
        if run == length:
            value = (value - ids[i - length] * top) % MODULUS
            run -= 1
        value = (value * RADIX + token) % MODULUS
        run += 1
        if run == length:
            yield i - length + 1, value


def longest_matches(pattern: list[int], text: list[int], used_p: list[bool], used_t: list[bool], length: int) -> list[tuple[int, int, int]]:
    """(size, pattern position, text position) of matches of at least ``length``, grown to the right."""
    seen = defaultdict(list)
    for at, value in running_hashes(text, used_t, length):
        seen[value].append(at)
    found = []
    for p, value in running_hashes(pattern, used_p, length):
        for t in seen.get(value, ()):
            if p and t and not used_p[p - 1] and not used_t[t - 1] and pattern[p - 1] == text[t - 1] >= 0:
                continue  # part of a match that begins further left
            k = 0
            while p + k < len(pattern) and t + k < len(text) and not used_p[p + k] and not used_t[t + k] and pattern[p + k] == text[t + k]:
                k += 1
            if k >= length:
                found.append((k, p, t))
    return found


def tile(pattern: list[int], text: list[int], least: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (size, pattern position, text position), longest first.

    Negative tokens match nothing. The search length starts at the pattern and
    falls by half; matches of twice the search length restart it, so the longest
    are always marked first; of equal ones the leftmost in pattern, then text.
    """
    used_p, used_t = [False] * len(pattern), [False] * len(text)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(len(pattern), 32))
    while True:
        found = longest_matches(pattern, text, used_p, used_t, length)
        top = max((k for k, _, _ in found), default=0)
        if top:
            # Exactly the longest: shorter ones may grow differently once these are marked.
            for k, p, t in sorted(x for x in found if x[0] == top):
                if not any(used_p[p : p + k]) and not any(used_t[t : t + k]):
                    used_p[p : p + k] = [True] * k
                    used_t[t : t + k] = [True] * k
                    tiles.append((k, p, t))
            continue
        if length == least:
            return tiles
        length = max(least, length // 2)


class Block:
    """Items of bounded size, with the index of their seeds."""

    def __init__(self, items: list[tuple[int, str]], match: int, coverage: float, shortest: int) -> None:
        self.match, self.coverage, self.shortest = match, coverage, shortest
        words = {}
        self.items: list[tuple[int, list[int]]] = []
        self.tiny: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            held = tokens(text)
            if len(held) >= match:
                self.items.append((item_id, [words.setdefault(w, len(words) + 1) for w in held]))
            elif held:
                self.tiny[tuple(held)].append(item_id)
        self.words = words
        places = defaultdict(list)
        for n, (_, ids) in enumerate(self.items):
            for at, key in enumerate(self.seeds(np.array(ids, np.int64)).tolist()):
                places[key].append((n, at))
        self.places = dict(places)
        self.keys = np.sort(np.fromiter(self.places, np.uint64, len(self.places)))

    def seeds(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.match + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        value = np.zeros(n, np.uint64)
        for i in range(self.match):
            value = value * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64)
        return value

    def judge(self, text: str | None) -> list[tuple]:
        held = tokens(text)
        if len(held) < self.match:
            n = len(held)
            mark = [{"doc_token": 0, "item_token": 0, "length": n}]
            return [(item_id, 1.0, 1, n, n, mark) for item_id in self.tiny.get(tuple(held), ())]
        if not len(self.keys):
            return []
        ids = np.fromiter(map(self.words.get, held, repeat(0)), np.int64, len(held))
        at = np.flatnonzero(ids)
        if len(at) < self.match:
            return []
        # Seeds at runs of known words only.
        at = at[: len(at) - self.match + 1][(at[self.match - 1 :] - at[: len(at) - self.match + 1]) == self.match - 1]
        if not len(at):
            return []
        values = np.zeros(len(at), np.uint64)
        for i in range(self.match):
            values = values * np.uint64(0x9E3779B97F4A7C15) + ids[at + i].astype(np.uint64)
        hit = self.keys[np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)] == values
        if not hit.any():
            return []
        by_item = defaultdict(lambda: (set(), set()))
        for d, key in zip(at[hit].tolist(), values[hit].tolist(), strict=True):
            for n, p in self.places[key]:
                in_doc, in_item = by_item[n]
                in_doc.add(d)
                in_item.add(p)
        out = []
        for n, (in_doc, in_item) in by_item.items():
            item_id, pattern = self.items[n]
            whole = len(pattern) < self.shortest
            need = len(pattern) if whole else self.coverage * len(pattern)
            if len({p + i for p in in_item for i in range(self.match)}) < need:
                continue  # no tiling can reach it
            covered = sorted({d + i for d in in_doc for i in range(self.match)})
            doc, where, before = [], [], None
            for d in covered:
                if before is not None and d != before + 1:
                    doc.append(-1)
                    where.append(-1)
                doc.append(int(ids[d]))
                where.append(d)
                before = d
            tiles = tile(pattern, doc, self.match)
            total = sum(k for k, _, _ in tiles)
            if total >= need and not (whole and len(tiles) > 1):
                marks = [{"doc_token": where[t], "item_token": p, "length": k} for k, p, t in sorted(tiles, key=lambda x: x[1])]
                out.append((item_id, total / len(pattern), len(tiles), tiles[0][0], len(pattern), marks))
        return out


def blocks(benchmark: DataFrame, block_tokens: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of about ``block_tokens`` words, one in memory at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if row.text:
            held.append((row.item_id, row.text))
            size += len(row.text) // 5 + 1
            if size >= block_tokens:
                yield held
                held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, shortest: int = SHORTEST_ITEM, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each document and item that its tiles cover: doc_id, item_id, coverage, tiles.

    Null and empty texts on either side match nothing. Items under ``shortest`` tokens
    must occur whole and unbroken, those under ``match`` tokens be all that a document
    says. Repeated documents and items give repeated rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    out = None
    for items in blocks(benchmark, block_tokens):
        shared = spark.sparkContext.broadcast((items, match, coverage, shortest))  # bounded by block_tokens

        def make(shared=shared):
            block = Block(*shared.value)

            def work(doc_ids, texts):
                rows = [(d, *found) for d, text in zip(doc_ids, texts, strict=True) for found in block.judge(text)]
                return list(zip(*rows, strict=True)) if rows else [[]] * 7

            return work

        part = map_columns(docs, ["doc_id", "text"], make, RESULT)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, shortest: int = SHORTEST_ITEM, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents without a covered item, judged where they are: a filter without a shuffle.

    Ids play no part, so rows without one, or that share one, are judged by their own text.
    """
    for items in blocks(benchmark, block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast((items, match, coverage, shortest))  # bounded by block_tokens

        def make(shared=shared):
            block = Block(*shared.value)
            return lambda texts: [not block.judge(t) for t in texts]

        docs = filter_rows(docs, "text", make)
    return docs
