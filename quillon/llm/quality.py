"""Quality rules: compression bands.

A text that says the same thing again and again compresses far better than prose,
and keys, encodings or noise compress far worse. The zstandard ratio (plain bytes
over packed bytes) of the whole document and of each fixed chunk is held against
a band. Short inputs can't compress as well as long ones, so each band belongs to
a range of lengths. Whole documents find repetition at a distance, chunks find a
damaged part in an otherwise good document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import map_columns

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Limits for inputs of fewer than ``below`` bytes; the last band has none."""

    below: int | None
    least: float
    most: float


#: Whole documents: ratio limits by length in bytes.
DOCUMENT_BANDS = (
    Band(400, 1.12, 2.8),
    Band(1_000, 1.20, 3.2),
    Band(4_000, 1.38, 3.8),
    Band(16_000, 1.50, 4.4),
    Band(64_000, 1.60, 5.0),
    Band(None, 1.60, 5.5),
)
#: Fixed chunks; a last chunk under MIN_CHUNK bytes isn't judged.
CHUNK_BYTES, MIN_CHUNK = 4096, 1024
CHUNK_BANDS = (Band(2_048, 1.30, 3.8), Band(None, 1.40, 4.4))
#: The share of a document's chunks that may lie outside their band.
BAD_CHUNKS = 0.25
LEVEL = 3

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks int, n_chunks_repetitive int, n_chunks_incompressible int, verdict string"


def band(bands: tuple[Band, ...], size: int) -> Band:
    return next(b for b in bands if b.below is None or size < b.below)


def repeat_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) < 1 << 20:
        windows = pairs[:-1] * len(number) + ids[2:]
    else:  # three numbers no longer fit in one
        windows = np.unique(pairs, return_inverse=True)[1][:-1] * np.int64(len(number)) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # on exactly space and \t\n\v\f\r
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeats = repeat_words(words)
    return n, len(text or "") - spaces, symbols, duplicate_lines(raw), repeats, n < 50 or 100 * repeats > 50 * n


class Judge:
    def __init__(self, documents=DOCUMENT_BANDS, chunks=CHUNK_BANDS, chunk_bytes=CHUNK_BYTES, bad_chunks=BAD_CHUNKS, level=LEVEL) -> None:
        self.documents, self.chunks, self.chunk_bytes, self.bad_chunks = documents, chunks, chunk_bytes, bad_chunks
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.packer.compress(raw))

    def judge(self, text: str | None) -> tuple[float, int, int, int, str]:
        """Ratio, chunks, those too repetitive and too dense, and ``ok`` or the reason."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0, 0, 0, "empty"
        whole, limits = self.ratio(raw), band(self.documents, len(raw))
        n = low = high = 0
        for at in range(0, len(raw), self.chunk_bytes):
            part = raw[at : at + self.chunk_bytes]
            if len(part) >= MIN_CHUNK:
                r, b = (whole if len(part) == len(raw) else self.ratio(part)), band(self.chunks, len(part))
                n, low, high = n + 1, low + (r > b.most), high + (r < b.least)
        if whole > limits.most:
            said = "repetitive"
        elif whole < limits.least:
            said = "incompressible"
        elif low > self.bad_chunks * n:
            said = "repetitive chunks"
        elif high > self.bad_chunks * n:
            said = "incompressible chunks"
        else:
            said = "ok"
        return whole, n, low, high, said


def compression_bands(docs: DataFrame, **limits) -> DataFrame:
    """Counts, ratios and verdict of every whole text; a map without a shuffle.

    Null and empty texts have no words, so they fail the base and are not kept.
    Repeated rows give repeated results; columns other than doc_id and text are
    not read; an empty table gives an empty result. Memory follows one text.
    """

    def make():
        judge = Judge(**limits)

        def work(doc_ids, texts):
            rows = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                counts = base_counts(text)
                ratio, n, low, high, said = judge.judge(text)
                rows.append((doc_id, *counts, not counts[-1] and said == "ok", ratio, n, low, high, said))
            return list(zip(*rows, strict=True)) if rows else [[]] * 13

        return work

    return map_columns(docs, ["doc_id", "text"], make, COLUMNS, rows=64)
