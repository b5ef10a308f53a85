"""Secret scans: base patterns, and a character convolutional network over candidates.

The patterns find what announces itself. The network, in numpy, looks at every
other run of key-like characters together with the text around it and tells keys
from long words, numbers, paths and names. It is trained on labelled findings; its
output is calibrated on findings it hasn't seen, and the thresholds, one for long and
one for short runs, are the highest that still reach the asked recall there.

A candidate is every run of 16 or more key-like characters, and every run of 8 to 15
with a digit in it or a capital behind a small letter. Shorter runs, and runs of 8 to
15 letters without such a change, are what prose is made of and are no candidates.

Labelled findings are (text, start, end, is_secret) rows. Where a corpus has none,
``synthetic_findings`` writes them from a seed; real ones can be passed instead.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_ROWS, map_columns, returning

KINDS = ("assign", "access", "hex", "cnn")

# The base patterns, and the fewest characters of what must be long.
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of fewer characters fail
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
ANNOUNCED = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Where a shorter candidate shows itself, its characters, and its fewest.
MIXED, RUN = re.compile(r"[0-9]|[a-z][A-Z]"), re.compile(r"[A-Za-z0-9+/_.=-]+")
KEY_LIKE = frozenset(string.ascii_letters + string.digits + "+/_.=-")
LONG, SHORT = 16, 8

#: Characters seen of the context on each side and of each end of a candidate.
CONTEXT, HEAD, TAIL = 20, 28, 12
WIDTH = CONTEXT + HEAD + TAIL + CONTEXT
#: A longer run is also seen in windows of HEAD + TAIL characters, so many apart.
STRIDE = 20
CLASSES = 24
FILTERS, KERNEL, HIDDEN = 32, 5, 16
FINDINGS, RECALL, SEED = 6_000, 0.98, 7
#: Short runs say less; asking more of them would take names and numbers along.
SHORT_FINDINGS, SHORT_RECALL = 4_000, 0.9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(x in low for x in ANNOUNCED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Every run of 16 or more key-like characters, and of 8 or more that mixes kinds of characters."""
    found, at = [m.span() for m in CANDIDATE.finditer(text)], 0
    for mark in MIXED.finditer(text):
        a = mark.start()
        if a < at:
            continue
        at = RUN.match(text, a).end()
        while a and at - a < LONG and text[a - 1] in KEY_LIKE:
            a -= 1
        if SHORT <= at - a < LONG:
            found.append((a, at))
    return sorted(found)


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The run, and if the network doesn't see all of it, windows that cover it."""
    wide = HEAD + TAIL
    if end - start <= wide:
        return [(start, end)]
    return [(start, end), *((a, a + wide) for a in range(start, end - wide, STRIDE)), (end - wide, end)]


def class_of(c: str) -> int:
    """Character classes that the network sees."""
    if c in string.ascii_lowercase:
        return 2 if c in "abcdef" else 3 if c in "aeiou" else 4
    if c in string.ascii_uppercase:
        return 5 if c in "ABCDEF" else 6 if c in "IOU" else 7
    if c in string.digits:
        return 8
    special = "=:/+_-.\"' \n,;@<>{}[]()"
    if c in special:
        return 9 + min(special.index(c), 13)
    return 23 if c.isalpha() else 1


TABLE = np.array([class_of(chr(i)) for i in range(0x250)], np.int8)


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Classes of context, first and last characters, and context, in fixed places; 0 where there is none."""
    out = np.zeros(WIDTH, np.int8)
    before = text[max(0, start - CONTEXT) : start]
    head = text[start : min(end, start + HEAD)]
    tail = text[max(start + HEAD, end - TAIL) : end]
    after = text[end : end + CONTEXT]
    for at, part in ((CONTEXT - len(before), before), (CONTEXT, head), (CONTEXT + HEAD, tail), (CONTEXT + HEAD + TAIL, after)):
        if part:
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            out[at : at + len(part)] = np.where(codes < len(TABLE), TABLE[np.minimum(codes, len(TABLE) - 1)], 23)
    return out


def statistics(text: str, start: int, end: int) -> list[float]:
    """A few numbers beside the characters: length, variety, changes of class."""
    part = text[start:end]
    codes = TABLE[np.frombuffer(part.encode("latin-1", "replace"), np.uint8)]
    kind = np.where(codes == 8, 0, np.where(codes >= 9, 3, np.where(codes >= 5, 1, 2)))
    n = len(part)
    return [min(n, 128) / 64, len(set(part)) / min(n, 64), float((np.diff(kind) != 0).mean()), float((kind == 0).mean()), float((kind == 3).mean())]


@dataclass
class Network:
    embed: np.ndarray  # KERNEL x CLASSES x FILTERS: a row for each class at each place of the kernel
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    short_threshold: float = 0.5

    def least(self, length: int) -> float:
        """The threshold for a candidate of so many characters."""
        return self.threshold if length >= LONG else self.short_threshold

    def convolve(self, codes: np.ndarray) -> np.ndarray:
        n = codes.shape[1] - KERNEL + 1
        total = np.broadcast_to(self.bias, (codes.shape[0], n, FILTERS)).copy()
        for k in range(KERNEL):
            total += self.embed[k][codes[:, k : k + n]]
        return np.maximum(total, 0)

    def logits(self, codes: np.ndarray, stats: np.ndarray) -> np.ndarray:
        maps = self.convolve(codes)
        x = np.concatenate([pooled(maps)[0], stats], axis=1)
        return np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias

    def probability(self, codes: np.ndarray, stats: np.ndarray) -> np.ndarray:
        out = [self.logits(codes[i : i + 512], stats[i : i + 512]) for i in range(0, len(codes), 512)]
        z = np.concatenate(out) if out else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))


#: Places of the maps that belong to the context before, the candidate, the context behind.
PARTS = (slice(0, CONTEXT - 2), slice(CONTEXT - 2, CONTEXT + HEAD + TAIL - 2), slice(CONTEXT + HEAD + TAIL - 2, None))


def pooled(maps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest value of each filter over each part, mean over the candidate; and where the largest were."""
    where = [maps[:, p].argmax(axis=1) for p in PARTS]
    most = [np.take_along_axis(maps[:, p], w[:, None], axis=1)[:, 0] for p, w in zip(PARTS, where)]
    return np.concatenate([*most, maps[:, PARTS[1]].mean(axis=1)], axis=1), where


def train(codes: np.ndarray, stats: np.ndarray, y: np.ndarray, rounds: int = 8, seed: int = SEED, recall: float = RECALL) -> Network:
    """Adam on the cross-entropy; then calibration and threshold on a fifth that was kept apart."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    kept, used = order[: len(y) // 5], order[len(y) // 5 :]
    wide = 4 * FILTERS + stats.shape[1]
    net = Network(r.normal(0, 0.3, (KERNEL, CLASSES, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, (2 / wide) ** 0.5, (wide, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), r.normal(0, 0.3, HIDDEN).astype(np.float32), 0.0)
    names = ["embed", "bias", "hidden", "hidden_bias", "out", "out_bias"]
    m = {k: np.zeros_like(getattr(net, k), dtype=np.float32) for k in names}
    v = {k: np.zeros_like(getattr(net, k), dtype=np.float32) for k in names}
    step = 0
    for _ in range(rounds):
        r.shuffle(used)
        for at in range(0, len(used), 128):
            rows = used[at : at + 128]
            c, n = codes[rows], len(rows)
            maps = net.convolve(c)
            p, where = pooled(maps)
            x = np.concatenate([p, stats[rows]], axis=1)
            h = np.maximum(x @ net.hidden + net.hidden_bias, 0)
            z = h @ net.out + net.out_bias
            dz = (1 / (1 + np.exp(-z)) - y[rows]) / n
            dh = np.outer(dz, net.out) * (h > 0)
            dx = dh @ net.hidden.T
            d_maps = np.zeros_like(maps)
            for i, (part, w) in enumerate(zip(PARTS, where)):
                np.put_along_axis(d_maps[:, part], w[:, None], dx[:, None, i * FILTERS : (i + 1) * FILTERS], axis=1)
            d_maps[:, PARTS[1]] += dx[:, None, 3 * FILTERS : 4 * FILTERS] / maps[:, PARTS[1]].shape[1]
            d_maps *= maps > 0
            flat = d_maps.reshape(-1, FILTERS)
            long = maps.shape[1]
            d_embed = np.stack([_one_hot(c[:, k : k + long]).T @ flat for k in range(KERNEL)])
            grads = {"embed": d_embed, "bias": flat.sum(axis=0), "hidden": x.T @ dh, "hidden_bias": dh.sum(axis=0), "out": h.T @ dz, "out_bias": dz.sum()}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * np.square(grads[k])
                change = 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - change)
    calibrate(net, codes[kept], stats[kept], y[kept], recall)
    return net


def _one_hot(codes: np.ndarray) -> np.ndarray:
    flat = codes.reshape(-1)
    out = np.zeros((len(flat), CLASSES), np.float32)
    out[np.arange(len(flat)), flat] = 1
    return out


def calibrate(net: Network, codes: np.ndarray, stats: np.ndarray, y: np.ndarray, recall: float) -> None:
    """A logistic fit of label on output, then the highest threshold with the recall, for long and for short runs."""
    z = np.concatenate([net.logits(codes[i : i + 512], stats[i : i + 512]) for i in range(0, len(y), 512)])
    scale, shift = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -40, 40)))
        scale -= 0.05 * float(((p - y) * z).mean() + 1e-3 * (scale - 1))
        shift -= 0.2 * float((p - y).mean())
    net.scale, net.shift = scale, shift
    said, short = net.probability(codes, stats), stats[:, 0] < LONG / 64

    def least(rows: np.ndarray, recall: float) -> float:
        positive = np.sort(said[rows & (y > 0.5)])
        return float(positive[int(np.floor((1 - recall) * len(positive)))]) if len(positive) else 1.0

    net.threshold, net.short_threshold = least(~short, recall), least(short, SHORT_RECALL)


def synthetic_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, bool]]:
    """Labelled findings written from a seed: keys of many forms, and what looks like them."""
    r = random.Random(seed)
    letters, alnum = string.ascii_letters, string.ascii_letters + string.digits
    some = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    syllables = [some("bcdfghklmnprstvw", 1, 2) + some("aeiou", 1, 2) for _ in range(60)]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))

    def secret() -> str:
        kind = r.randrange(11)
        if kind == 9:
            return some(letters, 16, 40)
        if kind == 0:
            return some(alnum + "+/", 20, 64) + r.choice(["", "=", "=="])
        if kind == 1:
            return r.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "pk_test_", "glpat-"]) + some(alnum, 20, 40)
        if kind == 2:
            return ".".join(some(alnum + "-_", 16, 50) for _ in range(3))
        if kind == 3:
            return some("0123456789abcdef", 24, 64)
        if kind == 4:
            return some("0123456789ABCDEF", 24, 64)
        if kind == 5:
            return "AKIA" + some(string.ascii_uppercase + string.digits, 16, 20)
        if kind == 6:
            return "AIza" + some(alnum + "-_", 30, 36)
        if kind == 7:
            return some(string.ascii_uppercase + string.digits, 20, 40)
        return some(alnum, 16, 48)

    def harmless() -> str:
        kind = r.randrange(20)
        if kind == 12:
            return "".join(word() for _ in range(r.randint(5, 7)))
        if kind == 13:
            return "".join(word().capitalize() for _ in range(r.randint(5, 8)))
        if kind == 14:
            return r.choice("/.-_").join(word() for _ in range(r.randint(5, 20)))
        if kind == 15:
            return r.choice("/.-_+=").join(word().upper() for _ in range(r.randint(4, 8)))
        if kind == 16:
            return r.choice("=-._/+") * r.randint(16, 80)
        if kind == 17:
            return (word() * 16)[: r.randint(16, 60)]
        if kind == 18:
            return "//" + r.choice(["www.", "m.", ""]) + word() + "-" + word() + ".example.com/" + "/".join(word() for _ in range(r.randint(1, 4)))
        if kind == 19:
            return word() + r.choice(["...", "--", "/", "=", "."]) + "".join(word() for _ in range(r.randint(5, 7))) + r.choice(["", "."])
        if kind == 0:
            return word() + word() + word() + word() + str(r.randint(0, 99))
        if kind == 1:
            return "/".join(word() for _ in range(r.randint(3, 6))) + "/" + str(r.randint(1, 2024)) + r.choice([".html", ".py", "", "/index"])
        if kind == 2:
            return some(string.digits, 16, 30)
        if kind == 3:
            return f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}.{r.randint(0, 59):02}.{r.randint(0, 59):02}"
        if kind == 4:
            return "_".join(word() for _ in range(r.randint(3, 6))) + "_" + str(r.randint(0, 999))
        if kind == 5:
            return "-".join(word() for _ in range(r.randint(3, 6))) + "-" + str(r.randint(0, 9999))
        if kind == 6:
            return r.choice("=-._") * r.randint(16, 60) + str(r.randint(0, 9))
        if kind == 7:
            return ".".join(word() for _ in range(4)) + str(r.randint(0, 99))
        if kind == 8:
            return "".join(word().capitalize() for _ in range(r.randint(3, 6))) + str(r.randint(0, 9))
        if kind == 9:
            return r.choice(["www.", ""]) + word() + word() + ".example.com/" + word() + str(r.randint(0, 99))
        if kind == 10:
            return ".".join(some(string.digits, 1, 3) for _ in range(r.randint(5, 8)))
        return (word()[:3] + str(r.randint(0, 9))) * r.randint(5, 9)

    def prose(k: int) -> str:
        return r.choice([" ", " ", "\n", ", "]).join(word() for _ in range(k))

    out = []
    for i in range(n):
        yes = i % 2 == 0
        part = secret() if yes else harmless()
        while len(part) < 16:
            part += some(letters, 16, 16) if yes else word()
        if r.random() < (0.5 if yes else 0.1):
            lead = r.choice(["key", "auth", "bearer", "credential", "access_key", "client_id", "pass", "signature", "id"]) + r.choice(["=", ": ", ' = "', "='", " "])
        else:
            lead = r.choice(["", " ", '"', "(", "see ", "at "])
        before = prose(r.randint(0, 6)) + r.choice([" ", "\n", ""]) + lead
        if before and before[-1].isalnum():
            before += " "
        after = r.choice(["", '"', "'", ")", ",", ";", "###", "$$$"]) + r.choice([" ", "\n"]) + prose(r.randint(0, 6))
        start, end = len(before), len(before) + len(part)
        if yes and r.random() < 0.15:
            # Inside a longer run: the finding is a window that holds most of the key.
            sign = r.choice("/.")
            lead = before + sign + sign.join(word() for _ in range(r.randint(4, 10))) + sign
            after = sign + sign.join(word() for _ in range(r.randint(4, 10))) + after
            start = len(lead) + r.randint(-10, max(0, len(part) - 30))
            before, end = lead, start + HEAD + TAIL
        out.append((before + part + after, start, end, yes))
    return out


def short_findings(n: int = SHORT_FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, bool]]:
    """Labelled findings of 8 to 15 characters: generated passwords, and the names and numbers that look like them.

    A finding is the run as it is scanned, so a name and its equals sign may belong to it.
    """
    r = random.Random(seed)
    letters, digits = string.ascii_letters, string.digits
    some = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    syllables = [some("bcdfghklmnprstvw", 1, 2) + some("aeiou", 1, 2) for _ in range(80)]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))

    def secret() -> str:
        chars = r.choice([letters + digits, letters + digits, letters + digits + "+/_-", string.ascii_uppercase + digits, string.ascii_lowercase + digits])
        return some(chars, SHORT, LONG - 1)

    def harmless() -> str:
        forms = (
            lambda: some(digits, 3, 4) + r.choice("-./") + some(digits, 3, 6) + r.choice(["", "-" + some(digits, 2, 4)]),
            lambda: ".".join(some(digits, 1, 3) for _ in range(4)),
            lambda: some(digits, 8, 15),
            lambda: f"{r.randint(1900, 2100)}{(s := r.choice('-./'))}{r.randint(1, 12):02}{s}{r.randint(1, 31):02}",
            lambda: f"{r.randint(1, 31)}{(s := r.choice('-./'))}{r.randint(1, 12):02}{s}{r.randint(1900, 2100)}",
            lambda: f"{r.choice(['v', 'V', ''])}{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}-{r.choice(['rc', 'beta', 'alpha', 'dev'])}{r.randint(0, 9)}",
            lambda: r.choice([str, str.capitalize, str.upper])(word() + word()) + r.choice(["", "-", "_", ".", "/", "="]) + some(digits, 1, 4),
            lambda: word() + word() + "." + some(digits, 1, 3),
            lambda: some(digits, 1, 4) + r.choice(["", "-", "_", "."]) + r.choice([str, str.capitalize])(word() + word()),
            lambda: word() + "".join(word().capitalize() for _ in range(r.randint(1, 3))) + r.choice(["", "", ".", str(r.randint(0, 9))]),
            lambda: "".join(word().capitalize() for _ in range(r.randint(2, 4))),
            lambda: word() + r.choice("._-/=") + word().capitalize() + r.choice(["", some(digits, 1, 2)]),
            lambda: r.choice(["=", "-", "."]) * r.randint(1, 4) + some(digits, 1, 4) + r.choice(["=", "-", "."]) * r.randint(3, 8),
            lambda: (word()[:2] + some(digits, 1, 1)) * r.randint(3, 5),
            lambda: some(string.ascii_uppercase, 2, 4) + r.choice(["-", ""]) + some(digits, 4, 8),
        )
        return r.choice(forms)()

    prose = lambda k: r.choice([" ", " ", "\n", ", "]).join(word() for _ in range(k))
    out: list[tuple[str, int, int, bool]] = []
    while len(out) < n:
        yes = len(out) % 2 == 0
        part = secret() if yes else harmless()
        if not SHORT <= len(part) < LONG or not MIXED.search(part):
            continue
        named = r.random() < (0.6 if yes else 0.1)
        lead = r.choice(["key", "auth", "bearer", "credential", "login", "client_id", "pass", "pwd", "id"]) + r.choice(["=", ": ", ' = "', "='", " "]) if named else r.choice(["", "", '"', "(", "see ", "at "])
        before = prose(r.randint(0, 6)) + r.choice([" ", "\n"]) + lead
        if before[-1] in KEY_LIKE and before[-1] != "=":
            before += " "
        after = r.choice(["", '"', "'", ")", ",", ";"]) + r.choice([" ", "\n"]) + prose(r.randint(0, 6))
        text = before + part + after
        out += [(text, a, b, yes) for a, b in candidates(text) if a <= len(before) < b]
    return out


def fit(findings: list[tuple[str, int, int, bool]] | None = None, recall: float = RECALL) -> Network:
    """The network, trained on (text, start, end, is_secret) rows; without any, on findings written from a seed.

    Repeated rows count as often as they occur; at least one row of each label is needed.
    """
    rows = synthetic_findings() + short_findings() if findings is None else findings
    # All windows of what is no secret are none; those of a secret needn't hold its key.
    rows = [(t, *w, y) for t, a, b, y in rows for w in (windows(a, b) if not y else [(a, b)])]
    codes = np.stack([encode(t, a, b) for t, a, b, _ in rows])
    stats = np.array([statistics(t, a, b) for t, a, b, _ in rows], np.float32)
    return train(codes, stats, np.array([float(y) for *_, y in rows], np.float32), recall=recall)


def covered(start: int, end: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether the base spans, sorted, together hold every character."""
    for a, _, b in base:
        if a <= start < b:
            start = b
    return start >= end


def scored(texts, network: Network) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of every candidate of each text; the score of a run is that of its best window."""
    asked, codes, stats = [], [], []
    for i, text in enumerate(texts):
        for a, b in candidates(text) if text else ():
            for w in windows(a, b):
                asked.append((i, a, b))
                codes.append(encode(text, *w))
                stats.append(statistics(text, *w))
    found: list[list] = [[] for _ in texts]
    if asked:
        best: dict[tuple[int, int, int], float] = {}
        for run, p in zip(asked, network.probability(np.stack(codes), np.array(stats, np.float32)).tolist(), strict=True):
            best[run] = max(p, best.get(run, 0.0))
        for (i, a, b), p in best.items():
            found[i].append((a, b, p))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, network: Network, columns=("doc_id", "text")) -> DataFrame:
    """doc_id and the spans (kind, start, end, score) of every whole text, in code points.

    Base spans have score 1. Every candidate is scored; those that lie in base spans
    add nothing, as the finding is there already; others may overlap them. Null and empty texts have no span;
    repeated rows give repeated results; other columns are not read. A map without
    a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        net = shared.value

        def work(doc_ids, texts):
            base = [base_spans(t) if t else [] for t in texts]
            found: list[list] = [[(a, k, b, 1.0) for a, k, b in x] for x in base]
            for i, runs in enumerate(scored(texts, net)):
                for a, b, score in runs:
                    if score >= net.least(b - a) and not covered(a, b, base[i]):
                        found[i].append((a, 3, b, score))
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(x)] for x in found]
            return [doc_ids, spans]

        return work

    return map_columns(docs, list(columns), make, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def redact_text(text: str | None, network: Network) -> str | None:
    """The text with each finding's characters replaced by its kind."""
    if not text:
        return text
    spans = [(a, b, KINDS[k]) for a, k, b in base_spans(text)]
    spans += [(a, b, "cnn") for a, b, s in scored([text], network)[0] if s >= network.least(b - a)]
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind}]" if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, network: Network) -> DataFrame:
    """The documents with secrets taken out of their texts; all columns and rows stay.

    ``n_chars``, where there is one, follows the new text. Null and empty texts stay
    as they are, repeated rows give repeated rows; a map without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    from pyspark.sql import functions as F

    @returning
    def clean(batches):
        net = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            field = batch.schema.field(at)
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                yield part.set_column(at, field, pa.array([redact_text(t, net) for t in part.column(at).to_pylist()], field.type))

    out = docs.mapInArrow(clean, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
