"""Toxicity by multiple-instance learning.

Only documents are labelled, yet a document is toxic because some sentence is.
Each sentence gets a probability from a logistic model over its words; a document's
probability is their noisy-or, 1 - prod(1 - p). The gradient of the document's
likelihood flows to the sentences in proportion to their own part in it, so the
model learns sentence scores from document labels and names the offending ones.

A sentence is scored by its words and by the beginnings of its words, so that
inflected forms of one stem share a weight; in scripts that write no spaces, by
pairs of neighbouring characters. Words of any length count.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_columns

#: Bounded sample of labelled rows: about so many of each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 6_000
#: Features kept (they bound the model, not the rows), the fewest documents of one, and the least association with the label.
FEATURES, LEAST_DOCS, LEAST_CHI2 = 20_000, 6, 14.0
#: Toxic documents are rare; each counts so many times its share.
TOXIC_WEIGHT = 2.0
FOLDS, FOLD = 5, 0
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+").findall
STEMS = (4, 5, 6, 7, 8)
#: A longer word is named by its beginning and a digest, so that names stay short.
LONG = 64
#: Scripts without spaces: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def features_of(word: str) -> list[str]:
    """The word and its beginnings, or the pairs of characters of a run that no spaces divide."""
    if not word.isascii() and UNSPACED.search(word):
        return sorted({word[i : i + 2] for i in range(max(1, len(word) - 1))})
    name = word if len(word) <= LONG else f"{word[:LONG]}~{hashlib.sha256(word.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}"
    return [name, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Spans between sentence marks, empty ones left out."""
    spans, at = [], 0
    for mark in SENTENCE.finditer(text):
        if mark.start() > at:
            spans.append((at, mark.start()))
        at = mark.end()
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def lowered(text: str) -> tuple[list[tuple[int, int]], str, list[tuple[int, int]]]:
    """Spans of the sentences in the text, the sentences lower-cased, and their places in that.

    Each sentence is lower-cased by itself where that may differ in length or form.
    """
    spans, low = sentences_of(text), text.lower()
    if len(low) == len(text) and "\u03a3" not in text:
        return spans, low, spans
    parts = [text[a:b].lower() for a, b in spans]
    ends = np.cumsum([0, *(len(x) + 1 for x in parts)]).tolist()
    return spans, "\n".join(parts), [(a, b - 1) for a, b in zip(ends, ends[1:])]


class _Known(dict):
    """Word to those of its features that have a weight, most often none."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in features_of(word) if f in self.weights)
        if len(self) > 500_000:
            self.clear()
        if len(word) <= LONG:
            self[word] = found
        return found


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.words, self.weights, self.bias = _Known(model.weights), model.weights, model.bias

    def sentence(self, words: set[str]) -> float:
        """Log-odds of a sentence from its words with weights. Each feature counts once, however often it is said."""
        held = {f for w in words for f in self.words[w]}
        return self.bias + sum(map(self.weights.__getitem__, sorted(held)))

    def score(self, text: str | None) -> tuple[float, int, float, list[tuple[int, int, float]]]:
        """Noisy-or, number of sentences, the highest sentence score, and the spans scored 0.5 or more."""
        if not text:
            return 0.0, 0, 0.0, []
        spans, low, places = lowered(text)
        if not spans:
            return 0.0, 0, 0.0, []
        told = {w for w in set(WORD(low)) if self.words[w]}  # most words say nothing
        z = np.full(len(spans), self.bias)
        if told:
            for i, (a, b) in enumerate(places):
                if found := told.intersection(WORD(low, a, b)):
                    z[i] = self.sentence(found)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        score = 1 - float(np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
        return score, len(spans), float(p.max()), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


def train(bags: list[tuple[int, float, int, np.ndarray, np.ndarray]], n_features: int, rounds: int = 500, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from documents: (label, weight, number of sentences, lengths, features).

    Only sentences with features are told apart: ``lengths`` says how many of
    ``features`` each of them has; the others are alike.
    """
    lengths = np.concatenate([np.empty(0, np.int32), *(b[3] for b in bags)])
    cols = np.concatenate([np.empty(0, np.int32), *(b[4] for b in bags)])
    n = len(lengths)
    rows = np.repeat(np.arange(n, dtype=np.int32), lengths)
    owner = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b[3]) for b in bags])
    empty = np.array([b[2] - len(b[3]) for b in bags], float)
    y = np.array([b[0] for b in bags], float)
    weight = np.array([b[1] for b in bags], float)
    weight /= weight.sum()
    w, bias = np.zeros(n_features), -4.0
    m1, m2, b1, b2 = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = bias + np.bincount(rows, w[cols], minlength=n)[:n]
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        p0 = min(max(1 / (1 + np.exp(-bias)), 1e-9), 1 - 1e-9)
        miss = np.bincount(owner, np.log1p(-p), minlength=len(bags)) + empty * np.log1p(-p0)
        some = np.clip(-np.expm1(miss), 1e-9, None)
        pull = weight * (y * np.exp(miss) / some - (1 - y))  # times p: the gradient of a sentence's log-odds
        g = pull[owner] * p
        grad = np.bincount(cols, g[rows], minlength=n_features) - decay * w
        grad_b = float(g.sum() + (pull * empty).sum() * p0)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        b1, b2 = 0.9 * b1 + 0.1 * grad_b, 0.99 * b2 + 0.01 * grad_b**2
        rate = 0.15 * (1 - t / (rounds + 1)) + 0.01
        w += rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        bias += rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Learns from labelled rows outside the held-out fold; text is the only input.

    Rows are chosen by a hash of their id, so all rows of an id are taken or none; an
    id with several texts gives a document of each, and one with several labels a
    document of each label. Null texts, ids and labels teach nothing.
    """
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out("doc_id", FOLDS, FOLD))
    n = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    if not n.get(1):
        return Model({}, -20.0)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, toxic / n[1]))).otherwise(F.lit(min(1.0, clean / max(1, n.get(0, 0)))))
    chosen = own.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000)) < share * 1_000_000)
    # About toxic + clean ids, whatever the table: small enough to send to every task.
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def count():
        def work(flags, texts):
            seen = (Counter(), Counter())
            for flag, text in zip(flags, texts, strict=True):
                words = set(WORD(lowered(text)[1]))
                seen[flag].update({f for w in words for f in features_of(w)})
            names = list(seen[0] | seen[1])
            return [names, [seen[1][f] for f in names], [seen[0][f] for f in names]]

        return work

    tally = map_columns(rows, ["toxic", "text"], count, "feature string, t long, c long", rows=2048).groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    total_t, total_c = min(toxic, n[1]), max(1, min(clean, n.get(0, 0)))
    a, b = F.col("t"), F.col("c")
    off = a * (total_c - b) - b * (total_t - a)
    chi2 = off * off * float(total_t + total_c) / (F.lit(float(total_t)) * total_c * (a + b) * F.greatest(F.lit(1.0), F.lit(float(total_t + total_c)) - a - b))
    kept = tally.where((a + b >= LEAST_DOCS) & (chi2 >= LEAST_CHI2)).orderBy(F.desc(chi2), "feature").limit(FEATURES).select("feature").collect()
    names = sorted(r.feature for r in kept)
    number = {f: i for i, f in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast(number)  # at most FEATURES entries

    def bag():
        known = shared.value

        def work(ids, flags, texts):
            sizes, packed, lengths = [], [], []
            for text in texts:
                spans, low, places = lowered(text)
                held = [x for a, b in places if (x := sorted({known[f] for w in WORD(low, a, b) for f in features_of(w) if f in known}))]
                sizes.append(len(spans))
                lengths.append(np.array([len(x) for x in held], np.int32).tobytes())
                packed.append(np.array([i for x in held for i in x], np.int32).tobytes())
            return [ids, flags, sizes, lengths, packed]

        return work

    bags = []
    told = map_columns(rows, ["doc_id", "toxic", "text"], bag, "doc_id long, toxic int, n int, lengths binary, features binary")
    for r in sorted(told.toLocalIterator(), key=lambda r: (r.doc_id, r.toxic, r.features)):
        weight = TOXIC_WEIGHT * n[1] / total_t if r.toxic else n.get(0, 0) / total_c
        bags.append((r.toxic, weight, r.n, np.frombuffer(r.lengths, np.int32), np.frombuffer(r.features, np.int32)))
    if not bags:
        return Model({}, -20.0)
    w, bias = train(bags, len(names))
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-3}, bias)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, top_sentence and the offending spans.

    A map without a shuffle. Null and empty texts have no sentence and score 0;
    repeated rows give repeated results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        use = shared.value.scorer()

        def work(doc_ids, out, texts):
            found = [use.score(t) for t in texts]
            score = [min(1.0, max(0.0, f[0])) for f in found]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in f[3]] for f in found]
            return [doc_ids, out, score, [int(s >= 0.5) for s in score], [f[1] for f in found], [f[2] for f in found], spans]

        return work

    ddl = "doc_id long, held_out boolean, score double, predicted int, n_sentences int, top_sentence double, spans array<struct<start:int,end:int,score:double>>"
    return map_columns(docs, ["doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "text"], make, ddl)
