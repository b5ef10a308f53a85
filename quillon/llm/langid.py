"""Language ID by hierarchical discrimination.

A first linear model predicts the language family; then, within that family, a
linear support vector machine for each pair of languages votes. Features are the
hashed letter bigrams and trigrams of the whole text, counted by array arithmetic.
Closely related languages thus get models that only have to tell them apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, held_out, map_columns

#: Bounded sample of labelled rows: about so many documents of each language; of more languages than these, fewer of each.
SAMPLE_PER_LANGUAGE, LANGUAGES = 700, 120
FEATURES = 4096
FOLDS, FOLD = 4, 2
UNDETERMINED = "und"
#: Fewest learned documents from which a distance limit is set, spread of a document's mean and of one n-gram's, share of the limit beyond the farthest learned document.
LEAST_KNOWN, SPREAD, SPREAD_OF_ONE, ROOM = 50, 0.1, 1.0, 1.7

# Families of ISO 639-1 codes. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "indic": "hi bn mr gu pa ur ne si",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, f"={lang}")


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    if not _letters:
        codes = np.arange(0x110000, dtype=np.uint32)
        codes[[not chr(c).isalpha() for c in range(0x110000)]] = 0
        _letters.append(codes)
    return _letters[0]


def counts_of(text: str | None) -> np.ndarray | None:
    """Counts of hashed bigrams and trigrams, or None without a letter."""
    if not text:
        return None
    codes = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not codes.any():
        return None
    # Runs of other characters are one border.
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    codes = np.concatenate([np.zeros(1, np.uint32), codes[keep], np.zeros(1, np.uint32)])
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    half = FEATURES // 2
    shift = np.uint32(32 - half.bit_length() + 1)
    return np.concatenate([np.bincount(two >> shift, minlength=half), np.bincount(three >> shift, minlength=half)])


def features_of(counts: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32)
    return x / max(1e-9, float(np.sqrt(x @ x)))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """L2-regularised squared hinge loss, classes weighted alike, by accelerated gradient descent; y is +1 or -1."""
    n = len(y)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))).astype(np.float32) / n
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    ahead, b_ahead = w.copy(), b
    step = 1 / (1 + 4 * cost)  # rows have length 1, and the bias adds 1
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead + b_ahead))
        pull = 2 * cost * weight * slack * y
        w_next = ahead - step * (ahead - x.T @ pull)
        b_next = b_ahead + step * float(pull.sum())
        k = t / (t + 3)
        ahead, b_ahead = w_next + k * (w_next - w), b_next + k * (b_next - b)
        w, b = w_next, b_next
    return w, float(b)


@dataclass
class Nearness:
    """How near a text is to any of the learned languages, by its n-grams.

    Each n-gram counts as in the language where it is most frequent, so texts of
    several learned languages are near. The distance is the mean log frequency
    below that of the learned documents, in spreads for the text's size.
    """

    log_p: np.ndarray
    middle: float
    limit: float

    def distance(self, x: np.ndarray) -> float:
        mean, size = mean_log(x, self.log_p)
        return (self.middle - mean) / float(np.sqrt(SPREAD**2 + SPREAD_OF_ONE / size))

    def factor(self, x: np.ndarray) -> float:
        """1 well within the limit, 1/2 at the limit, 0 far from all languages."""
        return float(1 / (1 + np.exp(np.clip(4.0 * (self.distance(x) - self.limit), -40, 40))))


def mean_log(x: np.ndarray, log_p: np.ndarray) -> tuple[float, float]:
    """Mean of log_p over the features, and how many n-grams they are worth."""
    total = float(x.sum())
    return float(x @ log_p) / total, total * total


def profile(x: np.ndarray, named: np.ndarray) -> np.ndarray:
    sums = [x[named == lang].sum(axis=0, dtype=np.float64) for lang in np.unique(named)]
    return np.max([np.log(p / p.sum() + 1e-5) for p in sums], axis=0)


def nearness(x: np.ndarray, named: np.ndarray) -> Nearness | None:
    """Profiles of the languages; the limit from documents that a profile of the other half hasn't seen."""
    half = np.zeros(len(named), bool)
    for lang in np.unique(named):
        half[np.flatnonzero(named == lang)[::2]] = True
    if len(named) < LEAST_KNOWN or len(np.unique(named[half])) != len(np.unique(named[~half])):
        return None
    known = np.array([mean_log(row, log_p) for part in (half, ~half) for log_p in [profile(x[part], named[part])] for row in x[~part]])
    found = Nearness(profile(x, named), float(np.median(known[:, 0])), 0.0)
    away = (found.middle - known[:, 0]) / np.sqrt(SPREAD**2 + SPREAD_OF_ONE / known[:, 1])
    found.limit = ROOM * float(away.max())
    return found


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]  # languages of each family
    family_models: tuple[np.ndarray, np.ndarray]
    pairs: list[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]  # of each family
    near: Nearness | None = None  # None: too few documents to tell what is far

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = counts_of(text)
        if counts is None or not self.families:
            return UNDETERMINED, 0.0
        x = features_of(counts)
        score, best = 1.0, 0
        if len(self.families) > 1:
            margins = self.family_models[0] @ x + self.family_models[1]
            best = int(margins.argmax())
            rest = np.delete(margins, best).max()
            score = 1 / (1 + np.exp(-2.0 * float(margins[best] - rest)))
        langs = self.members[best]
        at = 0
        if len(langs) > 1:
            which, w, b = self.pairs[best]
            margins = w @ x + b
            votes, total = np.zeros(len(langs)), np.zeros(len(langs))
            for (i, j), m in zip(which, margins, strict=True):
                votes[i if m >= 0 else j] += 1
                total[i] += m
                total[j] -= m
            at = int(np.lexsort((-total, -votes))[0])
            least = min(m if i == at else -m for (i, j), m in zip(which, margins, strict=True) if at in (i, j))
            score *= 1 / (1 + np.exp(-4.0 * float(least)))
        if self.near is not None:
            score *= self.near.factor(x)
        return langs[at], float(min(1.0, max(0.0, score)))


def train(samples: list[tuple[str, np.ndarray]]) -> Model:
    """From (language, features) rows; languages without a sample are never predicted."""
    langs = sorted({lang for lang, _ in samples})
    families = sorted({family_of(lang) for lang in langs})
    members = [[lang for lang in langs if family_of(lang) == f] for f in families]
    if not samples:
        return Model([], [], (np.zeros((0, FEATURES)), np.zeros(0)), [])
    x = np.stack([row for _, row in samples])
    named = np.array([lang for lang, _ in samples])
    of = np.array([families.index(family_of(lang)) for lang in named])
    first = [linear_svm(x, np.where(of == i, 1, -1).astype(np.float32)) for i in range(len(families))] if len(families) > 1 else []
    family_models = (np.stack([w for w, _ in first]), np.array([b for _, b in first])) if first else (np.zeros((1, FEATURES)), np.zeros(1))
    pairs = []
    for own in members:
        which = list(combinations(range(len(own)), 2))
        made = []
        for i, j in which:
            rows = (named == own[i]) | (named == own[j])
            made.append(linear_svm(x[rows], np.where(named[rows] == own[i], 1, -1).astype(np.float32)))
        pairs.append((which, np.stack([w for w, _ in made]), np.array([b for _, b in made])) if made else ([], np.zeros((0, FEATURES)), np.zeros(0)))
    return Model(families, members, family_models, pairs, nearness(x, named))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Learns from text and lang of the rows outside the held-out fold.

    Every language is learned. The share taken of each is set so that about
    ``per_language`` rows come from it, or its part of ``languages`` times as many
    where there are more; rows are chosen by a hash, whatever their order.
    """
    learn = docs.where("lang is not null and text is not null").where(~held_out("doc_id", FOLDS, FOLD) & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = learn.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return train([])
    per_language = min(per_language, max(1, per_language * languages // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, per_language / r["count"]))])
    chosen = learn.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")) * 1_000_000)

    def make():
        def work(langs, texts):
            rows = [(lang, counts) for lang, text in zip(langs, texts, strict=True) if (counts := counts_of(text)) is not None]
            held = [np.flatnonzero(c) for _, c in rows]
            return [[lang for lang, _ in rows], [h.astype(np.int16).tobytes() for h in held], [np.minimum(c[h], 1 << 30).astype(np.int32).tobytes() for h, (_, c) in zip(held, rows)]]

        return work

    samples = []
    for r in map_columns(chosen, ["lang", "text"], make, "lang string, at binary, n binary").toLocalIterator():
        counts = np.zeros(FEATURES, np.int64)
        counts[np.frombuffer(r.at, np.int16)] = np.frombuffer(r.n, np.int32)
        samples.append((r.lang, features_of(counts)))
    samples.sort(key=lambda s: (s[0], s[1].tobytes()))  # partitions come in any order
    return train(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; a map without a shuffle.

    Null texts and texts without a letter are ``und`` with score 0. Columns other
    than doc_id and text are not read; repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        use = shared.value

        def work(doc_ids, out, texts):
            found = [use.predict(t) for t in texts]
            return [doc_ids, out, [lang for lang, _ in found], [score for _, score in found]]

        return work

    return map_columns(docs, ["doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "text"], make, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents whose language is told with a score of ``least`` or more; a filter without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        use = shared.value

        def known(text) -> bool:
            lang, score = use.predict(text)
            return lang != UNDETERMINED and score >= least

        return lambda texts: [known(t) for t in texts]

    return filter_rows(docs, "text", make)
