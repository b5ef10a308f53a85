"""Language ID and toxicity: held-out accuracy on the synthetic tables, and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillon.llm import common, langid, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DATA, "documents")


def test_language_held_out(spark, docs):
    model = langid.fit(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == r.lang for r in got if r.held_out]
    assert len(held) > 150 and np.mean(held) > 0.95


def test_families_come_first():
    langs = ["en", "de", "fr", "es", "xx"]
    r = np.random.default_rng(1)
    rows = [(lang, langid.features_of(r.poisson(1 + 4 * (np.arange(langid.FEATURES) % 5 == i)))) for i, lang in enumerate(langs) for _ in range(20)]
    model = langid.train(rows)
    assert dict(zip(model.families, model.members)) == {"=xx": ["xx"], "germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert [len(p[0]) for p in model.pairs] == [0, 1, 1]


def test_svm_separates():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 30)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.sign(x @ r.normal(size=30)).astype(np.float32)
    w, b = langid.linear_svm(x, y)
    assert (np.sign(x @ w + b) == y).mean() > 0.95


def test_language_odd_rows(spark, docs):
    model = langid.fit(docs)
    rows = [(1, None), (2, ""), (3, "123 !!"), (3, "the and of with"), (None, "the and of"), (4, "the and of " * 20_000), (5, "日本語")]
    got = langid.identify(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int"), model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.lang_pred != "und" for r in got[3:])
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string")
    empty = langid.fit(nothing)
    assert empty.predict("abc") == ("und", 0.0) and langid.identify(nothing, model).collect() == []
    one = langid.fit(spark.createDataFrame([(1, "abc def", "en"), (2, None, "de"), (3, "x", None)], "doc_id long, text string, lang string"))
    assert one.predict("abc")[0] == "en"


def test_toxicity_held_out(spark, docs):
    labels = common.table(spark, "/root/testdata/sf0.1", "labels")
    many = common.table(spark, "/root/testdata/sf0.1", "documents")
    model = toxicity.fit(many, labels)
    got = toxicity.score_documents(many, model).join(labels, "doc_id").collect()
    held = [(r.predicted, r.toxic) for r in got if r.held_out]
    assert np.mean([p == t for p, t in held]) > 0.97
    # 7 of the 97 held-out toxic labels stand on texts without any toxic word.
    assert np.mean([p for p, t in held if t]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(bool(r.spans) for r in got if r.top_sentence >= 0.5)


def packed(bags):
    return [(y, w, n, np.array([len(x) for x in held], np.int32), np.array([i for x in held for i in x], np.int32)) for y, w, n, held in bags]


def test_sentences_are_learned_from_documents():
    """One bad sentence among clean ones; only the documents are labelled."""
    r = random.Random(1)
    bags = []
    for i in range(400):
        held = [tuple(sorted({r.randrange(1, 30), r.randrange(1, 30)})) for _ in range(5)]
        if i % 4 == 0:
            held[r.randrange(5)] = (0, r.randrange(1, 30))
        bags.append((int(i % 4 == 0), 1.0, 8, held))
    w, bias = toxicity.train(packed(bags), 30)
    assert w[0] + bias > 0 and all(w[k] + bias < 0 for k in range(1, 30))


def test_gradient_of_noisy_or():
    bags = [(1, 1.0, 3, [(0,), (1,)]), (0, 2.0, 2, [(1,)])]
    w, bias = toxicity.train(packed(bags), 2, rounds=400, decay=0)
    p = lambda z: 1 / (1 + np.exp(-z))
    assert 1 - (1 - p(w[0] + bias)) * (1 - p(w[1] + bias)) * (1 - p(bias)) > 0.9 and p(w[1] + bias) < 0.1


def test_toxicity_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "."), (3, "a bad. a good"), (None, "bad"), (4, "good " * 50_000), (5, "bad bad bad")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, score string")
    model = toxicity.Model({"bad": 9.0}, -4.0)
    got = toxicity.score_documents(df, model).collect()
    assert [r.predicted for r in got] == [0, 0, 0, 1, 1, 0, 1] and [(s.start, s.end) for s in got[3].spans] == [(0, 5)]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(df, none).weights == {}
    some = spark.createDataFrame([(4, 1), (5, None), (4, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert np.isfinite(toxicity.fit(df, some).bias)  # document 4 is labelled both ways
    assert toxicity.score_documents(df.limit(0), model).collect() == []


def test_unlearned_languages_are_far(spark):
    import corpus_pipeline

    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    model = langid.fit(docs)
    least = corpus_pipeline.LEAST_LANGUAGE_SCORE
    r = random.Random(5)
    junk = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n)) for n in (200, 1000)]
    far = ["Это русский текст о погоде и природе в городе. Сегодня хорошая погода и мы идём гулять", "日本語の文章です。これは学習していない言語です。" * 3, *junk]
    assert all(model.predict(t)[1] < least for t in far)
    assert all(model.predict(t)[1] >= least for t in ("the and of", "Avec.", "Das ist", "plain", "the and of with that is"))
    rows = spark.createDataFrame([(1, far[0]), (2, "the and of")], "doc_id long, text string")
    assert [x.doc_id for x in langid.keep_known(rows, model, least).collect()] == [2]
    got = langid.identify(docs, model).where("held_out and lang_pred != 'und'").select("score").collect()
    assert np.mean([x.score < least for x in got]) < 0.001


def test_every_language_is_learned(spark):
    words = {"en": "the and of with that", "de": "der und von mit dass", "fr": "le et des avec que"}
    rows = [(i, words[lang], lang) for i, lang in enumerate(k for k, n in (("en", 30), ("de", 20), ("fr", 10)) for _ in range(n))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=2)
    assert sorted(x for m in model.members for x in m) == ["de", "en", "fr"] and model.predict("le et des")[0] == "fr"


def plain_language(model, text):
    """Counts in a dictionary, whole numbers modulo 2**32, and votes pair by pair."""
    letters, border = [0], True
    for c in text.lower():
        if c.isalpha():
            letters.append(ord(c))
            border = False
        elif not border:
            letters.append(0)
            border = True
    if letters == [0]:
        return "und", 0.0
    letters.append(0)
    counts = [0] * langid.FEATURES
    half, m = langid.FEATURES // 2, 1 << 32
    for i in range(len(letters) - 1):
        two = (letters[i] * 0x9E3779B1 + letters[i + 1] * 0x85EBCA77) % m
        counts[two * half // m] += 1
        if i + 2 < len(letters):
            three = (two * 0xC2B2AE3D + letters[i + 2] * 0x27D4EB2F) % m
            counts[half + three * half // m] += 1
    x = [float(np.log1p(c)) for c in counts]
    norm = sum(v * v for v in x) ** 0.5
    x = np.array([v / norm for v in x])
    margins = [float(w @ x + b) for w, b in zip(*model.family_models)]
    best = max(range(len(margins)), key=margins.__getitem__)
    langs = model.members[best]
    wins = dict.fromkeys(langs, 0)
    which, w, b = model.pairs[best]
    for (i, j), wi, bi in zip(which, w, b):
        wins[langs[i] if float(wi @ x + bi) >= 0 else langs[j]] += 1
    return max(langs, key=wins.__getitem__), margins


def test_language_against_plain_python(spark, docs):
    model = langid.fit(docs)
    assert max(map(len, model.members)) <= 2  # so that votes have no ties
    texts = [r.text for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    texts += ["", "12 !", "a", " a", "a ", "é", "it's 1x", "日本語", "İstanbul", "x" * 10_000]
    for text in texts:
        assert model.predict(text)[0] == plain_language(model, text)[0], text[:80]


def plain_toxicity(model, text):
    sentences, begun = [], None
    for i, c in enumerate(text + "."):
        if c in ".!?\n":
            if begun is not None:
                sentences.append((begun, i))
            begun = None
        elif begun is None:
            begun = i
    clean, spans = 1.0, []
    for a, b in sentences:
        word, words = "", set()
        for c in text[a:b].lower() + " ":
            if c.isalnum() and not c.isdecimal():
                word += c
            elif word:
                words.add(word)
                word = ""
        held = {f for w in words for f in toxicity.features_of(w)}
        z = model.bias + sum(v for f, v in model.weights.items() if f in held)
        p = 1 / (1 + np.exp(-z))
        clean *= 1 - p
        if p >= 0.5:
            spans.append((a, b))
    return 1 - clean, len(sentences), spans


def test_toxicity_against_plain_python(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = toxicity.fit(docs, common.table(spark, "/root/testdata/sf0.01", "labels"))
    assert model.weights
    some = sorted(model.weights, key=model.weights.get)[-3:]
    texts = [r.text for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    texts += [f"İ good. You {some[-1].rstrip('*')}. ΑΣ.Β {some[-2].rstrip('*')}ΟΣ!", "ΑΣ.Β. x", "...", "a²b 1"]
    use = model.scorer()
    for text in texts:
        score, n, _, spans = use.score(text)
        want = plain_toxicity(model, text)
        assert abs(score - want[0]) < 1e-9 and n == want[1] and [x[:2] for x in spans] == want[2], text[:80]


def test_long_words_and_scripts_without_spaces():
    long = "x" * 60 + "bad" * 10
    other = long[:-1] + "e"
    assert len(long) > toxicity.LONG and toxicity.features_of(long)[0] != toxicity.features_of(other)[0] and all(len(f) < 90 for f in toxicity.features_of(long * 1000))
    model = toxicity.Model({toxicity.features_of(long)[0]: 9.0, "馬鹿": 9.0}, -4.0)
    use = model.scorer()
    assert use.score(f"fine. so {long} it is.")[3][0][:2] == (5, 5 + len(f" so {long} it is") - 0) and use.score(other)[3] == []
    assert [x[:2] for x in use.score("今日は良い\nお前は馬鹿だ\n")[3]] == [(6, 12)]
    assert [x[:2] for x in use.score("İ good. You " + long + ". fine.")[3]] == [(7, 12 + len(long))]


def test_long_words_are_learned(spark):
    long = "z" * 100
    rows = [(i, f"some words here {i}. {long if i % 4 == 0 else 'more'} there." + ("お前は馬鹿だ" if i % 4 == 1 else "")) for i in range(400)]
    labels = [(i, int(i % 4 < 2)) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    use = model.scorer()
    assert use.score(f"new. {long}.")[0] > 0.5 and use.score("new. お前は馬鹿だ。")[0] > 0.5 and use.score("new. more there.")[0] < 0.5
