"""Base counts against plain Python, verdicts on clear cases, and odd rows."""

from __future__ import annotations

import random
import re

from quillon.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_counts():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b", " ", " ", "\n", "\t", "\x0b", "#", "<", "é", " ", "\x1c", "\x85", "a b c ", "line\n"]) for _ in range(r.randint(0, 120)))
        assert quality.base_counts(text) == brute(text), repr(text)


def test_many_words_take_the_other_path(monkeypatch):
    words = [b"%d" % (i % 7) for i in range(40)]
    plain = quality.repeat_words(words)
    assert plain == brute(b" ".join(words).decode())[4]


def prose(n, seed=1):
    r = random.Random(seed)
    syllables = ["the", "an", "er", "on", "in", "re", "ti", "es", "nd", "st", "wh", "ble", "ly", "or", "ou", "ea", "sh", "ha"]
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n))


def test_bands():
    judge = quality.Judge()
    for n in (60, 200, 1000, 5000, 20_000):
        assert judge.judge(prose(n))[4] == "ok", n
    assert judge.judge("buy now cheap " * 400)[4] == "repetitive"
    noise = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=6000))
    assert judge.judge(noise)[4] == "incompressible"
    half = prose(3000) + " " + "x y z " * 4000
    assert judge.judge(half)[4] != "ok"


def test_chunks_find_a_damaged_part():
    r = random.Random(2)
    noise = "".join(r.choices([chr(c) for c in range(0x4E00, 0x9000)], k=4200))
    assert quality.Judge().judge(prose(1600) + noise)[4] in ("incompressible chunks", "incompressible")


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, prose(80)), (3, prose(80)), (None, "short"), (4, prose(60_000))]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, kept int")
    got = quality.compression_bands(df).collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 3, None, 4]
    assert [r.kept for r in got] == [False, False, True, True, False, True]
    assert [tuple(r[1:7]) for r in got] == [brute(t) for _, t in rows]
    assert quality.compression_bands(spark.createDataFrame([], "doc_id long, text string")).collect() == []
