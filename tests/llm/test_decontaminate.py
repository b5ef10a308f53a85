"""Greedy string tiling against a brute-force version, and documents with planted passages."""

from __future__ import annotations

import random

from quillon.llm import decontaminate as D


def brute_tile(pattern, text, least):
    used_p, used_t, tiles = [False] * len(pattern), [False] * len(text), []
    while True:
        best, found = least - 1, []
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] >= 0 and not used_p[p + k] and not used_t[t + k]:
                    k += 1
                if k > best:
                    best, found = k, [(p, t)]
                elif k == best and k >= least:
                    found.append((p, t))
        if not found:
            return tiles
        for p, t in found:
            if not any(used_p[p : p + best]) and not any(used_t[t : t + best]):
                used_p[p : p + best] = [True] * best
                used_t[t : t + best] = [True] * best
                tiles.append((best, p, t))


def test_tiling():
    r = random.Random(1)
    for _ in range(600):
        pattern = [r.randint(1, 5) for _ in range(r.randint(0, 40))]
        text = [r.choice([-1, 1, 2, 3, 4, 5]) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5 and pattern:
            cut = r.randrange(len(pattern))
            text = text[:10] + pattern[cut:] + text[10:15] + pattern[:cut] + text[15:]
        least = r.choice([2, 3, 4])
        assert D.tile(pattern, text, least) == brute_tile(pattern, text, least)


def brute(docs, items, match=D.MATCH, coverage=D.COVERAGE, shortest=D.SHORTEST_ITEM):
    out = []
    for item_id, item in items:
        words = D.tokens(item)
        if len(words) < shortest:
            continue
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        for doc_id, text in docs:
            ids = [number.get(w, -1) for w in D.tokens(text)]
            total = sum(k for k, _, _ in brute_tile([number[w] for w in words], ids, match))
            if total >= coverage * len(words):
                out.append((doc_id, item_id, round(total / len(words), 9)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 8, 20, 40])))) for i in range(12)]
    docs = []
    for i in range(60):
        words = [r.choice(vocab) for _ in range(r.choice([2, 30, 90]))]
        if r.random() < 0.7:
            held = r.choice(items)[1].split()
            kind = r.random()
            if kind < 0.4:  # reordered halves, upper case, marks
                cut = len(held) // 2
                words = [*held[cut:], *words, *(w.upper() + "," for w in held[:cut])]
            elif kind < 0.7:
                words = words[:5] + held + words[5:]
            else:
                words = words[:5] + held[: len(held) // 3] + words[5:]
        docs.append((i, " ".join(words)))
    return docs, items


def test_documents(spark):
    docs, items = corpus(3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 10
    for block_tokens in (D.BLOCK_TOKENS, 30):
        got = sorted(((r.doc_id, r.item_id, round(r.coverage, 9)) for r in D.contaminated(d, b, block_tokens=block_tokens).collect()), key=str)
        assert got == want
    kept = D.keep_clean(d, b)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {x[0] for x in want}) and kept.columns == d.columns


def test_tiles_name_the_tokens(spark):
    item = "one two three four five six seven eight nine ten"
    text = "x y " + "six seven eight nine ten" + " z " + "one two three four five"
    r = D.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert (r.coverage, r.n_tiles, [(t.doc_token, t.item_token, t.length) for t in r.tiles]) == (1.0, 2, [(8, 0, 5), (2, 5, 5)])


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None, 0), (2, "", 0), (3, item, 0), (3, item, 0), (None, item, 0), (4, "w " * 100_000 + item, 0), (5, "one two", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(1, item, "q"), (2, None, "q"), (3, "", "q"), (4, item, "q"), (None, "a b", "q")], "item_id long, text string, coverage string")
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()), key=str)
    assert got == sorted([(x, y) for x in (3, 3, None, 4) for y in (1, 4)], key=str)
    assert sorted((r.doc_id for r in D.keep_clean(d, b).collect()), key=str) == [1, 2, 5]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(d, none).collect() == [] and D.keep_clean(d, none).count() == 7
    assert D.contaminated(d.limit(0), b).collect() == []


def test_short_items(spark):
    """Under a tiling's length: whole and unbroken; under a tile's: nothing else in the document."""
    items = [(1, "What is the capital of France?"), (2, "Yes, no."), (3, "今日は良い天気です"), (4, "...")]
    docs = [(1, "so: WHAT is the capital of france, he said"), (2, "what is the capital of big France"), (3, "the capital of France what is"), (4, "yes no"), (5, "yes no maybe"), (6, "昔々今日は良い天気です。"), (7, "今日の天気です"), (8, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in D.contaminated(d, b).collect())
    assert got == [(1, 1, 1.0, 1), (4, 2, 1.0, 1), (6, 3, 1.0, 1)]
    assert sorted(r.doc_id for r in D.keep_clean(d, b).collect()) == [2, 3, 5, 7, 8]


def test_tokens_of_scripts():
    assert D.tokens("Ab_c 1x, 日本go ไทย") == ["ab", "c", "1x", "日", "本", "go", "ไ", "ท", "ย"]
