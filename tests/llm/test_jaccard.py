"""The join against a brute-force version, and every odd input."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillon.llm import jaccard, region, shingles


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [r.choice(vocab) for _ in range(60)]
    rows, base = [], []
    for i in range(n):
        kind = r.random()
        if kind < 0.4 or not base:
            w = [r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 6, 8, 9, 30, 80, 200]))]
        else:
            w = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1, 1])] = [r.choice(vocab)]
        if r.random() < 0.2:
            w = w + common
        base.append(w)
        rows.append((i, r.choice([" ", "\n", " \t"]).join(x.upper() if r.random() < 0.05 else x for x in w)))
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("options", [{}, {"task_sets": 6, "sample_docs": 40}])
def test_brute_force(spark, seed, options):
    rows = corpus(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n"), (None, text), (5, text), (5, "other words are here now ok"), (6, text + " more"), (7, "a b"), (8, "A  b"), (9, "a b c"), (10, " a b c d e f"), (11, "x " * 3000), (12, text)]
    df = spark.createDataFrame([(*r, 0, "y") for r in rows], "doc_id long, text string, n long, sig string")
    got = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    got = jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string"))
    assert got.collect() == [] and got.columns == ["doc_id", "n_shingles", "component_id"]


def test_shingle_set_matches_python():
    for _, t in corpus(5):
        assert len(shingles.shingle_set(t)) == len(set_of(t))


@pytest.mark.parametrize("with_pivot", [False, True])
def test_region_is_exact(with_pivot):
    rows = corpus(11, 220)
    sets = [x for x in (shingles.shingle_set(t) for _, t in rows) if len(x)]
    links, _, roots = region.join_region(sets, 0 if with_pivot else None)
    plain = [set(x.tolist()) for x in sets]
    for a, b in links:
        assert 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j]):
                assert roots[i] == roots[j]


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(3, text, "en"), (2, text.upper(), "de"), (4, "a b c", None), (None, "a b c", None)], "doc_id long, text string, lang string")
    got = jaccard.keep_first(df)
    assert got.columns == df.columns and sorted((r.doc_id for r in got.collect()), key=str) == [2, 4, None]


def test_repeated_ids_keep_their_own_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (2, a + " x"), (2, b), (3, b + " y"), (3, b)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.keep_first(df).collect())) == [(1, a), (2, b)]


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_large_regions_are_divided(spark, depth):
    """A passage that all share and no sample has seen: one region, far larger than a task, in which little is tied."""
    r = random.Random(depth)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(120):
        own = [f"d{i}x{k}" for k in range(60)]
        rows.append((3 * i, " ".join(shared + own)))
        for j in (1, 2):
            near = list(own)
            near[r.randrange(60)] = f"e{i}{j}"
            rows.append((3 * i + j, " ".join(shared + near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df, task_sets=20, sample_docs=1, depth=depth).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("most_blocks, levels", [(0, 4), (128, 2)])
def test_near_copies_are_not_divided_again_and_again(spark, monkeypatch, most_blocks, levels):
    """They share so many shingles that each division leaves one region of nearly all of them."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(90):
        near = list(base)
        for _ in range(r.randint(0, 9)):
            near[r.randrange(90)] = f"e{r.randrange(10**9)}"
        rows.append((i, " ".join(near)))
    joined, join = [], jaccard.join_tasks
    monkeypatch.setattr(jaccard, "MOST_BLOCKS", most_blocks, raising=False)
    monkeypatch.setattr(jaccard, "join_tasks", lambda tasks: joined.append(1) or join(tasks))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), task_sets=24, sample_docs=1).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert len(joined) <= levels


def test_blocks_hold_no_more_shingles_than_a_task(spark):
    rows = [(i, 5, 1000, i, 0.5, f"t{i}", i % 2 == 0) for i in range(40)]
    opened = spark.createDataFrame(rows, "sig long, region long, n long, known long, d double, text string, loose boolean")
    tasks = jaccard.blocks(opened, 500, 8_000).collect()
    held = {t: [x.sig for x in tasks if x.task == t] for t in {x.task for x in tasks}}
    assert max(map(len, held.values())) <= 20  # dealt by a hash
    met = {(a, b) for x in held.values() for a in x for b in x}
    assert all((a, b) in met for a in range(0, 40, 2) for b in range(40))


@pytest.mark.parametrize("ids", [[None] * 300, [7] * 300, list(range(300))])
def test_a_set_is_sent_once_whatever_the_ids(spark, ids):
    base = [f"w{k}" for k in range(200)]
    rows = [(d, " ".join(base[:100] + [f"x{i}"] + base[100:])) for i, d in enumerate(ids)]
    rows += rows[:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.meet(docs, np.empty(0, np.int64)).cache()
    plain = found.where("kind = 0")
    met = jaccard.regions(found.where("kind = 1").selectExpr("0L as parent", "sig", "n", "pivot", "shared"))
    tasks = jaccard.dealt(met, 100, 1_000_000)
    n = tasks.count()
    assert n >= 300 and jaccard.with_texts(tasks, plain, docs).count() == n
    found.unpersist()


def test_very_large_sets(spark):
    """Sizes on both sides of the 256th size class."""
    assert jaccard.size_class(2_980_000) < 256 <= jaccard.size_class(3_100_000)
    df = spark.createDataFrame([(i, None) for i in (1, 2)], "doc_id long, text string").selectExpr("doc_id", "array_join(transform(sequence(1, if(doc_id = 1, 2980004, 3100004)), x -> cast(x as string)), ' ') as text")
    got = jaccard.jaccard_components(df).collect()
    assert sorted(map(tuple, got)) == [(1, 2_980_000, 1), (2, 3_100_000, 1)]


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(5, i) for i in range(100, 400)] + [(i, i + 1) for i in range(1000, 1040)] + [(3, 5), (7, 7)]
    from quillon.llm.components import components

    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 3 for x in [3, 5, *range(100, 400)]} | {x: 1000 for x in range(1000, 1041)}


def test_components_of_random_links(spark):
    from quillon.llm.components import components

    r = random.Random(9)
    for n in (0, 1, 30, 300):
        edges = [(r.randrange(200), r.randrange(200)) for _ in range(n)]
        root = list(range(200))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        linked = {x for a, b in edges if a != b for x in (a, b)}
        got = sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).select("node", "root").collect()))
        assert got == sorted((x, find(x)) for x in linked)


def test_components_take_few_tables_where_a_task_holds_all_links(spark, monkeypatch):
    from quillon.llm import components

    written, write = [], components.checkpoint
    monkeypatch.setattr(components, "checkpoint", lambda df: written.append(1) or write(df))
    edges = [(i, i + 1) for i in range(60)] + [(i, 99) for i in range(100, 130)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 0 for x in range(61)} | {x: 99 for x in range(99, 130)}
    assert len(written) == 2


@pytest.mark.parametrize("slice_links", [1, 7, 400])
def test_components_of_slices(spark, slice_links):
    """Hubs, chains and random links between structs, in slices of the links that must be tied afterwards."""
    from quillon.llm.components import components

    r = random.Random(slice_links)
    links = [(0, i) for i in range(300, 340)] + [(i + 1, i) for i in range(400, 430)] + [(r.randrange(80), r.randrange(80)) for _ in range(60)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    made = [((a // 10, a - 250), (b // 10, b - 250)) for a, b in links]
    edges = spark.createDataFrame(made, "a struct<rep: long, sig: long>, b struct<rep: long, sig: long>").repartition(3)
    got = sorted((r.node.sig + 250, r.root.sig + 250) for r in components(edges, slice_links).collect())
    assert got == sorted((x, find(x)) for x in {x for a, b in links if a != b for x in (a, b)})
