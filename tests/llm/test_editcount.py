"""Counts after edits against counting the edited text from the start."""

from __future__ import annotations

import random

import public_tokenizers as P
import pytest
import tiktoken

from quillon.llm import editcount

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return editcount.Counter(f.read())


def test_pattern_is_the_vocabulary_s():
    import regex

    text = "It's we'll 12 é  \n\n x, don't 'tis  'r 're\t\n" + "".join(map(chr, range(32, 600)))
    assert regex.findall(editcount.PATTERN, text) == regex.findall(P.PATTERN, text)


def plain(counter, text):
    return len(counter.encoding.encode_ordinary(text))


@pytest.mark.parametrize("seed", range(6))
def test_random_edits(counter, seed):
    r = random.Random(seed)
    chars = ["a", "b", "the", " ", " ", "  ", "\n", "'", "'r", "'re", "e", "1", "22", "é", ",", "!!", "\t", "🎉", "x" * 50]
    some = lambda n: "".join(r.choice(chars) for _ in range(r.randint(0, n)))
    for _ in range(150):
        held = editcount.EditedText(some(r.choice([0, 3, 30, 400])), counter)
        assert held.tokens == plain(counter, held.text)
        for _ in range(r.randint(1, 3)):
            text, edits, at = held.text, [], 0
            while at <= len(text) and len(edits) < r.choice([1, 2, 10]):
                a = min(len(text), at + r.choice([0, 1, 2, 5, 40]))
                b = min(len(text), a + r.choice([0, 0, 1, 3, 20]))
                edits.append((a, b, some(4)))
                at = b + 1
            out, at = [], 0
            for a, b, new in edits:
                out += [text[at:a], new]
                at = b
            want = "".join([*out, text[at:]])
            held.apply(edits)
            assert held.text == want
            assert held.tokens == plain(counter, want)
            assert held.tree.chars == len(want)


def test_only_the_neighbourhood_is_cut_again(counter):
    text = "some plain words that go on " * 5000
    held = editcount.EditedText(text, counter)
    held.apply([(70_000, 70_004, "other")])
    assert held.recounted < 100 and held.tokens == plain(counter, held.text)


def test_bad_edits(counter):
    with pytest.raises(ValueError):
        editcount.EditedText("abc", counter).apply([(0, 2, ""), (1, 3, "")])


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "id 123456789 x\nline\nline\n\nline"), (3, "id 123456789 x\nline\nline\n\nline"), (None, "a b"), (4, "w " * 60_000), (5, "9" * 3000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_tokens string")
    got = editcount.count_edits(df, PATH).collect()
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(got, rows):
        after, at = "", 0
        for a, b, new in editcount.masking_edits(text or ""):
            after += (text or "")[at:a] + new
            at = b
        after += (text or "")[at:]
        assert (r.doc_id, r.n_tokens, r.n_tokens_after, r.n_chars_after) == (doc_id, len(t.encode_ordinary(text or "")), len(t.encode_ordinary(after)), len(after))
    assert got[2].n_edits == 3 and got[2].n_chars_after == len("id <num> x\nline\n\n")
    assert editcount.count_edits(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_many_edits_at_one_place(counter):
    """The tree stays flat, whatever the place of the edits."""
    r = random.Random(3)
    for place in (lambda n: n // 2, lambda n: n, lambda n: 0, lambda n: min(n, 7)):
        held = editcount.EditedText("some words. " * 30, counter)
        for _ in range(3000):
            at = place(len(held.text))
            held.apply([(at, at, r.choice(["a b", " x", "12 ", "é", ", no"]))])
        assert held.tokens == plain(counter, held.text) and held.tree.height <= 2 * held.tree.leaves.bit_length() + 16
