"""Ids and decoded text against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import sys
import time

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import bpe

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.load_rules(PATH))


PARTS = ["a", "b", "s", "e", "t", "the", "ing", "é", "é", "ü", "Σ", "ς", "İ", "K", "1", "²", "'", "'s", "'ll", " ", "\n", " ", "\x85", "#", "$", "🎉", "日本", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\x00", "aaaa", "----", "ß", "ﬁ", "​", "ẞ", "Ǆ", "\x1c"]


def test_random_texts(library, own):
    r = random.Random(2)
    for _ in range(8000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, repr(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=40))
def test_any_text(library, own, text):
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_runs(library, own):
    for text in ("a" * 5000, "=" * 5000, "ab" * 3000, "thethethe" * 500, "é" * 2000):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_every_token_is_its_own_encoding(own):
    for i, text in enumerate(own.tokens):
        if text.endswith("</w>") and i not in own.rules.unreachable and text.isascii() and text[:-4].isalpha() and text[:-4].islower():
            assert own.encode_word(text[:-4]) == (i,)


def test_documents(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello  world's\n<|endoftext|>"), (3, "Hello  world's\n<|endoftext|>"), (None, "x"), (4, "word " * 50_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, ids string")
    for got, (doc_id, text) in zip(bpe.encode_documents(df, PATH).collect(), rows, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert (got.doc_id, got.ids, got.decoded) == (doc_id, want, library.decode(want, skip_special_tokens=False))
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_digest(own):
    n, ids, decoded = bpe.digest(own, [1, 22], "a b")
    assert (n, ids, decoded) == (2, hashlib.sha256(b"1 22").hexdigest(), hashlib.sha256(b"a b").hexdigest())


def changed(tmp_path, **parts):
    import json

    with open(PATH) as f:
        told = json.load(f)
    told |= parts
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    return str(path)


def test_other_rules(tmp_path):
    """A file that cuts in another way is cut by the library; what isn't supported is refused."""
    path = changed(tmp_path, normalizer=None, pre_tokenizer={"type": "Sequence", "pretokenizers": [{"type": "Whitespace"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
    library, own = Tokenizer.from_file(path), bpe.Encoder(bpe.load_rules(path))
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 20)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)
    with pytest.raises(ValueError):
        bpe.load_rules(changed(tmp_path, decoder={"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}))


def test_tabled_cut(own):
    """The cut with written-out classes is that of the regex module for whatever is in its tables."""
    for i in range(0x10000):
        c = chr(i)
        text = f"a{c}{c}b 1{c}'s-{c} '{c}"
        assert own.split_tabled(text) == own.split(text), hex(i)


HIGH = ["a", "é", " ", "1", "'s", "\U0001f389", "\U0001d400", "\U00010400", "\U0001d7d8", "\U00020000", "\ufacf", "\ufad5", "\u0378", "\u2fef", "\U0001fbff", "\U000e0080", "\U000f0000", "\ue000", "\u212a", "\u1fef"]


def test_high_and_unassigned(library, own):
    """Above the tables, unassigned, and what only the normal form has above them (\ufacf)."""
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice(HIGH) for _ in range(r.randint(1, 12)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, ascii(text)
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if bpe.unassigned(c):
            assert bpe.UNSURE.search(c) and bpe.RARE.search(c)
        else:
            assert not bpe.UNSURE.search(c) and bool(bpe.RARE.search(c)) == (i > 0xFFFF)


def test_full_caches(library, monkeypatch):
    """What is met again and again is encoded once, however often the cache is full; ids don't depend on the caches."""
    monkeypatch.setattr(bpe, "WORDS_CACHED", 8)
    monkeypatch.setattr(bpe, "PAIRS_CACHED", 5)
    own, asked = bpe.Encoder(bpe.load_rules(PATH)), []
    encode = own.words.encode
    own.words.encode = lambda word: asked.append(word) or encode(word)
    for i in range(200):
        text = f"hotword rare{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'xy'[i // 100]}"
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert asked.count("hotword") == 1 and len(asked) == 201
    assert len(own.words) + len(own.words.older) <= 8


def test_letters_beyond_ascii_cost_no_more(own):
    """They were looked up one by one in a list of hundreds of ranges, which took most of the time."""

    def seconds(text):
        spent = []
        for _ in range(5):
            start = time.process_time()
            own.encode(text)
            spent.append(time.process_time() - start)
        return min(spent)

    assert seconds("mámá tétel " * 20_000) < 2.5 * seconds("mama tetel " * 20_000)
