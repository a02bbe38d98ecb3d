"""Hashes of words: no structured collisions, the same in stretches, little memory."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from formweave.llm import hashing, ngram_join, substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_thue_morse_words_differ(n):
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    hashes, _ = hashing.hash_words([one.encode(), other.encode()])
    assert hashes[0] != hashes[1]


def test_unlike_texts_of_such_words_are_apart(spark):
    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    docs = spark.createDataFrame([(1, " ".join([one] * 60)), (2, " ".join([other] * 60)), (3, f"{other} x")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs, 3, 90, 100).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("stretch", [1 << 20, 1000, 17])
def test_equal_words_and_only_they_have_equal_hashes(monkeypatch, stretch):
    monkeypatch.setattr(hashing, "STRETCH", stretch)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é\n\t") for _ in range(rng.randrange(400))).encode() for _ in range(60)] + [b"", b" ", b"x" * 3000, b"x" * 3000 + b" y"]
    for lower in (False, True):
        hashes, offsets = hashing.hash_words(texts, lower)
        words = [w.lower() if lower else w for t in texts for w in WORD.findall(t)]
        assert len(hashes) == len(words) and len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
        assert np.diff(offsets).tolist() == [len(WORD.findall(t)) for t in texts]
    assert [len(x) for x in hashing.hash_words([])] == [0, 1]


def test_memory_of_a_long_text():
    text = b"some words of a long text " * (24 << 20 >> 5)
    tracemalloc.start()
    hashes, _ = hashing.hash_words([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the text, its words' hashes and starts twice, and a stretch
    assert peak < len(text) * 2 + len(hashes) * 40 + (200 << 20)
