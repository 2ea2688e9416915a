"""Different texts that a hash linear modulo 2**64 takes for one, very long texts, very long words."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from orderflow.llm import docstats, setsketch, suffix_dedup, textbytes as tb, token_count
from tests.llm.conftest import thue_morse
from tests.llm.test_near_duplicates import brute
from tests.llm.test_suffix_dedup import brute as brute_repeats, found


@pytest.mark.parametrize("n", [16, 1024, 4096])
def test_ranges_of_a_buffer(n):
    one, two = thue_morse(n)
    buf = np.frombuffer((one + two + one).encode(), np.uint8)
    at = np.array([0, n, 2 * n])
    a, b, c = tb.RangeHash(buf)(at, at + n)
    assert a == c != b


def test_equal_ranges_have_equal_hashes_wherever_they_lie():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 70))) for _ in range(400)]
    text = " ".join(words).encode()
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - np.array([len(w) for w in words])
    name = {}
    for w, h in zip(words, tb.RangeHash(np.frombuffer(text, np.uint8))(start, end).tolist()):
        assert name.setdefault(w, h) == h
    assert len(set(name.values())) == len(name)


def test_statistics_tell_lines_and_words_apart():
    one, two = thue_morse(2048)
    def stats(text):
        data = text.encode()
        s = docstats.stats_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return int(s["n_dup_lines"][0]), int(s["n_repeat_words"][0])
    assert stats(f"{one}\n{two}") == (0, 0) and stats(f"{one}\n{one}") == (1, 0)
    line = "a b c d"
    assert stats(f"{line} {one} {line} {two}")[1] == 0 and stats(f"{line} {one} {line} {one}")[1] == 10


def test_near_duplicates_tell_sets_apart(spark):
    one, two = thue_morse(1024)
    rows = [(1, one), (2, two), (3, one.upper()), (4, f"{one} x"), (5, f"{two} x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for near in (setsketch.Near(3, 85), setsketch.Near(5, 80)):
        got = sorted((tuple(r) for r in setsketch.near_duplicates(docs, near).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
        assert got == brute(rows, near)
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect()) == [1, 2, 4, 5]


@pytest.fixture(scope="module")
def long_rows():
    """A text of 300 KB, its near copy, a text of one word of 6,000 bytes and one that holds it."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(46_000))
    word = "".join(rng.choice("xyz") for _ in range(6000))
    assert len(text) > tb.SLICE_BYTES
    return [(1, text), (2, text + " more words"), (3, word), (4, "some " + word), (5, word[:5999] + "q"), (6, "short")]


def test_near_duplicates_of_long_texts(spark, long_rows):
    near = setsketch.Near(3, 85)
    out = setsketch.near_duplicates(spark.createDataFrame(long_rows, "doc_id long, text string"), near)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == brute(long_rows, near)


def test_suffix_dedup_of_long_texts_and_rows_without_an_id(spark, long_rows):
    rows = long_rows + [(None, long_rows[2][1])] * 2 + [(None, long_rows[0][1][:70_000]), (2, "short again, and again, and again, and again, and once more")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_statistics_and_token_counts_of_long_texts(spark, long_rows):
    docs = spark.createDataFrame(long_rows, "doc_id long, text string")
    got = {r.doc_id: r for r in docstats.document_stats(docs).collect()}
    for i, text in long_rows:
        words = text.split(" ")
        seen = {}
        for k in range(len(words) - 4):
            seen.setdefault(tuple(words[k : k + 5]), []).append(k)
        covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(str(path))
    counts = {r.doc_id: r.n_tokens for r in token_count.token_counts(docs, path).collect()}
    assert counts == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in long_rows}
