from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orderflow.llm import resample as rs, variants as va

LOWER = {c: c + 32 for c in range(65, 91)}


# -- spelling variants ----------------------------------------------------------------

def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, spelling):
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if spelling.damage and h % spelling.damage == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= spelling.least_chars and n >= spelling.least_count}
    form, near_n = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(v, w)]
        near_n[w] = len(around)
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= spelling.ratio * n else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), n, near_n[w], words.get(form[w])) for w, n in words.items()), key=str)


def spelled(spark, rows, spelling):
    docs = spark.createDataFrame([(i, t, "x", "x", 1) for i, t in rows], "doc_id long, text string, word string, prefix string, id long")
    return sorted((tuple(r) for r in va.variants(docs, spelling).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def variant_rows():
    rng = random.Random(5)
    bases = ["anbnbn", "aaaaaa", "aaaaaaa", "abcdefg", "ÀÉîöüÿ", "zzyyxx", "Mixture", "straße×÷", "mississippi"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(bases)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abnzÀé") + w[k + 1 :], w[:k] + rng.choice("abnzÀé") + w[k:]])
            words.append(w)
        rows.append((rng.choice([i, i, i, None, 7]), rng.choice([" ", "\n", "-1-"]).join(words)))
    return rows + [(900, None), (901, ""), (902, "× ☃ 12")]


@pytest.mark.parametrize("damage,least", [(199, 5), (3, 1), (0, 2)])
def test_variants_equal_brute_force(spark, damage, least):
    spelling = va.Spelling(least_count=least, damage=damage, ratio=2 if least < 5 else 5)
    rows = variant_rows()
    got = spelled(spark, rows, spelling)
    assert got == brute_variants(rows, spelling) and any(r[1] for r in got)


def test_variants_of_long_words_and_texts(spark, monkeypatch):
    monkeypatch.setattr(va, "SLICE_CHARS", 50)
    rng = random.Random(1)
    long = "".join(rng.choice("abc") for _ in range(6000))
    rows = [(1, " ".join([long] * 12)), (2, " ".join([long[:3000] + "q" + long[3000:]] * 2 + [long[:-1]] * 2)), (3, long[:3000] + "b" + long[3001:])]
    for size in (62, 63, 64, 65, 66):       # around the length from which prefixes are hashed
        w = long[:size]
        rows += [(4, " ".join([w] * 3)), (5, " ".join([w[1:], w[:-1] + "z", "z" + w[1:], w[:30] + w[31:]]))]
    spelling = va.Spelling(least_count=1, ratio=3, damage=0)
    assert spelled(spark, rows, spelling) == brute_variants(rows, spelling)


def test_variants_follow_chains(spark):
    chain = ["abcdef", "abcdeg", "abcdhg", "abczhg", "abyzhg", "axyzhg"]
    rows = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(2**k)))]
    got = {r[0]: r[2] for r in spelled(spark, rows, va.Spelling(least_count=1, ratio=2, damage=0))}
    assert set(got.values()) == {"axyzhg"} and len(got) == 6


def test_variants_of_nothing(spark):
    assert spelled(spark, [(1, None)], va.Spelling()) == []
    assert va.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# -- resampling ---------------------------------------------------------------------

def brute_resample(rows, target, draw):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % draw.buckets for k in range(1, draw.ngrams + 1) for i in range(len(w) - k + 1)]
    docs = [(i, *grams(t)) for i, t in rows]
    s, t = Counter(b for _, _, g in docs for b in g), Counter(b for x in target for b in grams(x)[1])
    S, T, B = sum(s.values()), sum(t.values()), draw.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + B) / ((s[b] + 1) * (T + B))))
    out = []
    for i, words, g in docs:
        w = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((k for k, r in enumerate(out) if r[1] >= draw.least_words), key=lambda k: (-out[k][4], out[k][0] is None, out[k][0] or 0, -out[k][2], k))
    rank = {k: n + 1 for n, k in enumerate(able[: len(able) * draw.percent // 100])}
    return sorted(((r[0], *r[2:], rank.get(k)) for k, r in enumerate(out)), key=str)


def drawn(spark, docs, target, draw):
    t = spark.createDataFrame([(x, "x") for x in target], "text string, bucket string")
    return sorted((tuple(r) for r in rs.resample(docs, t, draw).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


TARGET = ["alta berren conus", None, "", "dréta dréren changed 42 " * 9, "☃日本語"]


@pytest.mark.parametrize("draw", [rs.Draw(), rs.Draw(ngrams=2, percent=50, buckets=97), rs.Draw(least_words=0, percent=100), rs.Draw(percent=0)])
def test_resample_equals_brute_force(spark, docs, texts, draw):
    assert drawn(spark, docs, TARGET, draw) == brute_resample(texts, TARGET, draw)


def test_resample_with_a_third_of_the_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(rs, "PIVOTS", 2)
    rows = [(i, f"w{i % 7} " * 25) for i in range(200)] + [(None, "same words " * 12)] * 60 + [(5, "same words " * 12)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert drawn(spark, docs, TARGET, rs.Draw(percent=40)) == brute_resample(rows, TARGET, rs.Draw(percent=40))


def test_resample_of_nothing(spark, no_docs):
    assert drawn(spark, no_docs, TARGET, rs.Draw()) == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert drawn(spark, one, [], rs.Draw()) == brute_resample([(1, "a b")], [], rs.Draw())


def test_crc_of_ranges():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.integers(0, 200, 300)
    assert rs.crc32(buf, start, end).tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(start, end)]
