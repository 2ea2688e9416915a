from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from orderflow.llm import mixing, ring


def test_place_fills_every_shard_and_goes_clockwise():
    owner, counts, capacity = [0, 1, 2, 1], [5, 0, 1, 3], [3, 3, 3]
    out = ring.place(counts, owner, capacity)
    rows = defaultdict(list)
    for arc, first, last, shard, base in out:
        for r in range(first, last + 1):
            rows[shard].append((base + r - first, arc, r))
    assert all(sorted(s for s, _, _ in v) == list(range(3)) for v in rows.values())
    assert sorted((a, r) for v in rows.values() for _, a, r in v) == sorted((a, r) for a, n in enumerate(counts) for r in range(n))
    # arc 0 overflows its shard by two rows: the next point's shard is full of its own rows, the one after has room
    assert [p for p in out if p[0] == 0] == [(0, 0, 2, 0, 0), (0, 3, 4, 2, 1)]


@pytest.mark.parametrize("shards", [40, 3])
def test_shards_differ_by_one_row(docs, texts, no_docs, shards):
    rows = ring.shard(docs, shards).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in texts), key=str)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(shards)) and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert ring.shard(no_docs, shards).collect() == []


def test_another_shard_moves_few_rows(spark):
    many = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    before = {r.doc_id: r["shard"] for r in ring.shard(many, 40).collect()}
    after = {r.doc_id: r["shard"] for r in ring.shard(many, 41).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.15 * len(before)


def corpus(spark):
    rows = [(i, "w " * 20, "big") for i in range(600)] + [(1000 + i, "w " * (5 + i % 3), "mid") for i in range(300)] + [(2000 + i, "w " * 7, "small") for i in range(90)]
    rows += [(3000 + i, None if i % 2 else "", "blank") for i in range(5)] + [(4000 + i, "w w", None) for i in range(50)] + [(4001, "w w", None)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, blocks int, tokens int"), rows


@pytest.mark.parametrize("limit,block", [(1.5, 1024), (3.0, 16)])
def test_repetition_limit(spark, monkeypatch, limit, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    docs, rows = corpus(spark)
    out = mixing.mix(docs, repeat_limit=limit).collect()
    have, read, ids = Counter(), Counter(), defaultdict(Counter)
    for i, t, s in rows:
        have[s] += len(re.findall(r"\S+", t or ""))
    for r in out:
        read[r.source] += r.mix_tokens
        ids[r.source][r.doc_id] += 1
    passes = {s: read[s] / have[s] for s in have if have[s]}
    assert max(passes.values()) <= limit + 1e-9 and max(passes.values()) > limit - 0.1 and min(passes.values()) == 1.0
    for s in have:     # every document at least once, none more often than the passes begun
        assert set(ids[s]) == {i for i, _, x in rows if x == s}
    # the weights are those of one exponent: ln(passes) is linear in ln(tokens)
    a, b, c = (math.log(passes[s]) for s in ("big", "mid", "small"))
    x, y, z = (math.log(have[s]) for s in ("big", "mid", "small"))
    assert abs((c - a) / (z - x) - (b - a) / (y - x)) < 0.05
    assert all(0 <= r.mix_position <= 1 for r in out)


def test_wordless_documents_are_read(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = [(i, None if i % 3 == 0 else " " * (i % 3 - 1), "thin") for i in range(300)] + [(300, "one two three", "thin")]
    rows += [(1000 + i, "four five six seven", "full") for i in range(50)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    whole = [r for r in out if r.mix_pass == 0]
    assert sorted(r.doc_id for r in whole) == [i for i, _, _ in rows]


def test_budget_and_entropy(spark, no_docs):
    docs, rows = corpus(spark)
    out = mixing.mix(docs, repeat_limit=None, entropy_share=0.9, budget=4000).collect()
    read = Counter()
    for r in out:
        read[r.source] += r.mix_tokens
    total = sum(read.values())
    assert 4000 - 4 * 20 <= total <= 4000 + 4
    shares = [v / total for v in read.values() if v]
    assert -sum(p * math.log(p) for p in shares) >= 0.9 * math.log(4) - 0.03
    assert mixing.mix(no_docs).collect() == []


def test_no_python_in_the_plans(docs):
    for df in (ring.shard(docs), mixing.mix(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
