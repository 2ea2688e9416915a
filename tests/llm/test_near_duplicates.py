from __future__ import annotations

import re

import numpy as np
import pytest

from orderflow.llm import setsketch as ss

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(texts, k):
    low = {c: c + 32 for c in range(65, 91)}
    out = []
    for _, t in texts:
        w = WORD.findall((t or "").translate(low))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    return out


def brute(texts, near):
    sets, ids = sets_of(texts, near.words), sorted({i for i, _ in texts if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(texts):
        for b, (j, _) in enumerate(texts[:a]):
            both = len(sets[a] & sets[b])
            if i is not None and j is not None and both and 100 * both >= near.percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for (i, _), s in zip(texts, sets)), key=str)


@pytest.mark.parametrize("near,chunk", [(ss.Near(3, 85), 512), (ss.Near(5, 80), 2)])
def test_equals_brute_force(docs, texts, monkeypatch, near, chunk):
    monkeypatch.setattr(ss, "CHUNK", chunk)
    got = sorted((tuple(r) for r in ss.near_duplicates(docs, near).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == brute(texts, near)


def test_empty_table(no_docs):
    assert ss.near_duplicates(no_docs).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    near = ss.Near(3, 85)
    union = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    a, b = union[:3600], union[400:]          # similarity 0.8
    row = lambda *parts: np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    s = ss.sketches(row(a, b, union), np.concatenate([a, b, union]), np.array([len(a), len(b), len(union)]), near.registers)
    assert (np.maximum(s[0], s[1]) == s[2]).all()
    greater, equal = (s[0] > s[1]).sum(), (s[0] == s[1]).sum()
    estimate, likely = ss.likelihood(np.array([greater]), np.array([near.registers - greater - equal]), near.registers, np.array([len(a)]), np.array([len(b)]), 0.85)
    assert abs(estimate[0] - 0.8) < 0.12 and likely[0]


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100 + i, 100) for i in range(1, 9)] + [(7, 200)]
    got = {r.node: r.part for r in ss.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(9)}, 200: 0}
