from __future__ import annotations

import hashlib

import numpy as np
import pytest

from orderflow.llm import suffix_dedup as sd


def brute(rows):
    """Every string of 50 bytes of every document against those of all smaller ids."""
    big = 2**63 - 1
    seen, out = set(), {}
    for i in sorted({big if j is None else j for j, _ in rows}):
        mine = [(k, (t or "").encode()) for k, (j, t) in enumerate(rows) if (big if j is None else j) == i]
        for k, b in mine:
            gone = bytearray(len(b))
            for p in range(len(b) - sd.LENGTH + 1):
                if b[p : p + sd.LENGTH] in seen:
                    gone[p : p + sd.LENGTH] = b"\1" * sd.LENGTH
            left = bytes(x for x, g in zip(b, gone) if not g)
            out[k] = (rows[k][0], len(b), sum(gone), sum(bool(g and (p == 0 or not gone[p - 1])) for p, g in enumerate(gone)), hashlib.sha256(left).hexdigest())
        for _, b in mine:
            seen.update(b[p : p + sd.LENGTH] for p in range(len(b) - sd.LENGTH + 1))
    return sorted(out.values(), key=str)


def found(df):
    return sorted((tuple(r) for r in sd.find_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("hot,block,shard", [(2000, 2 << 20, 8 << 20), (3, 4000, 9000)])
def test_equals_brute_force(docs, texts, monkeypatch, hot, block, shard):
    monkeypatch.setattr(sd, "HOT", hot), monkeypatch.setattr(sd, "BLOCK_BYTES", block), monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    assert found(docs) == brute(texts)


def test_empty_table(no_docs):
    assert found(no_docs) == []


def test_refinement_names_equal_strings_alike():
    rng = np.random.default_rng(1)
    contexts = rng.integers(97, 99, (40, sd.CONTEXT), dtype=np.uint8)
    contexts[7, 5:70] = contexts[3, 5:70]
    names = sd.refine(contexts)
    text = {(k, o): contexts[k, o : o + sd.LENGTH].tobytes() for k in range(40) for o in range(sd.CONTEXT - sd.LENGTH + 1)}
    by_name = {}
    for at, s in text.items():
        assert by_name.setdefault(int(names[at]), s) == s
    assert len(by_name) == len(set(text.values()))


def test_text_is_cut_at_whole_characters(docs):
    out = sd.remove_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert len(rows) == docs.count()
    assert sum(r.text is None for r in rows) == 2
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    text = "é" * 5
    assert sd.whole_characters(text.encode(), np.array([1]), np.array([7])).decode() == "ééé"
