from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as cp
from orderflow.llm import quality_gbt, setsketch


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's input and output on the smallest tables."""
    sf, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        result = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, result))
        docs = result
    return out


def test_stages_keep_the_columns(steps):
    assert len(cp.STAGES) == 5
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_decisions_take_effect(spark, steps):
    (raw, good), (_, one), (_, cut), (_, mixed), (_, ids) = steps
    judged = quality_gbt.assess(raw, quality_gbt.fit(raw, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in judged.filter("kept").collect())
    from tests.llm.test_near_duplicates import brute
    near = setsketch.Near(5, 80)
    kept = [i for i, _, _, k in brute([(r.doc_id, r.text) for r in good.collect()], near) if k]
    assert sorted(r.doc_id for r in one.collect()) == sorted(kept)
    assert sorted(r.doc_id for r in cut.collect()) == sorted(kept)
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) == set(kept) and set(times.values()) <= {1, 2}
    assert Counter(r.doc_id for r in ids.collect()) == times and all(r.round_trip for r in ids.collect())


def test_repeated_rows_and_null_ids(spark, docs):
    out = cp.near_dedup(spark, docs, "")
    ids = Counter(r.doc_id for r in out.collect())
    assert all(n == 1 for i, n in ids.items() if i is not None) and ids[None] == 2
    assert out.columns == docs.columns


def test_texts_of_a_repeated_id_are_decided_by_themselves(spark):
    words = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, words("a")), (2, words("a") + " more"), (2, words("b")), (2, words("b")), (3, words("c")), (3, words("d")), (3, words("c") + " more")]
    out = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    # one row of each of the four families, with a text of its own
    assert sorted((r.doc_id, r.text[0]) for r in out) == [(1, "a"), (2, "b"), (3, "c"), (3, "d")]
    assert all((r.doc_id, r.text) in rows for r in out)
