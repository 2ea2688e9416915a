from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from orderflow.llm import docstats as ds
from orderflow.llm import quality_gbt as q
from orderflow.llm import rule_ensemble as rules
from orderflow.llm import trees
from orderflow.sources.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_statistics_equal_brute_force(texts):
    more = [t for _, t in texts] + ["a b c d e a b c d e f", "\n\nx\nx\n\n x\nx", "# | <b> *", "é é é é é é é"]
    got = ds.batch_stats(pa.array(more, pa.string()))
    assert [tuple(int(got[c][i]) for c in ds.BASE) for i in range(len(more))] == [base(t) for t in more]


def test_monotone_trees_keep_their_order():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 3))
    y = ((x[:, 0] + 0.4 * rng.random(1500) + 0.3 * np.sin(9 * x[:, 0]) < 0.8)).astype(int)
    model = trees.boost(x, y, monotone={0: -1})
    probe = np.repeat(rng.random((40, 3)), 60, 0)
    probe[:, 0] = np.tile(np.linspace(0, 1, 60), 40)
    assert (np.diff(model.score(probe).reshape(40, 60)) <= 1e-9).all()
    free = trees.boost(x, y).score(probe).reshape(40, 60)
    assert (np.diff(free) > 1e-9).any()


def test_op10_verdicts(spark, docs, texts, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = q.assess(docs, q.fit(docs, labels)).collect()
    assert sorted(((r.doc_id, *(r[c] for c in ds.BASE)) for r in got), key=str) == sorted(((i, *base(t)) for i, t in texts), key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    alone = q.assess(docs, q.fit(docs, labels.limit(0))).collect()      # without labels the base rules decide
    assert all(r.kept != r.base_failed for r in alone)
    assert q.assess(no_docs, q.fit(no_docs, labels)).count() == 0
    assert q.keep_good(docs, q.fit(docs, labels)).columns == docs.columns


def test_compiled_rules_equal_the_matrix(spark, docs):
    stats = ds.document_stats(docs).toPandas()
    x = stats[list(ds.FEATURES)].to_numpy(float)
    model = rules.fit_sample(x, (x[:, 1] > 4).astype(int))
    assert model.rules
    got = ds.document_stats(docs).select(model.column().alias("s"), *ds.FEATURES).toPandas()
    z = rules.rule_matrix(got[list(ds.FEATURES)].to_numpy(float), [r for _, r in model.rules])
    want = 1 / (1 + np.exp(-(model.bias + z @ np.array([w for w, _ in model.rules]))))
    assert np.allclose(got["s"], want)


def test_op3_edges(spark, docs, no_docs, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rules.score(docs, rules.fit(docs, labels)).collect()
    assert len(got) == len(texts) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    import zlib
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert rules.score(no_docs, rules.fit(no_docs, labels)).count() == 0


def test_held_out_accuracy(spark):
    """Both models tell labelled junk from clean text on rows they have not seen."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = rules.score(docs, rules.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) >= 0.95
    learned = q.fit(docs, labels.filter("doc_id % 2 = 0"))
    judged = q.assess(docs, learned).join(labels, "doc_id").filter("doc_id % 2 = 1 AND NOT base_failed").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in judged]) >= 0.95


def test_node_arrays_equal_a_plain_walk():
    """Recursive descent, row by row, gives what the gathers over the node arrays give; leaves are reached,
    values on a threshold go left, and a constrained feature never raises the score."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(float)
    nodes = trees.boost(x, y, rounds=12, depth=4, monotone={1: -1})

    def walk(k, row, steps=0):
        if nodes.left[k] == k:
            return nodes.value[k], steps
        return walk(nodes.left[k] if row[nodes.feature[k]] <= nodes.threshold[k] else nodes.right[k], row, steps + 1)

    on_cut = x[: len(nodes.threshold)].copy()
    on_cut[:, nodes.feature[0]] = nodes.threshold[0]
    rows = np.concatenate([x, on_cut, rng.normal(size=(100, 4)) * 50])
    want = []
    for row in rows:
        found = [walk(r, row) for r in nodes.roots]
        assert max(s for _, s in found) <= nodes.depth
        want.append(nodes.base + sum(v for v, _ in found))
    assert len(nodes.roots) == 12 and len(set(want)) > 20
    assert np.allclose(nodes.margin(rows), want, rtol=0, atol=1e-12)

    risen = rows.copy()
    risen[:, 1] += 1.5
    assert (nodes.margin(risen) <= nodes.margin(rows) + 1e-12).all()
