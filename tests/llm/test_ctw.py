from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from orderflow.llm import ctw

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


class Tree:
    """Context-tree weighting, said plainly: a recursion over contexts for each node of the byte tree."""

    def __init__(self, streams, depth):
        self.depth, self.count, self.longer = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for line in streams:
            for i in range(depth, len(line)):
                for node, bit in self.bits(line[i]):
                    for d in range(depth + 1):
                        self.count[line[i - d : i], node][bit] += 1
                        if d < depth:
                            self.longer[line[i - d : i], node].add(line[i - d - 1 : i])
        self.kept = {}

    @staticmethod
    def bits(byte):
        return [((1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1) for j in range(8)]

    def own(self, context, node):
        z, o = self.count[context, node]
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def rest(self, context, node):
        return sum(self.weighted(c, node) for c in self.longer[context, node])

    def weighted(self, context, node):
        if (context, node) not in self.kept:
            own = self.own(context, node)
            if len(context) < self.depth:
                rest = self.rest(context, node)
                top = max(own, rest)
                own = top + math.log((math.exp(own - top) + math.exp(rest - top)) / 2)
            self.kept[context, node] = own
        return self.kept[context, node]

    def chance(self, context, node, bit, d=0):
        here = context[len(context) - d :]
        z, o = self.count[here, node] if (here, node) in self.count else (0, 0)
        p = ((z, o)[bit] + 0.5) / (z + o + 1)
        if d == self.depth or (context[len(context) - d - 1 :], node) not in self.count:
            return p
        beta = math.exp(min(self.own(here, node) - self.rest(here, node), 500))
        return (beta * p + self.chance(context, node, bit, d + 1)) / (beta + 1)

    def score(self, line):
        times = Counter(line[i - self.depth : i + 1] for i in range(self.depth, len(line)))
        return sum(n * math.log10(self.chance(g[:-1], node, bit)) for g, n in times.items() for node, bit in self.bits(g[-1]))


def brute(rows, model):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % model.folds == 0
    words = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    lines = [b"\n" * model.depth + b"".join(w.encode() + b" " for w in ws) + b"\n" for ws in words]
    tree = Tree([x for x, (i, _) in zip(lines, rows) if not held(i)], model.depth)
    count = Counter(w for ws, (i, _) in zip(words, rows) if not held(i) for w in [*ws, "\n"])
    n, v = sum(count.values()), len(count)
    out = []
    for (i, _), ws, line in zip(rows, words, lines):
        tokens = [*ws, "\n"]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, held(i), len(tokens), sum(count[w] > 0 for w in tokens), n, base, tree.score(line), len(line) - model.depth))
    return out


def scored(docs, model):
    return [tuple(r) for r in ctw.score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes").collect()]


def alike(got, wanted):
    key = lambda r: (str(r[:5]), r[7], round(r[6], 3))
    got, wanted = sorted(got, key=key), sorted(wanted, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in wanted] and [r[7] for r in got] == [r[7] for r in wanted]
    for a, b in zip(got, wanted):
        assert a[5:7] == pytest.approx(b[5:7], rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("model", [ctw.Model(), ctw.Model(depth=2, split=1, folds=3, block_bytes=2000), ctw.Model(depth=1, split=0, block_bytes=5000), ctw.Model(depth=7, split=7, folds=2)])
def test_equals_brute_force(docs, texts, monkeypatch, model):
    monkeypatch.setattr(ctw, "SLICE", 3000)
    monkeypatch.setattr(ctw, "ROWS", 500)
    alike(scored(docs, model), brute(texts, model))


def test_bytes_are_a_distribution(texts):
    tree = Tree([b"\n\n\n" + (t or "").encode() for _, t in texts[:20]], 3)
    for context in (b"\n\n\n", b"al ", b"zzz"):
        assert sum(math.prod(tree.chance(context, *x) for x in tree.bits(b)) for b in range(256)) == pytest.approx(1)


def test_without_training_documents(spark, no_docs):
    assert scored(no_docs, ctw.Model()) == []
    rows = [(None, None), (None, "ab c")]       # ids that are null are held out
    got = scored(spark.createDataFrame(rows, "doc_id long, text string"), ctw.Model())
    assert sorted(r[1:6] for r in got) == [(True, 1, 0, 0, 0.0), (True, 3, 0, 0, 0.0)]
    alike(got, [(None, True, 1, 0, 0, 0.0, 8 * math.log10(0.5), 1), (None, True, 3, 0, 0, 0.0, 48 * math.log10(0.5), 6)])


def test_very_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(ctw, "SLICE", 30_000)
    rows = [(1, "Long " * 16_000), (2, "x" * 60_000), (3, "long x"), (4, "x" * 6000 + " long"), (20, "y")]
    got = {r[0]: r for r in scored(spark.createDataFrame(rows, "doc_id long, text string"), ctw.Model())}
    assert got[1][2] == 16_001 and got[2][2] == 2 and got[1][7] == 80_001
    alike(list(got.values()), brute(rows, ctw.Model()))


def test_held_out_code_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = ctw.score(docs).filter("held_out").groupBy().agg({"score": "sum", "base_score": "sum", "bits_per_byte": "avg"}).first()
    assert out["sum(score)"] > out["sum(base_score)"] and out["avg(bits_per_byte)"] < 3.5
