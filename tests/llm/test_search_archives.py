from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from orderflow.llm import pivot_search as ps
from orderflow.llm import warc


def brute_top(vectors, k=5):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in usable if i % 50 == 0}:
        score = sorted((-sum(a * b for a, b in zip(mine, v)), c) for i, mine in usable if i == q for c, v in usable if c != q)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(score[:k])]
    return sorted(out)


def top(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, rank int, v int")
    whole = ps.integer_vectors(df)
    return sorted(tuple(r) for r in ps.top_k(whole, whole.filter("vec_id % 50 = 0")).collect())


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(400)]
    vectors += [(500 + i, vectors[7][1]) for i in range(30)] + [(600, [0.0] * 12), (650, None), (700, [float("nan")] * 12), (750, [None] * 12), (800, [float("inf")] * 12),
                (None, [1.0] * 12), (850, [1.0, 2.0]), (900, []), (50, [9.0] * 12)]
    assert top(spark, vectors) == brute_top(vectors)
    monkeypatch.setattr(ps, "VECTOR_BLOCK", 64), monkeypatch.setattr(ps, "QUERY_BLOCK", 3), monkeypatch.setattr(ps, "_FIRST", 8)
    assert top(spark, vectors) == brute_top(vectors)


def test_rows_of_one_id_equal_the_sql(spark, tmp_path):
    import duckdb
    from orderflow.llm.registry import OP2_SQL, QUERIES
    rng = random.Random(6)
    rows = [(rng.choice([0, 1, 2, 3, 50, 51]), [float(rng.randint(-3, 3)), float(rng.randint(-3, 3))]) for _ in range(40)] + [(1, [5.0, 0.0]), (1, [1.0, 0.0]), (50, [1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in QUERIES["op2_exact_top_k"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({OP2_SQL})").fetchall())


def test_top_k_of_few_and_none(spark):
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [1.0, 0.0])]
    assert top(spark, few) == brute_top(few)
    assert top(spark, []) == [] and top(spark, [(1, [1.0])]) == []


def pages():
    rng = random.Random(9)
    body = lambda n: "".join(rng.choice("<p>abc é\n\r") for _ in range(n))
    same, large = body(300), body(200_000)
    rows = [(i, f"http://h{i}/a b", body(rng.randint(0, 500))) for i in range(60)]
    rows += [(70, "u", same), (65, "u", same), (90, None, same), (65, "v", same), (71, "u", "short"), (72, "u", "short"), (73, "u", None), (74, "u", ""),
             (75, "x\r\nEvil: 1", large), (76, "u", large), (None, "u", same), (None, "u", body(150)), (77, "u", "é" * 50), (78, "u", "é" * 50)]
    return rows


def test_archives_give_back_every_page(spark, tmp_path, monkeypatch):
    rows = pages()
    df = spark.createDataFrame([(*r, "d", "p") for r in rows], "page_id long, url string, html string, digest string, payload string")
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h in first and i != first[h]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    for k, size in enumerate((64 << 20, 20_000)):
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", size), monkeypatch.setattr(warc, "SAMPLE_BYTES", size // 4)
        folder = str(tmp_path / str(k))
        manifest = warc.write_archives(warc.record_plan(df), folder)
        back = warc.read_archives(manifest, folder).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == sorted(want, key=str)
        assert sorted(bytes(r.payload) for r in back if r.payload is not None) == sorted((h or "").encode() for (_, _, h), w in zip(rows, want) if w[3] == "response")
        # the standard framing: a skippable dictionary frame, then frames that need it
        path = manifest.first().path
        with open(path, "rb") as f:
            assert f.read(4) == b"\x5d\x2a\x4d\x18"
    none = warc.write_archives(warc.record_plan(df.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(none, str(tmp_path / "none")).collect() == []
