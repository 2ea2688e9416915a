"""Exact top-k inner-product search by pivot-table elimination.

Vectors become integers, ``floor(256 * x)``. With one more coordinate all of
them have the same length, and a larger inner product is a smaller distance.
Distances of every vector to a table of pivots are computed once; by the
triangle inequality the largest difference of two rows of that table bounds the
distance from below, and so the inner product from above. Candidates are
scored in the order of their bounds until the next bound is below the k-th
score: the result is exact.

Queries and vectors meet in blocks: every block of queries with every block of
vectors, and only the k best of each pair of blocks go on.

Defined cases: rows without an id or vector, or with a null, NaN or infinite
component, take no part; shorter vectors are filled with zeros; rows that share an
id are candidates each, but not of one another, and queries of one id have one list
of best; ties go to the smaller id. Scores must stay below 2**63.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.session import cut_lineage

K = 5
SCALE = 256
PIVOTS, PIVOT_SAMPLE = 24, 1024     # pivots come from this bounded sample of smallest id hashes
VECTOR_BLOCK, QUERY_BLOCK = 8192, 1024
_TILE, _FIRST = 32, 64


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): usable rows, components as longs."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    rows = rows.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))


def choose_pivots(points: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first pivots of a sample."""
    chosen = [0]
    gap = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(n, len(points)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def lifted(v: np.ndarray, longest2: float) -> np.ndarray:
    """Vectors with the coordinate that gives all the length sqrt(longest2)."""
    return np.concatenate([v, np.sqrt(np.maximum(longest2 - (v * v).sum(1), 0))[:, None]], 1)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of_block(ids: np.ndarray, v: np.ndarray, to_pivots: np.ndarray, query_ids: np.ndarray, q: np.ndarray,
                  pivots: np.ndarray, longest2: float, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query of a block: (query ids, ids, scores) of its k best in a block of vectors."""
    # Doubles hold the products exactly up to 2**53; beyond that, integers.
    exact = np.float64 if longest2 < 2.0**52 else np.int64
    v, out = v.astype(exact), []
    norm2 = (q.astype(float) ** 2).sum(1)
    zero = np.concatenate([q.astype(float), np.zeros((len(q), 1))], 1)
    from_query = np.sqrt(np.maximum(((zero[:, None, :] - pivots[None]) ** 2).sum(2), 0)) if len(pivots) else np.zeros((len(q), 0))
    slack = 1e-6 * (1 + longest2**0.5)
    for a in range(0, len(q), _TILE):
        low = np.zeros((min(_TILE, len(q) - a), len(v)))
        for p in range(len(pivots)):
            np.maximum(low, np.abs(from_query[a : a + _TILE, p, None] - to_pivots[None, :, p]), out=low)
        bound = (longest2 + norm2[a : a + _TILE, None] - np.maximum(low - slack, 0) ** 2) / 2 + slack * longest2**0.5
        for i in range(len(bound)):
            upper, query = bound[i], q[a + i].astype(exact)
            own = ids == query_ids[a + i]
            upper[own] = -np.inf
            alive = len(v) - int(own.sum())
            if not alive:
                continue
            first = np.argpartition(-upper, min(_FIRST, len(v) - 1))[: min(_FIRST, alive)]
            first = first[~own[first]]
            taken, score = first, v[first] @ query
            if alive > len(first):
                least = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
                rest = upper >= least
                rest[first] = False
                rest[own] = False
                rest = np.flatnonzero(rest)
                rest = rest[np.argsort(-upper[rest])]
                size = 4 * _FIRST
                while len(rest):
                    some, rest = rest[:size], rest[size:]
                    taken, score = np.concatenate([taken, some]), np.concatenate([score, v[some] @ query])
                    size *= 2
                    if len(score) >= k:
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        better = score >= least
                        taken, score = taken[better], score[better]
                        rest = rest[: np.searchsorted(-upper[rest], -least, "right")]
            order = np.lexsort((ids[taken], -score))[:k]
            out.append((np.full(len(order), query_ids[a + i]), ids[taken[order]], score[order].astype(np.int64)))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for integer vectors (vec_id, v) of ``integer_vectors``;
    rows with a query's id are no candidates of it."""
    vectors = cut_lineage(vectors)
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    facts = vectors.agg(F.count("*").alias("n"), F.max(norm2).alias("longest2"), F.max(F.size("v")).alias("dims")).first()
    asked = queries.count()
    schema = "query_id long, vec_id long, score long"
    if not facts.n or not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, longest2 = max(int(facts.dims), 1), float(facts.longest2)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).collect()
    points = np.array([list(r.v) + [0] * (dims - len(r.v)) for r in sample], float)
    pivots = choose_pivots(lifted(points, longest2))

    def measure(batches):
        for b in batches:
            far = lifted(_matrix(pa.chunked_array([b.column(1)]), dims).astype(float), longest2)
            table = np.sqrt(np.maximum(((far[:, None, :] - pivots[None]) ** 2).sum(2), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(b) + 1) * len(pivots), len(pivots), dtype=np.int32)), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["vec_id", "v", "far"])

    v_blocks, q_blocks = -(-facts.n // VECTOR_BLOCK), -(-asked // QUERY_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    table = vectors.mapInArrow(measure, "vec_id long, v array<long>, far array<double>")
    left = table.withColumn("v_block", block(v_blocks)).withColumn("q_block", every(q_blocks))
    right = queries.select("vec_id", "v").withColumn("q_block", block(q_blocks)).withColumn("v_block", every(v_blocks))

    def search(vs: pa.Table, qs: pa.Table) -> pa.Table:
        found = []
        if len(vs) and len(qs):
            far = vs.column("far").combine_chunks().flatten().to_numpy().reshape(len(vs), -1)
            found = best_of_block(vs.column("vec_id").to_numpy(), _matrix(vs.column("v"), dims), far,
                                  qs.column("vec_id").to_numpy(), _matrix(qs.column("v"), dims), pivots, longest2, k)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    best = left.groupBy("v_block", "q_block").cogroup(right.groupBy("v_block", "q_block")).applyInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
