"""Importance resampling towards a target distribution.

1. Features (runs of 1 to ``ngrams`` words) of the raw and of the target table are counted
   into hashed buckets: each task keeps one array of ``buckets`` counts, so what it sends has
   a fixed size whatever it reads. The gains of the buckets form an array of that size.
2. A second map over the texts scores each document: the floored mean of its features' gains
   (the weight), plus Gumbel noise that depends only on the document's id. The largest
   scores are then a draw without replacement in proportion to the weights.
3. Distributed quickselect finds the key of the last drawn document: a few random pivot keys,
   exact counts of the keys below each, and only the keys between two neighbouring pivots go
   on. The composite key (score, doc_id, features, row) is unique, so ties need no care and a
   third of all rows under one score or one id is split like any other rows.
4. Only the drawn documents are sorted and ranked.

Defined cases: a null text is empty and has no features and weight 0; documents of fewer than
``least_words`` words are scored but never drawn; a null id hashes like an empty one and comes
after all ids; rows of one id are documents of their own, drawn alike; an empty target leaves
gains of the raw counts alone. Texts are read whole, in slices of bounded size; other columns
of the tables are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm import textbytes as tb
from orderflow.operators.ranking import global_position
from orderflow.session import cut_lineage


@dataclass(frozen=True)
class Draw:
    """Parameters of a draw."""

    ngrams: int = 1          # longest run of words that is a feature
    buckets: int = 10_000
    least_words: int = 20    # documents of fewer words are not drawn
    percent: int = 10        # of the others
    seed: int = 2024
    scale: int = 1000        # gains and noise are whole multiples of 1/scale


# Words are runs of digits, lower-case letters and everything beyond ASCII.
IN_WORD = np.ones(256, bool)
IN_WORD[:128] = False
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = True

LONG = 64                    # bytes; longer features are hashed one by one
PIVOTS = 15


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc32(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of byte ranges, one byte of all ranges at a time."""
    length = end - start
    order = np.argsort(-np.minimum(length, LONG + 1), kind="stable")
    size, at = length[order], start[order]
    longer = int(np.searchsorted(-size, -LONG, "left"))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[longer]) if longer < len(size) else 0):
        n = int(np.searchsorted(-size[longer:], -k, "left")) + longer
        part = crc[longer:n]
        crc[longer:n] = CRC[(part ^ buf[at[longer:n] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in order[:longer]:
        out[i] = zlib.crc32(buf[start[i] : end[i]].tobytes())
    return out


def features(buf: np.ndarray, offsets: np.ndarray, draw: Draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; text and bucket of every feature)."""
    low, rows = tb.LOWER[buf], len(offsets) - 1
    inside = IN_WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(low) else inside
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(low) else inside
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    # Words of one text, one space between them.
    keep = inside | before
    place = np.concatenate([[0], np.cumsum(keep)])
    line = np.where(inside, low, np.uint8(0x20))[keep]
    start, end = place[start], place[end]
    who, bucket = [row], [crc32(line, start, end)]
    for k in range(1, draw.ngrams):
        at = np.flatnonzero(row[: max(len(row) - k, 0)] == row[k:])
        who.append(row[at])
        bucket.append(crc32(line, start[at], end[at + k]))
    return np.bincount(row, minlength=rows), np.concatenate(who), (np.concatenate(bucket) % np.uint32(draw.buckets)).astype(np.int64)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = tb.text_buffer(column)
    for a, b in tb.slices(buf, offsets):
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def bucket_counts(table: DataFrame, draw: Draw, text_col: str = "text") -> np.ndarray:
    """Features of a table in each bucket. At most ``buckets`` rows a task, and to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for batch in batches:
            for _, _, buf, offsets in _slices(batch.column(0)):
                total += np.bincount(features(buf, offsets, draw)[2], minlength=draw.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = table.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(draw.buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int) -> np.ndarray:
    """Whole gains of the buckets: the scaled log ratio of smoothed shares, rounded down."""
    s, t, n = raw.astype(float), target.astype(float), float(len(raw))
    return np.floor(scale * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, draw: Draw, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in _slices(batch.column(1)):
                words, row, bucket = features(buf, offsets, draw)
                n = np.bincount(row, minlength=b - a)
                total = np.zeros(b - a, np.int64)
                np.add.at(total, row, gain[bucket])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (words, n, total // np.maximum(n, 1)))],
                    names=["doc_id", "n_words", "n_features", "weight"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long"))


def noise(doc_id: Column, draw: Draw) -> Column:
    """Scaled Gumbel noise of an id, rounded down."""
    key = F.concat(F.lit(f"{draw.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-draw.scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def composite_key() -> Column:
    """Ascending key: largest score first, then smaller ids, rows without an id last; unique."""
    return F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().cast("long").alias("b"),
                    F.coalesce("doc_id", F.lit(0)).alias("c"), (-F.col("n_features")).alias("d"), F.col("__row").alias("e"))


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS, seed: int = 7) -> tuple[int, ...]:
    """The ``k``-th smallest (from 1) of the unique ``composite_key`` of ``rows``: quickselect with
    ``pivots`` random pivots a round. At most that many keys and counts come to the driver."""
    rest, below = rows.select(composite_key().alias("key")), 0
    of = lambda key: F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(key, "abcde")])
    while True:
        seed += 1
        chosen = sorted(tuple(r.key) for r in rest.orderBy(F.rand(seed)).limit(pivots).collect())
        # Three-way counts: keys below, at (one, as keys are unique) and above each pivot.
        counts = rest.agg(*[F.count_if(F.col("key") < of(p)).alias(f"p{i}") for i, p in enumerate(chosen)]).first()
        ranks = [below + n for n in counts]
        if k - 1 in ranks:
            return chosen[ranks.index(k - 1)]
        low = [i for i, n in enumerate(ranks) if n < k - 1]
        high = [i for i, n in enumerate(ranks) if n > k - 1]
        if low:
            rest, below = rest.filter(F.col("key") > of(chosen[low[-1]])), ranks[low[-1]] + 1
        if high:
            rest = rest.filter(F.col("key") < of(chosen[high[0]]))


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (from 1 in the order of the draw; null if not drawn)."""
    gain = gains(bucket_counts(docs, draw, text_col), bucket_counts(target, draw, target_text_col), draw.scale)
    scored = weights(docs, gain, draw, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), draw))
    scored = cut_lineage(scored.withColumn("__row", F.monotonically_increasing_id()))   # pins the rows' numbers
    able = scored.filter(F.col("n_words") >= draw.least_words)
    k = able.count() * draw.percent // 100
    out = ("doc_id", "n_features", "weight", "score")
    if k == 0:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(kth_key(able, k), "abcde")])
    drawn = (F.col("n_words") >= draw.least_words) & (composite_key() <= last)
    key = scored.filter(drawn).select(*out, composite_key().alias("__key")).select(*out, "__key.*")
    ranked = global_position(key, list("abcde")).select(*out, (F.col("position") + 1).cast("long").alias("rank"))
    return ranked.unionByName(scored.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
