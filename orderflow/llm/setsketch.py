"""MinHash near-duplicates with SetSketch registers.

A document's set is its distinct word shingles. Its sketch holds, for each of
m hash functions, the smallest hash of the set as an exponential variable,
truncated to a logarithmic scale of base ``BASE`` (one byte each): registers of
a union are the larger registers, and two sets agree on a register with
probability close to their similarity.

1. One map makes shingle counts, a 128-bit fingerprint of the set, the sketch.
2. Equal sets are one class (grouped by fingerprint, with map-side combine), so
   copies never meet again; only classes go on.
3. Four registers are a band key. The number of bands follows from the
   similarity, so that a pair at the limit is missed with probability ``MISS``.
4. Pairs that share a key are estimated by likelihood from the registers that
   are greater, smaller and equal, and from the exact set sizes. A pair is
   refuted if the limit is less likely than the estimate by ``e**-LIKELIHOOD``.
5. What is left is verified on the full sets. First every class with its
   likeliest earlier partner: that joins most of a group by as many pairs as it
   has members. Then the classes of buckets that still hold several components
   form families (connected by likely pairs, written as spanning edges only).
   A family is dealt in chunks of ``CHUNK`` classes; each class outside the
   family's main component is sent to every chunk and intersected there with
   the sets of all its classes at once. Only links are written, so neither a
   bucket nor a family ever writes its pairs.

Defined cases: a null or blank text has no shingles and is linked with nothing;
a text of fewer words than a shingle is one shingle; rows with one doc_id are
one document; a row without an id is linked with nothing and kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm import textbytes as tb
from orderflow.session import cut_lineage

BASE, RATE = 1.09, 20.0     # registers cover sets of 1 to about 1e8 shingles in a byte
BAND_ROWS = 4
MISS = 1e-8
LIKELIHOOD = 16.0
CHUNK = 512
NEAREST = 4
_STEPS = 48


@dataclass(frozen=True)
class Near:
    """What is near: shingles of ``words`` words, ``percent`` similarity or more."""
    words: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** BAND_ROWS)))

    @property
    def registers(self) -> int:
        return self.bands * BAND_ROWS


# -- sets and sketches ---------------------------------------------------------

def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (row, 64-bit hash) sorted by row, and the set sizes."""
    low = tb.LOWER[buf]
    words = tb.Words(low, offsets)
    hashes = words.hashes()
    at, shingle = tb.windows(hashes, words.row, k)
    row = words.row[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        whole = tb.RangeHash(tb.mix(hashes).view(np.uint8))  # the words' hashes, as bytes
        own = tb.mix(whole(words.first_word[short] * 8, words.first_word[short + 1] * 8) + np.uint64(k))
        row, shingle = np.concatenate([row, short]), np.concatenate([shingle, own])
    order = np.argsort(shingle ^ tb.mix(row.astype(np.uint64) + np.uint64(1)))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    row, shingle = row[new], shingle[new]
    order = np.argsort(row, kind="stable")
    return row[order], shingle[order], np.bincount(row, minlength=words.rows).astype(np.int64)


def _constants(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, m, dtype=np.uint64), rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(row: np.ndarray, shingle: np.ndarray, size: np.ndarray, m: int) -> np.ndarray:
    """(rows, m) registers; all 0 for an empty set."""
    out = np.zeros((len(size), m), np.uint8)
    filled = size > 0
    if not filled.any():
        return out
    start = (np.cumsum(size) - size)[filled]
    least = np.empty((m, len(start)), np.uint64)
    flip, odd = _constants(m)
    with np.errstate(over="ignore"):
        for i in range(m):
            least[i] = np.minimum.reduceat((shingle ^ flip[i]) * odd[i], start)
    u = (least.astype(np.float64) + 1) / 2.0**64
    exponential = -np.log1p(-np.minimum(u, 1 - 1e-12)) / RATE
    out[filled] = np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, 255).astype(np.uint8).T
    return out


def signatures(docs: DataFrame, near: Near, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): one map over whole texts. The bands
    are the registers, four to an integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tb.text_buffer(batch.column(1))
            for a, b in tb.slices(buf, offsets):
                row, shingle, size = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], near.words)
                registers = sketches(row, shingle, size, near.registers)
                prints = np.zeros((2, b - a), np.uint64)
                if len(row):
                    start = (np.cumsum(size) - size)[size > 0]
                    prints[0, size > 0] = np.add.reduceat(tb.mix(shingle), start)
                    prints[1, size > 0] = np.add.reduceat(tb.mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), start)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * near.bands, near.bands, dtype=np.int32)), pa.array(registers.view("<i4").ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), bands],
                                                 names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<int>"))


# -- estimation ----------------------------------------------------------------

def _step(x: np.ndarray) -> np.ndarray:
    """Probability that one set's register exceeds the other's, from its own share of the union."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def likelihood(greater: np.ndarray, smaller: np.ndarray, m: int, n_u: np.ndarray, n_v: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood similarity of pairs, and whether ``limit`` or more is still likely."""
    total = (n_u + n_v).astype(float)
    u, v = (n_u / total)[:, None], (n_v / total)[:, None]
    most = np.minimum(n_u, n_v) / np.maximum(n_u, n_v)
    grid = np.linspace(0, 1, _STEPS)[None, :] * most[:, None]
    equal = m - greater - smaller

    def log_like(j: np.ndarray) -> np.ndarray:
        p, q = _step(u - v * j), _step(v - u * j)
        logs = [c[:, None] * np.log(np.maximum(x, 1e-12)) for c, x in ((greater, p), (smaller, q), (equal, 1 - p - q))]
        return logs[0] + logs[1] + logs[2]

    like = log_like(grid)
    best = like.argmax(1)
    estimate = grid[np.arange(len(best)), best]
    at_limit = log_like(np.minimum(limit, most)[:, None])[:, 0]
    likely = (most >= limit - 1e-9) & ((estimate >= limit) | (like[np.arange(len(best)), best] - at_limit <= LIKELIHOOD))
    return estimate, likely


def least_equal(near: Near) -> int:
    """Registers that a pair at the limit shares but with a chance of e**-LIKELIHOOD (Chernoff)."""
    p, m = near.percent / 100, near.registers
    for d in range(int(m * p), 0, -1):
        q = d / m
        if m * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p))) > LIKELIHOOD:
            return d
    return 0


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups (equal first ``keys`` columns) of a sorted partition, some thousand rows at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        if len(rest) < 8192:
            continue
        marks = [rest.column(k).to_numpy() for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in marks], 0))
        if len(change):
            yield rest.slice(0, change[-1] + 1)
            rest = rest.slice(change[-1] + 1).combine_chunks()
    if rest is not None and len(rest):
        yield rest


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices over the pairs (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def estimate_pairs(rows: DataFrame, near: Near, keep: int | None) -> DataFrame:
    """Likely pairs of rows (band, key, chunk, outside, class_id, part, n, bands) that share
    band, key and chunk: (a, b, estimate), a the outsider.

    A pair needs an outsider and two different parts. ``keep`` bounds the pairs written for
    each outsider and bucket to its likeliest ones; with None the pairs' connected groups are
    written instead, as one edge from each further member to the smallest class.
    """
    floor, m, limit = least_equal(near), near.registers, near.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            get = {c: table.column(c).to_numpy() for c in ("band", "key", "chunk", "outside", "class_id", "part", "n")}
            registers = table.column("bands").combine_chunks()
            registers = (registers.chunk(0) if isinstance(registers, pa.ChunkedArray) else registers).flatten().to_numpy().view(np.uint8).reshape(len(table), m)
            new = np.ones(len(table), bool)
            new[1:] = np.any([get[c][1:] != get[c][:-1] for c in ("band", "key", "chunk")], 0)
            end = np.append(np.flatnonzero(new)[1:], len(table))[np.cumsum(new) - 1]
            first = np.flatnonzero(get["outside"] > 0)
            found: list[tuple[np.ndarray, ...]] = []
            lag = 0
            while len(first):
                lag += 1
                first = first[first + lag < end[first]]
                for s in range(0, len(first), 1 << 14):
                    i = first[s : s + (1 << 14)]
                    j = i + lag
                    ok = get["part"][i] != get["part"][j]
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    equal = (registers[i] == registers[j]).sum(1)
                    ok = equal > floor
                    i, j, equal = i[ok], j[ok], equal[ok]
                    if not len(i):
                        continue
                    greater = (registers[i] > registers[j]).sum(1)
                    estimate, likely = likelihood(greater, m - equal - greater, m, get["n"][i], get["n"][j], limit)
                    found.append((i[likely], j[likely], estimate[likely]))
            if not found:
                continue
            i, j, estimate = (np.concatenate(x) for x in zip(*found))
            if keep is None:
                # The edges lead to the group's smallest class: buckets of other bands that hold it say the same.
                root, ids = connected(len(table), i, j), get["class_id"]
                least = np.full(len(table), np.iinfo(np.int64).max)
                np.minimum.at(least, root, ids)
                some = np.flatnonzero(ids != least[root])
                a, b = np.unique(np.stack([ids[some], least[root[some]]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.ones(len(a)))], names=["a", "b", "estimate"])
                continue
            # an outsider pair counts for both sides; a row's best ones, then the smaller id
            both = [(i, j), (j[get["outside"][j] > 0], i[get["outside"][j] > 0])]
            value = np.concatenate([estimate, estimate[get["outside"][j] > 0]])
            i, j = (np.concatenate(x) for x in zip(*both))
            order = np.lexsort((get["class_id"][j], -value, i))
            i, j, estimate = i[order], j[order], value[order]
            start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
            rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
            i, j, estimate = i[rank < keep], j[rank < keep], estimate[rank < keep]
            yield pa.RecordBatch.from_arrays([pa.array(get["class_id"][i]), pa.array(get["class_id"][j]), pa.array(estimate)], names=["a", "b", "estimate"])

    return (rows.select("band", "key", "chunk", "outside", "class_id", "part", "n", "bands")
            .repartition("band", "key", "chunk").sortWithinPartitions("band", "key", "chunk", F.desc("outside"), "class_id")
            .mapInArrow(run, "a long, b long, estimate double"))


# -- verification --------------------------------------------------------------

def verified(pairs: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose full sets are near enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                (abuf, aoff), (bbuf, boff) = tb.text_buffer(batch.column(2)), tb.text_buffer(batch.column(3))
                keep = []
                for s, e in tb.slices(np.zeros(0), aoff + boff):
                    ra, ha, na = shingle_sets(abuf[aoff[s] : aoff[e]], aoff[s : e + 1] - aoff[s], near.words)
                    rb, hb, nb = shingle_sets(bbuf[boff[s] : boff[e]], boff[s : e + 1] - boff[s], near.words)
                    row, key = np.concatenate([ra, rb]), np.concatenate([ha, hb])
                    order = np.argsort(key ^ tb.mix(row.astype(np.uint64) + np.uint64(1)))
                    row, key = row[order], key[order]
                    both = np.bincount(row[1:][(key[1:] == key[:-1]) & (row[1:] == row[:-1])], minlength=e - s)
                    keep.append((both > 0) & (100 * both >= near.percent * (na + nb - both)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(np.concatenate(keep)))

    one = docs.join(pairs, docs.doc_id == pairs.a).select("a", "b", F.col("text").alias("text_a"))
    two = docs.join(one, docs.doc_id == one.b).select("a", "b", "text_a", F.col("text").alias("text_b"))
    return two.mapInArrow(run, "a long, b long")


class _Chunk:
    """The sets of a chunk's classes, to intersect many sets with."""

    def __init__(self, table: pa.Table, near: Near):
        buf, offsets = tb.text_buffer(table.column("text"))
        rows, keys, sizes = [], [], []
        for a, b in tb.slices(buf, offsets):
            row, key, size = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], near.words)
            rows.append(row + a), keys.append(key), sizes.append(size)
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.argsort(key)
        self.row, self.key, self.size = row[order], key[order], np.concatenate(sizes)
        self.class_id, self.part = table.column("class_id").to_numpy(), table.column("part").to_numpy()

    def links(self, key: np.ndarray, part: int, percent: int) -> np.ndarray:
        """Rows of other parts that are near a set; one for each part."""
        first, last = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        size = last - first
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.bincount(self.row[at], minlength=len(self.size))
        hit = np.flatnonzero((both > 0) & (100 * both >= percent * (self.size + len(key) - both)) & (self.part != part))
        return hit[np.unique(self.part[hit], return_index=True)[1]]


def linked_in_chunks(rows: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) between different parts of a family: each outsider with the classes of each
    chunk. rows: (family, chunk, outside, class_id, part, text); in a chunk its classes come
    first (outside 0), then outsiders stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, chunk = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = [table.column(c).to_numpy() for c in ("family", "chunk", "outside")]
            cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in marks], 0)) + 1).tolist(), len(table)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if (marks[0][s], marks[1][s]) != here:
                    here, waiting, chunk = (marks[0][s], marks[1][s]), [], None
                some = table.slice(s, e - s)
                if marks[2][s] == 0:
                    waiting.append(some)
                    continue
                if chunk is None:
                    if not waiting:
                        continue
                    chunk, waiting = _Chunk(pa.concat_tables(waiting), near), []
                found_a, found_b = [], []
                buf, offsets = tb.text_buffer(some.column("text"))
                ids, parts = some.column("class_id").to_numpy(), some.column("part").to_numpy()
                for a, b in tb.slices(buf, offsets):
                    _, key, size = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], near.words)
                    end = np.cumsum(size)
                    for k in range(b - a):
                        hit = chunk.links(key[end[k] - size[k] : end[k]], parts[a + k], near.percent)
                        found_a += [ids[a + k]] * len(hit)
                        found_b += chunk.class_id[hit].tolist()
                if found_a:
                    yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return (rows.select("family", "chunk", "outside", "class_id", "part", "text").repartition("family", "chunk")
            .sortWithinPartitions("family", "chunk", "outside").mapInArrow(run, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, part): the smallest node that each node of the edges (a, b) reaches.

    Minimum labels over the edges, then one pointer jump, until nothing
    changes: rounds grow with the logarithm of the longest path. Every round
    is checkpointed in the shared folder.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("part")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("part").alias("m"))
        least = labels.join(near, labels.node == near.a, "left").select("node", F.col("part").alias("was"), F.least("part", "m").alias("part"))
        jump = labels.select(F.col("node").alias("target"), F.col("part").alias("its"))
        nxt = cut_lineage(least.join(jump, least.part == jump.target, "left").select("node", "was", F.least("part", "its").alias("part")))
        if nxt.filter("part != was").isEmpty():
            return nxt.select("node", "part")
        labels = nxt.select("node", "part")


def near_duplicates(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) of every row.

    ``class_id`` is the smallest document with the same set, ``component_id``
    the smallest reachable by links; ``kept`` marks that one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signs = cut_lineage(signatures(docs, near))
    same = ["n_shingles", "set_a", "set_b"]
    classes = cut_lineage(signs.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same)
                          .agg(F.min("doc_id").alias("class_id"), F.min_by("bands", "doc_id").alias("bands")))
    reps = classes.select("class_id", F.col("n_shingles").alias("n"), "bands")

    keyed = reps.select("class_id", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut_lineage(keyed.join(shared, ["band", "key"]))
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    chunk = F.pmod(F.hash("class_id", "band"), chunks)

    # First the likeliest earlier partner of each class.
    rows = members.select("band", "key", chunk.alias("chunk"), F.lit(1).alias("outside"), "class_id", F.col("class_id").alias("part"))
    nearest = estimate_pairs(rows.join(reps, "class_id"), near, 1 + NEAREST)
    ordered = nearest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "estimate")
    first = cut_lineage(ordered.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b")))
    parts = _merge(None, cut_lineage(verified(first, docs, near)))

    # Then what the buckets still hold apart.
    here = members.join(parts, members.class_id == parts.node, "left").select("band", "key", "size", "class_id", F.coalesce("part", "class_id").alias("part"))
    likely = estimate_pairs(_open(here, ["band", "key"], F.col("size"), F.hash("class_id", "band")).join(reps, "class_id"), near, None)
    families = components(likely.select("a", "b").distinct())
    sizes = families.groupBy("part").agg(F.count("*").alias("size")).withColumnRenamed("part", "family")
    held = (families.select(F.col("node").alias("class_id"), F.col("part").alias("family")).join(sizes, "family")
            .join(parts, F.col("class_id") == parts.node, "left").select("family", "size", "class_id", F.coalesce("part", "class_id").alias("part")))
    rows = _open(held, ["family"], F.col("size"), F.hash("class_id"), own_too=True)
    texts = docs.join(rows, docs.doc_id == rows.class_id).select("family", "chunk", "outside", "class_id", "part", "text")
    parts = _merge(parts, cut_lineage(linked_in_chunks(texts, near)))

    known = signs.join(classes.select(*same, "class_id"), same, "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))
    out = known.join(parts, known.class_id == parts.node, "left")
    component = F.coalesce("part", "class_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _open(rows: DataFrame, keys: list[str], size: Column, spread: Column, own_too: bool = False) -> DataFrame:
    """Rows of groups that hold several parts, dealt in chunks: a row of the group's main part
    goes to its chunk, a row outside of it to every chunk (marked ``outside``). With
    ``own_too`` rows outside are also in their own chunk, unmarked."""
    chunks = F.ceil(size / CHUNK).cast("int")
    sizes = rows.groupBy(*keys, "part").agg(F.count("*").alias("rows"))
    main = sizes.groupBy(*keys).agg(F.max_by("part", F.struct("rows", "part")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    own = F.struct(F.pmod(spread, chunks).alias("chunk"), F.lit(0).alias("outside"))
    every = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(c.alias("chunk"), F.lit(1).alias("outside")))
    to = F.when(F.col("part") == F.col("main"), F.array(own)).otherwise(F.concat(every, F.array(own)) if own_too else every)
    return rows.join(main, keys).withColumn("to", F.explode(to)).select(*keys, "to.chunk", "to.outside", "class_id", "part")


def _merge(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after new links: the links join whole components."""
    if parts is not None:
        a, b = parts.select(F.col("node").alias("a"), F.col("part").alias("pa")), parts.select(F.col("node").alias("b"), F.col("part").alias("pb"))
        links = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    joined = components(links.filter("a != b"))
    if parts is None:
        return joined
    old = parts.join(joined.withColumnRenamed("part", "to").withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("to", "part").alias("part"))
    return cut_lineage(old.unionByName(joined.join(parts, "node", "left_anti")))
