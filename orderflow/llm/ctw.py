"""Language-model scoring by context-tree weighting over bytes, beside a unigram base score.

The model reads a text as the base score does: lower-cased words (A-Z only), each followed by
one blank, then one end. A byte is eight binary decisions, so each of the 255 nodes of a
byte's binary tree has a context tree of its own over the last ``depth`` bytes. Every context
holds a Krichevsky-Trofimov estimate of its counts; context-tree weighting mixes the estimates
of all depths, each with the weight that the training data gave it.

1. Blocks of documents (dealt by a hash, bounded in bytes) send their different byte strings
   of ``depth`` + 1 bytes and their different words, with counts in training documents, to
   shards by hash. What is sent grows with the corpus; nothing is capped or hashed away.
2. Shards sum the strings. From these rows the tree is grown level by level: counts of a shorter
   context are the sums of the longer ones', and the weighted block probability of a context
   is half its own estimate plus half the product over its longer contexts. Strings that
   agree in the nearest ``split`` bytes are one task's arrays (their number has a bound);
   shorter contexts are grouped sums by context and node.
3. Going down level by level, each context joins its parent's mixture. Strings that only held-out
   documents hold are in the tree with no counts, where they change nothing: a decision
   takes the mixture up to the longest context that training has seen it in.
4. Every string's log probability (its eight decisions) goes back to the blocks that asked, and
   so do the words' counts; each block sums them over whole texts.

Defined cases: a null text is empty and scores its end alone; an id that is null hashes like an
empty one (held out); repeated rows count and are scored again; without training documents
every decision has probability 1/2 and every base term is log10(1) = 0; very long texts are
scored whole (a text is read in one task). Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm import textbytes as tb
from orderflow.session import cut_lineage


@dataclass(frozen=True)
class Model:
    """Parameters of the model and of its dealing."""

    depth: int = 5                 # bytes of the longest context; 7 at most
    split: int = 3                 # contexts longer than this are grown in arrays; at most depth
    folds: int = 10                # one fold of so many is held out
    smooth: float = 0.1            # of the base score
    block_bytes: int = 8 << 20     # texts of a block
    shard_blocks: int = 2          # blocks' messages that a shard is meant to hold
    least_shards: int = 64


BLANK, END = 0x20, 0x0A
LAST = bytes((END, BLANK))          # an end, among a message's words
SLICE = 1 << 20
ROWS = 100_000                     # strings whose levels are grown together
GRAMS, WORDS, TOKENS, DISTINCT = range(4)
MESSAGE = "block long, shard int, kind int, rows long, one binary, two binary"
_FIELDS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("rows", pa.int64()), ("one", pa.binary()), ("two", pa.binary())])


# -- texts as streams of bytes -------------------------------------------------------

class Stream:
    """Texts as the model reads them: ``depth`` ends as first context, then the words and the end.

    ``first`` and ``last`` bound the scored bytes of each text, ``token`` has the words (with
    their blank) and ends (with the first context of what follows) in order, ``owner`` the text of each.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, depth: int):
        sizes, rows = np.diff(offsets), len(offsets) - 1
        start = np.cumsum(sizes + depth + 2) - sizes - 2
        total = int(sizes.sum()) + rows * (depth + 2) + depth
        at = np.repeat(start - offsets[:-1], sizes) + np.arange(len(buf))
        line, inside, fixed = np.full(total, END, np.uint8), np.zeros(total, bool), np.ones(total, bool)
        line[at], inside[at], fixed[at], fixed[start + sizes] = tb.LOWER[buf], ~tb.SPACE[buf], False, False
        keep = inside | fixed
        keep[1:] |= inside[:-1]
        place = np.concatenate([[0], np.cumsum(keep)])
        line[~(inside | fixed)] = BLANK
        self.line, self.first, self.last, self.depth = line[keep], place[start], place[start + sizes + 2], depth
        begin = (inside & ~np.concatenate([[False], inside[:-1]])) if total else inside
        begin[start + sizes + 1] = True
        cuts = np.append(place[np.flatnonzero(begin)], len(self.line)).astype(np.int64)
        self.token = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(self.line)])
        self.owner = np.searchsorted(self.first, cuts[:-1], "right") - 1

    def grams(self) -> np.ndarray:
        """The string that ends at each byte: its context, the nearest byte first, then the byte itself.
        Places before the first text's are left out, so the result starts at place ``depth``."""
        n, d = len(self.line) - self.depth, self.depth
        out = self.line[d:].astype(np.uint64)
        for k in range(1, d + 1):
            out |= self.line[d - k : d - k + n].astype(np.uint64) << np.uint64(8 * (d - k + 1))
        return out

    def places(self, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Whether each place of ``grams`` belongs to a text, or to one of some texts."""
        step = np.zeros(len(self.line) + 1, np.int8)
        step[self.first[of]] = 1
        step[self.last[of]] = -1
        return np.cumsum(step[:-1])[self.depth :] > 0


def _streams(table: pa.Table, depth: int) -> Iterator[tuple[int, int, Stream]]:
    buf, offsets = tb.text_buffer(table.column("text"))
    for a, b in tb.slices(buf, offsets, SLICE):
        yield a, b, Stream(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], depth)


# -- messages --------------------------------------------------------------------------

def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def _numbers(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(_unpack(data), kind)


def _pack_scores(score: np.ndarray) -> bytes:
    """Scores to 36 binary digits (a relative error of 2**-37), bytes of one place together, which compresses."""
    rounded = (np.ascontiguousarray(score).view(np.uint64) + np.uint64(1 << 15)) & ~np.uint64((1 << 16) - 1)
    return _pack(rounded.view(np.uint8).reshape(-1, 8).T.tobytes())


def _scores(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(data), np.uint8).reshape(8, -1).T).view(np.float64).ravel()


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS) if rows else _FIELDS.empty_table()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def _summed_words(words: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    coded = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    total = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, coded.indices.to_numpy(), np.concatenate([np.zeros(0, np.int64), *counts]))
    return coded.dictionary, total


def _words(data: bytes) -> pa.Array:
    """The words of a message, with their blank."""
    raw = np.frombuffer(_unpack(data), np.uint8)
    cuts = np.concatenate([[0], np.flatnonzero(raw == BLANK) + 1]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)])


def _by_shard(block: int, kind: int, shard: np.ndarray, packed) -> list[tuple]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist() + [len(order)]
    return [(block, int(shard[order[a]]), kind, b - a, *packed(order[a:b])) for a, b in zip(cuts, cuts[1:])]


def _shard(gram: np.ndarray, shards: int) -> np.ndarray:
    return (tb.mix(gram) % np.uint64(shards)).astype(np.int64)


def ask(model: Model, shards: int):
    """A block's different strings and words, with their counts in its training documents."""
    def step(table: pa.Table) -> pa.Table:
        learn, block = table.column("learn").to_numpy(), table.column("block")[0].as_py()
        keys, times, words, counts = [], [], [], []
        for a, b, s in _streams(table, model.depth):
            gram = s.grams()
            for of, of_training in ((learn[a:b], 1), (~learn[a:b], 0)):
                u, n = np.unique(gram[s.places(of)], return_counts=True)
                keys.append(u), times.append(n * of_training)
            coded = s.token.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy()[learn[a:b][s.owner]], minlength=len(coded.dictionary))
            words.append(coded.dictionary), counts.append(n)
        key, n = _summed(np.concatenate(keys), np.concatenate(times))
        out = _by_shard(block, GRAMS, _shard(key, shards), lambda some: (_pack(key[some].tobytes()), _pack(n[some].tobytes())))
        word, m = _summed_words(words, counts)
        order = pc.sort_indices(word).to_numpy()
        word, m = [w if w[0] != END else LAST for w in word.take(pa.array(order)).to_pylist()], m[order]
        shard = np.array([zlib.crc32(w) % shards for w in word], np.int64)
        return _table(out + _by_shard(block, WORDS, shard, lambda some: (_pack(b"".join([word[i] for i in some])), _pack(m[some].tobytes()))))
    return step


def sum_grams(table: pa.Table) -> pa.Table:
    """Of one shard: its different strings and their counts."""
    key, n = _summed(np.concatenate([_numbers(x, np.uint64) for x in table.column("one").to_pylist()]),
                     np.concatenate([_numbers(x) for x in table.column("two").to_pylist()]))
    return pa.table({"gram": key.view(np.int64), "n": n})


def answer_words(table: pa.Table) -> pa.Table:
    """Of one shard: the counts of the words that each block named, and the shard's totals."""
    sent = table.to_pylist()
    words = [_words(r["one"]) for r in sent]
    known, total = _summed_words(words, [_numbers(r["two"]) for r in sent])
    shard = sent[0]["shard"]
    out = [(r["block"], shard, WORDS, r["rows"], r["one"], _pack(total[pc.index_in(w, value_set=known).to_numpy()].tobytes())) for r, w in zip(sent, words)]
    return _table(out + [(-1, shard, TOKENS, int(total.sum()), b"", b""), (-1, shard, DISTINCT, int((total > 0).sum()), b"", b"")])


def answer_grams(table: pa.Table, scored: pa.Table) -> pa.Table:
    """Of one shard: the log probabilities of the strings that each block named."""
    gram = scored.column("gram").to_numpy()
    order = np.argsort(gram)
    gram, score = gram[order], scored.column("score").to_numpy()[order]
    return _table([(r["block"], r["shard"], GRAMS, r["rows"], r["one"], _pack_scores(score[np.searchsorted(gram, _numbers(r["one"]))])) for r in table.to_pylist()])


# -- the tree -----------------------------------------------------------------------------
#
# A cell is a context and a node of the byte's binary tree: (context bytes, nearest first) << 8 | node.

def log_gamma(x, log):
    """Natural logarithm of gamma for x >= 0.5, by Stirling's series at x + 8; of arrays or columns."""
    y = x + 8
    below = log(x * (x + 1) * (x + 2) * (x + 3)) + log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y2 = y * y
    series = (1 - (1 / 30 - (1 / 105 - 1 / 140 / y2) / y2) / y2) / (12 * y)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def log_estimate(z, o, log):
    """Log of the Krichevsky-Trofimov block probability of ``z`` zeros and ``o`` ones."""
    return log_gamma(z + 0.5, log) + log_gamma(o + 0.5, log) - log_gamma(z + o + 1, log) - math.log(math.pi)


class Levels:
    """The cells of some strings at the depths from ``model.depth`` up to ``model.split``, as arrays.

    Each level has cells in order, their counts, ``weighted`` (log of the weighted block
    probability), ``share`` (weight of the cell's own estimate in its mixture) and ``up``, the
    place of its parent in the next shorter level.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, model: Model):
        byte, context = gram & np.uint64(255), gram >> np.uint64(8) << np.uint64(8)
        cell = np.concatenate([context | np.uint64(1 << j) | (byte >> np.uint64(8 - j)) for j in range(8)])
        self.bit = np.concatenate([(byte >> np.uint64(7 - j)) & np.uint64(1) for j in range(8)]).astype(bool)
        cell, self.place = np.unique(cell, return_inverse=True)
        times = np.tile(n, 8)
        counts = [np.bincount(self.place[b], times[b], len(cell)) for b in (~self.bit, self.bit)]
        own = log_estimate(*counts, np.log)
        self.levels = [{"cell": cell, "counts": counts, "weighted": own, "share": np.ones(len(cell))}]
        for _ in range(model.depth - model.split):
            lower = self.levels[-1]
            cell, lower["up"] = np.unique(lower["cell"] >> np.uint64(16) << np.uint64(8) | lower["cell"] & np.uint64(255), return_inverse=True)
            counts = [np.bincount(lower["up"], c, len(cell)) for c in lower["counts"]]
            longer = np.bincount(lower["up"], lower["weighted"], len(cell))
            own = log_estimate(*counts, np.log)
            with np.errstate(over="ignore"):
                self.levels.append({"cell": cell, "counts": counts, "weighted": np.logaddexp(own, longer) - math.log(2), "share": 1 / (1 + np.exp(longer - own))})

    def scores(self, state: dict[str, np.ndarray]) -> np.ndarray:
        """log10 probabilities of the strings, given the mixture ``state`` of the shortest level's cells."""
        top = self.levels[-1]
        order = np.argsort(state["cell"])
        at = order[np.searchsorted(state["cell"], top["cell"], sorter=order)]
        give, rest, end = [state["give_0"][at], state["give_1"][at]], state["rest"][at], [state["p_0"][at], state["p_1"][at]]
        for level in reversed(self.levels[:-1]):
            up, total = level["up"], level["counts"][0] + level["counts"][1]
            estimate = [(c + 0.5) / (total + 1) for c in level["counts"]]
            end = [np.where(total > 0, g[up] + rest[up] * e, p[up]) for g, e, p in zip(give, estimate, end)]
            give = [g[up] + rest[up] * level["share"] * e for g, e in zip(give, estimate)]
            rest = rest[up] * (1 - level["share"])
        p = np.where(self.bit, end[1][self.place], end[0][self.place])
        return np.log10(p).reshape(8, -1).sum(0)


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """A sorted stream in tables of about ``most`` rows that hold whole groups of the column ``near``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        near = table.column("near").to_numpy()
        cut = int(np.flatnonzero(np.append(True, near[1:] != near[:-1]))[-1])
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).combine_chunks().to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held)


STATE = ("give_0", "give_1", "rest", "p_0", "p_1")


def string_scores(grams: DataFrame, model: Model, shards: int) -> DataFrame:
    """(gram, shard, score) of strings (gram, n): log10 probability of the last byte after the others."""
    # Strings whose nearest ``split`` bytes agree share no longer context with others: their levels are
    # arrays of a task, and no group has more than 256 ** (depth + 1 - split) strings.
    near = F.shiftrightunsigned("gram", 8 * (model.depth + 1 - model.split))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ROWS):
            top = Levels(t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy(), model).levels[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (top["cell"].view(np.int64), *top["counts"], top["weighted"], top["share"])],
                                             names=["cell", "zeros", "ones", "weighted", "share"])

    rows = grams.select("gram", "n", near.alias("near"))
    levels = [cut_lineage(rows.repartition("near").sortWithinPartitions("near").mapInArrow(grow, "cell long, zeros double, ones double, weighted double, share double"))]
    shorter = F.expr("shiftleft(shiftrightunsigned(cell, 16), 8) | (cell & 255)")
    for _ in range(model.split):
        up = (levels[-1].groupBy(shorter.alias("cell"))
              .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("longer"))
              .withColumn("own", log_estimate(F.col("zeros"), F.col("ones"), F.log)).withColumn("gap", F.col("longer") - F.col("own")))
        mixed = F.greatest("own", "longer") + F.log1p(F.exp(-F.abs("gap"))) - math.log(2)
        levels.append(cut_lineage(up.select("cell", "zeros", "ones", mixed.alias("weighted"), (1 / (1 + F.exp("gap"))).alias("share"))))

    # Downwards: what shorter contexts give to each bit (give_0, give_1), what is left for longer
    # ones (rest), and the mixture's end at the longest context that was seen (p_0, p_1).
    total = F.col("zeros") + F.col("ones")
    estimate = [(F.col(c) + 0.5) / (total + 1) for c in ("zeros", "ones")]
    down = None
    for level in reversed(levels):
        if down is None:
            start = {"give_0": 0.0, "give_1": 0.0, "rest": 1.0, "p_0": 0.5, "p_1": 0.5}
            met = level.select("*", *[F.lit(v).alias(c) for c, v in start.items()])
        else:
            met = level.withColumn("up", shorter).join(down.withColumnRenamed("cell", "up"), "up")
        down = met.select(
            "cell", *[(F.col(f"give_{b}") + F.col("rest") * F.col("share") * e).alias(f"give_{b}") for b, e in enumerate(estimate)],
            (F.col("rest") * (1 - F.col("share"))).alias("rest"),
            *[F.when(total > 0, F.col(f"give_{b}") + F.col("rest") * e).otherwise(F.col(f"p_{b}")).alias(f"p_{b}") for b, e in enumerate(estimate)])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ROWS):
            of_cell = pc.is_valid(t.column("rest"))
            some = t.filter(pc.invert(of_cell))
            gram = some.column("key").to_numpy().view(np.uint64)
            cells = t.filter(of_cell)
            state = {"cell": cells.column("key").to_numpy().view(np.uint64), **{c: cells.column(c).to_numpy() for c in STATE}}
            score = Levels(gram, some.column("n").to_numpy(), model).scores(state)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(_shard(gram, shards).astype(np.int32)), pa.array(score)], names=["gram", "shard", "score"])

    no_state = [F.lit(None).cast("double").alias(c) for c in STATE]
    strings = rows.select("near", F.col("gram").alias("key"), "n", *no_state)
    cells = down.select(F.shiftrightunsigned("cell", 8).alias("near"), F.col("cell").alias("key"), F.lit(0).cast("long").alias("n"), *STATE)
    return strings.unionByName(cells).repartition("near").sortWithinPartitions("near").mapInArrow(tell, "gram long, shard int, score double")


# -- scoring ----------------------------------------------------------------------------------

def _heard(heard: pa.Table, kind: int) -> pa.Table:
    return heard.filter(pc.equal(heard.column("kind"), kind))


def finish(model: Model, n: int, v: int):
    """Sums the answers over the texts of a block."""
    def step(table: pa.Table, heard: pa.Table) -> pa.Table:
        said = _heard(heard, GRAMS)
        gram = np.concatenate([np.zeros(0, np.uint64), *(_numbers(x, np.uint64) for x in said.column("one").to_pylist())])
        score = np.concatenate([np.zeros(0), *map(_scores, said.column("two").to_pylist())])
        order = np.argsort(gram)
        gram, score = gram[order], score[order]
        said = _heard(heard, WORDS)
        words = pa.chunked_array([_words(x) for x in said.column("one").to_pylist()], pa.large_binary()).combine_chunks()
        count = np.concatenate([np.zeros(0, np.int64), *map(_numbers, said.column("two").to_pylist())])
        last = pc.index_in(pa.array([LAST], pa.large_binary()), value_set=words)[0]
        base = np.log10((count + model.smooth) / (n + model.smooth * (v + 1)))

        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        for _, _, s in _streams(table, model.depth):
            if not len(s.first):
                continue
            different, place = np.unique(s.grams(), return_inverse=True)   # sorted, so the search runs through memory in order
            each = np.where(s.places(), score[np.minimum(np.searchsorted(gram, different), len(score) - 1)][place], 0.0)
            coded = s.token.dictionary_encode()
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), last).to_numpy()[coded.indices.to_numpy()]
            rows = len(s.first)
            sums = (np.bincount(s.owner, minlength=rows), np.bincount(s.owner[count[at] > 0], minlength=rows), s.last - s.first,
                    np.bincount(s.owner, weights=base[at], minlength=rows), np.add.reduceat(each, s.first - s.depth))
            for part, x in zip(parts, sums):
                part.append(x)
        tokens, known, size, unigram, total = (np.concatenate(p) if p else np.zeros(0) for p in parts)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": pc.invert(table.column("learn")), "n_tokens": pa.array(tokens.astype(np.int64)),
            "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(tokens), n, np.int64)), "base_score": pa.array(unigram.astype(float)),
            "score": pa.array(total.astype(float)), "n_bytes": pa.array(size.astype(np.int64)), "bits_per_byte": pa.array(-total * math.log2(10) / np.maximum(size, 1)),
        })
    return step


def score(docs: DataFrame, model: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability by
    context-tree weighting), n_bytes (that the model reads) and bits_per_byte (its code length)."""
    doc_id = F.col(id_col).cast("long")
    fold = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % model.folds
    source = docs.select(doc_id.alias("doc_id"), F.col(text_col).cast("string").alias("text"), (fold != 0).alias("learn"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // model.block_bytes))
    shards = max(model.least_shards, -(-blocks // model.shard_blocks))
    # The text is in the hash, so rows that share an id (or have none) are dealt like others.
    source = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    asked = cut_lineage(source.groupBy("block").applyInArrow(ask(model, shards), MESSAGE))
    of_grams = asked.filter(F.col("kind") == GRAMS)
    grams = cut_lineage(of_grams.groupBy("shard").applyInArrow(sum_grams, "gram long, n long"))
    words = cut_lineage(asked.filter(F.col("kind") == WORDS).groupBy("shard").applyInArrow(answer_words, MESSAGE))
    totals = {r.kind: r.n for r in words.filter("block < 0").groupBy("kind").agg(F.sum("rows").alias("n")).collect()}
    scored = string_scores(grams, model, shards)
    answers = of_grams.groupBy("shard").cogroup(scored.groupBy("shard")).applyInArrow(answer_grams, MESSAGE).unionByName(words.filter("block >= 0"))
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
              "n_bytes long, bits_per_byte double")
    return (source.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(finish(model, totals.get(TOKENS, 0), totals.get(DISTINCT, 0)), schema))
