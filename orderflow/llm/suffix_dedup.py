"""Suffix-array dedup by bucket-pointer refinement, sharded over Spark.

Removes every byte covered by a string of ``LENGTH`` bytes that also starts in
a document with a smaller id: whole texts, all strings. Contexts and strings of two places meet
by 64-bit hashes of their bytes; a shard compares the bytes of equal hashes.

Sorting all suffixes at once is not distributed work, so the suffixes that can
decide are bucketed by a q-gram first (q = ``GRAM``):

* Anchors. In every string of ``LENGTH`` bytes the q-gram of smallest hash (all
  of them on a tie) is an anchor. Equal strings have equal anchors at equal
  offsets, so it is enough to compare strings around equal anchors; about one
  position in 18 is an anchor. The q-gram is the initial bucket.
* A block of documents sends the q-grams of its anchors to the shard of their
  bucket, and hears which are shared by two documents or more.
* For those it sends the anchor's context (the bytes of every string that can
  hold the anchor), once for equal contexts, with its smallest document.
* The shard refines its buckets to the order of ``LENGTH`` bytes: positions of a
  context start in buckets of 8 bytes; a bucket at depth h is refined by the
  bucket identifiers at offset h, and these updated identifiers are used for
  the next refinement (8 -> 16 -> 32 -> 50). Positions in one final bucket
  start equal strings; a string is repeated if its bucket has a smaller document.
* A q-gram of ``HOT`` documents or more would make one large bucket (the edge of
  a passage that many documents share). Its strings are sent one by one,
  once for equal strings of a block, to the shard of their own hash.

Blocks and shards have a size in bytes, their number follows the input. A
row is in the block of its id's and text's hash, so a lost task is redone alike, and rows
without an id, or of one id, are dealt like others.

Defined cases: a null text is empty; a document with a null id is never a
smaller one and is compared with all others; rows with one id are one
document's texts (never smaller than each other); ids are compared as integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm import textbytes as tb

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM                    # bytes of a string before or after its anchor
CONTEXT = GRAM + 2 * REACH
DEPTHS = ((8, 8, 16), (16, 16, 32), (32, LENGTH - 32, LENGTH))   # (depth, offset of the pointer, new depth)
HOT = 2000
BLOCK_BYTES, SHARD_BYTES = 2 << 20, 4 << 20
NO_ID = np.int64(2**63 - 1)
PAD = 0xFF                               # never a byte of UTF-8

_SLICE = 1 << 18


# -- anchors and contexts of a block ---------------------------------------------

def _words8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as an integer."""
    w = buf.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | (w[k:] << np.uint64(8 * k))
    return w


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over ``width`` entries from each position on."""
    size, out = 1, x
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(x) - width + 1], out[width - size :]) if size < width else out


class Piece:
    """Some documents of a block, padded, with their anchors."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, first_row: int):
        sizes = np.diff(offsets)
        self.sizes, self.first_row = sizes, first_row
        self.start = np.cumsum(sizes + LENGTH) - sizes
        self.buf = np.full(int(sizes.sum()) + LENGTH * (len(sizes) + 1), PAD, np.uint8)
        at = np.repeat(self.start - offsets[:-1], sizes) + np.arange(len(buf))
        self.buf[at] = buf
        self.anchor, self.gram = self._anchors()
        self.row = np.searchsorted(self.start, self.anchor, "right") - 1

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        words = _words8(self.buf)
        with np.errstate(over="ignore"):
            gram = tb.mix(words[:-8] ^ tb.mix(words[8:] + np.uint64(GRAM))) | np.uint64(1)
        n = len(gram)
        edge = np.zeros(len(self.buf) + 1, np.int8)
        whole = self.sizes >= LENGTH
        np.add.at(edge, self.start[whole], 1)
        np.add.at(edge, (self.start + self.sizes)[whole] - LENGTH + 1, -1)
        string = np.cumsum(edge[:n]) > 0                 # a whole string starts here
        width = REACH + 1
        least = _slide(gram, width, np.minimum)
        least = np.where(string[: len(least)], least, np.uint64(0))
        held = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, np.maximum)
        at = np.flatnonzero(held == gram[: len(held)])
        return at, gram[at]

    def contexts(self, anchor: np.ndarray) -> np.ndarray:
        return self.buf[anchor[:, None] + np.arange(-REACH, GRAM + REACH)]


def pieces(table: pa.Table) -> list[Piece]:
    buf, offsets = tb.text_buffer(table.column("text"))
    return [Piece(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a) for a, b in tb.slices(buf, offsets, _SLICE)]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a byte matrix."""
    wide = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), wide), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(np.uint64)
    out = np.full(len(rows), np.uint64(rows.shape[1]))
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            out = tb.mix(out * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return out


def group_rows(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of a byte matrix: (one representative each, its smallest document, group of every row)."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = row_hash(rows)
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1])
    group = np.empty(len(rows), np.int64)
    group[order] = np.cumsum(new) - 1
    chosen = order[new]
    if not np.array_equal(rows, rows[chosen[group]]):   # two texts with one hash: compare the bytes
        _, chosen, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
    least = np.full(len(chosen), NO_ID)
    np.minimum.at(least, group, docs)
    return chosen, least, group


def strings_of(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All whole strings of the contexts: (context, offset, bytes)."""
    filled = np.concatenate([np.zeros((len(contexts), 1), np.int64), np.cumsum(contexts == PAD, 1)], 1)
    whole = filled[:, LENGTH:] == filled[:, : CONTEXT - LENGTH + 1]
    which, offset = np.nonzero(whole)
    return which, offset, contexts[which[:, None], offset[:, None] + np.arange(LENGTH)]


# -- messages ----------------------------------------------------------------------

MESSAGE = "block long, shard int, kind int, rows long, one binary, two binary, three binary"
GRAMS, CONTEXTS, STRINGS, HOT_GRAMS = range(4)
_FIELDS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("rows", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("three", pa.binary())])


def _pack(x: np.ndarray) -> bytes:
    data = np.ascontiguousarray(x).tobytes()
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unpack(data: bytes, rows: int, kind, width: int = 1) -> np.ndarray:
    size = rows * width * np.dtype(kind).itemsize
    out = np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True) if size else b"", kind)
    return out.reshape(rows, width) if width > 1 else out


def _by_shard(block: int, kind: int, shard: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist() + [len(order)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        some = order[a:b]
        out.append((block, int(shard[some[0]]), kind, b - a, *[_pack(c[some]) for c in columns], *[b""] * (3 - len(columns))))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS) if rows else _FIELDS.empty_table()


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(24)) % np.uint64(shards)).astype(np.int64)


def _rows(table: pa.Table, kind: int) -> list[dict]:
    return [r for r in table.to_pylist() if r["kind"] == kind]


# -- the five steps -----------------------------------------------------------------

def send_grams(shards: int):
    def step(table: pa.Table) -> pa.Table:
        ids, gram, doc = _ids(table), [], []
        for p in pieces(table):
            gram.append(p.gram)
            doc.append(ids[p.row + p.first_row])
        gram, doc = np.concatenate(gram), np.concatenate(doc)
        order = np.lexsort((doc, gram))
        gram, doc = gram[order], doc[order]
        new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
        fresh = new | np.append(True, doc[1:] != doc[:-1])[: len(gram)]
        start = np.flatnonzero(new)
        docs = np.add.reduceat(fresh.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        gram = gram[new]
        return _table(_by_shard(table.column("block")[0].as_py(), GRAMS, _shard_of(gram, shards), [gram, np.minimum(docs, 65535).astype(np.uint16)]))
    return step


def shared_grams(table: pa.Table) -> pa.Table:
    """Of one shard: for each block, its q-grams of two documents or more, and which are hot."""
    sent = _rows(table, GRAMS)
    gram = np.concatenate([_unpack(r["one"], r["rows"], np.uint64) for r in sent])
    docs = np.concatenate([_unpack(r["two"], r["rows"], np.uint16) for r in sent]).astype(np.int64)
    block = np.repeat([r["block"] for r in sent], [r["rows"] for r in sent])
    order = np.argsort(gram)
    new = np.append(True, gram[order][1:] != gram[order][:-1])
    total = np.add.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    keep = total > 1
    gram, block, hot = gram[order][keep], block[order][keep], total[keep] >= HOT
    shard = int(sent[0]["shard"])
    out = []
    order = np.argsort(block, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
        out.append((int(block[some[0]]), shard, GRAMS, len(some), _pack(gram[some]), _pack(hot[some].astype(np.uint8)), b""))
    return _table(out)


def _gathered(parts: list[Piece], ids: np.ndarray, shared: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (and their documents) of the anchors whose q-gram is in the sorted array ``shared``,
    without repeats; ``most`` bounds how many are looked at together."""
    rows, docs, waiting = [np.zeros((0, CONTEXT), np.uint8)], [np.zeros(0, np.int64)], 0
    for p in parts:
        at = np.searchsorted(shared, p.gram)
        hit = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == p.gram) if len(shared) else np.zeros(0, np.int64)
        rows.append(p.contexts(p.anchor[hit]))
        docs.append(ids[p.row[hit] + p.first_row])
        waiting += len(hit)
        if waiting > most:
            x, d = np.concatenate(rows), np.concatenate(docs)
            chosen, least, _ = group_rows(x, d)
            rows, docs, waiting = [x[chosen]], [least], 0
    x, d = np.concatenate(rows), np.concatenate(docs)
    chosen, least, _ = group_rows(x, d)
    return x[chosen], least


def _hot_strings(contexts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different strings of the contexts and their smallest documents, 4096 contexts at a time."""
    rows, least = np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64)
    for a in range(0, len(contexts), 4096):
        which, _, text = strings_of(contexts[a : a + 4096])
        x, d = np.concatenate([rows, text]), np.concatenate([least, docs[a : a + 4096][which]])
        chosen, least, _ = group_rows(x, d)
        rows = x[chosen]
    return rows, least


def send_contexts(shards: int):
    def step(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not len(table) or not len(heard):
            return _FIELDS.empty_table()
        block, ids, parts = table.column("block")[0].as_py(), _ids(table), pieces(table)
        said = _rows(heard, GRAMS)
        gram = np.concatenate([_unpack(r["one"], r["rows"], np.uint64) for r in said])
        hot = np.concatenate([_unpack(r["two"], r["rows"], np.uint8) for r in said]) > 0
        rows, docs = _gathered(parts, ids, np.sort(gram[~hot]), 1 << 16)
        out = _by_shard(block, CONTEXTS, _shard_of(row_hash(rows[:, REACH : REACH + GRAM]), shards), [rows, docs])
        if hot.any():
            rows, docs = _hot_strings(*_gathered(parts, ids, np.sort(gram[hot]), 1 << 16))
            out += _by_shard(block, STRINGS, _shard_of(row_hash(rows), shards), [rows, docs])
            out.append((block, block % shards, HOT_GRAMS, int(hot.sum()), _pack(gram[hot]), b"", b""))
        return _table(out)
    return step


def refine(contexts: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the strings at each offset of the contexts: equal
    identifiers, equal strings. Bucket-pointer refinement from depth 8 to LENGTH."""
    n = len(contexts)
    buckets = np.stack([np.ascontiguousarray(contexts[:, k : k + 8]).view(np.uint64)[:, 0] for k in range(CONTEXT - 7)], 1)
    buckets = np.unique(buckets, return_inverse=True)[1].reshape(n, -1).astype(np.uint64)
    for _, pointer, depth in DEPTHS:
        width = CONTEXT - depth + 1
        pairs = (buckets[:, :width] << np.uint64(32)) | buckets[:, pointer : pointer + width]
        buckets = np.unique(pairs, return_inverse=True)[1].reshape(n, width).astype(np.uint64)
    return buckets


def repeated(contexts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of different contexts with their smallest documents: bits of the offsets whose
    string also starts in a context with a smaller document."""
    n = len(contexts)
    if not n:
        return np.zeros(0, np.int64)
    filled = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(contexts == PAD, 1)], 1)
    whole = filled[:, LENGTH:] == filled[:, : CONTEXT - LENGTH + 1]
    buckets = refine(contexts)
    least = np.full(int(buckets.max()) + 1, NO_ID)
    owner = np.broadcast_to(docs[:, None], buckets.shape)
    np.minimum.at(least, buckets[whole], owner[whole])
    found = whole & (least[buckets] < owner)
    return (found.astype(np.int64) << np.arange(found.shape[1], dtype=np.int64)).sum(1)


def judge_contexts(table: pa.Table) -> pa.Table:
    """Of one shard: what each block has to know about its contexts and strings."""
    out = [(r["block"], r["shard"], HOT_GRAMS, r["rows"], r["one"], b"", b"") for r in _rows(table, HOT_GRAMS)]
    shard = table.column("shard")[0].as_py()
    for kind, width in ((CONTEXTS, CONTEXT), (STRINGS, LENGTH)):
        sent = _rows(table, kind)
        if not sent:
            continue
        rows = np.concatenate([_unpack(r["one"], r["rows"], np.uint8, width) for r in sent])
        own = np.concatenate([_unpack(r["two"], r["rows"], np.int64) for r in sent])
        block = np.repeat([r["block"] for r in sent], [r["rows"] for r in sent])
        chosen, least, group = group_rows(rows, own)
        bits = np.zeros(len(chosen), np.int64)
        if kind == CONTEXTS:
            _, _, bucket = group_rows(rows[chosen][:, REACH : REACH + GRAM], least)
            order = np.argsort(bucket, kind="stable")
            size = np.bincount(bucket)[bucket[order]]
            order = order[size > 1]
            a = 0
            while a < len(order):  # whole q-gram buckets, some thousand contexts at a time
                b = min(a + 8192, len(order))
                while b < len(order) and bucket[order[b]] == bucket[order[b - 1]]:
                    b += 1
                some = order[a:b]
                bits[some] = repeated(rows[chosen[some]], least[some])
                a = b
        # Silence means: no smaller document elsewhere, and no repeated string.
        tell = np.flatnonzero((least[group] < own) | (bits[group] != 0))
        tell = tell[np.argsort(block[tell], kind="stable")]
        key = row_hash(rows[tell])
        for some in np.split(np.arange(len(tell)), np.flatnonzero(np.diff(block[tell])) + 1) if len(tell) else []:
            g = group[tell[some]]
            out.append((int(block[tell[some[0]]]), shard, kind, len(some), _pack(key[some]), _pack(least[g]), _pack(bits[g])))
    return _table(out)


def _answers(heard: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    said = _rows(heard, kind)
    key = np.concatenate([np.zeros(0, np.uint64), *(_unpack(r["one"], r["rows"], np.uint64) for r in said)])
    least = np.concatenate([np.zeros(0, np.int64), *(_unpack(r["two"], r["rows"], np.int64) for r in said)])
    bits = np.concatenate([np.zeros(0, np.int64), *(_unpack(r["three"], r["rows"], np.int64) for r in said)])
    order = np.argsort(key)
    return key[order], least[order], bits[order]


def _look_up(key: np.ndarray, table: np.ndarray, values: np.ndarray, missing: int) -> np.ndarray:
    if not len(table):
        return np.full(len(key), missing, np.int64)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, values[at], missing)


class Smallest:
    """Smallest document of each key, over the pieces of a block."""

    def __init__(self, keys: list[np.ndarray], docs: list[np.ndarray]):
        key, doc = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *docs])
        order = np.lexsort((doc, key))
        new = np.append(True, key[order][1:] != key[order][:-1])[: len(key)]
        self.key, self.doc = key[order][new], doc[order][new]

    def __call__(self, key: np.ndarray) -> np.ndarray:
        return _look_up(key, self.key, self.doc, int(NO_ID))


def removed_spans(table: pa.Table, heard: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the maximal removed runs of each document of a block."""
    ids, parts = _ids(table), pieces(table)
    key, least, bits = _answers(heard, CONTEXTS)
    skey, sleast, _ = _answers(heard, STRINGS)
    hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_unpack(r["one"], r["rows"], np.uint64) for r in _rows(heard, HOT_GRAMS))]))

    plain_keys, plain_docs, hot_keys, hot_docs, kept = [], [], [], [], []
    for p in parts:
        doc = ids[p.row + p.first_row]
        is_hot = np.zeros(len(p.gram), bool)
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, p.gram), len(hot) - 1)] == p.gram
        plain = np.flatnonzero(~is_hot)
        ck = row_hash(p.contexts(p.anchor[plain]))
        sat, sdoc, sk = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if is_hot.any():
            start = np.unique((p.anchor[is_hot][:, None] - np.arange(REACH + 1)).ravel())
            row = np.searchsorted(p.start, start, "right") - 1
            inside = (row >= 0) & (start >= p.start[row]) & (start + LENGTH <= p.start[row] + p.sizes[row])
            sat, row = start[inside], row[inside]
            sdoc = ids[row + p.first_row]
            sk = np.concatenate([np.zeros(0, np.uint64), *(row_hash(p.buf[sat[a : a + 65536, None] + np.arange(LENGTH)]) for a in range(0, len(sat), 65536))])
        plain_keys.append(ck), plain_docs.append(doc[plain]), hot_keys.append(sk), hot_docs.append(sdoc)
        kept.append((plain, ck, sat, sk, sdoc))
    here, here_strings = Smallest(plain_keys, plain_docs), Smallest(hot_keys, hot_docs)

    out = []
    for p, (plain, ck, sat, sk, sdoc) in zip(parts, kept):
        doc = ids[p.row[plain] + p.first_row]
        smallest = np.minimum(here(ck), _look_up(ck, key, least, int(NO_ID)))
        first = p.start[p.row[plain]]
        last = first + p.sizes[p.row[plain]]
        anchor = p.anchor[plain]
        cover = np.zeros(len(p.buf) + 1, np.int32)
        full = doc > smallest
        np.add.at(cover, np.maximum(anchor - REACH, first)[full], 1)
        np.add.at(cover, np.minimum(anchor + GRAM + REACH, last)[full], -1)
        some = np.flatnonzero(~full)
        mask = _look_up(ck[some], key, bits, 0)
        some, mask = some[mask != 0], mask[mask != 0]
        which, offset = np.nonzero((mask[:, None] >> np.arange(REACH + 1, dtype=np.int64)) & 1)
        start = np.concatenate([anchor[some][which] - REACH + offset, sat[sdoc > np.minimum(here_strings(sk), _look_up(sk, skey, sleast, int(NO_ID)))]])
        np.add.at(cover, start, 1)
        np.add.at(cover, start + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = np.searchsorted(p.start, begins, "right") - 1
        cuts = np.searchsorted(row, np.arange(len(p.sizes) + 1))
        for k in range(len(p.sizes)):
            s = slice(cuts[k], cuts[k + 1])
            out.append((begins[s] - p.start[k], ends[s] - p.start[k]))
    return out


def whole_characters(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The text without the characters that lie in a run with all their bytes."""
    out, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = max(a, b)
    return b"".join([*out, text[at:]])


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                 with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left), starts, ends
    (the removed runs), and with ``with_text`` kept_text, which is cut at whole characters.
    Columns named in ``carry`` come along as carry_0, carry_1, ..."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // SHARD_BYTES))
    # A few large blocks a partition would be dealt unevenly by their hash; many small ones are not.
    source = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    grams = source.groupBy("block").applyInArrow(send_grams(shards), MESSAGE)
    shared = grams.groupBy("shard").applyInArrow(shared_grams, MESSAGE)
    contexts = source.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_contexts(shards), MESSAGE)
    answers = contexts.groupBy("shard").applyInArrow(judge_contexts, MESSAGE)

    extra = [(f.name, f.dataType.simpleString()) for f in source.schema.fields if f.name.startswith("carry_")]
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
              + ", kept_text string" * with_text + "".join(f", {n} {t}" for n, t in extra))

    def finish(table: pa.Table, heard: pa.Table) -> pa.Table:
        columns: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", *["kept_text"] * with_text)}
        buf, offsets = tb.text_buffer(table.column("text"))
        spans = removed_spans(table, heard) if len(table) else []
        for k, (starts, ends) in enumerate(spans):
            text = buf[offsets[k] : offsets[k + 1]]
            left = np.ones(len(text), bool)
            for a, b in zip(starts, ends):
                left[a:b] = False
            columns["n_bytes"].append(len(text))
            columns["n_removed"].append(int((ends - starts).sum()))
            columns["n_spans"].append(len(starts))
            columns["kept_sha256"].append(hashlib.sha256(text[left].tobytes()).hexdigest())
            columns["starts"].append(starts)
            columns["ends"].append(ends)
            if with_text:
                columns["kept_text"].append(whole_characters(text.tobytes(), starts, ends).decode())
        kinds = {"kept_sha256": pa.string(), "kept_text": pa.string(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}
        made = {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in columns.items()}
        return pa.table({"doc_id": table.column("doc_id"), **made, **{n: table.column(n) for n, _ in extra}})

    return source.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut out of the text (whole characters); other columns stay,
    but the character count, if there is one, is renewed. A null text stays null."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    found = find_repeats(docs.withColumn("__no_text", F.col(text_col).isNull()), id_col, text_col, (id_col, "__no_text", *others), with_text=True)
    text = F.when(~F.col("carry_1"), F.col("kept_text"))
    back = {id_col: F.col("carry_0"), text_col: text, **{c: F.col(f"carry_{k + 2}") for k, c in enumerate(others)}}
    if length_col in docs.columns:
        back[length_col] = F.length(text).cast(docs.schema[length_col].dataType)
    return found.select(*[back[c].alias(c) for c in docs.columns])
