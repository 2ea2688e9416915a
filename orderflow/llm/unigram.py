"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text becomes ``▁`` + text with every blank as ``▁``; the best segmentation
into pieces maximises the sum of the pieces' scores, as the model file gives
them (they are taken as log scores). A character that no piece covers costs the
smallest score less 10 and is written as its bytes' pieces. Ties go to the
segmentation whose last piece starts first, then its prefix likewise: starts
are tried from left to right and only a strictly better sum replaces one found.

Pieces hold ``▁`` only at their start (checked when the model is read) and no
newline, so the best segmentation of a text is the concatenation of those of
its words. Words are looked up in a table; the words that are new to a batch
are segmented together, position by position, with numpy.

Defined cases: a null text is the empty one and has no pieces; repeated rows
are encoded each; decoding an encoded text gives the text back unless it holds
a literal ``▁``, which decodes as a blank.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10
MEMO_MOST = 250_000         # words remembered by a worker; the table starts anew when full
LOCKSTEP_BYTES = 48         # longer words are segmented one at a time


class DoubleArray:
    """Trie over bytes: from state s, byte c leads to ``base[s] + c`` if ``check`` there is s."""

    def __init__(self, keys: dict[bytes, int]):
        root: dict = {}
        for key, value in keys.items():
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 12
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        todo, low = [(root, 0)], 1
        while todo:
            node, state = todo.pop()
            value[state] = node.get(-1, -1)
            children = np.array(sorted(c for c in node if c >= 0), np.int64)
            if not len(children):
                continue
            offset = max(low - children[0], 0)
            while True:
                if offset + 512 >= len(check):
                    base, check, value = (np.concatenate([a, np.full(len(a), fill, np.int64)]) for a, fill in ((base, 0), (check, -1), (value, -1)))
                if offset and (check[offset + children] < 0).all():
                    break
                free = np.flatnonzero(check[offset + children[0] + 1 :][:4096] < 0)
                offset = offset + 1 + int(free[0]) if len(free) else offset + 4096
            base[state] = offset
            check[offset + children] = state
            while check[low] >= 0:
                low += 1
            todo += [(node[int(c)], int(offset + c)) for c in children]
        self.base, self.check, self.value = base, check, value


class Model:
    """Pieces, scores, byte pieces and the trie; plain arrays, a few MB for 32,000 pieces."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], skipped: set[int]):
        normal = {p.encode(): i for i, p in enumerate(pieces) if i not in skipped and i not in byte_ids.values() and p}
        if any(MARK in k.decode().lstrip(MARK) or b"\n" in k for k in normal):
            raise ValueError("a piece holds a whitespace marker after its start, or a newline")
        self.pieces, self.scores = pieces, np.array(scores, float)
        self.trie = DoubleArray(normal)
        self.byte_id = np.array([byte_ids.get(b, -1) for b in range(256)], np.int64)
        self.unknown = float(min(self.scores[i] for i in normal.values())) - UNKNOWN_PENALTY
        self.unknown_id = min(skipped, default=0)
        written = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in byte_ids.items():
            written[i] = bytes([b])
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.written_size = np.array([len(w) for w in written], np.int64)
        self.written_at = np.cumsum(self.written_size) - self.written_size

    @classmethod
    @lru_cache(maxsize=2)
    def read(cls, path: str) -> "Model":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        skipped = {i for i in range(n) if sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)}
        return cls(pieces, [sp.get_score(i) for i in range(n)], byte_ids, skipped)

    # -- segmentation ---------------------------------------------------

    def _spell(self, word: bytes, steps: list[tuple[int, int, int]]) -> list[int]:
        out: list[int] = []
        for start, end, piece in steps:
            if piece >= 0:
                out.append(piece)
            elif (self.byte_id >= 0).all():
                out += self.byte_id[list(word[start:end])].tolist()
            else:
                out.append(self.unknown_id)
        return out

    def segment_one(self, word: bytes) -> list[int]:
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(word)
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            if word[start] & 0xC0 == 0x80:
                continue
            char = start + 1
            while char < n and word[char] & 0xC0 == 0x80:
                char += 1
            here, state, covered = best[start], 0, False
            for end in range(start + 1, n + 1):
                nxt = base[state] + word[end - 1]
                if check[nxt] != state:
                    break
                state = nxt
                if value[state] >= 0:
                    covered |= end == char
                    got = here + scores[value[state]]
                    if got > best[end]:
                        best[end], back[end] = got, (start, int(value[state]))
            if not covered and here + self.unknown > best[char]:
                best[char], back[char] = here + self.unknown, (start, -1)
        steps, at = [], n
        while at:
            start, piece = back[at]
            steps.append((start, at, piece))
            at = start
        return self._spell(word, steps[::-1])

    def segment_many(self, words: list[bytes]) -> list[bytes]:
        """``segment_one`` for many short words, one position of all of them at a time
        (ids as int32 bytes); words with characters that no piece covers are done again alone."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        size = np.array([len(w) for w in words])
        wide = int(size.max(initial=0))
        text = np.zeros((len(words), wide + 1), np.int64)
        for i, w in enumerate(words):
            text[i, : len(w)] = np.frombuffer(w, np.uint8)
        best = np.full((len(words), wide + 1), -np.inf)
        best[:, 0] = 0
        came = np.zeros((len(words), wide + 1), np.int64)
        piece = np.full((len(words), wide + 1), -1, np.int64)
        cont = (text & 0xC0) == 0x80
        for start in range(wide):
            rows = np.flatnonzero((size > start) & ~cont[:, start])
            if not len(rows):
                continue
            char = np.full(len(words), start + 1)
            for j in range(start + 1, min(start + 4, wide)):
                char[(char == j) & cont[:, j]] = j + 1
            covered = np.zeros(len(words), bool)
            unknown_rows, state = rows, np.zeros(len(rows), np.int64)
            for end in range(start + 1, wide + 1):
                nxt = base[state] + text[rows, end - 1]
                ok = check[nxt] == state
                rows, state = rows[ok], nxt[ok]
                if not len(rows):
                    break
                hit = value[state] >= 0
                r, v = rows[hit], value[state[hit]]
                covered[r[char[r] == end]] = True
                got = best[r, start] + scores[v]
                better = got > best[r, end]
                r, v, got = r[better], v[better], got[better]
                best[r, end], came[r, end], piece[r, end] = got, start, v
                stay = size[rows] > end
                rows, state = rows[stay], state[stay]
            r = unknown_rows[~covered[unknown_rows]]
            got = best[r, start] + self.unknown
            better = got > best[r, char[r]]
            r, got = r[better], got[better]
            best[r, char[r]], came[r, char[r]], piece[r, char[r]] = got, start, -1
        ids = np.full((len(words), wide + 1), -2, np.int64)  # pieces from the end, right-aligned
        rows, at, column = np.arange(len(words)), size.copy(), wide
        while len(rows := rows[at[rows] > 0]):
            ids[rows, column] = piece[rows, at[rows]]
            at[rows] = came[rows, at[rows]]
            column -= 1
        known = (ids != -1).all(1)
        taken = ids >= 0
        flat, ends = ids[taken].astype(np.int32).tobytes(), np.cumsum(taken.sum(1) * 4).tolist()
        out, before = [], 0
        for w, plain, end in zip(words, known.tolist(), ends):
            out.append(flat[before:end] if plain else np.array(self.segment_one(w), np.int32).tobytes())
            before = end
        return out

    # -- decoding -------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the decoded pieces, with the blank of the leading marker."""
        size = self.written_size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.written_at[ids] - (ends - size), size)
        return self.written[at + np.arange(len(at))]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64))[1:].tobytes().decode(errors="replace")


class Table(dict):
    """Words segmented so far; notes the ones it is asked for in vain."""

    def __init__(self):
        super().__init__()
        self.missed: set[str] = set()

    def __missing__(self, chunk: str) -> bytes:
        self.missed.add(chunk)
        return b""


class Encoder:
    """A model with its table of words already segmented (ids as int32 bytes)."""

    _slow = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")

    def __init__(self, model: Model):
        self.model = model
        self.words = Table()

    def chunks(self, text: str) -> list[str]:
        """Independent parts of the marked text. ``x`` stands for ``▁x``; parts that
        start a line without a marker are prefixed by a newline."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " ":
            out = []
            for part in self._slow.findall(MARK + text.replace(" ", MARK)):
                if part[:1] == MARK and part[1:2] != MARK:
                    out.append(part[1:])
                elif part[0] == MARK or part == "\n":
                    out.append(part)
                elif out and out[-1] == "\n":
                    out[-1] = "\n" + part
                else:
                    out.append("\n\n" + part)
            return out
        if "\n" not in text:
            return text.split(" ")
        return text.replace("\n", " \n").split(" ")

    def _bytes_of(self, chunk: str) -> tuple[bytes, bytes]:
        """(ids to write first, bytes to segment) of a chunk."""
        if chunk[:2] == "\n\n":
            return b"", chunk[2:].encode()
        if chunk[:1] == "\n":
            newline = np.array(self.model.segment_one(b"\n"), np.int32).tobytes()
            return newline, chunk[1:].encode()
        return b"", (chunk if chunk[:2] == MARK + MARK else MARK + chunk).encode()

    def learn(self, new: list[str]) -> None:
        parts = [self._bytes_of(c) for c in new]
        order = sorted((k for k in range(len(new)) if len(parts[k][1]) <= LOCKSTEP_BYTES), key=lambda k: len(parts[k][1]))
        for a in range(0, len(order), 4096):
            some = order[a : a + 4096]
            for k, ids in zip(some, self.model.segment_many([parts[k][1] for k in some])):
                self.words[new[k]] = parts[k][0] + ids
        for k, c in enumerate(new):
            if len(parts[k][1]) > LOCKSTEP_BYTES:
                self.words[c] = parts[k][0] + np.array(self.model.segment_one(parts[k][1]), np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > MEMO_MOST:
            self.words = Table()
        words = self.words
        split = [self.chunks(t) for t in texts]
        out = [b"".join(map(words.__getitem__, s)) for s in split]
        if words.missed:
            new, words.missed = list(words.missed), set()
            self.learn(new)
            out = [b"".join(map(words.__getitem__, s)) for s in split]
        return [np.frombuffer(ids, np.int32) for ids in out]


def round_trips(model: Model, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
    return [model.decode_bytes(i)[1:].tobytes() == t.encode() for i, t in zip(ids, texts)]


_encoders: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_pieces[, ids], ids_sha256, round_trip) of every row; one map.

    ``ids_sha256`` is over the ids as little-endian int32; ``round_trip`` tells
    whether decoding the ids gives the text. The model (a few MB, bounded by
    the vocabulary) is read on the driver and broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model.read(model_path))
    key = f"{model_path}:{id(model)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(model.value)
        encoder = _encoders[key]
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = encoder.encode(texts)
                columns = {
                    "doc_id": part.column(0),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_pieces": pa.array([len(i) for i in ids], pa.int64()),
                }
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                columns["ids_sha256"] = pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids], pa.string())
                columns["round_trip"] = pa.array(round_trips(encoder.model, ids, texts), pa.bool_())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_bytes long, n_pieces long, " + "ids array<int>, " * with_ids + "ids_sha256 string, round_trip boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row: the text of its piece ids, byte pieces joined to characters and
    markers turned to blanks, without the blank of the leading marker; one map.

    Null or empty ids give an empty text; ids that the model lacks, or null among them, are left out; bytes
    that are no UTF-8 become the replacement character; other columns are not looked at.
    """
    model = encoded.sparkSession.sparkContext.broadcast(Model.read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = len(model.value.pieces)
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                ids = [np.array([i for i in row or () if i is not None and 0 <= i < known], np.int64) for row in part.column(1).to_pylist()]
                texts = [model.value.decode_bytes(i).tobytes().removeprefix(b" ").decode(errors="replace") for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
