"""Per-document text statistics: the inputs of the quality models and rules.

``document_stats`` is one map over whole texts (no shuffle). A null text has
the statistics of an empty one; every ratio of an empty text is 0. Words are
``[^\\x20\\x09-\\x0D]+``, lines are cut at ``\\n``, letters count in A-Z and a-z
only where a statistic says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm import textbytes as tb

REPEAT_WORDS = 5
SYMBOLS = b"#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_word_share",
            "upper_share", "bang_per_word", "digit_share", "other_punct_per_word", "distinct_word_share", "longest_word_share")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _BANG, _DIGIT = _table(SYMBOLS), _table(b"!"), _table(b"0123456789")
_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))
_PUNCT = _table(b".,;:?\"'()[]{}-_/\\@^~`+=")


def _per_row_distinct(key: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct keys of each row."""
    if not len(key):
        return np.zeros(rows, np.int64)
    key = _of_row(key, row)
    order = np.argsort(key)
    key, row = key[order], row[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount(row[new], minlength=rows).astype(np.int64)


def _of_row(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that also tell rows apart, so that one sort serves all rows."""
    return key ^ tb.mix(row.astype(np.uint64) + np.uint64(1))


def _repeated_words(words: tb.Words, hashes: np.ndarray) -> np.ndarray:
    """Words inside a 5-word window that its text holds twice or more."""
    at, key = tb.windows(hashes, words.row, REPEAT_WORDS)
    if not len(at):
        return np.zeros(words.rows, np.int64)
    key = _of_row(key, words.row[at])
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(hashes), bool)
    twice[at[order[1:][same]]] = True
    twice[at[order[:-1][same]]] = True
    covered = twice.copy()
    for j in range(1, REPEAT_WORDS):
        covered[j:] |= twice[:-j]
    return np.bincount(words.row[covered], minlength=words.rows).astype(np.int64)


def stats_of(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All statistics of the texts ``buf[offsets[i]:offsets[i + 1]]``."""
    words, ranges = tb.Words(buf, offsets), tb.RangeHash(buf)
    hashes, rows, n = words.hashes(ranges), words.rows, words.count
    whole = lambda flags: tb.per_row(flags, offsets)

    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    newline = buf == 10
    starts = np.flatnonzero(edge[:-1] | np.concatenate([[False], newline[:-1]])) if len(buf) else np.zeros(0, np.int64)
    ends = np.flatnonzero(newline | edge[1:]) if len(buf) else np.zeros(0, np.int64)
    ends = np.where(newline[ends], ends, ends + 1) if len(ends) else ends
    filled = np.concatenate([[0], np.cumsum(words.inside, dtype=np.int64)])
    holds = filled[ends] > filled[starts]
    starts, ends = starts[holds], ends[holds]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    lines = np.bincount(line_row, minlength=rows).astype(np.int64)
    dup_lines = lines - _per_row_distinct(ranges(starts, ends), line_row, rows)

    out = {
        "n_bytes": np.diff(offsets), "n_words": n, "word_chars": whole(words.inside & ((buf & 0xC0) != 0x80)),
        "n_symbols": whole(_SYMBOL[buf]), "n_dup_lines": dup_lines, "n_repeat_words": _repeated_words(words, hashes),
    }
    per = np.maximum(n, 1).astype(float)
    longest = np.zeros(rows, np.int64)
    if len(words.start):
        longest[n > 0] = np.maximum.reduceat(words.end - words.start, words.first_word[:-1][n > 0])
    letters = np.maximum(whole(_LETTER[buf]), 1)
    size = np.maximum(out["n_bytes"], 1)
    out |= {
        "log_words": np.log1p(n.astype(float)), "mean_word_chars": out["word_chars"] / per, "symbols_per_word": out["n_symbols"] / per,
        "dup_line_share": dup_lines / np.maximum(lines, 1), "repeat_word_share": out["n_repeat_words"] / per,
        "upper_share": whole(_UPPER[buf]) / letters, "bang_per_word": whole(_BANG[buf]) / per, "digit_share": whole(_DIGIT[buf]) / size,
        "other_punct_per_word": whole(_PUNCT[buf]) / per, "distinct_word_share": _per_row_distinct(hashes, words.row, rows) / per,
        "longest_word_share": longest / size,
    }
    return out


def batch_stats(column: pa.Array) -> dict[str, np.ndarray]:
    buf, offsets = tb.text_buffer(column)
    parts = [stats_of(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tb.slices(buf, offsets)]
    parts = parts or [stats_of(buf, offsets)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


SCHEMA = ("doc_id long, n_bytes long, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES))


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, base counts, model features), one row for each input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = batch_stats(b.column(1))
            names = ("n_bytes", *BASE, *FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[c]) for c in names)], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, learn: "F.Column | None" = None,
                    label_col: str = "quality") -> "tuple[np.ndarray, np.ndarray]":
    """Feature matrix and 0/1 labels of at most ``most`` labelled documents.

    The sample is the labelled ids of smallest hash, so it does not depend on
    the order of rows. Null ids and null labels are left out; a document with
    contradicting labels counts as 0. At most ``most`` ids are broadcast and at
    most ``most`` rows come to the driver.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
    if learn is not None:
        rows = rows.filter(learn)
    chosen = rows.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    stats = document_stats(texts.join(F.broadcast(chosen.select("id")), "id", "left_semi"), "id")
    got = (stats.join(F.broadcast(chosen), stats.doc_id == chosen.id).select("doc_id", "y", *FEATURES)
           .orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(most).toPandas())
    return got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(int)
