"""Spelling variants: words one edit apart, found by permuterm rotations.

1. One map counts the words of the texts, each task in a table of bounded size that it sends
   when full; a grouped sum makes the vocabulary. A hashed share of the words loses a letter
   (``damage``), the noise that the grouping has to mend.
2. Each word gets a terminator and all its rotations. A rotation that starts right after the
   character x of a word ``a x b`` is ``b $ a x``: without its last character it is the prefix
   ``b $ a``, which skips the edited place. Words that differ by a replacement have rotations
   under one prefix; the word ``a b``, shorter by x, has that prefix as a whole rotation. So
   the rotations are dealt and sorted by prefix, and a scan over each prefix's range
   tells every word in it how many others are there and which of them is the most frequent.
   A range holds at most one word per letter of the alphabet and the shorter word, whatever
   the input; pairs are never written.
3. In a run of equal characters every deletion gives one word; only that of the run's last
   character counts, so each near pair meets in one range.
4. A grouped sum over a word's ranges gives its number of near words and its form; roots follow
   the forms by pointer doubling. A form is ``ratio`` times as frequent, so chains are short.

Defined cases: a null or empty text has no words; a null id hashes like an empty one; repeated
rows count again; very long texts are read whole, in slices cut between words; prefixes of very
long words are compared by two hashes modulo 2**61 - 1; a word without near words has n_near 0 and is its own root. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.operators.ranking import global_position
from orderflow.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
END = "$"                       # the terminator; never part of a word
SLICE_CHARS = 1 << 20
TABLE_WORDS = 1 << 18           # different words that a task holds before it sends them
LONG_PREFIX = 64                # characters; longer prefixes are told apart by hashes
PRIME = (1 << 61) - 1
BASES = (1_000_003_919, 2_147_483_693)


@dataclass(frozen=True)
class Spelling:
    """Parameters: which words take part, and how much more frequent a form is."""

    least_chars: int = 6
    least_count: int = 5
    ratio: int = 5
    damage: int = 199           # one in so many (document, word) loses a letter; 0: none


def word_slices(text: str) -> Iterator[str]:
    """The text in slices that are cut between words; a longer word is a slice of its own."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        inside = RUN.match(text, at + SLICE_CHARS)
        cut = inside.end() if inside else at + SLICE_CHARS
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_words(doc_id: int | None, text: str, spelling: Spelling) -> Counter:
    """Lower-cased words of one text; those whose hash says so without one letter."""
    seed, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for part in word_slices(text):
        for word, n in Counter(RUN.findall(part.translate(LOWER) if not part.isascii() else part.lower())).items():
            h = zlib.crc32(word.encode(), seed)
            if spelling.damage and h % spelling.damage == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            out[word] += n
    return out


def vocabulary(docs: DataFrame, spelling: Spelling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words that are long and frequent enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                total.update(count_words(doc_id, text.as_py() or "", spelling))
                if len(total) > TABLE_WORDS:
                    yield _counts(total, spelling)
                    total = Counter()
        yield _counts(total, spelling)

    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= spelling.least_count)


def _counts(total: Counter, spelling: Spelling) -> pa.RecordBatch:
    some = [(w, n) for w, n in total.items() if len(w) >= spelling.least_chars]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, id, n, whole, last) of words (id, word, n): every rotation without its last character,
    and every whole one. ``last``: the skipped character ends its run of equal ones."""
    size, at = F.length("word"), F.col("at")
    cut = lambda start, n: F.substring(F.col("word"), start, n)
    # Place k (from 1) is the k-th character, which is skipped, or the gap in front of it.
    skip = F.struct(F.concat(cut(at + 1, size), F.lit(END), cut(F.lit(1), at - 1)).alias("prefix"), F.lit(False).alias("whole"),
                    (cut(at, F.lit(1)) != cut(at + 1, F.lit(1))).alias("last"))
    full = F.struct(F.concat(cut(at, size), F.lit(END), cut(F.lit(1), at - 1)).alias("prefix"), F.lit(True).alias("whole"), F.lit(True).alias("last"))
    both = F.when(at > size, F.array(full)).when(size < LONG_PREFIX, F.array(skip, full)).otherwise(F.array(skip))
    place = words.filter(size <= LONG_PREFIX).select("id", "n", "word", F.explode(F.sequence(F.lit(1), F.when(size < LONG_PREFIX, size + 1).otherwise(size))).alias("at"))
    plain = place.select("id", "n", F.explode(both).alias("r"))
    return plain.select("r.prefix", "id", "n", "r.whole", "r.last").unionByName(
        words.filter(size >= LONG_PREFIX).select("id", "n", "word").mapInArrow(_long_rotations, "prefix string, id long, n long, whole boolean, last boolean"))


def _hashes(word: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each base: hashes of the prefixes without their last character, and of the whole rotations."""
    codes, n = [ord(c) for c in word], len(word)
    for base in BASES:
        power, front, back = np.ones(n + 2, object), np.zeros(n + 1, object), np.zeros(n + 2, object)
        for k in range(n):
            power[k + 1] = power[k] * base % PRIME
            front[k + 1] = (front[k] + codes[k] * power[k]) % PRIME
        power[n + 1] = power[n] * base % PRIME
        for k in range(n - 1, -1, -1):
            back[k] = (back[k + 1] * base + codes[k]) % PRIME
        end = ord(END)
        skip = [(back[k + 1] + end * power[n - k - 1] + front[k] * power[n - k]) % PRIME for k in range(n)]
        full = [(back[k] + end * power[n - k] + front[k] * power[n - k + 1]) % PRIME for k in range(n + 1)]
        yield skip, full


def _long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rotations`` of long words: a prefix longer than LONG_PREFIX is its length and two hashes
    modulo 2**61 - 1, so a word of a million characters takes a million short rows."""
    names = ["prefix", "id", "n", "whole", "last"]
    for batch in batches:
        for i, n, word in zip(*(c.to_pylist() for c in batch.columns)):
            (skip, full), (skip_b, full_b) = _hashes(word)
            rows = [(f"{len(word) + 1}:{x:x}:{y:x}", i, n, True, True) for x, y in zip(full, full_b)]
            if len(word) > LONG_PREFIX:
                rows += [(f"{len(word)}:{x:x}:{y:x}", i, n, False, word[k] != word[k + 1 : k + 2]) for k, (x, y) in enumerate(zip(skip, skip_b))]
            for a in range(0, len(rows), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + (1 << 14)])], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): for words with near words, their number and the most frequent of them
    as (-n, id); ids follow the code-point order."""
    # The scan of a sorted range: what precedes and follows a word in the order of frequency.
    order = Window.partitionBy("prefix").orderBy(F.desc("n"), "id")
    all_of = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct((-F.col("n")).alias("n"), "id")
    first = lambda rows, which: F.first(F.when(which, member), ignorenulls=True).over(rows)
    skip, indel = ~F.col("whole"), ~F.col("whole") & F.col("last")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    scanned = rotations(words).select(
        "id", "whole", "last",
        F.sum(skip.cast("int")).over(all_of).alias("skips"), F.sum(indel.cast("int")).over(all_of).alias("indels"),
        F.coalesce(first(before, skip), first(behind, skip)).alias("other"),
        first(all_of, F.col("whole")).alias("shorter"), first(all_of, indel).alias("longer"))
    has_shorter = F.col("last") & F.col("shorter").isNotNull()
    found = scanned.select(
        "id",
        F.when(F.col("whole"), F.col("indels")).otherwise(F.col("skips") - 1 + has_shorter.cast("int")).alias("near"),
        F.when(F.col("whole"), F.col("longer")).when(has_shorter, F.least("other", "shorter")).otherwise(F.col("other")).alias("best"))
    return found.filter("near > 0").groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for every row (id, form) with a form: each round doubles the length of the way
    that a pointer has followed, so chains of length d take log2(d) rounds."""
    at = cut_lineage(forms.filter("form IS NOT NULL").select("id", F.col("form").alias("root"), F.lit(True).alias("open")))
    while at.filter("open").limit(1).count():
        ahead = at.select(F.col("id").alias("__at"), F.col("root").alias("__root"))
        met = at.join(ahead, at["root"] == ahead["__at"], "left")
        at = cut_lineage(met.select("id", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("open")))
    return at.select("id", "root")


def variants(docs: DataFrame, spelling: Spelling = Spelling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = cut_lineage(global_position(vocabulary(docs, spelling, id_col, text_col), ["word"], "id"))
    best_n = -F.col("best.n")
    mended = best_n >= spelling.ratio * F.col("n")
    judged = cut_lineage(words.join(near_words(words), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(mended, F.col("best.id")).alias("form"), F.when(mended, best_n).alias("form_n")))
    name = lambda key, column: words.select(F.col("id").alias(key), F.col("word").alias(column))
    ends = roots(judged).join(name("root", "root_word"), "root").select("id", "root_word")
    return (judged.join(name("form", "form_word"), "form", "left").join(ends, "id", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"))
