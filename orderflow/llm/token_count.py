"""Token counts with a whole-token shortcut.

Most pre-tokens of a text are vocabulary entries that encode alone as exactly
one token. Which ones do is proven once per worker by encoding the vocabulary
itself; they count 1 by a table look-up. Merges are run only for the rest, and
their counts are memoised in a table of bounded size.

The counts are those of the ``tokenizers`` library for the same file, without
begin, end or added tokens; special strings inside a text count as one token,
as the library's default has it. Texts outside Latin-1 are normalised and split
by the library's own components, others by an equivalent compiled pattern.

Defined cases: a null text counts as the empty one (0 bytes, 0 tokens); an empty
table gives no rows; repeated rows are counted each.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_LIMIT = 2048
MEMO_MOST = 800_000         # entries of the table of counts; it starts anew when full


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _latin(prefix: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c)).startswith(prefix))


class Counter:
    """Counts tokens of texts for one word-level BPE file (JSON text)."""

    def __init__(self, model_json: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model_json)
        spec = json.loads(model_json)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        letters, numbers, blank = _latin("L"), _latin("N"), " \t-\r\x85\xa0"
        self.latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blank}{letters}{numbers}]+")
        self.stand_in = byte_alphabet()
        self.whole = self._prove(spec["model"]["vocab"])
        self.tokens = Tokens(self)

    def _prove(self, vocab: dict[str, int]) -> dict[str, int]:
        """Vocabulary strings that, alone, are one pre-token and one token."""
        back = {c: b for b, c in self.stand_in.items()}
        out = {}
        for piece in vocab:
            if not piece.endswith(self.suffix):
                continue
            shown = piece[: len(piece) - len(self.suffix)]
            try:
                text = bytes(back[c] for c in shown).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and len(self.library.model.tokenize(shown)) == 1:
                out[text] = 1
        return out

    def merge(self, word: str) -> int:
        """Tokens of one pre-token by the library's merges."""
        return len(self.library.model.tokenize("".join(map(self.stand_in.__getitem__, word.encode()))))

    def pre_tokens(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.latin.findall(text.lower())
        except UnicodeEncodeError:
            back = {c: b for b, c in self.stand_in.items()}
            shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(back[c] for c in s).decode() for s, _ in shown]

    def count(self, text: str) -> int:
        parts, total = [text], 0
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            total += sum(map(self.tokens.__getitem__, self.pre_tokens(part)))
        if len(self.tokens) > MEMO_MOST:
            self.tokens = Tokens(self)
        return total


class Tokens(dict):
    """Tokens of each pre-token: 1 for the proven ones, else merged once and remembered."""

    def __init__(self, counter: Counter):
        super().__init__(counter.whole)
        self.merge = counter.merge

    def __missing__(self, word: str) -> int:
        n = self[word] = self.merge(word)
        return n


_counters: dict[int, tuple[str, Counter]] = {}


def _counter(model_json: str) -> Counter:
    """One counter per worker process and file."""
    key = hash(model_json)
    if key not in _counters or _counters[key][0] != model_json:
        _counters.clear()
        _counters[key] = (model_json, Counter(model_json))
    return _counters[key][1]


def token_counts(docs: DataFrame, model_path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; one map, no shuffle.

    The file is read on the driver; its text (1 to 2 MB) is broadcast.
    """
    with open(model_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model.value)
        for b in batches:
            sizes, counts = [], []
            for value in b.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
