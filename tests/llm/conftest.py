"""Small awkward tables for the training-data operators."""

from __future__ import annotations

import random

import pytest

from orderflow.llm.workers import let_workers_import

EXTRA = "lang string, source string, n_chars long, kept string, score string, block string, shard string, part string, class_id string, text_b string"


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    let_workers_import(spark)


def awkward_texts() -> list[tuple[int | None, str | None]]:
    """Texts with repeats, near copies, shared passages, nulls, blanks, odd characters, one long one."""
    rng = random.Random(11)
    vocabulary = [a + b for a in ("al", "ber", "con", "dré", "fen", "ügo", "ha", "ist") for b in ("ta", "ren", "us", "o", "ling", "sch")]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = line(30)
    rows: list[tuple[int | None, str | None]] = [(i, line(rng.randint(1, 60))) for i in range(40)]
    rows += [(40 + i, line(5) + "\n" + passage + "\n" + line(5)) for i in range(6)]
    base = line(200).split(" ")
    for i in range(8):
        copy = list(base)
        copy[rng.randrange(200)] = "changed"
        rows.append((50 + i, " ".join(copy)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (61, rows[3][1]), (62, None), (63, ""), (64, "  \n\t "), (65, "a"), (66, "☃ 日本語 İ ΣΑΣ ﬁ x"),
             (67, "ab" * 120), (68, line(6000)), (None, rows[5][1]), (None, None), (-7, rows[6][1]), (69, "same\nsame\nsame\n"), (70, "x" * 50), (71, "x" * 51), (5, rows[9][1])]
    return rows


@pytest.fixture(scope="session")
def texts():
    return awkward_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", None, "x", "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def thue_morse(n: int) -> tuple[str, str]:
    """Two different strings of ``n`` (a power of two) letters that every polynomial hash modulo 2**64
    takes for one, from 1,024 letters on."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})
