from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from orderflow.llm import token_count as tc
from orderflow.llm import unigram as u

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["İSTANBUL ΑΣ Σ ﬁ ①², ½x'll I'VE don't 日本語 é \x85a\xa0b\x1cc", "<|endoftext|> hi<|startoftext|><|endoftext", "a" * 300, "!!!???", "☃ ☃",
       "ÀÉß µ ª º", "\x00\x01 \x7f \xad", "'S 'tis", "<|", "\r\n\t ", "x" * 5000]


def test_counts_equal_the_library(docs, texts, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    counter = tc.Counter(open(BPE, encoding="utf-8").read())
    for t in ODD:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    got = sorted((tuple(r) for r in tc.token_counts(docs, BPE, limit=100).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in texts]
    assert got == sorted(want, key=str)
    assert tc.token_counts(no_docs, BPE).count() == 0


def test_counts_survive_a_full_table(monkeypatch, texts):
    counter = tc.Counter(open(BPE, encoding="utf-8").read())
    want = [counter.count(t or "") for _, t in texts]
    monkeypatch.setattr(tc, "MEMO_MOST", 10)
    assert [counter.count(t or "") for _, t in texts] == want


@pytest.fixture(scope="module")
def model():
    return u.Model.read(PIECES)


def test_words_equal_whole_text_viterbi(model):
    """Segmenting word by word equals one Viterbi run over the whole marked text."""
    rng, encoder = random.Random(2), u.Encoder(model)
    for _ in range(1500):
        t = "".join(rng.choice("ab ▁\n☃é☺xthe日") for _ in range(rng.randint(0, 30)))
        whole = model.segment_one((u.MARK + t.replace(" ", u.MARK)).encode()) if t else []
        assert encoder.encode([t])[0].tolist() == whole
        if u.MARK not in t:
            assert model.decode(np.array(whole, np.int64)) == t


def test_equals_the_library_as_a_unigram_model(texts):
    """The library, told that the pieces are a unigram model, segments alike. Scores below
    -40000 are raised to that for both: the library adds them in single precision."""
    import sentencepiece
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own = u.Model.read(PIECES)
    own = u.Model(own.pieces, np.maximum(own.scores, -40000).tolist(), {b: int(i) for b, i in enumerate(own.byte_id)}, {0, 1, 2})
    encoder = u.Encoder(own)
    for t in [x for _, t in texts if t for x in t.split("\n") if x][:60]:
        assert encoder.encode([t[:300]])[0].tolist() == library.encode(t[:300])


def test_exhaustive_segmentation(model):
    """No segmentation of a short word scores better."""
    known = {w: i for i, w in enumerate(model.pieces) if i > 258}

    def best(word):
        if not word:
            return 0.0
        return max([model.scores[known[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in known], default=-np.inf)

    for word in ("▁the", "▁unhappy", "▁banana", "▁lichung"):
        assert model.scores[model.segment_one(word.encode())].sum() == best(word)


def test_documents(docs, texts, no_docs, model):
    encoder = u.Encoder(model)
    rows = u.encode_documents(docs, PIECES).collect()
    want = sorted((i, encoder.encode([t or ""])[0].tolist()) for i, t in texts if i is not None)
    assert sorted((r.doc_id, r.ids) for r in rows if r.doc_id is not None) == want
    for r in rows:
        assert r.n_pieces == len(r.ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()
    assert u.encode_documents(no_docs, PIECES, with_ids=False).collect() == []


def test_registered_encoding_returns_the_ids(spark):
    from orderflow.llm.registry import QUERIES

    rows = QUERIES["op9_sentencepiece"](spark, "/root/testdata/sf0.001").limit(50).collect()
    assert rows and all(len(r.ids) == r.n_pieces for r in rows)
    assert all(hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() == r.ids_sha256 for r in rows)


def test_decoding_gives_the_texts_back(spark, docs, texts):
    back = u.decode_documents(u.encode_documents(docs, PIECES), PIECES)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, (t or "").replace(u.MARK, " ")) for i, t in texts), key=str)


def test_decoding_of_odd_ids(spark, model):
    whole = u.Encoder(model).encode(["a b"])[0].tolist()
    lone = int(model.byte_id[0xE2])
    rows = [(1, whole), (2, None), (3, []), (4, [None, -1, 10**9]), (5, whole + [None]), (None, whole[-1:]), (6, [lone])]
    df = spark.createDataFrame([(i, x, "t") for i, x in rows], "doc_id long, ids array<int>, text string")
    got = {r.doc_id: r.text for r in u.decode_documents(df, PIECES).collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == ("a b", "", "", "", "a b") and got[None] == "b" and got[6] == "\ufffd"
    assert u.decode_documents(df.limit(0), PIECES).collect() == []
