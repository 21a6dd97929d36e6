import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor

from llm_fixtures import documents, empty, odd, small  # noqa: F401
from tickloom.llm import piece_agenda, queries, wordlists

VOCABULARY = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=VOCABULARY)


def odd_texts():
    rng = random.Random(6)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "▁", "▁▁", "　", "🙂", "ﬁ", "\x00", "<s>", "</s>", "<0x41>", "字", "ing", "́", "�", "~"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    return texts + ["", " ", "▁", "   x", "x   ", "abc" * 2000, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


def test_agenda_equals_the_library(library, documents):
    model = piece_agenda.Pieces(VOCABULARY)
    for text in odd_texts() + [d["text"] for d in documents]:
        ids = model.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        assert model.decode(np.append(ids, model.end)) == library.decode(ids.tolist() + [model.end]), repr(text)
    model.check()


def test_batches_equal_the_library(library, documents):
    model = piece_agenda.Pieces(VOCABULARY)
    texts = odd_texts() + [d["text"] for d in documents]
    out = [row for batch in piece_agenda._batch(model, pa.array(range(len(texts))), pa.array(texts, pa.string()), True) for row in batch.to_pylist()]
    assert [r["doc_id"] for r in out] == list(range(len(texts)))
    for text, r in zip(texts, out):
        assert r["ids"] == library.encode(text, add_eos=True) and r["text"] == library.decode(r["ids"]), repr(text)


def test_any_ids_decode_as_the_library(library):
    rng, model = random.Random(7), piece_agenda.Pieces(VOCABULARY)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2]) for _ in range(rng.randrange(12))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_a_difference_is_reported():
    model = piece_agenda.Pieces(VOCABULARY)
    model.cost = {piece: cost for piece, cost in model.cost.items() if piece != "▁the"}
    model.encode("the other")
    with pytest.raises(RuntimeError):
        model.check()


def test_query_equals_the_library(spark, small, documents, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_piece_agenda(spark, small).collect()}
    want = {}
    for d in documents:
        ids = library.encode(d["text"], add_eos=True)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        want[d["doc_id"]] = (len(ids), *digests)
    assert got == want


def test_odd_rows_and_empty_table(odd, empty, library):
    rows = piece_agenda.decode(piece_agenda.encode(odd, VOCABULARY), VOCABULARY).collect()
    assert len(rows) == 11
    assert sorted(map(str, rows)) == sorted(map(str, piece_agenda.encode(odd, VOCABULARY, with_text=True).collect()))
    want = sorted(library.encode(t or "", add_eos=True) for t in [r.text for r in odd.select("text").collect()])
    assert sorted(r.ids for r in rows) == want
    assert {r.text for r in rows if r.doc_id in (3, 4)} == {""}
    assert piece_agenda.encode(empty, VOCABULARY).collect() == []


def test_runs_split_many_ids():
    bounds = np.cumsum([0, 5, 5, 100, 1, 1])
    assert list(wordlists.runs(bounds, 10)) == [(0, 2), (2, 3), (3, 5)]
