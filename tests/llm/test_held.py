"""What a stage keeps in a Python worker is gone when the worker goes on with another stage."""

from weakref import ref

import numpy as np
import public_tokenizers
import pyarrow as pa

from tickloom.llm import common, near_copies, piece_agenda, toxicity

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


class InPlace:
    """Rows whose tasks run in this process."""

    def __init__(self, *batches: pa.RecordBatch):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return pa.Table.from_batches(run(iter(self.batches)))


def _scored() -> ref:
    fitted = {"id": "held", "model": np.zeros((toxicity.KINDS,) * 3, np.float32), "weights": {"=vile": (9.0,)}, "curve": (-3.0, 1.0)}
    assert (toxicity._scores(fitted, ["a vile word", "a word"]) >= 0.5).tolist() == [True, False]
    return ref(common.held(("toxicity", "held"), lambda: None))


def _encoded() -> ref:
    model = piece_agenda.pieces(VOCABULARY)
    assert len(model.encode("some words")) and piece_agenda.pieces(VOCABULARY) is model
    return ref(model)


def test_a_vocabulary_takes_the_place_of_a_scorer():
    scorer = _scored()
    assert scorer() is not None
    encoder = _encoded()
    assert scorer() is None and encoder() is not None
    _scored()
    assert encoder() is None


def test_near_copies_keep_no_vocabulary():
    encoder = _encoded()
    assert encoder() is not None
    rows = pa.record_batch({"doc_id": [1, 2], "locator": ["x", None], "text": ["a b c d e f", ""]})
    assert near_copies.prints(InPlace(rows)).column("n").to_pylist() == [2, 1]
    assert encoder() is None
