import hashlib
import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from llm_fixtures import documents, empty, odd, odd_rows, small  # noqa: F401
from tickloom.llm import queries, tree_bpe

VOCABULARY = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def strange(rng, n):
    parts = ["a", "Be", "ab", "ing", " ", "  ", "\n", "\t", "'s", "'", "é", "é", "İ", "ß", "　", "12", "!", "...", "🙂", "\x1c", "\x00", "漢字", "<|endoftext|>", "</w>", "<", "ͅ", "ΑΣ"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(n)))


def test_words_and_symbols_encode_as_the_library(tokenizer):
    rng, model = random.Random(1), tree_bpe.words(VOCABULARY)
    for _ in range(3000):
        text = strange(rng, 30)
        want = ids(tokenizer, text)
        assert model.ids(model.symbols(text)).tolist() == want, repr(text)
        by_words = b"".join(model.words[w] for w in text.replace("\n", " ").split(" "))
        assert np.frombuffer(by_words, "<i4").tolist() == want, repr(text)


@pytest.mark.parametrize("leaf", [2, 3, 7, 50])
def test_tree_gives_the_ids_of_the_whole(tokenizer, leaf):
    """Leaves end anywhere, within words and long runs without a cut."""
    rng, model = random.Random(leaf), tree_bpe.words(VOCABULARY)
    texts = [strange(rng, 60) for _ in range(300)]
    texts += ["".join(rng.choice("abcdeinrst") for _ in range(400)) for _ in range(40)]
    texts += ["a" * 501, "ab" * 300, "!" * 333, "é" * 257, "ha" * 100 + " " + "na" * 100]
    for text in texts:
        parts = tree_bpe.halves(model.symbols(text), leaf)
        assert "".join(parts) == model.symbols(text) and all(len(p) <= leaf + 1 for p in parts)
        assert model.tree([model.ids(p) for p in parts]).tolist() == ids(tokenizer, text), repr(text)


def test_long_texts_go_by_leaves_and_come_out_the_same(spark, tokenizer):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["lorem ", "ipsum", "dolor, ", "x", "é"]) for _ in range(rng.choice([3, 400, 3000])))) for i in range(40)]
    rows += [(40, "z" * 20_000), (40, "same id " * 900), (None, "ab" * 9_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = tree_bpe.encode(docs, VOCABULARY, long=1000, leaf=300).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == sorted(((i, ids(tokenizer, t)) for i, t in rows), key=key)


def test_decode_is_the_library_s(spark, odd, tokenizer):
    encoded = tree_bpe.encode(odd, VOCABULARY)
    for r in tree_bpe.decode(encoded, VOCABULARY).collect():
        assert r.text == tokenizer.decode(list(r.ids), skip_special_tokens=False)
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in tree_bpe.decode(nulls, VOCABULARY).collect()) == [(1, ""), (2, "")]


def test_query(spark, small, documents, tokenizer):
    want = []
    for d in documents:
        found = ids(tokenizer, d["text"])
        text = tokenizer.decode(found, skip_special_tokens=False)
        want.append((d["doc_id"], len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op11_tree_bpe(spark, small).collect())) == sorted(want)


def test_odd_rows_and_empty_table(odd, empty, tokenizer):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = [(r.doc_id, list(r.ids)) for r in tree_bpe.encode(odd, VOCABULARY).collect()]
    assert sorted(got, key=key) == sorted(((r[0], ids(tokenizer, r[1])) for r in odd_rows()), key=key)
    assert tree_bpe.digests(empty, VOCABULARY).collect() == tree_bpe.encode(empty, VOCABULARY).collect() == []
