import collections

import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor

from llm_fixtures import empty, odd  # noqa: F401
import corpus_pipeline as cp
from test_near_copies import plain_set  # beside this file
from tickloom.llm import toxicity

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in cp.STAGES:
        folder = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs.collect())
        if name != cp.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return out


def test_toxicity_drops_what_it_rejects(spark, steps):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    fitted = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = toxicity._scores(fitted, [r.text for r in steps[0]])
    assert sorted(steps[1]) == sorted(r for r, s in zip(steps[0], scores) if s < 0.5)


def test_exact_dedup_keeps_the_largest_id(steps):
    last = {}
    for r in steps[1]:
        last[r.text] = max(last.get(r.text, r), r, key=lambda r: r.doc_id)
    assert sorted(steps[2]) == sorted(last.values())


def test_near_dedup_keeps_one_of_each_component(steps):
    """Of texts linked by a five-word likeness of 0.8 or more the smallest id stays, by brute force over all pairs."""
    sets = {r.doc_id: plain_set(r.text) for r in steps[2]}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    kept = {i for i in sets if top(i) == i}
    assert len(kept) < len(sets)
    assert sorted(steps[3]) == sorted(r for r in steps[2] if r.doc_id in kept)


def test_mixing_repeats_small_sources(steps):
    tokens = lambda r: len(r.text.split()) + 1
    before, after = collections.Counter(), collections.Counter()
    for r in steps[3]:
        before[r.source] += tokens(r)
    for r in steps[4]:
        after[r.source] += tokens(r)
    assert set(map(tuple, steps[3])) == set(map(tuple, steps[4]))
    passes = [after[s] / before[s] for s in before]
    assert min(passes) >= 1.0 and max(passes) <= 1.5 + 1e-9


def test_encoding_is_the_library_s(steps):
    library = SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, library.encode(r.text, add_eos=True)) for r in steps[4])
    assert sorted((r.doc_id, list(r.ids)) for r in steps[5]) == want
    assert all(r.n_tokens == len(r.ids) for r in steps[5])


def test_odd_rows_and_empty_table_pass_every_stage(spark, odd, empty, tmp_path):
    for name, start in (("odd", odd), ("empty", empty)):
        docs = start
        for i, (stage_name, stage) in enumerate(cp.STAGES):
            stage(spark, docs, FOLDER).write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))
        assert docs.columns == ["doc_id", "n_tokens", "ids"]
    assert docs.count() == 0
    ids = lambda i: sorted((r.doc_id is None, r.doc_id or 0) for r in spark.read.parquet(str(tmp_path / f"odd{i}")).select("doc_id").collect())
    # No text is toxic.  Of equal texts the largest id stays (2 of 1 and 2, 4 of 3 and 4; repeated rows once); then
    # 6 goes as a copy of 5, and 8, which has no words either, as one of 4.
    assert ids(0) == [(False, i) for i in (1, 2, 2, 3, 4, 5, 6, 8, 9, 9)] + [(True, 0)]
    assert ids(1) == [(False, i) for i in (2, 4, 5, 6, 8, 9, 9)] + [(True, 0)]
    assert ids(2) == [(False, i) for i in (2, 4, 5, 9, 9)] + [(True, 0)]
    assert set(ids(3)) == set(ids(2)) and len(ids(3)) == len(ids(4)) >= len(ids(2))
