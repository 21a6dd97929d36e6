import itertools
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from llm_fixtures import documents, empty, odd, small  # noqa: F401
from tickloom.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    return toxicity.fit(read("documents"), read("labels"))


def test_decoder_finds_the_best_reading_of_all(fitted):
    """Against every path through short lattices."""
    model = fitted["model"]
    for signs in ("1d10t", "l0s3r", "a11", "m0r0n", "tr4sh"):
        options = [[(c, 0.0)] if c in toxicity.CLASS else [(x, toxicity.AS_LETTER) for x in toxicity.LEET[c]] + [(" ", toxicity.AS_GAP)] for c in signs]
        for i in range(1, len(signs)):
            if signs[i] == signs[i - 1]:
                options[i] = options[i] + [("", toxicity.REPEATED)]
        best = (-1e9, "")
        for path in itertools.product(*options):
            a = b = 0
            total, read = 0.0, ""
            for letter, cost in path:
                total -= cost
                if letter == "" or letter == " " and b == 0:
                    continue
                c = toxicity.CLASS.get(letter, 0)
                total, read, a, b = total + float(model[a, b, c]), read + letter, b, c
            best = max(best, (total + float(model[a, b, 0]), read.strip()))
        assert toxicity.restore(signs, model) == best[1]


def test_obfuscated_words_score_like_plain_ones(fitted):
    clean = "the thing is of that and for ontion ther "
    assert toxicity._scores(fitted, [clean, "", clean * 50]).max() < 0.5
    hidden = ["you 1d10t", "such a l0s3r", "m0r0n here", "i d i o t", "s.c.u.m", "traaaash", "w0rthless", "a cl0wn", "patheeeetic"]
    found = toxicity._scores(fitted, [clean + h + " " + clean for h in hidden])
    assert (found >= 0.5).mean() >= 0.75, dict(zip(hidden, found))


def test_query_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op7_noisy_channel(spark, FOLDER).collect()}
    assert sorted(rows) == sorted(pq.read_table(f"{FOLDER}/documents.parquet")["doc_id"].to_pylist())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    labels = [(d["doc_id"], d["toxic"]) for d in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()]
    held = [(rows[i].predicted, toxic) for i, toxic in labels if rows[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.93
    assert sum(p and not t for p, t in held) <= 1


def test_labels_of_the_held_out_part_change_nothing(spark, fitted):
    from pyspark.sql import functions as F

    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    turned = read("labels").withColumn("toxic", F.when(toxicity.part_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(read("documents"), turned)
    assert again["weights"] == fitted["weights"] and again["curve"] == fitted["curve"]


def test_odd_rows_and_empty_tables(spark, odd, empty, fitted):
    rows = toxicity.score(odd, fitted).collect()
    assert len(rows) == 11 and all(r.score is not None for r in rows)
    assert toxicity.reject(odd, fitted).columns == odd.columns
    assert toxicity.reject(odd, fitted).count() == 11
    labels = spark.createDataFrame([(1, 0, None), (2, 1, 1), (2, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []
    none = toxicity.fit(odd, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(odd, none).collect())


def plain_words(text, model):
    """Words as written and as restored, without any shortcut."""
    found = set()
    for token in text.split():
        token = token.lower()
        found.update(toxicity._WORD.findall(token))
        for part in toxicity.obfuscated(token):
            found.update(toxicity._WORD.findall(toxicity.restore(part, model)))
    return found | toxicity.spaced(text, model)


def test_weights_and_scores_equal_a_plain_count(spark, documents):
    """All evidence counted document by document, the curve as fitted."""
    import math
    import zlib

    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fitted = toxicity.fit(docs, labels)
    texts = {d["doc_id"]: d["text"] or "" for d in documents}
    learned = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5}
    have = {i: {t for w in plain_words(text, fitted["model"]) for t in toxicity.terms(w)} for i, text in texts.items()}
    sides = [[i for i, x in learned.items() if x == side] for side in (0, 1)]
    weights = {}
    for term in set().union(*[have[i] for i in sides[1]]):
        clean, toxic = (sum(term in have[i] for i in side) for side in sides)
        odds = math.log((toxic + 0.5) / (len(sides[1]) + 1)) - math.log((clean + 0.5) / (len(sides[0]) + 1))
        bound = odds - toxicity.CONFIDENCE * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        if toxic >= 2 and bound > 0.5:
            weights[term] = bound
    assert fitted["weights"].keys() == weights.keys() and weights
    assert all(abs(fitted["weights"][t][0] - w) < 1e-9 for t, w in weights.items())
    start, slope = fitted["curve"]
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, fitted).collect()}
    for i in texts:
        want = 1 / (1 + math.exp(-(start + slope * max([weights.get(t, 0.0) for t in have[i]], default=0.0))))
        assert abs(got[i][0] - want) < 1e-9 and got[i][1] == (want >= 0.5), i


def test_beginnings_are_those_of_all_readings():
    import itertools

    for word in ("aab", "book", "aaab", "zzz", "ab", "llama", "eeff", "abbbc"):
        runs = [(k, len(list(g))) for k, g in itertools.groupby(word)]
        readings = {"".join(k * n for (k, _), n in zip(runs, sizes)) for sizes in itertools.product(*[range(1, n + 1) for _, n in runs])}
        assert toxicity.beginnings(word) == {r[:3] for r in readings}, word
