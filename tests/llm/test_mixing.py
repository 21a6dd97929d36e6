import collections
import math

import pytest

from llm_fixtures import documents, empty, odd, small  # noqa: F401
from tickloom.llm import mixing, queries


def source_tokens(documents):
    totals = collections.Counter()
    for d in documents:
        totals[d["source"]] += len(d["text"].split()) + 1
    return totals


def test_query_meets_the_limit_and_the_quotas(spark, small, documents):
    rows = queries.op8_temperature_mix(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in documents)
    totals, used, largest = source_tokens(documents), collections.Counter(), collections.Counter()
    for r in rows:
        used[r.source] += r.copies * r.n_tokens
        largest[r.source] = max(largest[r.source], r.n_tokens)
    assert all(r.copies >= 1 for r in rows)
    # Brute force: the exponent at which the most repeated source is used 1.5 times.
    low, high = 0.0, 1.0
    most = max(totals.values())
    for _ in range(60):
        t = (low + high) / 2
        low, high = (t, high) if (most / min(totals.values())) ** (1 - t) > 1.5 else (low, t)
    for source, n in totals.items():
        quota = n * (most / n) ** (1 - low)
        assert quota - largest[source] <= used[source] <= quota + 1e-3
    z = sum(n**low for n in totals.values())
    assert all(abs(r.weight - totals[r.source] ** low / z) < 1e-9 for r in rows)


@pytest.mark.parametrize("part", [0.5, 0.9, 1.0])
def test_entropy(spark, part):
    docs = spark.createDataFrame(
        [(100 * s + i, "w " * 9, "en", f"s{s}", 18) for s, n in enumerate((90, 30, 9, 3, 1)) for i in range(n)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    sizes = mixing.shares(mixing.counted(docs).select("_source", "_tokens"))
    t = mixing.exponent(sizes, entropy=part)
    table = mixing.weights(sizes, t, budget=10_000).collect()
    entropy = -sum(r.weight * math.log(r.weight) for r in table)
    assert abs(entropy - max(part * math.log(5), 0)) < 1e-6
    assert abs(sum(r.quota for r in table) - 10_000) < 1e-6


def test_mixture_repeats_rows_and_keeps_columns(odd):
    mixed = mixing.mixture(odd, max_repeats=2.0)
    assert mixed.columns == odd.columns
    assert mixed.count() >= odd.count()
    copies = mixing.mix(odd, max_repeats=2.0).agg({"copies": "sum"}).first()[0]
    assert copies == mixed.count()


def test_budget_below_a_pass_takes_a_prefix_of_the_permutation(spark, small, documents):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    totals = source_tokens(documents)
    budget = sum(totals.values()) // 4
    rows = mixing.mix(docs, max_repeats=1.0, budget=budget).select("doc.doc_id", "doc.source", "tokens", "copies").collect()
    used = sum(r.tokens * r.copies for r in rows)
    largest = sum(max(r.tokens for r in rows if r.source == s) for s in totals)
    assert budget - largest <= used <= budget


def test_empty_table(empty):
    assert mixing.mix(empty, max_repeats=1.5).collect() == []
