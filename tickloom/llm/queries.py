"""The registered queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import (
    chunk_prints, exact_dedup, filter_audit, kd_shards, lookup_kmeans, mixing, page_text, piece_agenda, simhash, token_files, toxicity, tree_bpe, warc_fixity,
)
from tickloom.llm.common import cut, shared_folder, table


def op1_chunk_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return chunk_prints.against_next(table(spark, sf_dir, "documents"))


def op2_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of two replicas of the pages' archive, and what decay has done to the second, found from the roots down."""
    left = lambda made: F.sha2(warc_fixity.decayed(made), 256)
    whole = cut(warc_fixity.listed(table(spark, sf_dir, "pages"), lost=warc_fixity.is_lost, repeated=warc_fixity.is_repeated, left=left))
    other = cut(warc_fixity.damaged_list(whole))
    found = warc_fixity.audit(whole.select("file", "offset", "length", "digest"), other)
    here = whole.select("page_id", "file", "offset", "length", "digest").join(found, ["file", "offset"], "left")
    extra = found.filter("damage = 'extra'").join(other, ["file", "offset"])
    rows = here.unionByName(extra, allowMissingColumns=True)
    return rows.select("page_id", "file", "offset", "length", "digest", F.coalesce("damage", F.lit("intact")).alias("state"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extract(table(spark, sf_dir, "pages"))


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's tokens, from the written files."""
    folder = shared_folder(spark, "token-codes")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, folder)


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal texts stays, for every document."""
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out part."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (toxicity.part_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture uses each document when no source is repeated over 1.5 times as often as another."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), max_repeats=mixing.MAX_REPEATS)
    return mixed.select("doc.doc_id", "doc.source", F.col("tokens").alias("n_tokens"), "weight", "passes", "copies")


def op9_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's SentencePiece ids and of the text they decode to."""
    found = piece_agenda.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_text=True)
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by shards of near-equal bytes."""
    placed = kd_shards.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids of a vocabulary with word ends and of the text they decode to."""
    return tree_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language's documents, in every order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lookup_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole vector, and how tight the clusters are."""
    return lookup_kmeans.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chunk_prints, op2_simhash_balls, op3_warc_fixity, op4_page_text, op5_token_codes, op6_stream_dedup, op7_noisy_channel, op8_temperature_mix, op9_piece_agenda, op10_kd_shards,
        op11_tree_bpe, op12_filter_audit, op13_lookup_kmeans,
    )
}

# Cells of the tensor per part, then each order's steps over them.
_AUDIT = """
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
               list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
        FROM documents
    ), flags AS (
        SELECT doc_id, part,
               CAST(len(words) < 100 AS INT) * 16 + CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT) * 8
               + CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) * 4
               + CAST(regexp_matches(t, '[#$%&*|]') AS INT) * 2 + CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS cell
        FROM d
    ), marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
    cells AS (
        SELECT part, cell, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
        FROM flags LEFT JOIN marks USING (doc_id) GROUP BY part, cell
    ), letters(f, bit) AS (VALUES ('A', 16), ('B', 8), ('C', 4), ('D', 2), ('E', 1)),
    orders AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
    ), walk AS (
        SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before FROM orders, range(1, 6) r(s)
    ), found AS (
        SELECT part, filter_order, step, bit,
               coalesce(sum(n) FILTER (cell & (before | bit) = 0), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (cell & before = 0 AND cell & bit <> 0), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (cell & before <> 0 AND cell & bit <> 0), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (cell = bit), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (cell & before = 0 AND cell & bit <> 0), 0)::BIGINT AS good_lost,
               coalesce(sum(bad) FILTER (cell & before = 0 AND cell & bit <> 0), 0)::BIGINT AS toxic_lost
        FROM cells, walk GROUP BY part, filter_order, step, bit
    )
    SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM found
"""


def _kmeans(rounds: int = 3) -> str:
    """The clustering with one table of centroids per round."""
    steps = [
        """kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64
        ), flat AS MATERIALIZED (SELECT vec_id, d, v[d] AS x FROM kept, range(1, 65) r(d)),
        seeds AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM kept QUALIFY k < 16),
        c0 AS MATERIALIZED (SELECT k, d, v[d] AS c FROM seeds, range(1, 65) r(d))"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
            SELECT vec_id, arg_min(k, [distance, k]) AS k, min(distance) AS distance
            FROM (SELECT vec_id, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM flat JOIN c{i} USING (d) GROUP BY vec_id, k) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
                SELECT k, d, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c
                FROM c{i} LEFT JOIN (SELECT k, d, sum(x) AS s, count(*) AS n FROM flat JOIN a{i} USING (vec_id) GROUP BY k, d) USING (k, d))""")
    return f"""
        WITH {", ".join(steps)}, digests AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
        SELECT vec_id, CAST(k AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN digests USING (k)
    """


ORACLES = {
    "op12_filter_audit": _AUDIT,
    "op13_lookup_kmeans": _kmeans(),
    "op6_stream_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
