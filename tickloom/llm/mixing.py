"""Temperature mixing of sources, realised as budgeted block permutations.

A source with share p of the tokens gets weight p**t, normalised.  The
exponent t is bisected until the weights reach a target entropy, or until no
source repeats more often than a limit while the least repeated is used once
as a whole.  Each source then gets its weight's part of the budget in tokens:
as many whole passes as fit, and of the next pass the first documents of a
permutation of blocks, and of documents within blocks, up to what is left.

Everything is DataFrame operations: shares, weights and blocks are tables, and
each round of the search is one aggregate over all sources that returns the
two sums it needs for a whole grid of exponents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.common import cut, text_of

MAX_REPEATS = 1.5
SEED = 42
ROWS_PER_BLOCK = 4096
GRID = 16
ROUNDS = 12
SHARPEST = 64.0
SMALL_TABLE = 10_000


def counted(docs: DataFrame) -> DataFrame:
    """doc (the whole row), doc_id, _source (a null is a source of its own) and _tokens: the words between white space, and one for the end."""
    words = F.regexp_count(text_of(), F.lit(r"\S+"))
    source = F.coalesce(F.col("source").cast("string"), F.lit("\u0000"))
    return docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", source.alias("_source"), (words + 1).cast("bigint").alias("_tokens"))


def shares(sizes: DataFrame) -> DataFrame:
    """Per source: tokens, rows, and the logarithm of its share; the total comes from one aggregate."""
    totals = sizes.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows"))
    total = F.lit(int(totals.agg(F.coalesce(F.sum("tokens"), F.lit(1))).first()[0]))
    return totals.withColumn("log_share", F.log(F.col("tokens") / total))


def _narrow(table: DataFrame, high: float, sums, above, rounds: int = ROUNDS) -> float:
    """Bisect t in [0, high], GRID parts at a time; ``above(row, i)`` says whether the goal lies at a larger t than the i-th."""
    low = 0.0
    for _ in range(rounds):
        ts = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        row = table.agg(*[c.alias(f"{n}_{i}") for i, t in enumerate(ts) for n, c in sums(t).items()]).first()
        k = max([i for i in range(GRID) if above(row, i)], default=0)
        low, high = ts[k], ts[k + 1]
    return (low + high) / 2


def exponent(table: DataFrame, entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent t for one of two goals.

    ``entropy``: of the weights, as a part of the largest possible, the
    logarithm of the number of sources.  It falls as t rises from 0; t ends at
    SHARPEST where ties keep it above the goal.
    ``max_repeats``: passes over the most repeated source for one over the
    least; the passes go as share**(t - 1), and t lies between 0 and 1.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give either an entropy or a limit of repetitions")
    if max_repeats is not None:
        if max_repeats < 1:
            raise ValueError("the limit must be 1 or more")
        limit = math.log(max_repeats)

        def sums(t):
            passes = F.col("log_share") * (t - 1.0)
            return {"range": F.max(passes) - F.min(passes)}

        return _narrow(table, 1.0, sums, lambda row, i: (row[f"range_{i}"] or 0.0) > limit)

    def sums(t):
        power = F.exp(F.col("log_share") * t)
        return {"z": F.sum(power), "s": F.sum(power * F.col("log_share") * t), "n": F.count("*")}

    def too_even(row, i):
        z, n = row[f"z_{i}"], row[f"n_{i}"]
        return bool(n and n > 1) and math.log(z) - row[f"s_{i}"] / z >= entropy * math.log(n)

    return _narrow(table, SHARPEST, sums, too_even)


def weights(table: DataFrame, t: float, budget: int | None = None) -> DataFrame:
    """Per source: weight, quota in tokens, whole passes and the tokens left of the next pass.

    Without a budget, it is the least at which every source is used once as a whole.
    """
    power = F.exp(F.col("log_share") * t)
    row = table.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("most")).first()
    scale = row.most if budget is None else (budget / row.z if row.z else 0.0)
    # A quota within a millionth of whole passes counts as these.
    quota = F.lit(float(scale or 0.0)) * power
    passes = F.floor(quota / F.col("tokens") + 1e-6)
    return table.select(
        "_source", "tokens", "rows", (power / F.lit(float(row.z or 1.0))).alias("weight"), quota.alias("quota"), passes.cast("bigint").alias("passes"),
        F.greatest(F.floor(quota - passes * F.col("tokens")), F.lit(0)).cast("bigint").alias("left"),
    )


def _order(pass_no: Column, rows: Column) -> list[Column]:
    """The place of a document in its source's permutation of that pass: of its block, then within the block."""
    block = F.pmod(F.xxhash64(F.lit(SEED), F.lit("block"), "doc_id"), F.ceil(rows / ROWS_PER_BLOCK))
    return [
        F.xxhash64(F.lit(SEED), F.lit("order"), pass_no, "_source", block).alias("_block_at"),
        F.xxhash64(F.lit(SEED), F.lit("row"), pass_no, "doc_id").alias("_row_at"),
    ]


def last_pass(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Per source the last document of its last, partial pass: (_source, cut), cut in the order of that pass.

    Tokens are summed within blocks, whose rows are bounded, and over the
    block totals of a source.  Rows that share source and doc_id go together.
    """
    known = _with_sources(rows.select("_source", "doc_id", "_tokens"), table.filter(F.col("left") > 0))
    units = known.select("_source", "doc_id", "_tokens", "left", *_order(F.col("passes"), F.col("rows"))).groupBy(
        "_source", "_block_at", "_row_at", "doc_id", "left"
    ).agg(F.sum("_tokens").alias("_tokens"))
    sums = units.groupBy("_source", "_block_at").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_block_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_block_at", "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_source", "_block_at").orderBy("_row_at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = units.withColumn("_through", F.sum("_tokens").over(inside)).join(starts, ["_source", "_block_at"])
    fits = placed.filter(F.col("_start") + F.col("_through") <= F.col("left"))
    return fits.groupBy("_source").agg(F.max(F.struct("_block_at", "_row_at", "doc_id")).alias("cut"))


def _with_sources(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join a table per source: broadcast while that table is known to be small, else by a shuffle that splits large sources."""
    return rows.join(F.broadcast(table) if table.count() <= SMALL_TABLE else table, "_source")


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc (the row), tokens, weight (of its source), passes, and copies, the number of times the mixture uses it.

    Rows of a null source are a source of their own; empty texts weigh one
    token; rows that share source and doc_id get the same copies.  An empty
    table gives no rows.
    """
    rows = counted(docs)
    sizes = cut(shares(rows.select("_source", "_tokens")))
    table = cut(weights(sizes, exponent(sizes, entropy, max_repeats), budget))
    known = cut(table.join(last_pass(rows, table), "_source", "left"))
    block_at, row_at = _order(F.col("passes"), F.col("rows"))
    more = F.struct(block_at, row_at, F.col("doc_id")) <= F.col("cut")
    copies = F.col("passes") + F.coalesce(more.cast("int"), F.lit(0))
    return _with_sources(rows, known).select("doc", F.col("_tokens").alias("tokens"), "weight", "passes", copies.cast("int").alias("copies"))


def mixture(docs: DataFrame, **goal) -> DataFrame:
    """The mixed table: the columns of ``docs``, each row as often as the mixture uses it."""
    used = mix(docs, **goal).filter("copies > 0")
    return used.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
