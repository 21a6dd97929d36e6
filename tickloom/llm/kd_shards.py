"""Shards of near-equal bytes by k-d tree partitioning.

Documents are points in the space of their metadata.  A node that stands for
several shards is split where their part of its bytes lies below, along the
dimension in which its points are spread widest; leaves are the shards, each
filled up to its share of the bytes.  Spark finds the cuts: all nodes of a
level are refined together, nine bits of the coordinate a round, from sums of
bytes per (node, bucket); the driver sees at most shards * 512 sums.

Copies of a text are one point, weighed with all their bytes, so a cut lies
beside a group and never in it.  Groups that weigh a sixteenth of a shard or
more, a bounded number, are placed before the tree, each on the emptiest
shard; the tree fills what they leave.  Only a group heavier than a whole
shard is dealt, in shard-sized parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.common import cut, text_of

SHARDS = 24
ROW_BYTES = 8
# Groups of copies that weigh this part of a shard are placed before the tree: at most shards * PLACED_PART.
PLACED_PART = 16
BITS_PER_ROUND = 9
COORDINATE_BITS = 24
KEY_BITS = 63
DIMENSIONS = ("doc_id", "size", "source", "lang")
ROWS_PER_SLOT_RUN = 50_000


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and what the tree needs, one numbered row per document; null texts count as empty."""
    text = text_of()
    present = [c for c in ("source", "lang") if c in docs.columns]
    named = [(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) if c in present else F.lit(0)).cast("bigint").alias(c) for c in ("source", "lang")]
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("digest"),
        *named,
    )


GROUP = ["digest", "size", "text_crc32"]


def groups(rows: DataFrame) -> DataFrame:
    """Copies as one point each: the group, its rows and bytes, and the coordinates of its least document."""
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "source", "lang"))
    found = rows.groupBy(*GROUP).agg(F.count("*").alias("rows"), F.sum("size").alias("weight"), least.alias("_least"))
    return found.select(*GROUP, "rows", "weight", *[F.col(f"_least.{d}").alias(f"at_{d}") for d in DIMENSIONS if d != "size"])


def placed_first(heavy: list, total: int, shards: int) -> tuple[list[tuple], list[int]]:
    """Where heavy groups go: (group, rows of a part, part, shard) per part, and the bytes on each shard.

    The heaviest comes first, to the emptiest shard.  A group of more than a
    shard's bytes is dealt in parts of a shard each.
    """
    parts = []
    for g in heavy:
        each = max(1, round(total / shards / g.size)) if g.weight * shards > total else g.rows
        parts += [((*g[:3], each, n), (min(g.rows, each * (n + 1)) - each * n) * g.size) for n in range(-(-g.rows // each))]
    loads, out = [0] * shards, []
    for key, weight in sorted(parts, key=lambda p: (-p[1], p[0])):
        shard = min(range(shards), key=lambda k: (loads[k], k))
        loads[shard] += weight
        out.append((*key, shard))
    return out, loads


def numbered(rows: DataFrame, keys: list[str], runs: int, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``, from 0 without a gap per ``keys``: within runs dealt by the row's number, then by the rows of earlier runs."""
    dealt = rows.withColumn("_run", F.pmod(F.xxhash64(F.lit("slot"), "row"), F.lit(runs)))
    counts = dealt.groupBy(*keys, "_run").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_run", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(starts, [*keys, "_run"]).withColumn("slot", F.col("_start") + F.col("_within")).drop("_run", "_within", "_start")


def keyed(found: DataFrame) -> DataFrame:
    """Groups with one non-negative BIGINT per dimension: the scaled coordinate, then bits that order groups of equal coordinate."""
    at = {d: F.col("size" if d == "size" else f"at_{d}") for d in DIMENSIONS}
    bounds = found.agg(*[f(at[d]).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << COORDINATE_BITS) - 1
    rest = KEY_BITS - COORDINATE_BITS
    order = F.shiftrightunsigned(F.xxhash64(*GROUP), 64 - rest)
    columns = []
    for d in DIMENSIONS:
        lo, hi = bounds[f"lo_{d}"] or 0, bounds[f"hi_{d}"] or 0
        scaled = (at[d].cast("double") - F.lit(float(lo))) / F.lit(float(max(1, hi - lo))) * top
        place = F.least(F.greatest(scaled.cast("bigint"), F.lit(0)), F.lit(top))
        columns.append((F.shiftleft(place, rest) + order).alias(f"key_{d}"))
    return found.select(*GROUP, "weight", *columns)


def _choose(node: Column, values: dict[int, object], kind: str) -> Column:
    """The value of each node; the table is bounded by the number of shards."""
    if not values:
        return F.lit(None).cast(kind)
    table = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    return F.element_at(table, node).cast(kind)


def tree(keys: DataFrame, room: list[int]) -> DataFrame:
    """The shard of each group, filling shards in proportion to their ``room``: columns GROUP and shard."""
    shards = len(room)
    names = [f"key_{d}" for d in DIMENSIONS]
    nodes = {0: shards}  # first shard of the node: number of its shards
    placed = keys.withColumn("node", F.lit(0))
    while any(k > 1 for k in nodes.values()):
        wide = {n: k for n, k in nodes.items() if k > 1}
        inner = placed.filter(F.col("node").isin(list(wide)))
        spread = inner.groupBy("node").agg(
            F.sum("weight").alias("weight"), *[(F.max(c) - F.min(c)).alias(c) for c in names]
        ).collect()  # a row per node
        axis = {r.node: max(range(len(names)), key=lambda i: r[names[i]]) for r in spread}
        goal = {r.node: _lower(r.weight, room[r.node : r.node + wide[r.node]]) for r in spread}
        along = inner.select("node", "weight", F.element_at(F.array(*names), _choose(F.col("node"), {n: i + 1 for n, i in axis.items()}, "int")).alias("key"))
        cuts = _cuts(along, goal)
        key = F.element_at(F.array(*names), _choose(F.col("node"), {n: i + 1 for n, i in axis.items()}, "int"))
        upper = {n: n + k // 2 for n, k in wide.items() if n in cuts}
        above = key >= _choose(F.col("node"), cuts, "bigint")
        placed = placed.withColumn("node", F.when(above, _choose(F.col("node"), upper, "int")).otherwise(F.col("node")))
        nodes = {n: k for n, k in nodes.items() if k == 1} | {n: k // 2 for n, k in wide.items()} | {n + k // 2: k - k // 2 for n, k in wide.items()}
        placed = cut(placed)
    return placed.select(*GROUP, F.col("node").alias("shard"))


def _lower(weight: int, room: list[int]) -> int:
    """The bytes that go to the first half of the shards."""
    half = len(room) // 2
    return weight * sum(room[:half]) // sum(room) if sum(room) else weight * half // len(room)


def _cuts(along: DataFrame, goal: dict[int, int]) -> dict[int, int]:
    """Per node the least key that goes to its upper half: the bytes below it come closest to the goal.

    All nodes are refined by BITS_PER_ROUND bits a round, from one sum per (node, bucket).
    """
    prefix = {n: 0 for n in goal}
    below = {n: 0 for n in goal}
    last: dict[int, int] = {}
    for shift in range(KEY_BITS - BITS_PER_ROUND, -1, -BITS_PER_ROUND):
        head = F.shiftright("key", shift + BITS_PER_ROUND)
        bucket = F.shiftright("key", shift).bitwiseAND((1 << BITS_PER_ROUND) - 1)
        inside = along.filter(head == _choose(F.col("node"), prefix, "bigint"))
        sums = inside.groupBy("node", bucket.alias("bucket")).agg(F.sum("weight").alias("weight")).collect()
        by: dict[int, list] = {}
        for r in sums:
            by.setdefault(r.node, []).append((r.bucket, r.weight))
        for n, rows in by.items():
            rows.sort()
            for bucket_, weight in rows:
                if below[n] + weight > goal[n] or bucket_ == rows[-1][0]:
                    break
                below[n] += weight
            prefix[n] = (prefix[n] << BITS_PER_ROUND) + bucket_
            last[n] = weight
    # The point at the cut goes to the side that leaves the bytes closer to the goal.
    return {n: prefix[n] + (1 if 2 * (goal[n] - below[n]) > last[n] else 0) for n in prefix}


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    Sizes of the shards are near equal, and equal texts share a shard unless
    they outweigh it.  Slots count from 0 without a gap in each shard.  Null
    ids, sources and languages are points at the origin; an empty table gives
    no rows; a table of fewer groups than shards leaves shards empty.
    """
    rows = cut(measured(docs))
    found = cut(groups(rows))
    total = found.agg(F.sum("weight")).first()[0] or 0
    # A row per group of at least a sixteenth of a shard.
    heavy = found.filter(F.col("weight") * F.lit(shards * PLACED_PART) >= F.lit(total)).select(*GROUP, "rows", "weight").collect()
    first, loads = placed_first(heavy, total, shards)
    spark = rows.sparkSession
    places = spark.createDataFrame(first, "digest bigint, size bigint, text_crc32 bigint, each bigint, part bigint, shard int")
    light = found.join(F.broadcast(places.select(*GROUP).distinct()), GROUP, "left_anti")
    leaves = tree(cut(keyed(light)), [max(0, total - n * shards) for n in loads])
    # Groups of the tree are small, so no key of this join is hot; those placed first join a bounded table.
    columns = ["row", "doc_id", "size", "text_crc32", "shard"]
    kinds = F.broadcast(places.select(*GROUP, "each").distinct())
    filled = rows.join(leaves, GROUP).select(*columns)
    runs = _runs(rows, 1)
    ranked = numbered(rows.join(kinds, GROUP), GROUP, runs, ["row"]).withColumn("part", F.call_function("div", F.col("slot"), F.col("each")))
    put = ranked.join(F.broadcast(places.drop("each")), [*GROUP, "part"]).select(*columns)
    placed = cut(filled.unionByName(put))
    out = numbered(placed, ["shard"], _runs(placed, shards), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"))


def _runs(rows: DataFrame, shards: int) -> int:
    return max(8, rows.count() // (shards * ROWS_PER_SLOT_RUN))
