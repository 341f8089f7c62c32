"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (problem 8)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.llm.text import token_counts
from melisma.tables import materialise

#: Tokens a block holds about; a source's quota is dealt in whole blocks.
BLOCK_TOKENS = 16_384
#: Blocks an output shard holds about; the driver plans at most MOST_SHARDS, which hold more blocks beyond that.
SHARD_BLOCKS, MOST_SHARDS = 64, 65_536
#: Tokens of a source that are put in order together, about.
BUCKET_TOKENS = 1 << 24


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of each source for each shard: the quotas are halved recursively by multivariate-hypergeometric draws.

    Row sums differ by one at most, column sums are exactly the quotas; the same arguments give the same table.
    """
    total = sum(quotas)
    cut = [total * i // shards for i in range(shards + 1)]
    out: list[list[int]] = [[] for _ in range(shards)]
    stack = [(0, shards, list(quotas))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        take = cut[mid] - cut[lo]
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, take, method="marginals").tolist() if take else [0] * len(have)
        stack += [(lo, mid, left), (mid, hi, [h - x for h, x in zip(have, left)])]
    return out


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], size: int | None = None) -> dict[str, int]:
    """Tokens to draw of each source. Without `size`, the largest mixture in which every source that has any text meets
    its share within its repeats; shares of sources without text are left out and the others keep their proportions."""
    live = [(s, w, r) for s, w, r in targets if w > 0 and r > 0 and totals.get(s, 0) > 0]
    whole = sum(w for _, w, _ in live)
    if not live:
        return {}
    most = min(totals[s] * r / (w / whole) for s, w, r in live)
    size = int(most) if size is None else size
    return {s: min(int(round(size * w / whole)), totals[s] * r) for s, w, r in live}


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 17, size: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """`doc_id`, `source`, `use` (0 for the first), `tokens`, `shard`, `position`: the documents drawn, in shuffled order within shards.

    Each use of a source is a permutation of its own by hash; full uses come first, the last is cut where the quota is
    reached (a document belongs to it if its middle does). Positions in a permutation come from sums per hash bucket, so
    no source is gathered in one task. Documents without tokens, id or source, or of a source without target, are left out.
    """
    known = docs.where("doc_id IS NOT NULL AND source IS NOT NULL")
    sized = counts if counts is not None else token_counts(known)
    sized = materialise(known.select("doc_id", "source").join(sized, "doc_id").where("tokens > 0"), "sized")
    goal = [(r[0], r[1] or 0.0, r[2] or 0) for r in targets.groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).where("source IS NOT NULL").orderBy("source").collect()]
    totals = {r[0]: r[1] for r in sized.join(F.broadcast(targets.select("source").distinct()), "source").groupBy("source").agg(F.sum("tokens")).collect()}
    quota = plan(totals, goal, size)
    spark = docs.sparkSession
    if not quota:
        return sized.select("doc_id", "source", F.lit(0).alias("use"), "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("position")).limit(0)
    names = sorted(quota)
    blocks = [max(1, -(-quota[s] // BLOCK_TOKENS)) for s in names]
    shards = max(1, min(sum(blocks) // SHARD_BLOCKS, MOST_SHARDS))
    buckets = max(64, -(-sum(totals.values()) // BUCKET_TOKENS))
    table = split_quotas(blocks, shards, seed)
    # the blocks of a source go to shards as consecutive ranges of its permutation
    ranges = []
    for k, s in enumerate(names):
        at = 0
        for i, row in enumerate(table):
            if row[k]:
                ranges.append((s, at, at + row[k], i))
                at += row[k]
    uses = spark.createDataFrame([(s, u, totals[s] * u, quota[s], blocks[k]) for k, s in enumerate(names) for u in range(-(-quota[s] // totals[s]))], "source string, use int, base long, quota long, blocks int")
    drawn = sized.join(F.broadcast(uses), "source").withColumn("h", F.xxhash64("doc_id", "use", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = drawn.groupBy("source", "use", "bucket").agg(F.sum("tokens").alias("n"))
    before = before.select("source", "use", "bucket", (F.sum("n").over(W.partitionBy("source", "use").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.sum("tokens").over(W.partitionBy("source", "use", "bucket").orderBy("h", "doc_id")) - F.col("tokens") / 2
    placed = drawn.withColumn("inside", inside).join(before, ["source", "use", "bucket"]).withColumn("at", F.col("base") + F.col("before") + F.col("inside")).where("at < quota")
    placed = placed.withColumn("block", F.least(F.floor(F.col("at") * F.col("blocks") / F.col("quota")), F.col("blocks") - 1).cast("long"))
    # every range is written out by block: as many rows as there are blocks
    owner = spark.createDataFrame(ranges, "source string, lo long, hi long, shard int").select("source", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("block"))
    order = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("doc_id", "use", F.lit(seed + 1)), "doc_id", "use")).cast("long") - 1
    return placed.join(owner, ["source", "block"]).select("doc_id", "source", "use", "tokens", "shard", order.alias("position"))


def mixture_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """`source`, `target_share`, `actual_share`, `tokens`, `records`, `uses`, `max_repeats`: what was asked and what was reached, also for sources without text."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"), (F.max("use") + 1).alias("uses"))
    want = targets.select("source", "target_share", "max_repeats")
    tokens = F.coalesce("tokens", F.lit(0))
    return want.join(got, "source", "left").select("source", "target_share", (tokens / F.sum(tokens).over(W.partitionBy())).alias("actual_share"), tokens.alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("uses", F.lit(0)).alias("uses"), "max_repeats")
