"""Corpus housekeeping: exact duplicates, leakage-safe groups, splits, evaluation picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.operators.graph import components

#: Groups above this share of all files are placed one by one, the others dealt in order of a hash.
LARGE = 0.001


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row in `order` of every `key`, as a partial aggregate; rows with a null key all stay."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(key, "_r.*").select(*rows.columns)
    return best.unionByName(rows.where(F.col(key).isNull()))


def leakage_groups(files: DataFrame, keys: list[str], ident: str = "file_id") -> DataFrame:
    """`ident`, `group`: files that share any of the keys, directly or through others, get the smallest id among them.

    A key that many files share costs one edge a file. Null keys join nothing.
    """
    edges = None
    for k in keys:
        part = files.where(F.col(k).isNotNull()).select(F.col(ident).alias("src"), F.col(k).alias("_k"))
        heads = part.groupBy("_k").agg(F.min("src").alias("dst"))
        star = part.join(heads, "_k").where("src <> dst").select("src", "dst")
        edges = star if edges is None else edges.unionByName(star)
    named = components(edges).select(F.col("node").alias(ident), "root")
    return files.select(ident).join(named, ident, "left").select(ident, F.coalesce("root", ident).alias("group"))


def split_groups(groups: DataFrame, targets: list[tuple[str, float]], seed: int = 42, ident: str = "file_id") -> DataFrame:
    """`ident`, `group`, `split`: whole groups dealt so that shares of files come as near the targets as groups allow.

    Groups above LARGE of all files (at most 1 / LARGE exist) are placed on the driver, largest first, where most is
    missing; the rest is laid end to end in hash order, and each group goes where its middle falls.
    """
    size = groups.groupBy("group").agg(F.count("*").alias("size"))
    total = groups.count()
    whole = sum(s for _, s in targets) or 1.0
    room = {name: share / whole * total for name, share in targets}
    placed, taken = [], 0
    for g, n in size.where(F.col("size") > LARGE * total).orderBy(F.desc("size"), "group").collect():
        to = max(room, key=lambda x: room[x])
        room[to] -= n
        taken += n
        placed.append((g, to))
    small = size.where(F.col("size") <= LARGE * total).withColumn("h", F.xxhash64("group", F.lit(seed))).withColumn("b", F.pmod("h", F.lit(1024)))
    sums = small.groupBy("b").agg(F.sum("size").alias("n"))
    sums = sums.select("b", (F.sum("n").over(W.orderBy("b")) - F.col("n")).alias("before"))
    inner = F.sum("size").over(W.partitionBy("b").orderBy("h", "group")) - F.col("size") / 2
    laid = small.withColumn("inner", inner).join(F.broadcast(sums), "b").withColumn("at", F.col("before") + F.col("inner"))
    left = {k: max(v, 0.0) for k, v in room.items()}
    scale = (total - taken) / sum(left.values()) if sum(left.values()) else 1.0
    pick, upto = F.lit(targets[0][0]), 0.0
    for name, _ in targets:
        pick = F.when(F.col("at") >= upto, F.lit(name)).otherwise(pick) if left[name] > 0 else pick
        upto += left[name] * scale
    dealt = laid.select("group", pick.alias("split"))
    if placed:
        dealt = dealt.unionByName(groups.sparkSession.createDataFrame(placed, dealt.schema))
    return groups.join(dealt, "group").select(ident, "group", "split")


def hashed_order(seed: int, *cols: str) -> F.Column:
    """A reproducible shuffle: the hex digest of seed and key, sortable in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hashed_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The n rows with the smallest digest, a top-k without a full sort."""
    return rows.withColumn("_h", hashed_order(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def per_bucket(rows: DataFrame, bucket: str, order: list, n: int) -> DataFrame:
    """At most n rows of every bucket, first in `order`."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(bucket).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def round_robin(rows: DataFrame, bucket: str, order: list[str], n: int) -> DataFrame:
    """n rows, one of each bucket in turn."""
    turn = F.row_number().over(W.partitionBy(bucket).orderBy(*order))
    return rows.withColumn("_turn", turn).orderBy("_turn", bucket).limit(n).drop("_turn")


def quartile_cuts(rows: DataFrame, value: str) -> DataFrame:
    """One row `q1`, `q2`, `q3`: nearest ranks, half-even, of the non-null values; different values are counted first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k"))
    ranked = counts.withColumn("upto", F.sum("k").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("n", F.sum("k").over(W.partitionBy()))
    at = lambda q: F.min(F.when(F.col("upto") > F.rint((F.col("n") - 1) * q), F.col("v")))
    return ranked.agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def quartile_bucket(value, cuts: str = "") -> F.Column:
    """0 to 3 by the three cuts (columns q1, q2, q3 with the prefix)."""
    q1, q2, q3 = (F.col(f"{cuts}q{i}") for i in (1, 2, 3))
    return F.when(value <= q1, 0).when(value <= q2, 1).when(value <= q3, 2).otherwise(3)
