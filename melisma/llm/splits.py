"""Cross-split overlap (problem 1) and leakage-safe splits (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.llm.names import name_classes
from melisma.llm.near import HELD, TRAIN, music_links
from melisma.operators.graph import components
from melisma.tables import current_rows, materialise

#: Groups above this share of all records are placed one by one; the others are dealt within bands of size, each a power of two.
LARGE = 0.001


def current_records(records: DataFrame) -> DataFrame:
    cols = ["file_id", "ingested_at", "rel_path", "artist", "title", "family_key", "content_hash", "note_count", "duration_sec", "source", "split"]
    return current_rows(records.select(*cols), "file_id", "ingested_at")


def canonical(col: str) -> F.Column:
    """Lower case, without punctuation, white space collapsed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(F.col(col)), r"[^\p{L}\p{N}]+", " "))


def _named(records: DataFrame, classes: DataFrame) -> DataFrame:
    """Records with the entity of their artist and title; a string that names nothing stands for itself, in canonical form."""
    for field in ("artist", "title"):
        own = classes.where(F.col("field") == field).select(F.col("name").alias(field), F.col("class_id").alias(f"{field}_id"))
        records = records.join(own, field, "left")
    return records


def _unparsed_key(named: DataFrame) -> DataFrame:
    """One hash of everything in which an unparsed copy must agree: note_count, duration_sec, artist and title in whatever spelling."""
    who = [F.coalesce(F.col(f"{f}_id").cast("string"), F.concat(F.lit("="), canonical(f)), F.lit("")) for f in ("artist", "title")]
    ok = "note_count IS NOT NULL AND duration_sec IS NOT NULL AND (artist_id IS NOT NULL OR title_id IS NOT NULL) AND (content_hash IS NULL OR content_hash <> 'EMPTY')"
    return named.where(ok).select("file_id", "split", "source", F.sha2(F.concat_ws("\t", F.col("note_count").cast("string"), F.col("duration_sec").cast("string"), *who), 256).alias("key"), F.col("content_hash").isNull().alias("unparsed"))


def overlap_pairs(records: DataFrame, notes: DataFrame) -> DataFrame:
    """`file_id_a` < `file_id_b`, `kind`: a train record and a valid, test or eval record that are the same or nearly so.

    kind 'exact' - equal notes; 'near' - equal but for small edits; 'unparsed' - one was not parsed and both agree in
    note_count, duration_sec, artist and title. Evaluation hashes are joined with training hashes; a group of equal
    records is joined through its hash and split, never within itself. Records without split or notes have no pairs of
    the first two kinds; empty tables give no rows.
    """
    cur = materialise(current_records(records), "current")
    side = cur.where("split IN ('train', 'valid', 'test', 'eval')").select("file_id", F.expr("split = 'train'").alias("train"))
    roles = side.select("file_id", F.when(F.col("train"), TRAIN).otherwise(HELD).alias("role"))
    members, rep_pairs = music_links(records, notes, roles)
    placed = materialise(members.join(side, "file_id").select("rep", "file_id", "train"), "placed")
    train = placed.where("train").select("rep", F.col("file_id").alias("t"))
    held = placed.where("NOT train").select("rep", F.col("file_id").alias("h"))
    exact = train.join(held, "rep").select("t", "h", F.lit("exact").alias("kind"))
    both = rep_pairs.select("a", "b").unionByName(rep_pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = train.withColumnRenamed("rep", "a").join(both, "a").join(held.withColumnRenamed("rep", "b"), "b").select("t", "h", F.lit("near").alias("kind"))
    keyed = materialise(_unparsed_key(_named(cur, name_classes(records))).join(side, "file_id").select("key", "file_id", "train", "unparsed"), "keyed")
    t = keyed.where("train").select("key", F.col("file_id").alias("t"), F.col("unparsed").alias("ut"))
    h = keyed.where("NOT train").select("key", F.col("file_id").alias("h"), F.col("unparsed").alias("uh"))
    lost = t.join(h, "key").where("ut OR uh").select("t", "h", F.lit("unparsed").alias("kind"))
    every = exact.unionByName(near).unionByName(lost)
    return every.groupBy(F.least("t", "h").alias("file_id_a"), F.greatest("t", "h").alias("file_id_b")).agg(F.min("kind").alias("kind"))


def overlap_counts(records: DataFrame, notes: DataFrame) -> DataFrame:
    """`split`, `source`, `kind`, `records`, `pairs`: evaluation records that stand in train too, counted per split and source (null source stays null)."""
    cur = current_records(records).select(F.col("file_id").alias("id"), "split", "source").where("split IN ('valid', 'test', 'eval')")
    pairs = materialise(overlap_pairs(records, notes), "overlap")
    ends = pairs.select(F.explode(F.array("file_id_a", "file_id_b")).alias("id"), "kind")
    per = ends.groupBy("id", "kind").agg(F.count("*").alias("pairs"))
    return per.join(cur, "id").groupBy("split", "source", "kind").agg(F.count("*").alias("records"), F.sum("pairs").alias("pairs"))


def related_groups(records: DataFrame, notes: DataFrame) -> DataFrame:
    """`file_id`, `group_file_id`, `note_count`: the smallest record each one belongs to, directly or through others.

    Records are joined to entity nodes (artist, work, music, unparsed copy) rather than to each other, so a group of any
    size costs one edge a record and reason. Entity nodes have negative ids.
    """
    cur = materialise(current_records(records), "current")
    named = materialise(_named(cur, name_classes(records)), "named")
    members, links = music_links(records, notes)

    def star(df: DataFrame, key: str) -> DataFrame:
        """Each record of a key -> the key's smallest record."""
        head = df.groupBy(key).agg(F.min("file_id").alias("dst"))
        return df.select(F.col("file_id").alias("src"), key).join(head, key).where("src <> dst").select("src", "dst")

    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(members.where("file_id <> rep").select(F.col("file_id").alias("src"), F.col("rep").alias("dst")))
    for col in ("artist_id", "title_id"):
        edges = edges.unionByName(star(named.where(F.col(col).isNotNull()).select("file_id", col), col))
    keyed = _unparsed_key(named)
    broken = keyed.groupBy("key").agg(F.max("unparsed").alias("any")).where("any").select("key")
    edges = edges.unionByName(star(keyed.join(broken, "key", "left_semi").select("file_id", "key"), "key"))
    cls = components(edges)
    return cur.select("file_id", "note_count").join(cls.select(F.col("node").alias("file_id"), "root"), "file_id", "left").select("file_id", F.coalesce("root", "file_id").alias("group_file_id"), "note_count")


def assign_splits(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """`file_id`, `group_file_id`, `split`: every group whole in one split, shares of records as near the targets as groups allow.

    Groups above LARGE of all records (at most 1 / LARGE can exist, whatever the data's size) are placed largest first where
    most room is left, on the driver. The others are stratified by size band (powers of two); a band's groups are laid end
    to end in hash order and dealt systematically: the split whose share of the band covers a group's middle takes it.
    Null or negative target shares count as none.
    """
    groups = materialise(groups.select("file_id", "group_file_id"), "groups")
    size = groups.groupBy("group_file_id").agg(F.count("*").alias("size"))
    want = [(r[0], max(r[1] or 0.0, 0.0)) for r in targets.select("split_name", "target_share").where("split_name IS NOT NULL").orderBy(F.desc("target_share"), "split_name").collect()]
    whole = sum(s for _, s in want)
    total = groups.count()
    if not want or not whole or not total:
        return groups.select("file_id", "group_file_id", F.lit(None).cast("string").alias("split")).limit(0) if not total else groups.withColumn("split", F.lit(None).cast("string"))
    room = {n: s / whole * total for n, s in want}
    big = size.where(F.col("size") > LARGE * total).orderBy(F.desc("size"), "group_file_id").collect()
    placed = []
    for g, n in big:
        to = max(room, key=lambda x: (min(room[x] - n, 0), room[x]))
        room[to] -= n
        placed.append((g, to))
    rest = {n: max(v, 0.0) for n, v in room.items()}
    whole = sum(rest.values()) or 1.0
    small = size.where(F.col("size") <= LARGE * total)
    # running positions without one window a band: sums per hash bucket first, then within the bucket
    small = small.withColumn("band", F.floor(F.log2("size"))).withColumn("h", F.xxhash64("group_file_id")).withColumn("bucket", F.pmod("h", F.lit(4096)))
    start = small.groupBy("band", "bucket").agg(F.sum("size").alias("n"))
    start = start.select("band", "bucket", (F.sum("n").over(W.partitionBy("band").orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy("band")).alias("held"))
    within = F.sum("size").over(W.partitionBy("band", "bucket").orderBy("h", "group_file_id")) - F.col("size") / 2
    laid = small.withColumn("within", within).join(start, ["band", "bucket"]).withColumn("at", (F.col("before") + F.col("within")) / F.col("held"))
    pick, upto = F.lit(want[0][0]), 0.0
    for n, v in rest.items():
        pick = F.when(F.col("at") >= upto, F.lit(n)).otherwise(pick) if v > 0 else pick
        upto += v / whole
    dealt = laid.select("group_file_id", pick.alias("split"))
    spark = groups.sparkSession
    if placed:
        dealt = dealt.unionByName(spark.createDataFrame(placed, "group_file_id long, split string"))
    return groups.join(dealt, "group_file_id").select("file_id", "group_file_id", "split")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """`split`, `records`, `share`, `target_share`: what a split got and should get."""
    total = W.partitionBy()
    got = assigned.groupBy("split").agg(F.count("*").alias("records"))
    want = targets.select(F.col("split_name").alias("split"), "target_share")
    return got.join(want, "split", "full").select("split", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) / F.sum("records").over(total)).alias("share"), "target_share")
