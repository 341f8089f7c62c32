"""Notes to the token language and back to rows: grid, streams, vocabulary, encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.functions import numeric as N

# Special and task tokens, instruments and key roots, in vocabulary order.
SPECIAL = ("BOS", "EOS", "FIM_HOLE", "FIM_MID")
INSTRUMENTS = ("PIANO",)
ROOTS = ("C", "C_SHARP", "D", "D_SHARP", "E", "F", "F_SHARP", "G", "G_SHARP", "A", "A_SHARP", "B")
# Offsets by which training sequences are transposed.
TRANSPOSE = (-12, -5, -3, 3, 5, 12)


def note_rows(events: DataFrame) -> DataFrame:
    """Notes that count: closed, readable, not of the drum channel; repeated rows collapse to the greatest velocity."""
    ok = "file_id IS NOT NULL AND start_tick IS NOT NULL AND end_tick IS NOT NULL AND pitch IS NOT NULL AND (channel IS NULL OR channel <> 9)"
    return events.where(ok).groupBy("file_id", "track_idx", "channel", "start_tick", "end_tick", "pitch").agg(F.max("velocity").alias("velocity"))


def tokenizer_notes(notes: DataFrame) -> DataFrame:
    """Notes within the pitch range and of some length."""
    return notes.where((F.col("pitch").between(N.PITCH_MIN, N.PITCH_MAX)) & (F.col("end_tick") > F.col("start_tick")))


def grid(notes: DataFrame, files: DataFrame) -> DataFrame:
    """`file_id`, `bar`, `pos`, `pitch`, `dur`, `vel`: notes on the 32-step bar grid.

    `files` gives ticks_per_beat (null counts as 480; files with none above 0 have no rows). Null velocity counts as 64.
    """
    tpb = files.select("file_id", F.coalesce("ticks_per_beat", F.lit(480)).alias("tpb")).where("tpb > 0")
    n = tokenizer_notes(notes).where("start_tick >= 0").join(tpb, "file_id").withColumn("ticks", N.bar_ticks(F.col("tpb")).cast("long"))
    step = F.col("ticks") / 32.0
    length = F.greatest(F.lit(1), N.whole((F.col("end_tick") - F.col("start_tick")) / step))
    return n.select(
        "file_id", F.expr("start_tick div ticks").alias("bar"), N.clip(N.whole((F.col("start_tick") % F.col("ticks")) / step), 0, 31).alias("pos"), "pitch",
        N.nearest(length).alias("dur"), N.velocity_bin(F.coalesce("velocity", F.lit(64))).alias("vel"),
    )


def numbered(events: DataFrame) -> DataFrame:
    """Grid rows with `event_idx` (order within the file) and `unit` (32 a bar)."""
    order = W.partitionBy("file_id").orderBy("bar", "pos", "pitch", "dur", "vel")
    return events.withColumn("event_idx", F.row_number().over(order).cast("long") - 1).withColumn("unit", F.col("bar") * 32 + F.col("pos"))


def transposed(notes: DataFrame, offsets=TRANSPOSE) -> DataFrame:
    """Every note at every offset, for the (file, offset) variants of which no note leaves the pitch range. 0 and repeats among the offsets are dropped."""
    kept = [o for o in dict.fromkeys(offsets) if o]
    reach = notes.groupBy("file_id").agg(F.min("pitch").alias("low"), F.max("pitch").alias("high"))
    ok = reach.select("file_id", "low", "high", F.explode(F.array(*[F.lit(o) for o in kept])).alias("offset")).where((F.col("low") + F.col("offset") >= N.PITCH_MIN) & (F.col("high") + F.col("offset") <= N.PITCH_MAX))
    return notes.join(ok.select("file_id", "offset"), "file_id").withColumn("pitch", F.col("pitch") + F.col("offset"))


def token_stream(events: DataFrame, files: DataFrame, tempo: Column) -> DataFrame:
    """`file_id`, `tokens` array: BOS tempo (BAR note*)* EOS, without keys; a full spine of bars, empty ones included.

    One row per file of `files`; a file without notes gives BOS EOS. `tempo` is the file's tempo token (an expression over `files`).
    """
    note = F.concat(F.lit("POS_"), "pos", F.lit(" INST_PIANO PITCH_"), "pitch", F.lit(" DUR_"), "dur", F.lit(" VEL_"), "vel")
    rows = events.select("file_id", "bar", F.struct("pos", "pitch", "dur", "vel", note.alias("text")).alias("e"))
    bars = rows.groupBy("file_id", "bar").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]), " ").alias("body"))
    by_bar = bars.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("bar", "body"))).alias("bodies"), F.max("bar").alias("last"))
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda b: F.concat_ws(" ", F.lit("BAR"), F.try_element_at(F.col("bodies"), b))))
    whole = F.when(F.col("last").isNotNull(), F.concat_ws(" ", F.lit("BOS"), "tempo", text, F.lit("EOS"))).otherwise("BOS EOS")
    return files.select("file_id", tempo.alias("tempo")).join(by_bar, "file_id", "left").select("file_id", F.split(whole, " ").alias("tokens"))


def vocabulary(spark) -> DataFrame:
    """`id`, `token`: the vocabulary in its fixed order, first occurrences only, ids dense from 0."""

    def run(prefix: str, first: int, last: int, step: int = 1) -> Column:
        return F.transform(F.sequence(F.lit(first), F.lit(last), F.lit(step)), lambda i: F.concat(F.lit(prefix), i.cast("string")))

    def words(*items: str) -> Column:
        return F.array(*[F.lit(x) for x in items])

    parts = [
        words(*SPECIAL), words("BAR"), run("POS_", 0, N.POSITIONS - 1), words(*[f"INST_{x}" for x in INSTRUMENTS]), run("PITCH_", N.PITCH_MIN, N.PITCH_MAX),
        words(*[f"DUR_{x}" for x in N.DURATIONS]), run("VEL_", 0, N.BINS - 1), run("TEMPO_", N.TEMPO_MIN, N.TEMPO_MAX, N.TEMPO_STEP),
        words(*[f"KEY_{r}_MAJ" for r in ROOTS]), words(*[f"KEY_{r}_MIN" for r in ROOTS]), words("KEY_UNCERTAIN"),
    ]
    return spark.range(1).select(F.posexplode(F.array_distinct(F.concat(*parts))).alias("id", "token"))


def encoded(streams: DataFrame, vocab: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `ids`, `oov`: ids of the known tokens in order, and how many tokens were unknown. The vocabulary is a few hundred rows."""
    rows = streams.select(key, F.posexplode("tokens").alias("at", "token")).join(F.broadcast(vocab), "token", "left")
    known = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id"))))
    return rows.groupBy(key).agg(F.transform(known, lambda x: x["id"]).alias("ids"), F.count_if(F.col("id").isNull()).alias("oov"))
