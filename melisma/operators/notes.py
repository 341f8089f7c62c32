"""Messages to notes and file metrics: pairing, polyphony, filters, validation, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.functions import numeric as N

# General MIDI programs of the percussive family; the drum channel (0-based).
DRUM_PROGRAMS = tuple(range(112, 120))
DRUM_CHANNEL = 9

#: Limits of the ordered drop rules; pass other values as a dict of the same keys.
LIMITS = {
    "min_note_count": 50, "min_unique_pitch": 5, "drop_zero_duration": True, "max_simultaneous": 24, "min_melody_tracks": 1,
    "min_total_bars": 8, "min_duration_sec": 10.0, "bpm_min": 40.0, "bpm_max": 220.0,
}


def absolute_ticks(messages: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds `abs_tick`, the running sum of `delta` within a track; null deltas count as 0."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return messages.withColumn("abs_tick", F.sum(F.coalesce("delta", F.lit(0))).over(w))


def delta_ticks(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds `delta`: ticks since the event before in merge order, the first one since 0."""
    return events.withColumn("delta", F.col("tick") - F.coalesce(F.lag("tick").over(W.partitionBy(*by).orderBy(*order)), F.lit(0)))


def paired_notes(messages: DataFrame, by: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """On and off messages (`d` +1 and -1) of a key -> notes, last on first off.

    The stack is read off running sums: its depth is the sum of `d` above its running minimum, an off that lowers the
    minimum met an empty stack and is dropped, and an on pairs with the next off of its own level. Ons without such an
    off stay open and are dropped. Gives `by`, `carry` of both ends as start_* and end_*.
    """
    w = W.partitionBy(*by).orderBy(*order)
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    s = messages.withColumn("_s", F.sum("d").over(run))
    s = s.withColumn("_m", F.least(F.lit(0), F.min("_s").over(run)))
    s = s.withColumn("_fell", (F.col("d") < 0) & (F.col("_m") < F.coalesce(F.lag("_m").over(w), F.lit(0)))).where("NOT _fell")
    s = s.withColumn("_level", F.col("_s") - F.col("_m") + F.when(F.col("d") < 0, 1).otherwise(0))
    at = W.partitionBy(*by, "_level").orderBy(*order)
    nxt = s.select("*", F.lead("d").over(at).alias("_d"), *[F.lead(c).over(at).alias(f"end_{c}") for c in carry])
    return nxt.where("d > 0 AND _d < 0").select(*by, *[F.col(c).alias(f"start_{c}") for c in carry], *[f"end_{c}" for c in carry])


def max_polyphony(notes: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `max_polyphony`: most notes that sound at once; at equal ticks ends come before starts, notes without length don't count."""
    n = notes.where("end_tick > start_tick")
    points = n.select(key, F.explode(F.array(F.struct(F.col("start_tick").alias("tick"), F.lit(1).alias("d")), F.struct(F.col("end_tick").alias("tick"), F.lit(-1).alias("d")))).alias("p"))
    net = points.groupBy(key, F.col("p.tick").alias("tick")).agg(F.sum("p.d").alias("d"))  # ends first: the most at a tick is after all of them
    run = F.sum("d").over(W.partitionBy(key).orderBy("tick").rowsBetween(W.unboundedPreceding, W.currentRow))
    return net.select(key, run.alias("now")).groupBy(key).agg(F.max("now").alias("max_polyphony"))


def merged_tempos(tempos: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`key`, `tick`, `bpm`: of several tempo events at one tick the last in `order` counts. Null ticks and tempos are dropped."""
    last = F.max(F.struct(*[F.col(c) for c in order], F.col("bpm").alias("bpm")))
    return tempos.where("tick IS NOT NULL AND bpm IS NOT NULL").groupBy(key, "tick").agg(last.alias("e")).select(key, "tick", F.col("e.bpm").alias("bpm"))


def playback_seconds(tempos: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """`key`, `seconds`: playing time up to `last_tick` with `ticks_per_beat`, each tempo from its tick on, 120 before the first."""
    first = lengths.select(key, F.lit(0).cast("long").alias("tick"), F.lit(120.0).alias("bpm"), F.lit(0).alias("real"))
    both = first.unionByName(tempos.select(key, F.col("tick").cast("long"), "bpm", F.lit(1).alias("real")))
    held = merged_tempos(both.withColumn("o", F.col("real")), key, ["o"]).join(lengths, key)
    nxt = F.coalesce(F.lead("tick").over(W.partitionBy(key).orderBy("tick")), F.col("last_tick"))
    span = F.greatest(F.lit(0), F.least(nxt, "last_tick") - F.least("tick", "last_tick"))
    return held.withColumn("part", span * 60.0 / F.col("bpm") / F.col("ticks_per_beat")).groupBy(key).agg(F.sum("part").alias("seconds"))


def track_stats(messages: DataFrame, piano: int = 0) -> DataFrame:
    """`file_id`, `track_idx`, `note_count`, `has_piano`, `has_channel`: drum-channel messages only show that the track has channel messages."""
    channel, tuned = F.col("channel").isNotNull(), F.col("channel").isNotNull() & (F.col("channel") != DRUM_CHANNEL)
    return messages.groupBy("file_id", "track_idx").agg(
        F.count_if(tuned & (F.col("type") == "note_on") & (F.col("velocity") > 0)).alias("note_count"),
        F.coalesce(F.bool_or(tuned & (F.col("type") == "program_change") & (F.col("program") == piano)), F.lit(False)).alias("has_piano"),
        F.bool_or(channel).alias("has_channel"),
    )


def primary_track(stats: DataFrame, mode: str = "piano_first_then_most_notes") -> DataFrame:
    """`file_id`, `track_idx` of the leading track; files without a candidate have no row. Ties go to the first track."""
    if mode not in ("none", "most_notes", "piano_only", "piano_first_then_most_notes"):
        raise ValueError(f"unknown mode {mode!r}")
    tracks = stats.where("note_count > 0")
    if mode == "none":
        tracks = tracks.limit(0)
    elif mode == "piano_only":
        tracks = tracks.where("has_piano")
    piano = F.col("has_piano").cast("int") if mode == "piano_first_then_most_notes" else F.lit(0)
    best = tracks.groupBy("file_id").agg(F.max(F.struct(piano.alias("p"), F.col("note_count").alias("n"), (-F.col("track_idx")).alias("t"))).alias("b"))
    return best.select("file_id", (-F.col("b.t")).alias("track_idx"))


def kept_tracks(stats: DataFrame, mode: str = "piano_first_then_most_notes") -> DataFrame:
    """`file_id`, `track_idx`, `kept`: of the tracks with notes only the leading one, of the others those without channel messages; mode 'none' keeps all."""
    lead = primary_track(stats, mode).select("file_id", F.col("track_idx").alias("lead"))
    kept = F.when(F.col("note_count") > 0, F.coalesce(F.col("track_idx") == F.col("lead"), F.lit(False))).otherwise(~F.col("has_channel"))
    return stats.join(lead, "file_id", "left").select("file_id", "track_idx", (F.lit(True) if mode == "none" else kept).alias("kept"))


def filtered_messages(messages: DataFrame, mode: str = "piano_first_then_most_notes", low: int = N.PITCH_MIN, high: int = N.PITCH_MAX) -> DataFrame:
    """Adds `kept` to message rows (`file_id`, `track_idx`, `msg_idx`, `type`, `channel`, `note`, `program`, `velocity`).

    Dropped: tracks not kept, all tempo messages but the first of the kept tracks in track order, the drum channel, drum
    programs and all that follows on their channel until another program, and notes outside the pitch range. In absolute
    ticks the time of a dropped message is carried on by itself.
    """
    rows = messages.join(kept_tracks(track_stats(messages), mode).withColumnRenamed("kept", "track_kept"), ["file_id", "track_idx"])
    drum = F.col("program").isin(*DRUM_PROGRAMS)
    is_program = (F.col("type") == "program_change") & (F.col("channel") != DRUM_CHANNEL)
    upto = W.partitionBy("file_id", "track_idx", "channel").orderBy("msg_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_drums", F.coalesce(F.last(F.when(is_program, drum), ignorenulls=True).over(upto), F.lit(False)))
    tempo = F.col("type") == "set_tempo"
    first = F.min(F.when(tempo & F.col("track_kept"), F.struct("track_idx", "msg_idx"))).over(W.partitionBy("file_id"))
    outside = F.col("type").isin("note_on", "note_off") & ~F.col("note").between(low, high)
    channel = F.coalesce((F.col("channel") == DRUM_CHANNEL) | F.col("_drums") | outside, F.lit(False)) & F.col("channel").isNotNull()
    kept = F.col("track_kept") & F.when(tempo, F.struct("track_idx", "msg_idx") == first).otherwise(True) & ~channel
    return rows.withColumn("kept", kept).drop("track_kept", "_drums")


def truncated(messages: DataFrame, cutoff: int) -> DataFrame:
    """`file_id`, `note`, `tick`, `d`: messages up to the cutoff tick, and, where a file goes on beyond it, an off at the cutoff for every note still open."""
    beyond = messages.groupBy("file_id").agg(F.max("tick").alias("last")).where(F.col("last") > cutoff).select("file_id")
    kept = messages.where(F.col("tick") <= cutoff)
    run = W.partitionBy("file_id", "note").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = kept.select("file_id", "note", "ts", "event_id", F.sum("d").over(run).alias("s"))
    # what is open at the end: the last sum above the lowest one (or 0)
    end = s.groupBy("file_id", "note").agg(F.max_by("s", F.struct("ts", "event_id")).alias("s"), F.least(F.lit(0), F.min("s")).alias("m"))
    left = end.select("file_id", "note", (F.col("s") - F.col("m")).alias("n")).where("n > 0").join(beyond, "file_id", "left_semi")
    closing = left.select("file_id", "note", F.lit(cutoff).cast("long").alias("tick"), F.explode(F.array_repeat(F.lit(-1), F.col("n").cast("int"))).alias("d"))
    return kept.select("file_id", "note", "tick", "d").unionByName(closing)


def content_hash(notes: DataFrame, files: DataFrame, resolution: int = 12) -> DataFrame:
    """`file_id`, `content_hash`: SHA-1 of the sorted (start, length, pitch) triples at 480 ticks a beat, rounded to the resolution; 'EMPTY' without notes.

    Rounding is half-even, twice, and the triples are written as compact JSON. Null ticks_per_beat counts as 1.
    """
    q = float(max(1, resolution))
    tpb = F.greatest(F.lit(1), F.coalesce("ticks_per_beat", F.lit(1)))

    def scaled(c: Column) -> Column:
        return (F.rint(F.rint(c * 480 / tpb) / q) * q).cast("long")

    rows = notes.join(files.select("file_id", "ticks_per_beat"), "file_id")
    triple = F.array(scaled(F.col("start_tick")), scaled(F.greatest(F.lit(0), F.col("end_tick") - F.col("start_tick"))), F.col("pitch").cast("long"))
    hashed = rows.groupBy("file_id").agg(F.sha1(F.to_json(F.array_sort(F.collect_list(triple)))).alias("h"))
    return files.select("file_id").join(hashed, "file_id", "left").select("file_id", F.coalesce("h", F.lit("EMPTY")).alias("content_hash"))


def melodic_tracks(notes: DataFrame, min_notes: int = 8, min_pitches: int = 4) -> DataFrame:
    """`file_id`, `melodic_tracks`: tracks with so many notes and different pitches."""
    tracks = notes.groupBy("file_id", "track_idx").agg(F.count("*").alias("n"), F.count_distinct("pitch").alias("p"))
    return tracks.groupBy("file_id").agg(F.count_if((F.col("n") >= min_notes) & (F.col("p") >= min_pitches)).alias("melodic_tracks"))


def file_metrics(notes: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file: note_count, unique_pitch, zero_duration, max_polyphony, melodic_tracks, total_bars, duration_sec, bpm_median. Files without notes have zeros."""
    base = notes.groupBy("file_id").agg(F.count("*").alias("note_count"), F.count_distinct("pitch").alias("unique_pitch"), F.count_if(F.col("end_tick") <= F.col("start_tick")).alias("zero_duration"), F.max("end_tick").alias("last"))
    rows = files.select("file_id", "ticks_per_beat", "duration_sec", "bpm_median").join(base, "file_id", "left").join(max_polyphony(notes), "file_id", "left").join(melodic_tracks(notes), "file_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("note_count", "unique_pitch", "zero_duration", "max_polyphony", "melodic_tracks")]
    bars = N.total_bars(F.col("last"), N.bar_ticks(F.coalesce("ticks_per_beat", F.lit(480))))
    return rows.select("file_id", *zero, bars.alias("total_bars"), "duration_sec", "bpm_median")


def drop_reason(limits: dict | None = None) -> Column:
    """The first rule a row of file metrics breaks, null if none; a missing tempo passes, a missing duration doesn't count as short."""
    m = LIMITS | (limits or {})
    c = F.col
    rules = [
        (c("note_count") < m["min_note_count"], "note_count_below_min"), (c("unique_pitch") < m["min_unique_pitch"], "unique_pitch_below_min"),
        (F.lit(m["drop_zero_duration"]) & (c("zero_duration") > 0), "contains_zero_duration_note"), (c("max_polyphony") > m["max_simultaneous"], "polyphony_exceeds_limit"),
        (c("melodic_tracks") < m["min_melody_tracks"], "no_melody_track"), (c("total_bars") < m["min_total_bars"], "bars_too_short"),
        (c("duration_sec") < m["min_duration_sec"], "duration_too_short"), (~c("bpm_median").between(m["bpm_min"], m["bpm_max"]), "bpm_out_of_range"),
    ]
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules])


def reason_counts(reasons: DataFrame, order: str = "file_id") -> DataFrame:
    """`reason`, `files`, `place`: most frequent first, ties by first appearance in `order`."""
    n = reasons.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("files"), F.min(order).alias("first"))
    return n.select("reason", "files", F.row_number().over(W.orderBy(F.desc("files"), "first")).alias("place"))
