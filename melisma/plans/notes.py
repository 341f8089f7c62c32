"""Queries of message pairing, file metrics and cleaning rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import text as X
from melisma.operators import notes as O
from melisma.operators import tokens as T
from melisma.plans.registry import query
from melisma.plans.views import messages, notes, records, twin
from melisma.tables import table


@query(twin("SELECT event_id, file_id, delta, sum(delta) OVER (PARTITION BY file_id ORDER BY msg_idx)::bigint AS abs_tick FROM (SELECT *, tick - coalesce(lag(tick) OVER (PARTITION BY file_id ORDER BY msg_idx), 0) AS delta FROM msgs)", "msgs"))
def w1_absolute_tick(spark: SparkSession, d: str) -> DataFrame:
    rows = O.delta_ticks(messages(spark, d), ["file_id"], ["ts", "event_id"])
    return O.absolute_ticks(rows, ["file_id"], ["ts", "event_id"]).select("event_id", "file_id", "delta", "abs_tick")


_PAIR = """WITH s AS (SELECT *, sum(d) OVER w AS s FROM msgs WINDOW w AS (PARTITION BY file_id, note ORDER BY msg_idx)),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY file_id, note ORDER BY msg_idx)) AS m FROM s),
l AS (SELECT *, s - m + (d < 0)::int AS level FROM m QUALIFY NOT (d < 0 AND m < coalesce(lag(m) OVER (PARTITION BY file_id, note ORDER BY msg_idx), 0)))
SELECT a.file_id, a.note, a.tick AS start_tick, min_by(b.tick, b.msg_idx) AS end_tick, a.event_id AS start_event_id, min_by(b.event_id, b.msg_idx) AS end_event_id
FROM l a JOIN l b ON a.file_id = b.file_id AND a.note = b.note AND a.level = b.level AND a.d > 0 AND b.d < 0 AND b.msg_idx > a.msg_idx
WHERE NOT EXISTS (SELECT 1 FROM l c WHERE c.file_id = a.file_id AND c.note = a.note AND c.level = a.level AND c.d > 0 AND c.msg_idx > a.msg_idx AND c.msg_idx < (SELECT min(e.msg_idx) FROM l e WHERE e.file_id = a.file_id AND e.note = a.note AND e.level = a.level AND e.d < 0 AND e.msg_idx > a.msg_idx))
GROUP BY ALL"""


@query(twin(_PAIR, "msgs"))
def w2_lifo_notes(spark: SparkSession, d: str) -> DataFrame:
    return O.paired_notes(messages(spark, d), ["file_id", "note"], ["ts", "event_id"], ["tick", "event_id"])


_POLY = """p AS (SELECT file_id, start_tick AS tick, 1 AS d FROM notes WHERE end_tick > start_tick UNION ALL SELECT file_id, end_tick, -1 FROM notes WHERE end_tick > start_tick),
poly AS (SELECT file_id, max(now)::bigint AS max_polyphony FROM (SELECT file_id, sum(d) OVER (PARTITION BY file_id ORDER BY tick, d ROWS UNBOUNDED PRECEDING) AS now FROM p) GROUP BY file_id)"""


@query(twin(f"WITH {_POLY} SELECT * FROM poly", "notes"))
def w3_max_polyphony(spark: SparkSession, d: str) -> DataFrame:
    return O.max_polyphony(notes(spark, d))


_TEMPOS = "t AS (SELECT seq_id, bar_idx * 1920 AS tick, arg_max(try_cast(substr(effective_tempo_token, 7) AS double), (analysed_at, loaded_at, try_cast(substr(effective_tempo_token, 7) AS double))) AS bpm FROM bar_info WHERE effective_tempo_token IS NOT NULL AND loaded_at IS NOT NULL GROUP BY ALL)"


def bar_tempos(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bar_info").where("effective_tempo_token IS NOT NULL AND loaded_at IS NOT NULL")
    rows = rows.select("seq_id", (F.col("bar_idx") * 1920).alias("tick"), X.prefixed_int(F.col("effective_tempo_token"), "TEMPO_").cast("double").alias("bpm"), "analysed_at", "loaded_at")
    return O.merged_tempos(rows.withColumn("b", F.col("bpm")), "seq_id", ["analysed_at", "loaded_at", "b"])


@query(f"WITH {_TEMPOS} SELECT * FROM t WHERE bpm IS NOT NULL")
def w4_tempo_changes(spark: SparkSession, d: str) -> DataFrame:
    return bar_tempos(spark, d)


_LEN = """, l AS (SELECT seq_id, (max(bar_idx) + 1) * 1920 AS last FROM bar_info GROUP BY seq_id), u AS (SELECT seq_id, tick, bpm FROM t WHERE bpm IS NOT NULL UNION ALL SELECT seq_id, 0, 120.0 FROM l WHERE seq_id NOT IN (SELECT seq_id FROM t WHERE tick = 0 AND bpm IS NOT NULL)),
s AS (SELECT seq_id, tick, bpm, last, coalesce(lead(tick) OVER (PARTITION BY seq_id ORDER BY tick), last) AS nxt FROM u JOIN l USING (seq_id))
SELECT seq_id, round(sum(greatest(0, least(nxt, last) - least(tick, last)) * 60.0::double / bpm / 480), 6) AS seconds FROM s GROUP BY seq_id"""


@query(f"WITH {_TEMPOS}{_LEN}")
def f23_playback_seconds(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "bar_info").groupBy("seq_id").agg(((F.max("bar_idx") + 1) * 1920).alias("last_tick")).withColumn("ticks_per_beat", F.lit(480))
    return O.playback_seconds(bar_tempos(spark, d), last, "seq_id").select("seq_id", F.round("seconds", 6).alias("seconds"))


# messages of several tracks, channels and kinds, from `events`
_MIDI = """midi AS (SELECT user_id AS file_id, (event_id % 3)::int AS track_idx, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id)::int AS msg_idx,
CASE event_type WHEN 'purchase' THEN 'note_off' WHEN 'signup' THEN 'program_change' WHEN 'error' THEN 'set_tempo' ELSE 'note_on' END AS type, json_extract_string(props, '$.k')::int AS k, event_type, user_id FROM events),
m AS (SELECT file_id, track_idx, msg_idx, type, CASE WHEN type <> 'set_tempo' THEN k % 16 END AS channel, CASE WHEN type LIKE 'note%' THEN 21 + k END AS note, CASE WHEN type = 'program_change' THEN 28 + k END AS program, CASE WHEN type = 'note_on' THEN k END AS velocity FROM midi)"""
_STATS = """, st AS (SELECT file_id, track_idx, count(*) FILTER (channel <> 9 AND type = 'note_on' AND velocity > 0) AS note_count, coalesce(bool_or(channel <> 9 AND type = 'program_change' AND program = 30), false) AS has_piano, bool_or(channel IS NOT NULL) AS has_channel FROM m GROUP BY ALL)"""
_LEAD = ", ld AS (SELECT file_id, track_idx FROM st WHERE note_count > 0 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY has_piano DESC, note_count DESC, track_idx) = 1)"
_KEPT = ", kt AS (SELECT st.file_id, st.track_idx, CASE WHEN note_count > 0 THEN coalesce(st.track_idx = ld.track_idx, false) ELSE NOT has_channel END AS kept FROM st LEFT JOIN ld ON st.file_id = ld.file_id)"


def midi_messages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k, t = F.get_json_object("props", "$.k").cast("int"), F.col("type")
    kind = F.when(F.col("event_type") == "purchase", "note_off").when(F.col("event_type") == "signup", "program_change").when(F.col("event_type") == "error", "set_tempo").otherwise("note_on")
    idx = F.expr("row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id)")
    rows = e.select(F.col("user_id").alias("file_id"), (F.col("event_id") % 3).cast("int").alias("track_idx"), idx.alias("msg_idx"), kind.alias("type"), k.alias("k"))
    return rows.select("file_id", "track_idx", "msg_idx", "type", F.when(t != "set_tempo", F.col("k") % 16).alias("channel"), F.when(t.startswith("note"), F.col("k") + 21).alias("note"), F.when(t == "program_change", F.col("k") + 28).alias("program"), F.when(t == "note_on", F.col("k")).alias("velocity"))


@query(f"WITH {_MIDI}{_STATS} SELECT * FROM st")
def g0_track_stats(spark: SparkSession, d: str) -> DataFrame:
    return O.track_stats(midi_messages(spark, d), piano=30)


@query(f"WITH {_MIDI}{_STATS}{_LEAD} SELECT * FROM ld")
def p3_primary_track(spark: SparkSession, d: str) -> DataFrame:
    return O.primary_track(O.track_stats(midi_messages(spark, d), piano=30))


@query(f"WITH {_MIDI}{_STATS}{_LEAD}{_KEPT} SELECT * FROM kt")
def p4_kept_tracks(spark: SparkSession, d: str) -> DataFrame:
    return O.kept_tracks(O.track_stats(midi_messages(spark, d), piano=30))


_FILTER = """, r AS (SELECT m.*, kt.kept AS tk, coalesce(last_value(CASE WHEN type = 'program_change' AND channel <> 9 THEN program BETWEEN 112 AND 119 END IGNORE NULLS) OVER (PARTITION BY m.file_id, m.track_idx, channel ORDER BY msg_idx ROWS UNBOUNDED PRECEDING), false) AS drums FROM m JOIN kt USING (file_id, track_idx)),
f AS (SELECT file_id, min(track_idx * 100000 + msg_idx) AS first_at FROM r WHERE tk AND type = 'set_tempo' GROUP BY file_id)
SELECT r.file_id, track_idx, msg_idx, type, channel, note, program, velocity, tk AND CASE WHEN type = 'set_tempo' THEN track_idx * 100000 + msg_idx = first_at ELSE channel <> 9 AND NOT drums AND (type NOT LIKE 'note%' OR note BETWEEN 21 AND 108) END AS kept FROM r LEFT JOIN f USING (file_id)"""


@query(f"WITH {_MIDI}{_STATS.replace('program = 30', 'program = 0')}{_LEAD}{_KEPT}{_FILTER}")
def p2_filtered_messages(spark: SparkSession, d: str) -> DataFrame:
    return O.filtered_messages(midi_messages(spark, d))


_CUT = """WITH k AS (SELECT * FROM msgs WHERE tick <= 400), s AS (SELECT file_id, note, msg_idx, sum(d) OVER (PARTITION BY file_id, note ORDER BY msg_idx) AS s FROM k),
o AS (SELECT file_id, note, max_by(s, msg_idx) - least(0, min(s)) AS n FROM s WHERE file_id IN (SELECT file_id FROM msgs WHERE tick > 400) GROUP BY ALL)
SELECT file_id, note, tick, d FROM k UNION ALL SELECT file_id, note, 400, -1 FROM (SELECT file_id, note, unnest(range(n::bigint)) FROM o WHERE n > 0)"""


@query(twin(_CUT, "msgs"))
def p5_truncated(spark: SparkSession, d: str) -> DataFrame:
    return O.truncated(messages(spark, d), 400)


@query(twin("SELECT file_id, count(*) AS notes FROM notes WHERE pitch BETWEEN 21 AND 108 AND end_tick > start_tick GROUP BY file_id", "notes"))
def p6_pitch_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.tokenizer_notes(notes(spark, d)).groupBy("file_id").agg(F.count("*").alias("notes"))


_VARIANTS = "SELECT file_id, o AS \"offset\", count(*) AS notes, sum(pitch + o)::bigint AS pitches FROM notes, (SELECT unnest([-12, -5, -3, 3, 5, 12]) AS o) WHERE pitch BETWEEN 21 AND 108 AND end_tick > start_tick GROUP BY ALL HAVING bool_and(pitch + o BETWEEN 21 AND 108)"


@query(twin(_VARIANTS, "notes"))
def p7_transposed(spark: SparkSession, d: str) -> DataFrame:
    return T.transposed(T.tokenizer_notes(notes(spark, d))).groupBy("file_id", "offset").agg(F.count("*").alias("notes"), F.sum("pitch").alias("pitches"))


@query(twin("SELECT file_id, o AS \"offset\" FROM (SELECT DISTINCT file_id FROM notes), (SELECT unnest([-12, -5, -3, 3, 5, 12]) AS o) WHERE file_id NOT IN (SELECT file_id FROM notes WHERE pitch + o NOT BETWEEN 21 AND 108)", "notes"))
def j10_transpose_variants(spark: SparkSession, d: str) -> DataFrame:
    return T.transposed(notes(spark, d)).select("file_id", "offset").distinct()


_SCALE = "(round_even(round_even({x} * 480 / greatest(1, coalesce(ticks_per_beat, 1))::double, 0) / 12.0::double, 0) * 12)::bigint"
_HASH = f"""SELECT cur.file_id, coalesce(sha1(to_json(list_sort(list([{_SCALE.format(x='start_tick')}, {_SCALE.format(x='greatest(0, end_tick - start_tick)')}, pitch::bigint]) FILTER (notes.file_id IS NOT NULL)))::varchar), 'EMPTY') AS content_hash FROM cur LEFT JOIN notes ON notes.file_id = cur.file_id GROUP BY cur.file_id"""


@query(twin(_HASH, "cur", "notes"))
def f33_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return O.content_hash(notes(spark, d), records(spark, d))


@query(twin("SELECT source, median(bpm_median) AS bpm FROM cur GROUP BY source", "cur"))
def g3_median_bpm(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("source").agg(F.median("bpm_median").alias("bpm"))


_MELODIC = "mel AS (SELECT file_id, count(*) FILTER (n >= 8 AND p >= 4) AS melodic_tracks FROM (SELECT file_id, track_idx, count(*) AS n, count(DISTINCT pitch) AS p FROM notes GROUP BY ALL) GROUP BY file_id)"
_METRICS = f"""{_POLY}, {_MELODIC}, base AS (SELECT file_id, count(*) AS n, count(DISTINCT pitch) AS u, count(*) FILTER (end_tick <= start_tick) AS z, max(end_tick) AS last FROM notes GROUP BY file_id),
met AS (SELECT file_id, coalesce(n, 0) AS note_count, coalesce(u, 0) AS unique_pitch, coalesce(z, 0) AS zero_duration, coalesce(max_polyphony, 0) AS max_polyphony, coalesce(melodic_tracks, 0) AS melodic_tracks,
coalesce(ceil(last / greatest(1, coalesce(ticks_per_beat, 480) * 4)::double), 0)::int AS total_bars, duration_sec, bpm_median FROM cur LEFT JOIN base USING (file_id) LEFT JOIN poly USING (file_id) LEFT JOIN mel USING (file_id)),
why AS (SELECT file_id, CASE WHEN note_count < 50 THEN 'note_count_below_min' WHEN unique_pitch < 5 THEN 'unique_pitch_below_min' WHEN zero_duration > 0 THEN 'contains_zero_duration_note' WHEN max_polyphony > 24 THEN 'polyphony_exceeds_limit'
WHEN melodic_tracks < 1 THEN 'no_melody_track' WHEN total_bars < 8 THEN 'bars_too_short' WHEN duration_sec < 10 THEN 'duration_too_short' WHEN bpm_median NOT BETWEEN 40 AND 220 THEN 'bpm_out_of_range' END AS reason FROM met)"""


@query(twin(f"WITH {_METRICS} SELECT * FROM met", "cur", "notes"))
def g4_file_metrics(spark: SparkSession, d: str) -> DataFrame:
    return O.file_metrics(notes(spark, d), records(spark, d))


@query(twin(f"WITH {_MELODIC} SELECT * FROM mel", "notes"))
def g5_melodic_tracks(spark: SparkSession, d: str) -> DataFrame:
    return O.melodic_tracks(notes(spark, d))


def reasons(spark: SparkSession, d: str) -> DataFrame:
    return O.file_metrics(notes(spark, d), records(spark, d)).select("file_id", O.drop_reason().alias("reason"))


@query(twin(f"WITH {_METRICS} SELECT * FROM why", "cur", "notes"))
def p1_drop_reason(spark: SparkSession, d: str) -> DataFrame:
    return reasons(spark, d)


@query(twin(f"WITH {_METRICS} SELECT reason, count(*) AS files, row_number() OVER (ORDER BY count(*) DESC, min(file_id))::int AS place FROM why WHERE reason IS NOT NULL GROUP BY reason", "cur", "notes"))
def g6_drop_distribution(spark: SparkSession, d: str) -> DataFrame:
    return O.reason_counts(reasons(spark, d))


@query(twin(f"WITH {_METRICS} SELECT count(*) AS files, count(*) FILTER (reason IS NULL) AS kept, count(reason) AS dropped, round(count(*) FILTER (reason IS NULL) / count(*)::double, 6) AS keep_rate, count(*) FILTER (note_count = 0) AS empty FROM why JOIN met USING (file_id)", "cur", "notes"))
def g7_clean_report(spark: SparkSession, d: str) -> DataFrame:
    m = O.file_metrics(notes(spark, d), records(spark, d)).withColumn("reason", O.drop_reason())
    kept = F.count_if(F.col("reason").isNull())
    return m.agg(F.count("*").alias("files"), kept.alias("kept"), F.count("reason").alias("dropped"), F.round(kept / F.count("*"), 6).alias("keep_rate"), F.count_if(F.col("note_count") == 0).alias("empty"))


_MERGE = "SELECT file_id, tick, kind, note, tick - coalesce(lag(tick) OVER (PARTITION BY file_id ORDER BY tick, kind, note, seq), 0) AS delta FROM (SELECT file_id, tick, CASE WHEN d < 0 THEN 0 ELSE 1 END AS kind, note, event_id AS seq FROM msgs)"


@query(twin(_MERGE, "msgs"))
def o3_merge_sort_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).select("file_id", "tick", F.when(F.col("d") < 0, 0).otherwise(1).alias("kind"), "note", F.col("event_id").alias("seq"))
    return O.delta_ticks(rows, ["file_id"], ["tick", "kind", "note", "seq"]).drop("seq")
