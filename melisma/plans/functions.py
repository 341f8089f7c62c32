"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import numeric as N
from melisma.functions import text as X
from melisma.plans.registry import query
from melisma.plans.views import checkpoints, messages, notes, records, token_grid, twin
from melisma.tables import table


def velocity_bin_sql(v: str) -> str:
    x = f"((least(127, greatest(1, {v}))::double - 64) / 63)"
    return f"least(15, greatest(0, round_even((CASE WHEN {x} < 0 THEN -1 ELSE 1 END * ln(1 + 8 * abs({x})) / ln(9.0::double) + 1) / 2 * 15, 0)))::int"


def velocity_value_sql(b: str) -> str:
    s = f"(2.0::double * {b} / 15 - 1)"
    return f"least(127, greatest(1, round_even(64 + 63 * CASE WHEN {s} < 0 THEN -1 ELSE 1 END * (pow(9.0::double, abs({s})) - 1) / 8, 0)))::int"


def tempo_sql(bpm: str) -> str:
    return f"'TEMPO_' || (40 + 2 * round_even((least(220, greatest(40, round_even({bpm}, 0))) - 40) / 2, 0))::int"


def smooth_sql(t: str) -> str:
    t = f"greatest(0.0::double, least(1.0::double, {t}))"
    return f"({t} * {t} * (3 - 2 * {t}))"


@query("SELECT velocity, " + velocity_bin_sql("velocity") + " AS bin, count(*) AS notes FROM note_events WHERE velocity IS NOT NULL GROUP BY velocity")
def f1_velocity_bins(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "note_events").where("velocity IS NOT NULL").groupBy("velocity").agg(F.count("*").alias("notes"))
    return v.select("velocity", N.velocity_bin(F.col("velocity")).alias("bin"), "notes")


@query(f"SELECT bin, {velocity_value_sql('bin')} AS velocity, count(*) AS notes FROM (SELECT {velocity_bin_sql('velocity')} AS bin FROM note_events WHERE velocity IS NOT NULL) GROUP BY bin")
def f2_velocity_decode(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "note_events").where("velocity IS NOT NULL").groupBy(N.velocity_bin(F.col("velocity")).alias("bin")).agg(F.count("*").alias("notes"))
    return b.select("bin", N.velocity_value(F.col("bin")).alias("velocity"), "notes")


@query(f"SELECT range::int AS bin, {velocity_value_sql('range')} AS velocity FROM range(16)")
def f3_velocity_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(N.BINS).select(F.col("id").cast("int").alias("bin"), N.velocity_value(F.col("id")).alias("velocity"))


@query(f"SELECT file_id, bpm_median, {tempo_sql('bpm_median')} AS token FROM file_records WHERE bpm_median IS NOT NULL")
def f4_tempo_token(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_records").where("bpm_median IS NOT NULL").select("file_id", "bpm_median", N.tempo_token(F.col("bpm_median")).alias("token"))


@query("SELECT event_id, value, list_sort(list_transform([1,2,3,4,6,8,12,16,24,32], lambda b: [abs(greatest(1, round_even(value / 4, 0)) - b), b]))[1][2]::int AS dur FROM events WHERE value IS NOT NULL")
def f5_duration_bin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", "value", N.nearest(F.greatest(F.lit(1), N.whole(F.col("value") / 4))).alias("dur"))


@query("SELECT file_id, round(60000000 / tempo_us::double, 6) AS bpm, tempo_us FROM (SELECT file_id, round_even(60000000 / nullif(bpm_median, 0), 0)::bigint AS tempo_us FROM file_records WHERE bpm_median > 0)")
def f6_tempo_conversion(spark: SparkSession, d: str) -> DataFrame:
    us = table(spark, d, "file_records").where("bpm_median > 0").select("file_id", F.rint(F.lit(60_000_000) / F.col("bpm_median")).cast("long").alias("tempo_us"))
    return us.select("file_id", F.round(N.bpm_of(F.col("tempo_us")), 6).alias("bpm"), "tempo_us")


@query("SELECT file_id, ticks_per_beat, greatest(1, round_even(ticks_per_beat * 4.0::double, 0)::int) AS common, greatest(1, round_even(ticks_per_beat * (6 * 0.5::double), 0)::int) AS six_eight FROM file_records WHERE ticks_per_beat IS NOT NULL")
def f7_bar_ticks(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ticks_per_beat")
    return table(spark, d, "file_records").where("ticks_per_beat IS NOT NULL").select("file_id", "ticks_per_beat", N.bar_ticks(t).alias("common"), N.bar_ticks(t, F.lit(6), F.lit(8)).alias("six_eight"))


@query(twin("SELECT file_id, event_id, (greatest(0, tick) // 32)::int AS bar, (greatest(0, tick) % 32)::int AS pos FROM msgs", "msgs"))
def f8_unit_to_bar_pos(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("file_id", "event_id", N.unit_bar(F.col("tick")).alias("bar"), N.unit_pos(F.col("tick")).alias("pos"))


@query("SELECT l_orderkey, l_linenumber, round(least(1.0::double, greatest(0.0::double, abs(l_quantity - l_linenumber) / greatest(1.0::double, abs(l_quantity), abs(l_linenumber)))), 6) AS ratio FROM lineitem")
def f9_safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.safe_ratio(F.abs(a - b), a, b), 6).alias("ratio"))


_PIECE = """SELECT event_id, round(CASE WHEN value <= 5 THEN 0.0 WHEN value >= 55 THEN 100.0 WHEN value <= 28 THEN 60 * {a} ELSE 60 + 40 * {b} END::double, 6) AS score_max,
round(CASE WHEN value >= 98 THEN 0.0 WHEN value <= 18 THEN 100.0 WHEN value >= 60 THEN 60 * {c} ELSE 60 + 40 * {e} END::double, 6) AS score_min FROM events WHERE value IS NOT NULL"""


@query(_PIECE.format(a=smooth_sql("(value - 5) / 23"), b=smooth_sql("(value - 28) / 27"), c=smooth_sql("(98 - value) / 38"), e=smooth_sql("(60 - value) / 42")))
def f10_piecewise_score(spark: SparkSession, d: str) -> DataFrame:
    v, at = F.col("value"), lambda *x: [F.lit(float(y)) for y in x]
    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", F.round(N.piecewise_score(v, F.lit("max"), *at(5, 28, 55)), 6).alias("score_max"), F.round(N.piecewise_score(v, F.lit("min"), *at(98, 60, 18)), 6).alias("score_min"))


_BAND = "SELECT event_id, round(CASE WHEN value BETWEEN 20 AND 30 THEN 100.0 WHEN value >= 10 AND value < 20 THEN 60 + 40 * {a} WHEN value > 30 AND value <= 50 THEN 60 + 40 * {b} WHEN value >= 2 AND value < 10 THEN 60 * {c} WHEN value > 50 AND value <= 90 THEN 60 * {e} ELSE 0.0 END::double, 6) AS score FROM events WHERE value IS NOT NULL"


@query(_BAND.format(a=smooth_sql("(value - 10) / 10"), b=smooth_sql("(50 - value) / 20"), c=smooth_sql("(value - 2) / 8"), e=smooth_sql("(90 - value) / 40")))
def f11_band_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", F.round(N.band_score(F.col("value"), *[F.lit(float(x)) for x in (2, 10, 20, 30, 50, 90)]), 6).alias("score"))


@query("SELECT doc_id, CASE WHEN isfinite(try_cast(trim(substr(text, 1, 12)) AS double)) THEN try_cast(trim(substr(text, 1, 12)) AS double) END AS number, try_cast(json_extract_string('{\"k\": ' || n_chars || '}', '$.k') AS double) AS size FROM documents")
def f12_finite_number(spark: SparkSession, d: str) -> DataFrame:
    head = F.regexp_replace(F.substring("text", 1, 12), r"^ +| +$", "")
    number = F.when(head.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), N.finite(head))
    return table(spark, d, "documents").select("doc_id", number.alias("number"), N.finite(F.col("n_chars").cast("string")).alias("size"))


@query(twin("SELECT step, round(coalesce(CASE WHEN var_pop(x) > 1e-18 AND var_pop(y) > 0 THEN corr(x, y) END, 0.0), 6) AS r FROM (SELECT step, unnest([stop, budget, time_order, empty_bar, first_event, syntax_invalid]) AS x, unnest([1.0, 2.0, 3.0, 4.0, 5.0, 6.0])::double AS y FROM ckpt) GROUP BY step", "ckpt"))
def f13_pearson(spark: SparkSession, d: str) -> DataFrame:
    c = checkpoints(spark, d)
    return c.select("step", F.round(N.pearson(F.array("stop", "budget", "time_order", "empty_bar", "first_event", "syntax_invalid"), [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), 6).alias("r"))


@query("SELECT track_idx, round(greatest(0.0::double, least(1.0::double, -sum(n / t * ln(n / t)) / ln(128.0::double))), 6) AS entropy FROM (SELECT track_idx, n::double AS n, sum(n) OVER (PARTITION BY track_idx)::double AS t FROM (SELECT track_idx, pitch, count(*) AS n FROM note_events WHERE pitch IS NOT NULL GROUP BY ALL)) GROUP BY track_idx")
def f14_entropy(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "note_events").where("pitch IS NOT NULL").groupBy("track_idx", "pitch").agg(F.count("*").alias("n"))
    # -sum(p ln p) = ln t - sum(n ln n) / t: one pass, no window
    e = n.groupBy("track_idx").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
    value = (F.log("t") - F.col("s") / F.col("t")) / F.log(F.lit(128.0))
    return e.select("track_idx", F.round(N.clip(value, 0.0, 1.0), 6).alias("entropy"))


@query(twin("SELECT pos, CASE WHEN pos = 0 THEN 1.6 WHEN pos % 8 = 0 THEN 1.3 ELSE 1.0 END::double AS weight, count(*) AS notes FROM grid GROUP BY pos", "grid"))
def f15_onset_weight(spark: SparkSession, d: str) -> DataFrame:
    return token_grid(spark, d).groupBy("pos").agg(F.count("*").alias("notes")).select("pos", N.onset_weight(F.col("pos")).alias("weight"), "notes")


_STATES = "after_bar after_vel after_pos after_head_tempo expect_bos".split()
_STEPS = "(SELECT a.range::int AS done, b.room, s.state FROM range(130) a, (SELECT unnest([0, 10, 48, 96, 128]) AS room) b, (SELECT unnest(['after_bar', 'after_vel', 'after_pos', 'after_head_tempo', 'expect_bos']) AS state) s)"
_SAFE = "state IN ('after_head_tempo', 'after_bar', 'after_bar_tempo', 'after_vel')"


def _decode_steps(spark: SparkSession) -> DataFrame:
    """All steps of decoding loops of a few sizes and states: the domain of the decode policies."""
    grid = spark.range(130).select(F.col("id").cast("int").alias("done"), F.explode(F.array(*[F.lit(x) for x in (0, 10, 48, 96, 128)])).alias("room"))
    return grid.select("done", "room", F.explode(F.array(*[F.lit(x) for x in _STATES])).alias("state"))


@query(f"""SELECT done, room, state, round(CASE WHEN room <= 0 THEN 0 ELSE CASE WHEN done / room::double >= 0.6 THEN 0.2 ELSE 0 END + CASE WHEN done / room::double >= 0.78 THEN 0.6 ELSE 0 END + CASE WHEN done / room::double >= 0.9 THEN 1.35 ELSE 0 END
+ CASE WHEN room - done <= 6 THEN 0.65 ELSE 0 END + CASE WHEN room - done <= 3 THEN 1.1 ELSE 0 END + CASE WHEN {_SAFE} AND done >= greatest(16, least(32, room // 3)) THEN 0.4 ELSE 0 END END::double, 6) AS bias FROM {_STEPS}""")
def f16_eos_bias(spark: SparkSession, d: str) -> DataFrame:
    return _decode_steps(spark).select("done", "room", "state", F.round(N.eos_bias(F.col("done"), F.col("room"), F.col("state")), 6).alias("bias"))


@query(f"SELECT done, room, state, {_SAFE} AND done > 0 AND room > 0 AND room - done <= greatest(3, least(5, room // 10)) AND done >= greatest(16, least(28, room // 3)) AS stop FROM {_STEPS}")
def f17_safe_stop(spark: SparkSession, d: str) -> DataFrame:
    return _decode_steps(spark).select("done", "room", "state", N.force_stop(F.col("done"), F.col("room"), F.col("state")).alias("stop"))


@query("""SELECT step::int AS step, round(CASE WHEN step <= 100 THEN step / 100.0::double ELSE 0.1 + 0.9 * (1 - (step - 100) / 900.0::double) END, 6) AS linear,
round(CASE WHEN step <= 100 THEN step / 100.0::double ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - 100) / 900.0::double)) END, 6) AS cosine FROM (SELECT range + 1 AS step FROM range(1000))""")
def f18_learning_rate(spark: SparkSession, d: str) -> DataFrame:
    s = spark.range(1, 1001).select(F.col("id").cast("int").alias("step"))
    return s.select("step", *[F.round(N.learning_rate(F.col("step"), k, 1000, 100, 0.1), 6).alias(k) for k in ("linear", "cosine")])


@query(twin("SELECT step, greatest(0, step)::bigint * 8 * 512 AS tokens FROM ckpt", "ckpt"))
def f19_tokens_seen(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints(spark, d).select("step", N.tokens_seen(F.col("step"), F.lit(8), F.lit(512)).alias("tokens"))


@query("SELECT shard_id, num_tokens, ceil(num_tokens / (2 * 4 * 512))::bigint AS steps FROM packed_index WHERE num_tokens IS NOT NULL")
def f20_one_pass_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "packed_index").where("num_tokens IS NOT NULL").select("shard_id", "num_tokens", N.one_pass_steps(F.col("num_tokens"), 2, 4, 512).alias("steps"))


@query(twin("SELECT cur.file_id, coalesce(ceil(max(end_tick) / greatest(1, ticks_per_beat * 4)::double), 0)::int AS bars FROM cur LEFT JOIN notes USING (file_id) WHERE ticks_per_beat IS NOT NULL GROUP BY cur.file_id, ticks_per_beat", "cur", "notes"))
def f21_total_bars(spark: SparkSession, d: str) -> DataFrame:
    last = notes(spark, d).groupBy("file_id").agg(F.max("end_tick").alias("last"))
    cur = records(spark, d).where("ticks_per_beat IS NOT NULL").select("file_id", "ticks_per_beat")
    return cur.join(last, "file_id", "left").select("file_id", N.total_bars(F.col("last"), N.bar_ticks(F.col("ticks_per_beat"))).alias("bars"))


@query("SELECT source, round(count(*) FILTER (content_hash IS NULL) / nullif(count(*), 0)::double, 6) AS unparsed_rate, round(count(*) FILTER (note_count > 0) / nullif(count(*) FILTER (note_count IS NOT NULL), 0)::double, 6) AS noted_rate, round(avg(duration_sec) FILTER (isfinite(duration_sec)), 6) AS mean_duration FROM file_records GROUP BY source")
def f22_safe_rate_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_records").groupBy("source").agg(
        F.round(N.safe_rate(F.count_if(F.col("content_hash").isNull()), F.count("*")), 6).alias("unparsed_rate"),
        F.round(N.safe_rate(F.count_if(F.col("note_count") > 0), F.count("note_count")), 6).alias("noted_rate"),
        F.round(F.avg(N.finite(F.col("duration_sec"))), 6).alias("mean_duration"),
    )


_NORM = "coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g'), '\\.[0-9]+$', ''), '[_\\-]+', ' ', 'g'), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'unknown')"


def normalize_sql(c: str) -> str:
    return _NORM.format(c=c)


@query(f"SELECT file_id, artist, {normalize_sql('artist')} AS artist_key, {normalize_sql('title')} AS title_key FROM file_records")
def f30_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_records").select("file_id", "artist", X.normalize_text(F.col("artist")).alias("artist_key"), X.normalize_text(F.col("title")).alias("title_key"))


@query(f"""SELECT file_id, CASE WHEN len(p) >= 3 AND {normalize_sql('p[1]')} = 'clean midi' THEN p[2] WHEN len(p) >= 2 THEN p[-2] ELSE 'unknown' END AS artist,
CASE WHEN regexp_matches(p[-1], '^.+\\.[^.]+$') THEN regexp_replace(p[-1], '\\.[^.]*$', '') ELSE p[-1] END AS title FROM (SELECT file_id, string_split(rel_path, '/') AS p FROM file_records WHERE rel_path IS NOT NULL)""")
def f31_path_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_records").where("rel_path IS NOT NULL").select("file_id", X.path_artist(F.col("rel_path")).alias("artist"), X.path_title(F.col("rel_path")).alias("title"))


@query(f"SELECT key, family_key, count(*) AS records FROM (SELECT {normalize_sql('artist')} || '::' || {normalize_sql('title')} AS key, family_key FROM file_records) GROUP BY ALL")
def f32_family_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_records").groupBy(X.family_key(F.col("artist"), F.col("title")).alias("key"), "family_key").agg(F.count("*").alias("records"))


@query("SELECT effective_tempo_token AS token, try_cast(substr(effective_tempo_token, 7) AS int) AS bpm, CASE WHEN starts_with(effective_tempo_token, 'KEY_') THEN 0 END AS other, count(*) AS bars FROM bar_info WHERE starts_with(effective_tempo_token, 'TEMPO_') GROUP BY ALL")
def f34_token_number(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("effective_tempo_token")
    bars = table(spark, d, "bar_info").where(t.startswith("TEMPO_")).groupBy(t.alias("token")).agg(F.count("*").alias("bars"))
    return bars.select("token", X.prefixed_int(F.col("token"), "TEMPO_").alias("bpm"), X.prefixed_int(F.col("token"), "KEY_").alias("other"), "bars")


@query("SELECT tempo_token AS token, try_cast(substr(tempo_token, 7) AS int)::double AS bpm, 'PIANO' AS instrument, count(*) AS phrases FROM phrase_spans WHERE tempo_token IS NOT NULL GROUP BY tempo_token")
def f36_token_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of tempo and instrument tokens; a token out of range would fail the query."""
    t = table(spark, d, "phrase_spans").where("tempo_token IS NOT NULL").groupBy(F.col("tempo_token").alias("token")).agg(F.count("*").alias("phrases"))
    return t.select("token", X.tempo_of(F.col("token")).alias("bpm"), X.instrument_of(F.lit("INST_piano")).alias("instrument"), "phrases")


_NAMES = "(SELECT unnest(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']) AS root)"


@query(f"SELECT name, replace(replace('KEY_' || upper(name), '#', '_SHARP'), ':', '_') AS token FROM (SELECT root || ':' || m AS name FROM {_NAMES}, (SELECT unnest(['maj', 'min']) AS m) UNION ALL SELECT 'uncertain')")
def f35_key_token(spark: SparkSession, d: str) -> DataFrame:
    names = [f"{r.replace('_SHARP', '#')}:{m}" for r in ("C", "C_SHARP", "D", "D_SHARP", "E", "F", "F_SHARP", "G", "G_SHARP", "A", "A_SHARP", "B") for m in ("maj", "min")]
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in [*names, "uncertain"]])).alias("name"))
    return rows.select("name", X.key_token(F.col("name")).alias("token"))


_CKPT_NAMES = "(SELECT checkpoint AS name FROM ckpt UNION ALL SELECT unnest(['best.pt', 'last.pt', 'latest.pt', 'step_x.pt', 'notes.pt']))"


@query(twin(f"SELECT name, try_cast(nullif(regexp_extract(name, '^step_([0-9]+)\\.pt$', 1), '') AS bigint) AS step, CASE WHEN regexp_matches(name, '^step_[0-9]+\\.pt$') THEN 0 WHEN name = 'best.pt' THEN 1 WHEN name = 'last.pt' THEN 2 WHEN name = 'latest.pt' THEN 3 ELSE 4 END AS kind FROM {_CKPT_NAMES}", "ckpt"))
def f37_checkpoint_order(spark: SparkSession, d: str) -> DataFrame:
    names = checkpoint_names(spark, d)
    return names.select("name", X.checkpoint_step(F.col("name")).alias("step"), X.checkpoint_class(F.col("name")).alias("kind"))


def checkpoint_names(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("best.pt", "last.pt", "latest.pt", "step_x.pt", "notes.pt")])).alias("name"))
    return checkpoints(spark, d).select(F.col("checkpoint").alias("name")).unionByName(extra)


@query(twin("SELECT step, CASE WHEN structural IS NULL THEN 'NA' ELSE printf('%.2f%%', structural * 100) END AS structural, printf('%.2f', valid_loss) AS valid_loss, round_even(stop * 1000, 0)::bigint::varchar AS stop FROM ckpt", "ckpt"))
def f39_format_metric(spark: SparkSession, d: str) -> DataFrame:
    c = checkpoints(spark, d)
    return c.select("step", X.format_metric(F.col("structural"), "percent").alias("structural"), X.format_metric(F.col("valid_loss"), "decimal").alias("valid_loss"), X.format_metric(F.col("stop") * 1000, "int").alias("stop"))


@query("SELECT file_id, nullif(regexp_replace(regexp_replace(title, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), '') AS tag FROM file_records WHERE title IS NOT NULL")
def f41_sanitize_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_records").where("title IS NOT NULL").select("file_id", X.sanitize_tag(F.col("title")).alias("tag"))


@query("SELECT file_id, title, CASE WHEN n = 1 THEN title ELSE title || '#' || n END AS label FROM (SELECT file_id, title, row_number() OVER (PARTITION BY title ORDER BY file_id, ingested_at) AS n FROM file_records WHERE title IS NOT NULL)")
def f42_unique_label(spark: SparkSession, d: str) -> DataFrame:
    n = F.expr("row_number() OVER (PARTITION BY title ORDER BY file_id, ingested_at)")
    rows = table(spark, d, "file_records").where("title IS NOT NULL").select("file_id", "title", n.alias("n"))
    return rows.select("file_id", "title", F.when(F.col("n") == 1, F.col("title")).otherwise(F.concat("title", F.lit("#"), F.col("n").cast("string"))).alias("label"))
