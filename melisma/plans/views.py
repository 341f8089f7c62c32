"""The views over the input tables that queries start from, in Spark and as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import numeric as N
from melisma.operators.tokens import grid, note_rows, token_stream
from melisma.tables import current_rows, table

_RECORD = "rel_path midi_path artist title family_key content_hash note_count duration_sec ticks_per_beat bpm_median source split scanned_at".split()

# name -> (views it needs, SQL)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "cur": ((), "SELECT * FROM file_records WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC NULLS LAST, " + ", ".join(f"{c} DESC NULLS LAST" for c in _RECORD) + ") = 1"),
    "notes": (
        (),
        "SELECT file_id, track_idx, channel, start_tick, end_tick, pitch, max(velocity) AS velocity FROM note_events "
        "WHERE file_id IS NOT NULL AND start_tick IS NOT NULL AND end_tick IS NOT NULL AND pitch IS NOT NULL AND (channel IS NULL OR channel <> 9) GROUP BY file_id, track_idx, channel, start_tick, end_tick, pitch",
    ),
    "grid": (
        ("cur", "notes"),
        """SELECT file_id, start_tick // ticks AS bar, least(31, greatest(0, round_even((start_tick % ticks) / (ticks / 32.0::double), 0)))::int AS pos, pitch,
        list_sort(list_transform([1,2,3,4,6,8,12,16,24,32], lambda b: [abs(greatest(1, round_even((end_tick - start_tick) / (ticks / 32.0::double), 0)) - b), b]))[1][2]::int AS dur,
        least(15, greatest(0, round_even((CASE WHEN v < 64 THEN -1 ELSE 1 END * ln(1 + 8 * abs((v - 64) / 63.0::double)) / ln(9.0::double) + 1) / 2 * 15, 0)))::int AS vel
        FROM (SELECT n.*, greatest(1, round_even(coalesce(ticks_per_beat, 480) * 4.0::double, 0)::bigint) AS ticks, least(127, greatest(1, coalesce(velocity, 64)))::double AS v
        FROM notes n JOIN cur USING (file_id) WHERE coalesce(ticks_per_beat, 480) > 0 AND n.pitch BETWEEN 21 AND 108 AND end_tick > start_tick AND start_tick >= 0)""",
    ),
    "ev": (("grid",), "SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY bar, pos, pitch, dur, vel) - 1 AS event_idx, bar * 32 + pos AS unit FROM grid"),
    "msgs": (
        (),
        """SELECT event_id, user_id AS file_id, (json_extract_string(props, '$.k')::int % 12) AS note, (epoch_us(ts) - 1704067200000000) // 3600000000 AS tick,
        CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE -1 END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS msg_idx FROM events""",
    ),
    "log": (
        (),
        """SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, CASE WHEN event_type = 'view' THEN 'eval' ELSE 'train' END AS event,
        CASE WHEN event_type <> 'view' THEN value / 100 END AS loss, CASE WHEN event_type = 'view' THEN value / 100 END AS valid_loss, CASE WHEN event_type = 'signup' THEN value / 100 END AS logged_ema FROM events""",
    ),
    "ckpt": (
        (),
        """SELECT l_suppkey AS step, 'step_' || l_suppkey || '.pt' AS checkpoint, avg((l_returnflag = 'R')::int) AS stop, avg((l_discount > 0.05)::int) AS budget, avg((l_tax < 0.07)::int) AS time_order,
        CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE avg((l_quantity > 10)::int) END AS structural, avg((l_quantity <= 5)::int) AS empty_bar, avg((l_linestatus = 'F')::int) AS first_event,
        avg((l_tax = 0)::int) AS syntax_invalid, round(avg(l_extendedprice) / 50000, 9) AS valid_loss FROM lineitem GROUP BY l_suppkey""",
    ),
}


def twin(body: str, *views: str) -> str:
    """`body` with the views it names, and those they need, as common table expressions."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in _VIEWS[name][0]:
            add(other)
        if name not in need:
            need.append(name)

    for v in views:
        add(v)
    head = ", ".join(f"{v} AS ({_VIEWS[v][1]})" for v in need)
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"


def records(spark: SparkSession, d: str) -> DataFrame:
    """Current rows of file_records."""
    return current_rows(table(spark, d, "file_records"), "file_id", "ingested_at")


def notes(spark: SparkSession, d: str) -> DataFrame:
    return note_rows(table(spark, d, "note_events"))


def token_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid(notes(spark, d), records(spark, d).select("file_id", "ticks_per_beat"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Note-on and note-off messages by file, from `events`."""
    e = table(spark, d, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    key = F.get_json_object("props", "$.k").cast("int") % 12
    on = F.when(F.col("event_type").isin("click", "view", "purchase"), 1).otherwise(-1)
    return e.select("event_id", F.col("user_id").alias("file_id"), key.alias("note"), micros.alias("_m"), on.alias("d"), "ts").withColumn("tick", F.expr("_m div 3600000000")).select("event_id", "file_id", "note", "tick", "d", "ts")


def training_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of train and eval events per run, from `events`."""
    e = table(spark, d, "events")
    view, value = F.col("event_type") == "view", F.col("value") / 100
    line = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)")
    return e.select(
        F.col("user_id").alias("run"), line.cast("long").alias("line_no"), F.when(view, "eval").otherwise("train").alias("event"),
        F.when(~view, value).alias("loss"), F.when(view, value).alias("valid_loss"), F.when(F.col("event_type") == "signup", value).alias("logged_ema"),
    )


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Metric rows of checkpoints, from `lineitem`."""
    share = lambda test: F.expr(f"avg(cast({test} as int))")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("step")).agg(
        share("l_returnflag = 'R'").alias("stop"), share("l_discount > 0.05").alias("budget"), share("l_tax < 0.07").alias("time_order"), share("l_quantity > 10").alias("structural"),
        share("l_quantity <= 5").alias("empty_bar"), share("l_linestatus = 'F'").alias("first_event"), share("l_tax = 0").alias("syntax_invalid"), F.expr("round(avg(l_extendedprice) / 50000, 9)").alias("valid_loss"),
    )
    named = rows.withColumn("structural", F.expr("CASE WHEN step % 7 <> 0 THEN structural END"))
    return named.withColumn("checkpoint", F.concat(F.lit("step_"), F.col("step").cast("string"), F.lit(".pt")))

_NOTE = "'POS_' || pos || ' INST_PIANO PITCH_' || pitch || ' DUR_' || dur || ' VEL_' || vel"
_TEMPO = "'TEMPO_' || (40 + 2 * round_even((least(220, greatest(40, round_even(coalesce(bpm_median, 120), 0))) - 40) / 2, 0))::int"
_VIEWS["tok"] = (
    ("grid", "cur"),
    f"""SELECT cur.file_id, CASE WHEN body IS NULL THEN ['BOS', 'EOS'] ELSE string_split('BOS ' || {_TEMPO} || ' ' || body || ' EOS', ' ') END AS tokens FROM cur LEFT JOIN
    (SELECT file_id, string_agg('BAR' || coalesce(' ' || notes, ''), ' ' ORDER BY bar) AS body FROM (SELECT file_id, unnest(range(0, max(bar) + 1)) AS bar FROM grid GROUP BY file_id)
    LEFT JOIN (SELECT file_id, bar, string_agg({_NOTE}, ' ' ORDER BY pos, pitch, dur, vel) AS notes FROM grid GROUP BY ALL) USING (file_id, bar) GROUP BY file_id) b ON b.file_id = cur.file_id""",
)
# sequences with faults of several kinds, by file
_VIEWS["btok"] = (
    ("tok",),
    """SELECT file_id, CASE file_id % 8 WHEN 1 THEN tokens[:-2] WHEN 2 THEN tokens[1:4] || tokens[6:] WHEN 3 THEN tokens[1:2] || ['XXX'] || tokens[4:] WHEN 4 THEN tokens[1:9] WHEN 5 THEN tokens || ['BAR']
    WHEN 6 THEN ['FIM_HOLE'] || tokens WHEN 7 THEN tokens[1:2] || ['KEY_C_MAJ', 'TEMPO_80'] || tokens[3:] ELSE tokens END AS tokens FROM tok""",
)
_VIEWS["row"] = (("btok",), "SELECT file_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS idx FROM btok")
LETTER = """CASE WHEN token = 'BOS' THEN 'B' WHEN token = 'EOS' THEN 'E' WHEN token = 'BAR' THEN 'R' WHEN token IN (SELECT token FROM vocab) THEN
CASE split_part(token, '_', 1) WHEN 'TEMPO' THEN 'T' WHEN 'KEY' THEN 'K' WHEN 'POS' THEN 'P' WHEN 'INST' THEN 'I' WHEN 'PITCH' THEN 'C' WHEN 'DUR' THEN 'D' WHEN 'VEL' THEN 'V' ELSE '?' END ELSE '?' END"""
_ROOTS = "['C', 'C_SHARP', 'D', 'D_SHARP', 'E', 'F', 'F_SHARP', 'G', 'G_SHARP', 'A', 'A_SHARP', 'B']"
_VIEWS["vocab"] = (
    (),
    f"""SELECT (row_number() OVER (ORDER BY part, n) - 1)::int AS id, token FROM (SELECT 0 AS part, range AS n, ['BOS', 'EOS', 'FIM_HOLE', 'FIM_MID', 'BAR'][range + 1] AS token FROM range(5)
    UNION ALL SELECT 1, range, 'POS_' || range FROM range(32) UNION ALL SELECT 2, 0, 'INST_PIANO' UNION ALL SELECT 3, range, 'PITCH_' || range FROM range(21, 109)
    UNION ALL SELECT 4, b, 'DUR_' || b FROM (SELECT unnest([1,2,3,4,6,8,12,16,24,32]) AS b) UNION ALL SELECT 5, range, 'VEL_' || range FROM range(16) UNION ALL SELECT 6, range, 'TEMPO_' || range FROM range(40, 221, 2)
    UNION ALL SELECT 7, range, 'KEY_' || {_ROOTS}[range + 1] || '_MAJ' FROM range(12) UNION ALL SELECT 8, range, 'KEY_' || {_ROOTS}[range + 1] || '_MIN' FROM range(12) UNION ALL SELECT 9, 0, 'KEY_UNCERTAIN')""",
)
_VIEWS["code"] = (("row", "vocab"), f"SELECT file_id, idx, token, {LETTER} AS sign FROM row")


def streams(spark: SparkSession, d: str) -> DataFrame:
    """Token sequences of all current files."""
    cur = records(spark, d).select("file_id", "ticks_per_beat", "bpm_median")
    return token_stream(grid(notes(spark, d), cur), cur, N.tempo_token(F.coalesce("bpm_median", F.lit(120.0))))


def faulty_streams(spark: SparkSession, d: str) -> DataFrame:
    """Token sequences of which seven in eight have a fault, by file."""
    t, n = F.col("tokens"), F.size("tokens")

    def cut(a: int, b: int | None = None) -> Column:
        return F.slice(t, F.lit(a), F.lit(b - a + 1) if b else F.greatest(F.lit(0), n - a + 1))

    words = lambda *x: F.array(*[F.lit(w) for w in x])
    kinds = {
        1: F.slice(t, F.lit(1), n - 1), 2: F.concat(cut(1, 4), cut(6)), 3: F.concat(cut(1, 2), words("XXX"), cut(4)), 4: cut(1, 9), 5: F.concat(t, words("BAR")), 6: F.concat(words("FIM_HOLE"), t),
        7: F.concat(cut(1, 2), words("KEY_C_MAJ", "TEMPO_80"), cut(3)),
    }
    out = t
    for k, v in kinds.items():
        out = F.when(F.col("file_id") % 8 == k, v).otherwise(out)
    return streams(spark, d).select("file_id", out.alias("tokens"))
