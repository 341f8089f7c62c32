"""Queries of sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import numeric as N
from melisma.operators.tokens import vocabulary
from melisma.plans.registry import query
from melisma.plans.views import records, streams, token_grid, twin
from melisma.sources import files, midi
from melisma.streaming import events as stream
from melisma.tables import shared_dir, table


def velocities(spark: SparkSession) -> list[int]:
    return [r["v"] for r in spark.range(N.BINS).select("id", N.velocity_value(F.col("id")).alias("v")).orderBy("id").collect()]


@query(twin("SELECT file_id, count(*) AS notes, sum(pos + 32 * bar)::bigint AS units, sum(dur)::bigint AS durations FROM grid GROUP BY file_id", "grid"))
def s2_midi_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Token sequences written as MIDI bytes, parsed, paired and put on the grid again: whole-number sums must be those of the grid they came from.

    Notes of one pitch that overlap pair last on first off, which keeps each file's sums of starts and of ends.
    """
    rows = midi.messages(midi.midi_bytes(streams(spark, d), velocities(spark)), key="file_id")
    unit = midi.TICKS * 4 // 32
    n = midi.notes_of(rows, "file_id")
    return n.groupBy("file_id").agg(F.count("*").alias("notes"), (F.sum("start_tick") / unit).cast("long").alias("units"), (F.sum(F.col("end_tick") - F.col("start_tick")) / unit).cast("long").alias("durations"))


@query(twin("SELECT file_id, 2 + 2 * count(grid.pos) + (count(grid.pos) > 0)::int + (count(grid.pos) > 0)::int AS messages FROM cur LEFT JOIN grid USING (file_id) GROUP BY file_id", "cur", "grid"))
def k5_midi_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of every written file: time signature and end, and with notes a tempo, a program and two a note."""
    return midi.messages(midi.midi_bytes(streams(spark, d), velocities(spark)), key="file_id").groupBy("file_id").agg(F.count("*").alias("messages"))


@query(twin("SELECT file_id, split, note_count FROM cur WHERE split IS NOT NULL", "cur"))
def s3_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Split rows written as JSON lines and read again (K1, S3)."""
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(records(spark, d).where("split IS NOT NULL").select("file_id", "split", "note_count"), path)
    return files.read_jsonl(spark, path, "file_id long, split string, note_count int")


@query(twin("SELECT array_to_string(tokens, ' ') AS line, count(*) AS files FROM tok GROUP BY line", "tok"))
def s6_token_lines(spark: SparkSession, d: str) -> DataFrame:
    """Token lines written as text and read again (K2, S6)."""
    path = f"{shared_dir(spark)}/tok-{uuid.uuid4().hex}"
    files.write_tokens(streams(spark, d), path)
    return files.read_tokens(spark, path).groupBy(F.array_join("tokens", " ").alias("line")).agg(F.count("*").alias("files"))


@query(twin("SELECT a.file_id, a.n::bigint AS row_id, b.title FROM (SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS n FROM cur) a JOIN (SELECT title, row_number() OVER (ORDER BY file_id) - 1 AS n FROM cur) b ON a.n = b.n", "cur"))
def j2_positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Two tables joined by position; their numbers of rows must agree (S10)."""
    n = F.expr("row_number() OVER (ORDER BY file_id) - 1").cast("long")
    left, right = records(spark, d).select(n.alias("row_id"), "file_id"), records(spark, d).select(n.alias("row_id"), "title")
    return files.zipped(left, right)


@query(twin("SELECT id, token FROM vocab", "vocab"))
def s8_vocabulary_scan(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary by its inverted mapping, gaps filled."""
    pairs = {r["token"]: r["id"] for r in vocabulary(spark).collect()}
    return files.vocabulary_table(spark, {"token_to_id": pairs})


@query(twin("SELECT step, valid_loss, round(valid_loss - min(valid_loss) OVER (ORDER BY step), 9) AS above_best, step = max(step) OVER () AS latest FROM ckpt", "ckpt"))
def k9_dashboard_table(spark: SparkSession, d: str) -> DataFrame:
    """What the training panel plots: a metric by step, its distance from the best so far, the latest point."""
    from melisma.plans.views import checkpoints

    best = F.expr("min(valid_loss) OVER (ORDER BY step)")
    return checkpoints(spark, d).select("step", "valid_loss", F.round(F.col("valid_loss") - best, 9).alias("above_best"), (F.col("step") == F.expr("max(step) OVER ()")).alias("latest"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def st_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows over the event stream, drained once over all files there are."""
    kind = table(spark, d, "events").schema
    s = stream.file_stream(spark, d, kind, "events.parquet")
    out = stream.drained(stream.event_windows(s, "ts", "event_type"), f"w_{uuid.uuid4().hex[:12]}", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events")


@query("SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events")
def st_running_best(spark: SparkSession, d: str) -> DataFrame:
    """Running mean and least value per user, kept in state."""
    kind = table(spark, d, "events").schema
    s = stream.file_stream(spark, d, kind, "events.parquet")
    out = stream.drained(stream.running_mean(s, "user_id", "event_id", "value"), f"m_{uuid.uuid4().hex[:12]}", "append")
    return out.select("user_id", "event_id", "best")


@query(twin("SELECT tok.file_id % 8 AS part, count(*) AS sequences, sum(len(tokens))::bigint AS tokens FROM tok GROUP BY part", "tok"))
def s7_packed_scan(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all sequences written as flat binaries of eight parts and read back by offset and length (K3, S7)."""
    from melisma.operators.tokens import encoded

    folder = f"{shared_dir(spark).removeprefix('file://')}/packed-{uuid.uuid4().hex}"
    coded = encoded(streams(spark, d), vocabulary(spark))
    out = None
    for part in range(8):  # one binary a part, each of which is one file
        if not files.write_packed(coded.where(F.col("file_id") % 8 == part), folder, f"p{part}", "file_id")["num_sequences"]:
            continue
        back = files.read_packed(spark, folder, f"p{part}").agg(F.lit(part).cast("long").alias("part"), F.count("*").alias("sequences"), F.sum(F.size("ids")).alias("tokens"))
        out = back if out is None else out.unionByName(back)
    return out if out is not None else spark.createDataFrame([], "part long, sequences long, tokens long")


@query(twin("SELECT checkpoint, CASE WHEN step % 2 = 0 THEN 'continuation' ELSE 'infilling' END AS task, step FROM ckpt", "ckpt"))
def k12_sample_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sample rows written in folders by checkpoint and task, and read back."""
    from melisma.plans.views import checkpoints

    path = f"{shared_dir(spark)}/samples-{uuid.uuid4().hex}"
    task = F.when(F.col("step") % 2 == 0, "continuation").otherwise("infilling")
    files.write_samples(checkpoints(spark, d).select("checkpoint", task.alias("task"), "step"), path)
    return spark.read.json(path, schema="checkpoint string, task string, step long")
