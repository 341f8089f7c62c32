"""The corpus pipeline as stages over tables: clean, split, tokenize, pack, validate. Each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import numeric as N
from melisma.operators import corpus, grammar, notes, sequences, tokens
from melisma.tables import current_rows, table


def should_run(stage: str, order: list[str], start: str | None = None, stop: str | None = None) -> bool:
    """Whether a stage lies between the first and the last one asked for."""
    at = order.index(stage)
    return (start is None or at >= order.index(start)) and (stop is None or at <= order.index(stop))


def clean(spark: SparkSession, d: str, _: dict) -> DataFrame:
    """Files that pass the drop rules, first of each content hash, with hash, family key and metrics."""
    from melisma.functions import text

    files = current_rows(table(spark, d, "file_records"), "file_id", "ingested_at")
    n = notes_of(spark, d)
    metrics = notes.file_metrics(n, files).withColumn("reason", notes.drop_reason()).where("reason IS NULL").drop("reason")
    hashed = metrics.join(notes.content_hash(n, files), "file_id").join(files.select("file_id", "rel_path", "artist", "title", "ticks_per_beat"), "file_id")
    hashed = hashed.withColumn("family_key", text.family_key(F.col("artist"), F.col("title")))
    return corpus.first_of_each(hashed, "content_hash", ["rel_path", "file_id"])


def notes_of(spark: SparkSession, d: str) -> DataFrame:
    return tokens.note_rows(table(spark, d, "note_events"))


def split(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """Leakage-safe splits of the cleaned files."""
    groups = corpus.leakage_groups(done["clean"], ["family_key", "content_hash"])
    targets = [(r[0], r[1]) for r in table(spark, d, "split_targets").where("split_name IS NOT NULL AND target_share IS NOT NULL").orderBy("split_name").collect()]
    return corpus.split_groups(groups, targets)


def tokenize(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """Token sequences of the cleaned files, training files also at every transposition that fits."""
    files = done["clean"].select("file_id", "ticks_per_beat", "bpm_median").join(done["split"].select("file_id", "split"), "file_id")
    tempo = N.tempo_token(F.coalesce("bpm_median", F.lit(120.0)))
    own = notes_of(spark, d).join(files.select("file_id"), "file_id")
    plain = tokens.token_stream(tokens.grid(own, files), files, tempo).withColumn("offset", F.lit(0))
    train = files.where("split = 'train'")
    moved = tokens.transposed(tokens.tokenizer_notes(own.join(train.select("file_id"), "file_id", "left_semi")))
    out = plain
    for o in tokens.TRANSPOSE:  # a fixed handful of variants
        part = moved.where(F.col("offset") == o).drop("offset")
        kept = train.join(part.select("file_id").distinct(), "file_id", "left_semi")
        out = out.unionByName(tokens.token_stream(tokens.grid(part, kept), kept, tempo).withColumn("offset", F.lit(o)))
    return out.join(files.select("file_id", "split"), "file_id")


def pack(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """Ids, lengths and running offsets per split."""
    seq = done["tokenize"].withColumn("seq", F.col("file_id") * 64 + F.col("offset") + 32)
    coded = tokens.encoded(seq.select("seq", "tokens"), tokens.vocabulary(spark), "seq").join(seq.select("seq", "split"), "seq")
    return sequences.running_offsets(coded.withColumn("length", F.size("ids")), ["split"], "seq", "length", "offset")


def validate(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """Failures per split: unknown tokens, broken order, offsets that don't meet. No rows if all is well."""
    t = done["tokenize"].withColumn("_c", grammar.letters(F.col("tokens"), strict=False))
    bad = t.select("split", F.when(~grammar.prefix_valid(F.col("_c")), "order").alias("failure")).where("failure IS NOT NULL")
    p = done["pack"]
    oov = p.where("oov > 0").select("split", F.lit("unknown token").alias("failure"))
    gap = p.withColumn("_e", F.expr("lag(offset + length) OVER (PARTITION BY split ORDER BY seq)")).where("_e IS NOT NULL AND _e <> offset").select("split", F.lit("offset").alias("failure"))
    return bad.unionByName(oov).unionByName(gap).groupBy("split", "failure").agg(F.count("*").alias("rows"))


STAGES: dict[str, Callable[[SparkSession, str, dict], DataFrame]] = {"clean": clean, "split": split, "tokenize": tokenize, "pack": pack, "validate": validate}


def run(spark: SparkSession, d: str, out: str, start: str | None = None, stop: str | None = None) -> dict[str, DataFrame]:
    """Runs the stages asked for; each is written below `out` as Parquet, and stages before them are read from there."""
    done: dict[str, DataFrame] = {}
    order = list(STAGES)
    for name, stage in STAGES.items():
        path = f"{out}/{name}.parquet"
        if should_run(name, order, start, stop):
            stage(spark, d, done).write.mode("overwrite").parquet(path)
        elif stop is not None and order.index(name) > order.index(stop):
            break
        done[name] = spark.read.parquet(path)
    return done
