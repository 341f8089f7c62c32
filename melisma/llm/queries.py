"""The pN_ queries: each applies its operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm import mix, names, near, pack, pieces, spam, splits, text
from melisma.tables import table


def _records_notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "file_records"), table(spark, d, "note_events")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlap_pairs(*_records_notes(spark, d)).select("file_id_a", "file_id_b")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlap_counts(*_records_notes(spark, d))


def _capacity(spark: SparkSession, d: str) -> int:
    return table(spark, d, "size_limits").where("limit_name = 'pack_capacity'").first()["tokens"]


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.sequence_pieces(table(spark, d, "bar_info"), table(spark, d, "phrase_spans"), table(spark, d, "size_limits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("piece_no = 0").select("seq_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(table(spark, d, "file_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_groups(*_records_notes(spark, d)).where("file_id <> group_file_id").select("group_file_id", "file_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(splits.related_groups(*_records_notes(spark, d)), table(spark, d, "split_targets"))


def p5_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(pack.packed_items(table(spark, d, "packed_index")), _capacity(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_packed(spark, d).where("part_no = 1").select("shard_id", "item_no")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return pack.packing_report(p5_packed(spark, d), _capacity(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near.same_music_pairs(*_records_notes(spark, d))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return near.music_classes(*_records_notes(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return text.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """How many texts come back exactly from their ids."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = text.decode(text.encode(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").agg(F.count("*").alias("documents"), F.count_if(F.coalesce("text", F.lit("")) == F.col("back")).alias("equal"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return text.encode_spans(table(spark, d, "documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture_shares(p8_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_pieces, p3_found, p4_found, p4_splits, p5_found, p5_packed, p5_report, p6_found, p6_classes, p7_ids, p7_decoded, p7_spans, p8_mixture, p8_shares, p9_found)}


def twins() -> dict[str, str]:
    """SQL twins: problem 2's cases; the other problems have none."""
    newest = "n AS (SELECT seq_id, max(analysed_at) AS analysed_at FROM (SELECT seq_id, analysed_at FROM bar_info UNION ALL SELECT seq_id, analysed_at FROM phrase_spans) GROUP BY seq_id)"
    ends = "e AS (SELECT seq_id, end_token FROM bar_info JOIN n USING (seq_id, analysed_at) UNION ALL SELECT seq_id, end_token FROM phrase_spans JOIN n USING (seq_id, analysed_at))"
    return {"p2_found": f"WITH {newest}, {ends} SELECT seq_id FROM e GROUP BY seq_id HAVING max(end_token) > (SELECT max(tokens) FROM size_limits WHERE limit_name = 'context_window')"}
