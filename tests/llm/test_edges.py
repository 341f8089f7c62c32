"""All pN_ queries over tables with nulls anywhere, repeated rows, extra columns of clashing names, and over empty tables."""

import os

import pytest
from pyspark.sql import functions as F

from melisma.llm import queries as llm

DATA = "/root/testdata/sf0.001"
CLASH = ["key", "a", "b", "n", "rep", "role", "lot", "bin", "bucket", "h", "id", "space", "shard", "tokens_", "share", "text_", "ids", "node", "root", "x", "y", "side", "pos", "kind"]
KEYS = {"file_records": {"file_id"}, "note_events": {"file_id"}, "bar_info": {"seq_id", "bar_idx", "analysed_at"}, "phrase_spans": {"seq_id", "phrase_idx", "analysed_at"}, "documents": {"doc_id"}, "packed_index": {"shard_id"}}
SETTINGS = ("size_limits", "split_targets", "mix_targets")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    for name in [*KEYS, *SETTINGS]:
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        if name in KEYS:
            df = df.select(*[F.col(c) if c in KEYS[name] else F.when(F.pmod(F.xxhash64(*[F.lit(c), *KEYS[name]]), F.lit(9)) != 0, F.col(c)).alias(c) for c in df.columns])
            df = df.unionByName(df.limit(50)).withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})
        df.write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in [*KEYS, *SETTINGS]:
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        (df if name in SETTINGS else df.limit(0)).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_odd_tables(spark, odd, name):
    assert llm.queries()[name](spark, odd).count() >= 0


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, empty, name):
    rows = llm.queries()[name](spark, empty).count()
    assert rows == {"p5_report": 1, "p7_decoded": 1, "p8_shares": spark.read.parquet(f"{empty}/mix_targets.parquet").count()}.get(name, 0)


def test_every_document_has_its_ids(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert llm.p7_ids(spark, odd).count() == docs.count() and os.path.exists(f"{odd}/documents.parquet")


def test_near_duplicates_of_repeated_and_extreme_records(spark):
    from tests.llm.test_near import tables

    records = {1: [(0, 60)], 2: [(4, 60)], 3: [(k, 60) for k in range(400)], 4: [(k, 60) for k in range(390)], 5: [(k, 40 + k % 50) for k in range(30)], 6: [(k + 64, 40 + k % 50) for k in range(30)]}
    from melisma.llm import near

    found = {tuple(r) for r in near.same_music_pairs(*tables(spark, records)).collect()}
    assert found == {(1, 2), (3, 4), (5, 6)}
