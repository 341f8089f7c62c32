import random

import pytest

from melisma.llm import mix, pieces, splits, text


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    odd = ["", None, " \n\t ", "<|endoftext|> plain", "é́ ツ 🎹 " * 40, "a" * 50_000, "\x00\x07 end", "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(500))]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)] + [(99, "a b", "y"), (99, "a b", "y")], "doc_id long, text string, key string")


def test_ids_come_back_as_the_same_texts(docs):
    coded = text.encode(docs)
    assert coded.columns == ["doc_id", "ids"] and coded.count() == 10
    got = sorted((r["doc_id"], r["text"]) for r in text.decode(coded).collect())
    assert got == sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert all(r["ids"] == [] for r in coded.where("doc_id < 2").collect())


def test_ids_equal_the_tokenizer(docs):
    tok = text._tokenizer(text.TOKENIZERS, "byte_bpe_50k")
    want = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in text.encode(docs).collect()} == want


def test_spans_cover_the_text(docs):
    for r in text.encode_spans(docs.where("doc_id IN (4, 5, 7)")).collect():
        full = docs.where(f"doc_id = {r['doc_id']}").first()["text"]
        assert r["starts"][0] == 0 and r["ends"][-1] == len(full) and len(r["starts"]) == len(r["ids"])


def test_quotas_are_split_exactly():
    table = mix.split_quotas([7, 0, 40, 13], 9, 3)
    assert [sum(c) for c in zip(*table)] == [7, 0, 40, 13] and max(map(sum, table)) - min(map(sum, table)) <= 1
    assert table == mix.split_quotas([7, 0, 40, 13], 9, 3)


def test_mixture_meets_shares_within_repeats(spark):
    docs = spark.createDataFrame([(i, f"note {i} and some words " * 20, "ab"[i % 4 == 0]) for i in range(400)] + [(900, None, "a"), (901, "x", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("c", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = mix.mixture(docs, targets)
    shares = {r["source"]: r for r in mix.mixture_shares(out, targets).collect()}
    assert abs(shares["a"]["actual_share"] - 0.5) < 0.02 and shares["c"]["tokens"] == 0
    assert out.groupBy("doc_id", "source").count().where("source = 'a' AND count > 1 OR count > 3").count() == 0


def test_pieces_cover_every_token(spark):
    rng = random.Random(8)
    bars, at = [], 1
    for k in range(40):
        size = rng.choice([1, 30, 60, 200, 1500 if k == 20 else 90])
        bars.append(("s", k, at, at + size, "2024-01-02"))
        at += size
    rows = spark.createDataFrame(bars + [("s", 0, None, 9999, "2024-01-01"), ("t", 0, 1, 50, "2024-01-02")], "seq_id string, bar_idx int, start_token int, end_token int, analysed_at string")
    phrases = spark.createDataFrame([("s", 8, None, None, "2024-01-02")], "seq_id string, start_bar int, start_token int, end_token int, analysed_at string")
    limits = spark.createDataFrame([("context_window", 1024), ("piece_overlap", 64)], "limit_name string, tokens int")
    out = sorted(pieces.sequence_pieces(rows, phrases, limits).collect(), key=lambda r: r["piece_no"])
    assert {r["seq_id"] for r in out} == {"s"} and out[0]["start_token"] == 0 and out[-1]["end_token"] == at
    assert all(r["end_token"] - r["start_token"] <= 1024 for r in out)
    assert all(b["start_token"] <= a["end_token"] - 64 and b["end_token"] > a["end_token"] for a, b in zip(out, out[1:]))


def test_splits_keep_groups_and_shares(spark):
    groups = spark.createDataFrame([(i, i // (1 + i % 3)) for i in range(6000)], "file_id long, group_file_id long")
    targets = spark.createDataFrame([("train", 0.9), ("valid", 0.05), ("test", 0.05), ("none", None)], "split_name string, target_share double")
    out = splits.assign_splits(groups, targets)
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(n.values()) == 6000 and abs(n["train"] / 6000 - 0.9) < 0.01
    assert out.groupBy("group_file_id").agg({"split": "max"}).count() == out.select("group_file_id", "split").distinct().count()
