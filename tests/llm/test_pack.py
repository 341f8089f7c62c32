import random

from melisma.llm import pack


def test_lots_keep_every_item_whole_and_within_capacity(spark):
    rng = random.Random(4)
    rows = [("s", i, rng.choice([0, 5, 60, 300, 700, 1024, 1500, 2600])) for i in range(400)] + [("s", 400, None), ("t", 0, 10)]
    items = spark.createDataFrame(rows, "shard_id string, item_no int, tokens int")
    for lot in (1_000_000, 60):
        out = pack.pack(items, 1024, lot).collect()
        held: dict[str, int] = {}
        for r in out:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["tokens"]
        assert max(held.values()) <= 1024
        size: dict[tuple, int] = {}
        for r in out:
            size[r["shard_id"], r["item_no"]] = size.get((r["shard_id"], r["item_no"]), 0) + r["tokens"]
        assert size == {(s, i): n or 0 for s, i, n in rows}
        assert all(r["part_no"] == 0 for r in out if size[r["shard_id"], r["item_no"]] <= 1024)


def test_empty_index(spark):
    none = spark.createDataFrame([], "shard_id string, item_no int, tokens int")
    assert pack.pack(none, 1024).count() == 0


def test_true_lengths_from_faulty_arrays():
    assert pack.true_lengths([0, 5, None, 11], [5, None, 4, 3], 14) == [5, 2, 4, 3]
    assert pack.true_lengths([0, 5, 99, 11], [5, 2, 4, 3], 14) == [5, 2, 4, 3]
    assert pack.true_lengths([], [], 0) == []
