"""Filling fixed-capacity containers by sum-of-squares packing (problem 5)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melisma.tables import current_rows, materialise

#: Items one task packs; what its open bins hold is packed again with that of others.
TASK_ITEMS = 1_000_000


def true_lengths(offsets: list, lengths: list, num_tokens: int | None) -> list[int]:
    """The items' lengths from lengths, offsets and the total, any entry of which may be null or wrong.

    Where an offset plus its length gives the next offset, both stand. Between such anchors the start positions are
    chosen that contradict the fewest entries. Arrays of different size are padded with nulls.
    """
    n = max(len(offsets), len(lengths))
    if not n:
        return []
    o = [*offsets, *[None] * (n - len(offsets)), num_tokens]
    ln = [*lengths, *[None] * (n - len(lengths))]
    o[0] = 0
    if o[n] is None and o[n - 1] is not None and ln[n - 1] is not None:
        o[n] = o[n - 1] + ln[n - 1]
    good = [o[i] is not None and ln[i] is not None and ln[i] >= 0 and o[i + 1] is not None and o[i] + ln[i] == o[i + 1] for i in range(n)]
    t: list = [None] * (n + 1)
    t[0] = 0
    i = 0
    while i < n:
        if good[i] and t[i] == o[i]:
            t[i + 1] = o[i + 1]
            i += 1
            continue
        j = i  # the stretch i..j has no anchor inside
        while j < n and not (good[j] and j > i):
            j += 1
        end = o[j] if j < n or num_tokens is not None or o[n] is not None else None
        ahead: list[set] = [set() for _ in range(j - i + 1)]
        ahead[0] = {t[i]}
        for k in range(i + 1, j + 1):
            here = ahead[k - i]
            if o[k] is not None and o[k] >= t[i]:
                here.add(o[k])
            if ln[k - 1] is not None and ln[k - 1] >= 0:
                here |= {x + ln[k - 1] for x in ahead[k - 1 - i]}
        if end is not None:
            back = end
            ahead[j - i] = {end}
            for k in range(j - 1, i, -1):
                if ln[k] is None or ln[k] < 0:
                    break
                back -= ln[k]
                if back >= t[i]:
                    ahead[k - i].add(back)
        best: list[dict] = [{t[i]: (0, None)}]
        for k in range(i + 1, j + 1):
            row: dict = {}
            for x in ahead[k - i] or {max(best[-1])}:
                wrong = 0 if o[k] == x else 1
                found = min(((c + wrong + (ln[k - 1] != x - y), -y) for y, (c, _) in best[-1].items() if x >= y), default=None)
                if found:
                    row[x] = (found[0], -found[1])
            best.append(row or {max(best[-1]): (0, max(best[-1]))})
        x = min(best[-1], key=lambda v: (best[-1][v][0], v))
        for k in range(j, i, -1):
            t[k] = x
            x = best[k - i][x][1]
        i = j
    return [t[k + 1] - t[k] for k in range(n)]


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for shard, offsets, lengths, total in batch.itertuples(index=False):
            clean = [[None if v is None or v != v else int(v) for v in ([] if a is None else a)] for a in (offsets, lengths)]
            rows.extend((shard, i, n) for i, n in enumerate(true_lengths(*clean, None if total is None or total != total else int(total))))
        yield pd.DataFrame(rows, columns=["shard_id", "item_no", "tokens"])


def packed_items(index: DataFrame) -> DataFrame:
    """`shard_id`, `item_no` (from 0), `tokens` (true length) of the newest delivery of every shard; empty shards give no rows."""
    now = current_rows(index.select("shard_id", "written_at", "offsets", "lengths", "num_tokens"), "shard_id", "written_at")
    return now.select("shard_id", "offsets", "lengths", "num_tokens").mapInPandas(_items, "shard_id string, item_no int, tokens int")


class SumOfSquares:
    """Open bins by residual gap; an item goes where the sum of squared counts of open bins per gap becomes least."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.bins = 0

    def place(self, size: int) -> int:
        cap, count = self.capacity, self.count
        if size == 0:
            return max(self.bins - 1, 0)
        # moving a bin from gap g to g - size changes the sum by 2 (N[g - size] - N[g] + 1); full and unopened bins count nothing
        gain = count[: cap + 1 - size] - count[size:] + 1
        gain[count[size:] == 0] = 2**40
        gain[0] = -count[size] if count[size] else 2**40  # fills the bin exactly
        gain[-1] = count[cap - size] if size < cap else -(2**40)  # a new bin
        g = int(np.argmin(gain)) + size
        if g == cap:
            ident = self.bins
            self.bins += 1
        else:
            ident = self.open[g].pop()
            count[g] -= 1
        if g > size:
            self.open[g - size].append(ident)
            count[g - size] += 1
        return ident


def _pack(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = SumOfSquares(capacity)
        for batch in batches:
            where = [packer.place(n) for n in batch["tokens"].tolist()]
            yield batch.assign(bin=where)[["lot", "id", "tokens", "bin"]]

    return run


def _lots(df: DataFrame, lots: int) -> DataFrame:
    """Rows dealt to `lots` partitions by hash, in hash order within each."""
    lot = F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int")
    return df.withColumn("lot", lot).repartition(lots, "lot").sortWithinPartitions("lot", F.xxhash64("id", F.lit(1)), "id")


def pack(items: DataFrame, capacity: int, task_items: int = TASK_ITEMS) -> DataFrame:
    """`shard_id`, `item_no`, `part_no`, `start`, `tokens`, `container_id`: every item in a container, whole unless longer than `capacity`.

    An item beyond the capacity fills whole containers of its own and packs its rest. Items are dealt to lots of about
    `task_items`, each packed by one task. Full bins stand; the items of the bins a lot leaves open (a few hundred,
    however many items it had) are dealt to fewer lots and packed anew, until one lot is left, so that only its open bins
    stay part empty. Items of length 0 take no room and go with container "0"; negative lengths count as 0. Ties and
    repeated lengths are settled by hash of shard and number.
    """
    size = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))
    cut = items.select("shard_id", "item_no", size.alias("tokens"))
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / capacity).cast("int") - 1, F.lit(0)))).alias("part_no")
    parts = cut.select("shard_id", "item_no", "tokens", part).select("shard_id", "item_no", "part_no", (F.col("part_no") * capacity).alias("start"), F.least(F.lit(capacity), F.col("tokens") - F.col("part_no") * capacity).alias("tokens"))
    parts = materialise(parts.withColumn("id", F.concat_ws("/", "shard_id", "item_no", "part_no")), "parts")
    loose = parts.where(f"tokens > 0 AND tokens < {capacity}")
    schema = "lot int, id string, tokens int, bin long"
    done, now, turn = [], loose.select("id", "tokens"), 0
    lots = max(1, -(-loose.count() // task_items))
    while True:
        packed = materialise(_lots(now, lots).select("lot", "id", "tokens").mapInPandas(_pack(capacity), schema), "packed")
        named = packed.select("id", "tokens", F.concat_ws("-", F.lit(f"r{turn}"), "lot", "bin").alias("container"))
        if lots == 1:
            done.append(named)
            break
        fill = packed.groupBy("lot", "bin").agg(F.sum("tokens").alias("held"))
        named = materialise(packed.join(fill, ["lot", "bin"]).select("id", "tokens", F.concat_ws("-", F.lit(f"r{turn}"), "lot", "bin").alias("container"), (F.col("held") < capacity).alias("open")), "filled")
        done.append(named.where("NOT open").select("id", "tokens", "container"))
        now = named.where("open").select("id", "tokens")
        lots, turn = min(lots - 1, max(1, -(-now.count() // task_items))), turn + 1
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    where = parts.join(named.select("id", "container"), "id", "left")
    own = F.when(F.col("tokens") == capacity, F.concat(F.lit("w-"), "id")).when(F.col("tokens") == 0, F.lit("0"))
    return where.select("shard_id", "item_no", "part_no", "start", "tokens", F.coalesce("container", own).alias("container_id"))


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, parts, containers, tokens, the least containers that could do (tokens / capacity), and the unused share."""
    held = packed.where("tokens > 0").groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"))
    return held.agg(F.sum("parts").alias("parts"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.ceil(F.sum("tokens") / capacity).alias("bound"), (1 - F.sum("tokens") / (F.count("*") * capacity)).alias("unused_share"))
