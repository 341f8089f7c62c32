"""Cutting oversized sequences at natural boundaries with overlap, by dynamic programming (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundary, strongest first where one position has several.
PHRASE, BAR, INSIDE = 2, 1, 0
#: Cut penalties: no number of cuts of one kind outweighs one of the next kind.
PENALTY = {PHRASE: 0.0, BAR: 1e3, INSIDE: 1e6}
#: For a start inside a bar that isn't itself too long (whole bars of overlap would leave no room).
SHORT_OVERLAP = 1e5
KINDS = ("inside", "bar", "phrase")


def cut_points(position: np.ndarray, kind: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut at the end) of a sequence with sorted, distinct boundary positions.

    The first and last position are the sequence's ends. Each piece is at most `limit` long; the next one starts at the
    last boundary that leaves `overlap` tokens or more in common, or, in a bar that is cut, exactly `overlap` before the
    cut. Minimised: penalties of the cuts, then the sum of squared unused shares of the pieces (size imbalance).
    """
    pos, kin = [int(position[0])], [int(kind[0])]
    step = max(1, (limit - overlap) // 8)
    for p, k in zip(position[1:].tolist(), kind[1:].tolist()):
        if p - pos[-1] > limit:  # candidate cuts inside a bar that alone exceeds the limit
            a = pos[-1]
            inner = {a + n * step for n in range(1, (p - a - 1) // step + 1)} | {p - n * step for n in range(1, (p - a - 1) // step + 1)} | {a + limit}
            for x in sorted(inner):
                if a < x < p:
                    pos.append(x)
                    kin.append(INSIDE)
        pos.append(p)
        kin.append(k)
    pos_a = np.array(pos)
    whole = pos_a[np.array(kin) != INSIDE]
    whole[-1:] = pos_a[-1]
    n = len(pos)
    if pos[-1] - pos[0] <= limit:
        return [(pos[0], pos[-1], "end")]
    cost, back, start = np.full(n, np.inf), np.full(n, -1), np.full(n, pos[0])
    extra = np.zeros(n)
    for e in range(1, n):  # where the piece after a cut at e begins
        if kin[e] == INSIDE:
            start[e] = pos[e] - overlap
        else:
            start[e] = whole[max(0, np.searchsorted(whole, pos[e] - overlap, side="right") - 1)]
            # no room for the next boundary after whole bars: the exact overlap instead
            nxt = pos[e + 1] if e + 1 < n else pos[e]
            if nxt - start[e] > limit or pos[e] - start[e] >= limit or start[e] < pos[0]:
                start[e], extra[e] = pos[e] - overlap, SHORT_OVERLAP
    cost[0], start[0] = 0.0, pos[0]
    lo = 0
    for e in range(1, n):
        while pos[e] - min(pos[lo], pos[e]) > limit:
            lo += 1
        js = np.arange(lo, e)
        size = pos[e] - start[js]
        ok = size <= limit
        total = np.where(ok, cost[js] + (1 - size / limit) ** 2, np.inf)
        b = int(np.argmin(total))
        cost[e] = total[b] + (PENALTY[kin[e]] + extra[e] if e < n - 1 else 0.0)
        back[e] = js[b]
    out, e = [], n - 1
    while e > 0:
        b = int(back[e])
        out.append((int(start[b]), pos[e], "end" if e == n - 1 else KINDS[kin[e]]))
        e = b
    return out[::-1]


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def done(seq: np.ndarray, pos: np.ndarray, kind: np.ndarray) -> pa.RecordBatch | None:
            order = np.lexsort((pos, seq))
            seq, pos, kind = seq[order], pos[order], kind[order]
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            rows = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(seq)]):
                if pos[b - 1] > limit:
                    rows.extend((seq[a], i, *x) for i, x in enumerate(cut_points(pos[a:b], kind[a:b], limit, overlap)))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["seq_id", "piece_no", "start_token", "end_token", "cut"]) if rows else None

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
            new = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut and (made := done(*[c[:cut] for c in cols])):
                yield made
            rest = [c[cut:] for c in cols]
        if rest is not None and (made := done(*rest)):
            yield made

    return run


def sequence_pieces(bars: DataFrame, phrases: DataFrame, limits: DataFrame) -> DataFrame:
    """`seq_id`, `piece_no`, `start_token`, `end_token` (exclusive), `cut` (how it ends): pieces of the sequences beyond context_window.

    Only rows of a sequence's newest analysis (over both tables) count; repeated rows collapse in the pre-aggregation.
    Null positions are skipped, a phrase's start falls back to its first bar's. Missing bars leave a longer stretch
    without boundary, which counts as one bar. Sequences within the limit, without positions or with null seq_id give no
    rows, nor do empty tables. Without context_window in `limits` there is nothing to cut.
    """
    value = {r[0]: r[1] for r in limits.where("limit_name IN ('context_window', 'piece_overlap') AND tokens IS NOT NULL").select("limit_name", "tokens").collect()}
    limit = value.get("context_window", 2**31 - 2)
    overlap = min(value.get("piece_overlap", 0), max(0, limit - 1))
    newest = bars.select("seq_id", "analysed_at").unionByName(phrases.select("seq_id", "analysed_at")).where("seq_id IS NOT NULL").groupBy("seq_id").agg(F.max("analysed_at").alias("analysed_at"))
    bar = bars.select("seq_id", "bar_idx", "start_token", "end_token", "analysed_at").join(newest, ["seq_id", "analysed_at"])
    bar_start = bar.groupBy("seq_id", "bar_idx").agg(F.min("start_token").alias("bar_start"))
    phrase = phrases.select("seq_id", F.col("start_bar").alias("bar_idx"), "start_token", "end_token", "analysed_at").join(newest, ["seq_id", "analysed_at"]).join(bar_start, ["seq_id", "bar_idx"], "left")

    def at(df: DataFrame, col, kind: int) -> DataFrame:
        return df.select("seq_id", col.alias("pos"), F.lit(kind).alias("kind"))

    points = at(bar, F.explode(F.array("start_token", "end_token")), BAR).unionByName(at(phrase, F.explode(F.array(F.coalesce("start_token", "bar_start"), F.col("end_token"))), PHRASE))
    points = points.where("pos >= 0").unionByName(at(newest, F.lit(0), BAR))
    points = points.groupBy("seq_id", "pos").agg(F.max("kind").alias("kind"))
    return points.repartition("seq_id").sortWithinPartitions("seq_id").mapInArrow(_cut(limit, overlap), "seq_id string, piece_no int, start_token int, end_token int, cut string")
