"""Phrase boundaries and spans from bar summaries, and windows of whole phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.functions import numeric as N

# Weights of the signals of a boundary, phrase lengths in bars, and the contribution from which a signal is named.
WEIGHTS = {"rest_gap": 0.40, "note_density_delta": 0.24, "onset_density_delta": 0.18, "pitch_span_delta": 0.12, "duration_delta": 0.06}
SHORTEST, LONGEST, PREFERRED, GAP = 2, 8, 4, 2
NAMED = 0.10


def boundary_scores(bars: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `bar` (the right one), `score`, `reasons`: how much speaks for a phrase boundary between neighbouring bars of a bar summary."""
    w = W.partitionBy(key).orderBy("bar")
    cols = ("note_count", "onset_count", "rest_ratio", "pitch_span", "mean_duration")
    b = bars.select(key, "bar", *cols, F.lag("bar").over(w).alias("left"), *[F.lag(c).over(w).alias(f"l_{c}") for c in cols]).where("left IS NOT NULL")
    delta = lambda c: N.safe_ratio(F.abs(F.col(c) - F.col(f"l_{c}")).cast("double"), F.col(f"l_{c}").cast("double"), F.col(c).cast("double"))
    rest = F.when((F.col("note_count") == 0) | (F.col("l_note_count") == 0), 1.0).otherwise(F.greatest("rest_ratio", "l_rest_ratio"))
    signals = {"rest_gap": rest, "note_density_delta": delta("note_count"), "onset_density_delta": delta("onset_count"), "pitch_span_delta": delta("pitch_span"), "duration_delta": delta("mean_duration")}
    b = b.select(key, "bar", *[(F.lit(WEIGHTS[k]) * v).alias(k) for k, v in signals.items()])
    score = sum((F.col(k) for k in WEIGHTS), F.lit(0.0))
    reasons = F.filter(F.array(*[F.when(F.col(k) >= NAMED, F.lit(k)) for k in WEIGHTS]), lambda x: x.isNotNull())
    return b.select(key, "bar", score.alias("score"), reasons.alias("reasons"))


def candidate_boundaries(scores: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `bar`, `score`: boundaries not under the sequence's third quartile (nearest rank, half-even) and not under their neighbours."""
    w = W.partitionBy(key).orderBy("bar")
    low = F.lit(float("-inf"))
    top = scores.groupBy(key).agg(F.array_sort(F.collect_list("score")).alias("s"))
    top = top.select(key, F.element_at("s", N.whole((F.size("s") - 1) * 0.75) + 1).alias("q"))
    s = scores.select(key, "bar", "score", F.coalesce(F.lag("score").over(w), low).alias("p"), F.coalesce(F.lead("score").over(w), low).alias("n"))
    return s.join(top, key).where("score >= q AND score >= p AND score >= n").select(key, "bar", "score")


def spaced(found: list[tuple[int, float]]) -> list[int]:
    """Boundaries in order, at least GAP bars apart; of two too close ones the stronger stays, the earlier on a tie."""
    kept: list[tuple[int, float]] = []
    for bar, score in found:
        if not kept or bar - kept[-1][0] >= GAP:
            kept.append((bar, score))
        elif score > kept[-1][1]:
            kept[-1] = (bar, score)
    return [b for b, _ in kept]


def spans(total: int, boundaries: list[int]) -> list[tuple[int, int]]:
    """Phrase spans (first bar, bar after the last): short ones join the one before (the first one the next), long ones are split near the preferred length."""
    edges = [0, *boundaries, total]
    raw = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
    joined: list[list[int]] = []
    wait = None  # start of a first span that is too short
    for a, b in raw:
        if wait is not None:
            joined.append([wait, b])
            wait = None
        elif b - a >= SHORTEST or len(raw) == 1:
            joined.append([a, b])
        elif joined:
            joined[-1][1] = b
        else:
            wait = a
    if wait is not None:
        joined.append([wait, total])
    out = []
    for a, b in joined:
        while b - a > LONGEST:
            ideal = a + PREFERRED
            inside = [x for x in boundaries if a + SHORTEST <= x <= b - SHORTEST]
            cut = min(inside, key=lambda x: (abs(x - ideal), x - a)) if inside else min(b - SHORTEST, max(a + SHORTEST, ideal))
            out.append((a, cut))
            a = cut
        out.append((a, b))
    return out


def phrase_spans(scores: DataFrame, totals: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `phrase`, `first`, `last` (exclusive): phrases of every sequence of `totals` (`key`, `bars`).

    Thinning and splitting depend on what was kept before, so each sequence's few boundaries are folded in order.
    """
    found = candidate_boundaries(scores, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bar", "score"))).alias("found"))
    seqs = totals.where("bars > 0").join(found, key, "left").select(key, F.col("bars").cast("int").alias("bars"), "found")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, bars, found_ in zip(batch[key], batch["bars"], batch["found"]):
                marks = spaced([(int(x["bar"]), x["score"]) for x in found_]) if found_ is not None else []
                rows.extend((ident, n, a, b) for n, (a, b) in enumerate(spans(int(bars), marks)))
            yield pd.DataFrame(rows, columns=[key, "phrase", "first", "last"])

    return seqs.mapInPandas(fold, f"{key} {seqs.schema[key].dataType.simpleString()}, phrase int, first int, last int")


def boundary_counts(windows: DataFrame, phrases: DataFrame, key: str = "file_id") -> DataFrame:
    """Adds `boundaries`: phrase starts strictly inside a window (`key`, `first`, `last`); the first phrase's start is none."""
    marks = phrases.where("phrase > 0").groupBy(key).agg(F.collect_list("first").alias("_marks"))
    inside = F.size(F.filter(F.coalesce("_marks", F.array().cast("array<int>")), lambda b: (b > F.col("first")) & (b < F.col("last"))))
    return windows.join(marks, key, "left").withColumn("boundaries", inside).drop("_marks")


def window_candidates(phrases: DataFrame, kind: str, fewest: int, most: int, key: str = "file_id") -> DataFrame:
    """`key`, `first`, `last` (exclusive): the windows of `fewest` to `most` bars that a sampler of this kind may take.

    'single_phrase': whole phrases, and pieces of longer ones; 'cross_boundary': some bars on each side of a boundary, within
    the two phrases; 'long_context': from any phrase's start to a later phrase's end.
    """
    p = phrases.select(key, "phrase", "first", "last").withColumn("size", F.col("last") - F.col("first"))
    sizes = F.explode(F.sequence(F.lit(fewest), F.lit(most))).alias("n")
    if kind == "single_phrase":
        whole = p.where(F.col("size").between(fewest, most)).select(key, "first", "last")
        longer = p.where(F.col("size") > most).select(key, "first", "last", sizes)
        pieces = longer.select(key, "n", F.explode(F.sequence(F.col("first"), F.col("last") - F.col("n"))).alias("first"))
        return whole.unionByName(pieces.select(key, "first", (F.col("first") + F.col("n")).alias("last")))
    if kind == "cross_boundary":
        w = W.partitionBy(key).orderBy("phrase")
        pairs = p.withColumn("end", F.lead("last").over(w)).where("end IS NOT NULL").select(key, "first", F.col("last").alias("mark"), "end", sizes)
        takes = pairs.where("n > 1").select(key, "first", "mark", "end", "n", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("left"))
        fit = takes.where("left <= mark - first AND n - left <= end - mark")
        return fit.select(key, (F.col("mark") - F.col("left")).alias("first"), (F.col("mark") + F.col("n") - F.col("left")).alias("last"))
    if kind == "long_context":
        ends = p.select(key, F.col("phrase").alias("q"), F.col("last").alias("end"))
        # phrases hold a bar at least, so no more than `most` of them fit
        ahead = p.select(key, "first", F.explode(F.sequence(F.col("phrase") + 1, F.col("phrase") + most - 1)).alias("q"))
        return ahead.join(ends, [key, "q"]).where((F.col("end") - F.col("first")).between(fewest, most)).select(key, "first", F.col("end").alias("last"))
    raise ValueError(f"unknown kind {kind!r}")


def window_lengths(windows: DataFrame, bars: DataFrame, key: str = "file_id") -> DataFrame:
    """Adds `length`: tokens of a window with BOS, tempo and key in force, and EOS. `bars` as from bar_table; sums up to each bar make it two lookups."""
    w = W.partitionBy(key).orderBy("bar").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = 1 + F.size("body")
    head = F.lit(2) + F.col("tempo").isNotNull().cast("int") + F.col("key_token").isNotNull().cast("int")
    sums = bars.select(key, "bar", F.sum(own).over(w).alias("upto"), own.alias("own"), head.alias("head"))
    a = sums.select(key, F.col("bar").alias("first"), (F.col("upto") - F.col("own")).alias("_before"), "head")
    b = sums.select(key, (F.col("bar") + 1).alias("last"), "upto")
    return windows.join(a, [key, "first"]).join(b, [key, "last"]).withColumn("length", F.col("upto") - F.col("_before") + F.col("head")).drop("upto", "_before", "head")


def picked(rows: DataFrame, by: list[str], order: list[str], seed: int) -> DataFrame:
    """One row per group, drawn by hash: the row with the smallest hash of the seed, the group and the row itself."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*by, *order]]))
    best = F.min(F.struct(mark.alias("_h"), *[F.col(c) for c in rows.columns if c not in by])).alias("_b")
    return rows.groupBy(*by).agg(best).select(*by, "_b.*").drop("_h")
