"""Training logs, checkpoint choice and scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.functions import numeric as N

ALPHA = 0.1


def loss_ema(log: DataFrame, by: str = "run", order: str = "line_no") -> DataFrame:
    """Adds `ema` to train and eval rows: a running mean of the training loss, taken over where a mean was logged; eval rows see the latest one before them.

    Each value depends on the one before, so a run's log is folded in order, one run at a time, in Arrow batches. Losses that
    are missing change nothing.
    """
    cols = log.columns

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        now, out = None, []
        for event, loss, logged in zip(rows["event"], rows["loss"].to_numpy(float), rows["logged_ema"].to_numpy(float)):
            if event == "train" and logged == logged:
                now = logged
            elif event == "train" and loss == loss:
                now = loss if now is None else ALPHA * loss + (1 - ALPHA) * now
            out.append(now)
        return rows.assign(ema=np.array(out, dtype=float))[[*cols, "ema"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema)
    return log.groupBy(by).applyInPandas(fold, f"{schema}, ema double").withColumn("ema", F.when(~F.isnan("ema"), F.col("ema")))


def aligned_log(log: DataFrame, batch: int, length: int, by: str = "run", order: str = "line_no") -> DataFrame:
    """Adds `ema`, `best_so_far`, `overfit_gap`, `tokens_seen` and keeps the last row of every event and step. `step` is `order` where missing."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = loss_ema(log, by, order)
    step = F.col("step") if "step" in log.columns else F.col(order)
    rows = rows.withColumn("step", step).withColumn("best_so_far", F.min("valid_loss").over(w)).withColumn("best_so_far", F.when(F.col("event") == "eval", F.col("best_so_far")))
    rows = rows.withColumn("overfit_gap", F.col("valid_loss") - F.col("ema")).withColumn("tokens_seen", N.tokens_seen(F.col("step"), F.lit(batch), F.lit(length)))
    last = F.row_number().over(W.partitionBy(by, "event", "step").orderBy(F.desc(order)))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def log_summary(aligned: DataFrame, by: str = "run") -> DataFrame:
    """One row per run: numbers of rows, last steps, latest and best losses, plateau, loss statistics. Missing parts are null."""
    ev, tr = F.col("event") == "eval", F.col("event") == "train"
    has = ev & F.col("valid_loss").isNotNull()
    best = F.min(F.when(has, F.struct("valid_loss", "step")))
    base = aligned.groupBy(by).agg(
        F.count_if(tr).alias("train_rows"), F.count_if(ev).alias("eval_rows"), F.max(F.when(tr, F.col("step"))).alias("last_train_step"), F.max(F.when(ev, F.col("step"))).alias("last_eval_step"),
        F.max_by(F.when(tr, F.col("loss")), F.when(tr, F.col("step"))).alias("latest_train_loss"), F.max_by(F.when(ev, F.col("valid_loss")), F.when(ev, F.col("step"))).alias("latest_valid_loss"),
        best.alias("_b"), F.min(F.when(tr, F.col("loss"))).alias("train_loss_min"), F.min(F.when(tr, F.col("ema"))).alias("train_ema_min"),
        F.avg(F.when(tr, F.col("loss"))).alias("train_loss_mean"), F.median(F.when(tr, F.col("loss"))).alias("train_loss_median"),
        F.when(F.count(F.when(tr, F.col("loss"))) > 1, F.stddev_pop(F.when(tr, F.col("loss")))).alias("train_loss_std"),
    )
    after = aligned.where(ev).join(base.select(by, F.col("_b.step").alias("_at")), by).groupBy(by).agg(F.count_if(F.col("step") > F.col("_at")).alias("plateau"))
    out = base.join(after, by, "left").withColumn("best_valid_loss", F.col("_b.valid_loss")).withColumn("best_valid_step", F.col("_b.step")).drop("_b")
    return out.withColumn("plateau", F.coalesce("plateau", F.lit(0)))


def prefiltered(checkpoints: DataFrame, keep: int, earliest: int, by: list[str] | None = None) -> DataFrame:
    """`place` (1..keep) of the checkpoints kept: the earliest ones, then by lowest loss, then, if too few have one, the others in order of `step`."""
    by = by or []
    have = F.col("valid_loss").isNotNull()
    part = W.partitionBy(*by)
    rows = checkpoints.withColumn("_early", F.when(have, F.row_number().over(W.partitionBy(*by, have).orderBy("step"))))
    kind = F.when(have & (F.col("_early") <= earliest), 0).when(have, 1).otherwise(2)
    first = F.when(kind == 1, F.col("valid_loss")).otherwise(0.0)
    return rows.withColumn("place", F.row_number().over(part.orderBy(kind, first, "step"))).where(F.col("place") <= keep).drop("_early")


def evenly_spaced(rows: DataFrame, n: int, order: str) -> DataFrame:
    """n rows at even distances in `order`, both ends included; all rows if there are no more; n = 1 gives the last."""
    ranked = rows.withColumn("_i", F.row_number().over(W.orderBy(order)) - 1).withColumn("_t", F.count("*").over(W.partitionBy()))
    if n <= 0:
        return ranked.drop("_i", "_t")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("_t") - 1) / F.lit(max(1, n - 1))).cast("int")) if n > 1 else F.array(F.col("_t").cast("int") - 1)
    return ranked.where((F.col("_t") <= n) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_t")


def rank_score(value: Column, goal: str) -> Column:
    """1 for the best row down to 0, equal values share their mean rank, a single value gets 1, null gets null."""
    w = W.partitionBy(value.isNull())
    order = value.desc() if goal == "max" else value.asc()
    rank = F.rank().over(w.orderBy(order)) - 1
    same = F.count("*").over(W.partitionBy(value))
    n = F.count("*").over(w)
    return F.when(value.isNull(), None).when(n == 1, 1.0).otherwise(1.0 - (rank + (same - 1) / 2.0) / (n - 1))


# The weights, goals, gates and tie-breakers by which checkpoints are ranked.
PROFILE = {
    "weights": [("structural", "max", 0.30), ("time_order", "max", 0.24), ("empty_bar", "min", 0.12), ("stop", "max", 0.12), ("budget", "min", 0.08), ("first_event", "max", 0.06), ("syntax_invalid", "min", 0.04), ("valid_loss", "min", 0.04)],
    "gates": [("stop", "max", 0.20), ("budget", "min", 0.75), ("time_order", "max", 0.85)],
    "ties": [("structural", "max"), ("time_order", "max"), ("stop", "max"), ("valid_loss", "min"), ("step", "max")],
}


def gates(rows: DataFrame, specs: list[tuple[str, str, float]]) -> DataFrame:
    """Adds `passed` and `failed`: every threshold must hold, a missing value fails; reasons read name<0.2000, name>0.7500 or name=NA."""
    found = []
    for name, goal, least in specs:
        v = F.col(name)
        ok = F.coalesce(v >= least if goal == "max" else v <= least, F.lit(False))
        text = F.when(v.isNull(), f"{name}=NA").otherwise(f"{name}{'<' if goal == 'max' else '>'}{least:.4f}")
        found.append(F.when(~ok, text))
    failed = F.filter(F.array(*found), lambda x: x.isNotNull())
    return rows.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def balanced(rows: DataFrame, profile: dict = PROFILE) -> DataFrame:
    """Adds `balanced_score` and `coverage`: weighted mean of the rank scores a row has, and the share of the weights it has them for."""
    whole = sum(w for _, _, w in profile["weights"])
    scored = rows.withColumns({f"_r_{n}": rank_score(F.col(n), g) for n, g, _ in profile["weights"]})
    total = sum((F.coalesce(F.col(f"_r_{n}") * w, F.lit(0.0)) for n, _, w in profile["weights"]), F.lit(0.0))
    used = sum((F.when(F.col(f"_r_{n}").isNotNull(), w).otherwise(0.0) for n, _, w in profile["weights"]), F.lit(0.0))
    return scored.withColumn("balanced_score", F.try_divide(total, F.nullif(used, F.lit(0.0)))).withColumn("coverage", used / whole).drop(*[f"_r_{n}" for n, _, _ in profile["weights"]])


def leaderboard(rows: DataFrame, profile: dict = PROFILE) -> DataFrame:
    """Adds `place`: rows with a score, those that pass all gates if any does, by score and tie-breakers; the others get null."""
    s = balanced(gates(rows, profile["gates"]), profile)
    scored = F.col("balanced_score").isNotNull()
    any_passed = F.max(F.when(scored, F.col("passed"))).over(W.partitionBy())
    on_board = scored & (F.col("passed") | ~any_passed)
    order = [F.round("balanced_score", 12).desc_nulls_last(), *[F.col(n).desc_nulls_last() if g == "max" else F.col(n).asc_nulls_last() for n, g in profile["ties"]]]
    return s.withColumn("_on", on_board).withColumn("place", F.when(F.col("_on"), F.row_number().over(W.partitionBy("_on").orderBy(*order)))).drop("_on")


# Dimensions (weight) and their metrics: name, goal, weight, bad, acceptable, ideal.
DIMENSIONS = {
    ("continuation_closure", 0.20): [("stop_success", "max", 0.40, 0.05, 0.28, 0.55), ("budget_stop", "min", 0.25, 0.98, 0.60, 0.18), ("missing_eos", "min", 0.25, 0.98, 0.60, 0.15), ("append_eos_recoverable", "max", 0.10, 0.02, 0.15, 0.40)],
    ("continuation_structure", 0.20): [("cont_structural", "max", 0.35, 0.15, 0.55, 0.82), ("cont_time_order", "max", 0.30, 0.75, 0.94, 0.995), ("empty_bar", "min", 0.20, 0.25, 0.05, 0.01), ("cont_syntax_invalid", "min", 0.15, 0.95, 0.30, 0.06)],
    ("infilling_integrity", 0.22): [("infill_structural", "max", 0.50, 0.20, 0.72, 0.96), ("infill_time_order", "max", 0.30, 0.45, 0.82, 0.97), ("infill_syntax_invalid", "min", 0.20, 0.85, 0.18, 0.03)],
    ("phrase_coherence", 0.15): [("first_event", "max", 0.25, 0.12, 0.48, 0.82), ("duration_l1", "min", 0.25, 1.30, 0.55, 0.15), ("cont_pitch_diversity", "max", 0.20, 0.12, 0.52, 0.82), ("infill_pitch_diversity", "max", 0.20, 0.12, 0.52, 0.82), ("cont_most_common_pitch", "min", 0.10, 0.85, 0.38, 0.18)],
    ("long_context_stability", 0.15): [("low_density", "min", 0.15, 0.28, 0.08, 0.02), ("multi_empty_run", "min", 0.20, 0.25, 0.05, 0.01), ("event_delta", "abs", 0.20, 40.0, 12.0, 2.0), ("pitch_span_delta", "abs", 0.15, 22.0, 7.0, 1.5), ("longest_run", "min", 0.15, 0.78, 0.24, 0.10), ("most_common_pitch", "min", 0.15, 0.85, 0.38, 0.18)],
    ("training_health", 0.08): [("valid_loss", "min", 0.45, 2.00, 0.95, 0.55), ("best_valid", "min", 0.35, 1.90, 0.90, 0.55), ("overfit_gap", "band", 0.20, -0.80, -0.35, -0.10)],
}
# Upper half of the band of overfit_gap.
BAND_HIGH = (0.03, 0.10, 0.25)


def absolute_scores(rows: DataFrame, key: list[str], dimensions: dict = DIMENSIONS) -> DataFrame:
    """`key`, one column per dimension, `absolute_score`, `coverage`: fixed curves, independent of the other rows.

    A missing metric leaves its dimension's weights, a dimension counts by the share of weights it has. Metrics absent
    from `rows` count as missing.
    """
    out, total, have, whole = rows, F.lit(0.0), F.lit(0.0), 0.0
    cols = {}
    for (name, weight), metrics in dimensions.items():
        score, used, full = F.lit(0.0), F.lit(0.0), 0.0
        for metric, goal, w, bad, ok, ideal in metrics:
            full += w
            if metric not in rows.columns:
                continue
            v = N.finite(F.col(metric))
            at = [F.lit(float(x)) for x in (bad, ok, ideal)]
            s = N.band_score(v, *at, *[F.lit(x) for x in BAND_HIGH]) if goal == "band" else N.piecewise_score(F.abs(v) if goal == "abs" else v, F.lit("max" if goal == "max" else "min"), *at)
            score = score + F.coalesce(s * w, F.lit(0.0))
            used = used + F.when(v.isNotNull(), w).otherwise(0.0)
        cols[name] = F.try_divide(score, F.nullif(used, F.lit(0.0)))
        share = used / full
        total = total + weight * share * F.coalesce(cols[name], F.lit(0.0))
        have, whole = have + weight * share, whole + weight
    return out.select(*key, *[c.alias(n) for n, c in cols.items()], F.try_divide(total, F.nullif(have, F.lit(0.0))).alias("absolute_score"), (have / whole).alias("coverage"))
