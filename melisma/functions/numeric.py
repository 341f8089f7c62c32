"""Scales, bins, ratios and score curves as Column expressions. Rounding is half-even (`rint`) throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token grid.
POSITIONS = 32
DURATIONS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
TEMPO_MIN, TEMPO_MAX, TEMPO_STEP = 40, 220, 2
PITCH_MIN, PITCH_MAX = 21, 108
# Centred mu-law scale of velocities.
MU, CENTRE, HALF, BINS = 8.0, 64.0, 63.0, 16


def whole(c: Column) -> Column:
    """Half-even rounding to an int; null stays null."""
    return F.rint(c).cast("int")


def clip(c: Column, low, high) -> Column:
    """Within [low, high]; null stays null (greatest and least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def velocity_bin(velocity: Column) -> Column:
    """Velocity -> bin 0..15 on a centred mu-law scale; 0 counts as 1, values outside 1..127 are clipped, null stays null."""
    x = (clip(velocity.cast("double"), 1.0, 127.0) - CENTRE) / HALF
    size = F.log1p(MU * F.abs(x)) / math.log1p(MU)
    signed = F.when(x < 0, -size).otherwise(size)
    return clip(whole((signed + 1.0) / 2.0 * (BINS - 1)), 0, BINS - 1)


def velocity_value(bin_id: Column) -> Column:
    """Bin -> the velocity that stands for it; bins outside the scale are clipped, null stays null."""
    s = 2.0 * clip(bin_id.cast("double"), 0.0, BINS - 1.0) / (BINS - 1) - 1.0
    size = (F.pow(F.lit(1.0 + MU), F.abs(s)) - 1.0) / MU
    return clip(whole(CENTRE + HALF * F.when(s < 0, -size).otherwise(size)), 1, 127)


def tempo_token(bpm: Column) -> Column:
    """Beats per minute -> TEMPO_x on the even grid 40..220; null stays null."""
    clipped = clip(F.rint(bpm), float(TEMPO_MIN), float(TEMPO_MAX))
    value = whole((clipped - TEMPO_MIN) / TEMPO_STEP) * TEMPO_STEP + TEMPO_MIN
    return F.concat(F.lit("TEMPO_"), clip(value, TEMPO_MIN, TEMPO_MAX).cast("string"))


def nearest(value: Column, candidates=DURATIONS) -> Column:
    """The nearest of the candidates, the smaller one on a tie; null stays null."""
    options = F.array(*[F.struct(F.abs(value - c).alias("gap"), F.lit(c).alias("value")) for c in candidates])
    return F.when(value.isNotNull(), F.array_min(options)["value"])


def bpm_of(tempo_us: Column) -> Column:
    """Microseconds a beat -> beats a minute; 0 and null give null."""
    return F.try_divide(F.lit(60_000_000.0), tempo_us)


def bar_ticks(ticks_per_beat: Column, numerator: Column | None = None, denominator: Column | None = None) -> Column:
    """Ticks a bar, at least 1; 4/4 unless a time signature is given."""
    numerator, denominator = (F.lit(4) if c is None else c for c in (numerator, denominator))
    return F.greatest(F.lit(1), whole(ticks_per_beat * numerator * (4.0 / F.greatest(F.lit(1), denominator))))


def total_bars(last_end: Column, ticks: Column) -> Column:
    """Bars up to the last end; no notes (null) give 0."""
    return F.coalesce(F.ceil(last_end / F.greatest(F.lit(1), ticks)), F.lit(0)).cast("int")


def unit_bar(unit: Column) -> Column:
    return (F.greatest(F.lit(0), unit) / POSITIONS).cast("int")


def unit_pos(unit: Column) -> Column:
    return (F.greatest(F.lit(0), unit) % POSITIONS).cast("int")


def safe_ratio(delta: Column, left: Column, right: Column) -> Column:
    """delta as a share of the larger side (at least 1), within 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), delta / F.greatest(F.lit(1.0), F.abs(left), F.abs(right))))


def finite(c: Column) -> Column:
    """Value as double; text that is no number, NaN and infinities become null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def onset_weight(pos: Column) -> Column:
    """1.6 on the bar line, 1.3 on other beats, 1 elsewhere."""
    return F.when(pos == 0, 1.6).when(pos % 8 == 0, 1.3).otherwise(1.0)


def smoothstep(t: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t * t * (3.0 - 2.0 * t)


def piecewise_score(value: Column, goal: Column, bad: Column, acceptable: Column, ideal: Column) -> Column:
    """0 at bad, 60 at acceptable, 100 at ideal, smooth between; goal 'min' counts downwards. Null stays null."""
    sign = F.when(goal == "max", 1.0).otherwise(-1.0)
    v, b, a, i = (sign * x for x in (value, bad, acceptable, ideal))
    low, high = smoothstep((v - b) / F.greatest(F.lit(1e-12), a - b)), smoothstep((v - a) / F.greatest(F.lit(1e-12), i - a))
    return F.when(value.isNull(), None).when(v <= b, 0.0).when(v >= i, 100.0).when(v <= a, 60.0 * low).otherwise(60.0 + 40.0 * high)


def band_score(value: Column, bad_low: Column, ok_low: Column, ideal_low: Column, ideal_high: Column, ok_high: Column, bad_high: Column) -> Column:
    """100 inside the ideal band, 60 at the acceptable edges, 0 outside the bad ones. Null stays null."""
    up = F.least((value - ok_low) / (ideal_low - ok_low), (ok_high - value) / (ok_high - ideal_high))
    out = F.least((value - bad_low) / (ok_low - bad_low), (bad_high - value) / (bad_high - ok_high))
    inner = value.between(ideal_low, ideal_high)
    return F.when(value.isNull(), None).when(inner, 100.0).when(value.between(ok_low, ok_high), 60.0 + 40.0 * smoothstep(up)).when(value.between(bad_low, bad_high), 60.0 * smoothstep(out)).otherwise(0.0)


# States at which a sequence may end on a whole event.
SAFE_CLOSE = ("after_head_tempo", "after_bar", "after_bar_tempo", "after_vel")


def eos_bias(done: Column, room: Column, state: Column) -> Column:
    """Additive bias towards the end token, by progress, what is left and a safe state; 0 without room."""
    progress, left = done / room, room - done
    steps = [(progress >= 0.60, 0.20), (progress >= 0.78, 0.60), (progress >= 0.90, 1.35), (left <= 6, 0.65), (left <= 3, 1.10)]
    safe = state.isin(*SAFE_CLOSE) & (done >= F.greatest(F.lit(16), F.least(F.lit(32), F.floor(room / 3))))
    total = sum((F.when(test, weight).otherwise(0.0) for test, weight in [*steps, (safe, 0.40)]), F.lit(0.0))
    return F.when((room <= 0) | (done < 0), 0.0).otherwise(total)


def force_stop(done: Column, room: Column, state: Column) -> Column:
    """Whether to stop at a safe state because the room is nearly used up."""
    near = room - done <= F.greatest(F.lit(3), F.least(F.lit(5), F.floor(room / 10)))
    return F.coalesce(state.isin(*SAFE_CLOSE), F.lit(False)) & (done > 0) & (room > 0) & near & (done >= F.greatest(F.lit(16), F.least(F.lit(28), F.floor(room / 3))))


def learning_rate(step: Column, name: str, total: int, warmup: int, floor: float) -> Column:
    """Scale of the learning rate at a step counted from 1: 'none', 'linear' or 'cosine' after a linear warm-up."""
    if name == "none":
        return F.lit(1.0)
    warm, low = max(0, min(warmup, total)), min(1.0, max(0.0, floor))
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warm) / float(max(1, total - warm))))
    shape = 1.0 - done if name == "linear" else 0.5 * (1.0 + F.cos(math.pi * done))
    fall = F.lit(low) if total <= warm else low + (1.0 - low) * shape
    return F.when((F.lit(warm) > 0) & (step <= warm), step / float(max(1, warm))).otherwise(fall)


def tokens_seen(step: Column, batch: Column, length: Column) -> Column:
    """Training tokens up to a step; null if batch or length is."""
    return F.when(batch.isNotNull() & length.isNotNull(), F.greatest(F.lit(0), step).cast("long") * F.greatest(F.lit(1), batch) * F.greatest(F.lit(1), length))


def one_pass_steps(tokens: Column, batch: int, accumulation: int, length: int) -> Column:
    """Optimiser steps that see every token once."""
    return F.ceil(tokens / (batch * accumulation * length)).cast("long")


def safe_rate(part: Column, of: Column) -> Column:
    """part / of, null where nothing was counted."""
    return F.try_divide(part, of)


def pearson(values: Column, reference: list[float]) -> Column:
    """Correlation of an array column of doubles with a fixed vector, two passes in index order; no variance gives 0."""
    n = float(len(reference))
    mean_ref = sum(reference) / n
    ref = [x - mean_ref for x in reference]
    var_ref = 0.0
    for x in ref:
        var_ref += x * x
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    centred = F.transform(values, lambda x: x - mean)
    pairs = F.zip_with(centred, F.array(*[F.lit(x) for x in ref]), lambda x, r: F.struct(x.alias("x"), r.alias("r")))
    sums = F.aggregate(pairs, F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx")), lambda a, p: F.struct((a.xy + p.x * p.r).alias("xy"), (a.xx + p.x * p.x).alias("xx")))
    denom = F.sqrt(sums["xx"]) * math.sqrt(var_ref)
    return F.when(denom > 0, sums["xy"] / denom).otherwise(0.0)
