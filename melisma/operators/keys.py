"""Key timelines: sliding frames, weighted pitch-class histograms, ranked keys, smoothed path, segments and modulations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.functions import numeric as N

# Pitch classes, and how strongly each one speaks for a major or minor key on C.
PITCH_CLASSES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
KEYS = tuple(f"{p}:{m}" for m in ("maj", "min") for p in PITCH_CLASSES)
# Window and hop in units, least score and margin, neighbourhood, penalties.
WINDOW, HOP = 32, 16
LEAST_SCORE, LEAST_MARGIN = 0.30, 0.10
RADIUS, DECAY = 3, 0.65
CONFIRM, GLOBAL_BIAS, CHANGE = 2, 0.18, 0.45
UNCERTAIN = "uncertain"


def rotated(profile: tuple[float, ...], root: int) -> list[float]:
    return [profile[(i - root) % 12] for i in range(12)]


PROFILES = {f"{p}:{m}": rotated(profile, root) for m, profile in (("maj", MAJOR), ("min", MINOR)) for root, p in enumerate(PITCH_CLASSES)}


def units_total(events: DataFrame, bars: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `total`: units of a sequence, its bars or its last note's end, whichever is later. `bars` gives `bars` per key."""
    last = events.groupBy(key).agg(F.max(F.col("unit") + F.greatest(F.lit(1), "dur")).alias("last"))
    return bars.join(last, key, "left").select(key, F.greatest(F.col("bars") * N.POSITIONS, F.coalesce("last", F.lit(0))).cast("long").alias("total")).where("bars > 0")


def frames(totals: DataFrame, key: str = "file_id", window: int = WINDOW, hop: int = HOP) -> DataFrame:
    """`key`, `frame`, `start`, `end`: windows every hop, and one more that ends with the sequence if the last hop falls short."""
    last = F.greatest(F.lit(window), "total") - window
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(hop).cast("long")), F.array(last.cast("long"))))
    return totals.select(key, F.posexplode(starts).alias("frame", "start")).select(key, "frame", "start", (F.col("start") + window).alias("end"))


def frame_overlaps(events: DataFrame, spans: DataFrame, key: str = "file_id", hop: int = HOP) -> DataFrame:
    """`key`, `frame`, `pitch`, `pos`, `overlap`: notes (`unit`, `dur`) that sound within a frame, and for how long.

    Both sides are cut into cells of a hop, so the interval condition becomes an equi-join; a pair is kept in the first
    cell both have only.
    """
    note_end = F.col("unit") + F.greatest(F.lit(1), "dur")
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / hop), F.floor((b - 1) / hop)))
    n = events.select(key, "pitch", "pos", F.col("unit").alias("s"), note_end.alias("e"), cell(F.col("unit"), note_end).alias("cell"))
    f = spans.select(key, "frame", "start", "end", cell(F.col("start"), F.col("end")).alias("cell"))
    both = n.join(f, [key, "cell"]).where(F.col("cell") == F.floor(F.greatest("s", "start") / hop))
    return both.withColumn("overlap", F.least("e", "end") - F.greatest("s", "start")).where("overlap > 0").select(key, "frame", "pitch", "pos", "overlap")


def pitch_class_histogram(overlaps: DataFrame, spans: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `frame`, `hist` (12 doubles): overlap times onset weight by pitch class; frames without notes have zeros."""
    pc = F.col("pitch") % 12
    # tenths are summed as whole numbers, so that the order of addition doesn't matter
    weight = F.rint(N.onset_weight(F.col("pos")) * 10).cast("long") * F.col("overlap")
    sums = overlaps.groupBy(key, "frame").agg(*[F.sum(F.when(pc == i, weight).otherwise(0)).alias(f"_{i}") for i in range(12)])
    return spans.join(sums, [key, "frame"], "left").select(key, "frame", "start", "end", F.array(*[F.coalesce(f"_{i}", F.lit(0)) / 10.0 for i in range(12)]).alias("hist"))


def _centred(profile: list[float]) -> tuple[list[float], float]:
    mean = sum(profile) / len(profile)
    rest = [x - mean for x in profile]
    square = 0.0
    for x in rest:
        square += x * x
    return rest, math.sqrt(square)


def with_key_scores(rows: DataFrame, name: str = "scores") -> DataFrame:
    """Adds the 24 correlations of `hist` with the keys' profiles, in the order of KEYS; no variance gives 0.

    Two passes in index order, as functions.numeric.pearson, but the histogram is centred once and the profiles are one
    literal, so that the plan stays small.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    parts = [_centred(PROFILES[k]) for k in KEYS]
    profiles = F.array(*[F.struct(F.array(*[F.lit(x) for x in rest]).alias("r"), F.lit(norm).alias("norm")) for rest, norm in parts])
    r = rows.withColumn("_m", total("hist") / 12.0).withColumn("_c", F.transform("hist", lambda x: x - F.col("_m")))
    r = r.withColumn("_v", F.sqrt(total(F.transform("_c", lambda x: x * x))))
    score = F.transform(profiles, lambda p: F.when(F.col("_v") * p["norm"] > 0, total(F.zip_with("_c", p["r"], lambda x, y: x * y)) / (F.col("_v") * p["norm"])).otherwise(0.0))
    return r.withColumn(name, score).drop("_m", "_c", "_v")


def ranked_keys(scores: Column) -> Column:
    """Array of (key, score), best first; equal scores in order of the names."""
    pairs = F.zip_with(F.array(*[F.lit(k) for k in KEYS]), scores, lambda k, s: F.struct((-s).alias("n"), k.alias("key")))
    return F.transform(F.array_sort(pairs), lambda p: F.struct(p["key"].alias("key"), (-p["n"]).alias("score")))


def raw_frames(hists: DataFrame, key: str = "file_id") -> DataFrame:
    """Adds `scores`, `raw_key`, `best`, `margin`, `uncertain` to frame histograms."""
    h = with_key_scores(hists).withColumn("_r", ranked_keys(F.col("scores")))
    best, second = F.col("_r")[0], F.col("_r")[1]
    weight = F.aggregate("hist", F.lit(0.0), lambda a, x: a + x)
    h = h.withColumn("raw_key", best["key"]).withColumn("best", best["score"]).withColumn("margin", F.greatest(F.lit(0.0), best["score"] - second["score"]))
    return h.withColumn("uncertain", (weight <= 0) | (F.col("best") < LEAST_SCORE) | (F.col("margin") < LEAST_MARGIN)).drop("_r")


def _faded(share: float):
    return lambda x: F.greatest(F.lit(0.0), x) * share


def neighbourhood_support(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """Adds `support` (24 doubles): positive scores of the frames up to RADIUS away, each weaker by DECAY a step."""
    w = W.partitionBy(key).orderBy("frame")
    total = F.array(*[F.lit(0.0)] * len(KEYS))
    for d in range(-RADIUS, RADIUS + 1):
        other = F.lag("scores", -d).over(w) if d < 0 else (F.col("scores") if d == 0 else F.lead("scores", d).over(w))
        faded = F.transform(other, _faded(DECAY ** abs(d)))
        total = F.when(other.isNull(), total).otherwise(F.zip_with(total, faded, lambda a, x: a + x))
    return rows.withColumn("support", total)


def best_path(scores: np.ndarray, bias: np.ndarray) -> list[int]:
    """Keys of a sequence of frames (frames x 24) that score most in all, each change costing CHANGE; ties go to the earlier key."""
    emission = scores + GLOBAL_BIAS * np.maximum(0.0, bias)
    now, back = emission[0].copy(), []
    stay = np.full((24, 24), CHANGE)
    np.fill_diagonal(stay, 0.0)
    for e in emission[1:]:
        options = (now[:, None] + e[None, :]) - stay
        at = options.argmax(0)
        back.append(at)
        now = options[at, np.arange(24)]
    path = [int(now.argmax())]
    for at in reversed(back):
        path.append(int(at[path[-1]]))
    return path[::-1]


def segments(labels: list[str]) -> list[tuple[str, int, int]]:
    """(key, first frame, frame after the last): a new key counts once it holds CONFIRM frames in a row; uncertain frames change nothing."""
    known = [i for i, x in enumerate(labels) if x != UNCERTAIN]
    if not known:
        return []
    out, start = [], known[0]
    key, i = labels[start], start + 1
    while i < len(labels):
        j = i
        while j < len(labels) and labels[j] == labels[i]:
            j += 1
        if labels[i] not in (UNCERTAIN, key) and j - i >= CONFIRM:
            out.append((key, start, i))
            key, start = labels[i], i
        i = j
    return [*out, (key, start, len(labels))]


def key_segments(rows: DataFrame, totals: DataFrame, overall: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `segment`, `name`, `start_unit`, `end_unit`, `mean_score`, `support`: stable stretches of one key.

    `rows` are raw frames with support, `overall` holds `bias` (24 scores of the whole sequence). The path is a dynamic
    program over a sequence's frames, so one sequence is folded at a time, in Arrow batches; all else is joins.
    """
    packed = F.array_sort(F.collect_list(F.struct("frame", "start", "scores", "best", "uncertain", "support")))
    seqs = rows.groupBy(key).agg(packed.alias("frames")).join(overall.select(key, "bias"), key).join(totals, key)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ident, fr, bias, total in zip(batch[key], batch["frames"], batch["bias"], batch["total"]):
                bias = np.asarray(bias, float)
                path = best_path(np.array([f["scores"] for f in fr], float), bias)
                labels = [UNCERTAIN if f["uncertain"] else KEYS[k] for f, k in zip(fr, path)]
                for n, (name, a, b) in enumerate(segments(labels)):
                    hit = [i for i in range(a, b) if labels[i] == name]
                    later = [i for i in range(a, len(fr)) if labels[i] == name][:CONFIRM]
                    k = KEYS.index(name)
                    support = [max(0.0, fr[i]["support"][k] + GLOBAL_BIAS * max(0.0, bias[k])) for i in later]
                    mean = sum(fr[i]["best"] for i in hit) / len(hit) if hit else 0.0
                    out.append((ident, n, name, int(fr[a]["start"]), int(total) if b >= len(fr) else int(fr[b]["start"]), mean, sum(support) / len(support) if support else 0.0))
            yield pd.DataFrame(out, columns=[key, "segment", "name", "start_unit", "end_unit", "mean_score", "support"])

    kind = rows.schema[key].dataType.simpleString()
    return seqs.select(key, "frames", "bias", "total").mapInPandas(fold, f"{key} {kind}, segment int, name string, start_unit long, end_unit long, mean_score double, support double")


def timeline(events: DataFrame, bars: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(raw frames with support, segments) of sequences: `events` as numbered grid rows, `bars` with `key` and `bars`."""
    totals = units_total(events, bars, key)
    spans = frames(totals, key)
    raw = neighbourhood_support(raw_frames(pitch_class_histogram(frame_overlaps(events, spans, key), spans, key), key), key)
    whole = totals.select(key, F.lit(0).alias("frame"), F.lit(0).cast("long").alias("start"), F.greatest(F.lit(1), "total").alias("end"))
    overall = pitch_class_histogram(events.select(key, F.lit(0).alias("frame"), "pitch", "pos", F.greatest(F.lit(1), "dur").alias("overlap")), whole, key)
    overall = with_key_scores(overall, "bias").select(key, "bias")
    return raw, key_segments(raw, totals, overall, key)


def modulations(segs: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `bar`, `pos`, `from_key`, `to_key`, `support`: where a new stable key begins."""
    w = W.partitionBy(key).orderBy("segment")
    rows = segs.withColumn("from_key", F.lag("name").over(w)).where("from_key <> name")
    return rows.select(key, N.unit_bar(F.col("start_unit")).alias("bar"), N.unit_pos(F.col("start_unit")).alias("pos"), "from_key", F.col("name").alias("to_key"), "support")


def dominant_key(segs: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `dominant`, `coverage`: the key that holds longest (ties by name) and its share of all segments' length."""
    per = segs.groupBy(key, "name").agg(F.sum(F.greatest(F.lit(0), F.col("end_unit") - F.col("start_unit"))).alias("held"))
    best = per.groupBy(key).agg(F.min(F.struct((-F.col("held")).alias("n"), F.col("name"))).alias("b"), F.sum("held").alias("all"))
    return best.select(key, F.col("b.name").alias("dominant"), F.try_divide(-F.col("b.n"), F.col("all")).alias("coverage"))


def with_keys(bodies: DataFrame, segs: DataFrame, key: str = "file_id") -> DataFrame:
    """`bodies` (`key`, `bar`, `tempo` of the bar or null, `head_tempo`, `notes`: text) -> `key`, `text`: the sequence with its first key at the head and each modulation's key in its bar."""
    name = lambda c: F.concat(F.lit("KEY_"), F.upper(F.replace(F.replace(c, F.lit("#"), F.lit("_SHARP")), F.lit(":"), F.lit("_"))))
    first = segs.where("segment = 0").select(key, name(F.col("name")).alias("head_key"))
    change = modulations(segs, key).groupBy(key, "bar").agg(F.max_by("to_key", "pos").alias("to")).select(key, "bar", name(F.col("to")).alias("own_key"))
    rows = bodies.join(change, [key, "bar"], "left").select(key, "bar", "head_tempo", F.concat_ws(" ", F.lit("BAR"), "tempo", "own_key", F.nullif("notes", F.lit(""))).alias("t"))
    seq = rows.groupBy(key).agg(F.first("head_tempo").alias("head_tempo"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar", "t"))), lambda x: x["t"]), " ").alias("body"))
    return seq.join(first, key, "left").select(key, F.concat_ws(" ", F.lit("BOS"), "head_tempo", F.coalesce("head_key", F.lit("KEY_UNCERTAIN")), "body", F.lit("EOS")).alias("text"))
