"""Structure metrics of note sequences: bars, order, overlaps, runs, diversity and repetition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.functions import numeric as N
from melisma.operators.sequences import repeat_ratio
from melisma.tables import materialise

# Least events for a metric to count, and how many different values count as full variety.
PITCH_EVENTS, RHYTHM_EVENTS, REPEAT_EVENTS = 6, 6, 8
PITCHES, ONSETS, LENGTHS = 12, 8, 6


def bar_info(events: DataFrame, bars: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `bar`, `note_count`, `onset_count`, `rest_ratio`, `pitch_span`, `mean_duration`: one row per bar of `bars` (`key`, `bar`), empty ones included."""
    cells = F.sequence(F.col("pos"), F.least(F.lit(N.POSITIONS - 1), F.col("pos") + F.greatest(F.lit(1), "dur") - 1))
    mask = F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x)))
    agg = events.withColumn("_mask", mask).groupBy(key, "bar").agg(
        F.count("*").alias("note_count"), F.count_distinct("pos").alias("onset_count"), F.bit_count(F.bit_or("_mask")).alias("cells"),
        (F.max("pitch") - F.min("pitch")).alias("pitch_span"), F.avg("dur").alias("mean_duration"),
    )
    rows = bars.select(key, "bar").join(agg, [key, "bar"], "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return rows.select(key, "bar", zero("note_count", "long"), zero("onset_count", "long"), (1.0 - F.coalesce("cells", F.lit(0)) / N.POSITIONS).alias("rest_ratio"), zero("pitch_span", "int"), zero("mean_duration", "double"))


def bar_spine(events: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `bar`: all bars from 0 to the last one with a note."""
    last = events.groupBy(key).agg(F.max("bar").alias("last"))
    return last.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("bar"))


def same_pitch_overlaps(events: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `overlaps`: notes (`event_idx`, `unit`, `pitch`, `dur`) that begin before an earlier one of their pitch has ended."""
    w = W.partitionBy(key, "pitch").orderBy("event_idx").rowsBetween(W.unboundedPreceding, -1)
    over = F.col("unit") < F.max(F.col("unit") + F.greatest(F.lit(1), "dur")).over(w)
    return events.select(key, over.alias("o")).groupBy(key).agg(F.count_if("o").alias("overlaps"))


def longest_run(rows: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """`by`, `name`: length of the longest run of equal neighbours. Null values form no run."""
    w = W.partitionBy(*by).orderBy(order)
    new = F.when(F.lag("_v").over(w).eqNullSafe(F.col("_v")), 0).otherwise(1)
    marked = rows.withColumn("_v", value).withColumn("_new", new)
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = marked.where("_v IS NOT NULL").groupBy(*by, "_run").agg(F.count("*").alias("_n"))
    return runs.groupBy(*by).agg(F.max("_n").alias(name))


def time_order_violations(events: DataFrame, key: str = "file_id", order: str = "idx") -> DataFrame:
    """`key`, `violations`: notes before the note written before them in the same bar."""
    w = W.partitionBy(key, "bar").orderBy(order)
    return events.select(key, (F.col("pos") < F.lag("pos").over(w)).alias("v")).groupBy(key).agg(F.count_if("v").alias("violations"))


def value_entropy(events: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """`key`, and with the prefix: `n`, `unique`, `top` (count of the commonest), `entropy` (natural). Values are counted first."""
    counts = events.groupBy(key, value).agg(F.count("*").alias("k"))
    e = counts.groupBy(key).agg(F.sum("k").alias("n"), F.count("*").alias("u"), F.max("k").alias("t"), F.sum(F.col("k") * F.log("k")).alias("s"))
    return e.select(key, F.col("n").alias(f"{prefix}n"), F.col("u").alias(f"{prefix}unique"), F.col("t").alias(f"{prefix}top"), (F.log("n") - F.col("s") / F.col("n")).alias(f"{prefix}entropy"))


def diversity(entropy: Column, unique: Column, reference: int) -> Column:
    """0.6 of the entropy as a share of its maximum, 0.4 of the variety as a share of the reference."""
    return N.clip(0.6 * F.when(unique > 1, entropy / F.log(unique)).otherwise(0.0) + 0.4 * F.least(unique, F.lit(reference)) / float(reference), 0.0, 1.0)


def pitch_collapse(events: DataFrame, key: str = "file_id", order: str = "event_idx") -> DataFrame:
    """`key`, `pitch_events`, `pitch_unique`, `coverage`, `most_common_ratio`, `longest_run_ratio`, `pitch_diversity`; the last three null below 6 events."""
    e = value_entropy(events, key, "pitch", "p_").join(longest_run(events, [key], order, F.col("pitch"), "run"), key)
    enough = F.col("p_n") >= PITCH_EVENTS
    return e.select(
        key, F.col("p_n").alias("pitch_events"), F.col("p_unique").alias("pitch_unique"), F.least(F.lit(1.0), F.col("p_n") / PITCH_EVENTS).alias("coverage"),
        F.when(enough, F.col("p_top") / F.col("p_n")).alias("most_common_ratio"), F.when(enough, F.col("run") / F.col("p_n")).alias("longest_run_ratio"),
        F.when(enough, diversity(F.col("p_entropy"), F.col("p_unique"), PITCHES)).alias("pitch_diversity"),
    )


def rhythm_diversity(events: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `rhythm_events`, `onset_unique`, `onset_entropy`, `bar_start_ratio`, `strong_beat_ratio`, `duration_diversity`, `rhythm_diversity`; ratios null below 6 events."""
    onset, length = value_entropy(events, key, "pos", "o_"), value_entropy(events, key, "dur", "d_")
    beats = events.groupBy(key).agg(F.avg((F.col("pos") == 0).cast("int")).alias("start"), F.avg((F.col("pos") % 8 == 0).cast("int")).alias("strong"))
    rows = onset.join(length, key).join(beats, key).withColumn("h", N.clip(F.col("o_entropy") / math.log(N.POSITIONS), 0.0, 1.0)).withColumn("dd", diversity(F.col("d_entropy"), F.col("d_unique"), LENGTHS))
    score = 0.35 * F.col("h") + 0.20 * F.least("o_unique", F.lit(ONSETS)) / ONSETS + 0.20 * F.col("dd") + 0.15 * (1.0 - F.col("strong")) + 0.10 * (1.0 - F.col("start"))
    some = lambda c: F.when(F.col("o_n") >= RHYTHM_EVENTS, c)
    return rows.select(
        key, F.col("o_n").alias("rhythm_events"), F.col("o_unique").alias("onset_unique"), some(F.col("h")).alias("onset_entropy"), some(F.col("start")).alias("bar_start_ratio"), some(F.col("strong")).alias("strong_beat_ratio"),
        some(F.col("dd")).alias("duration_diversity"), some(N.clip(score, 0.0, 1.0)).alias("rhythm_diversity"),
    )


def repetition(events: DataFrame, key: str = "file_id", order: str = "event_idx") -> DataFrame:
    """`key`, `event_repeat`, `rhythm_repeat`: mean share of repeated pairs and triples of (pos, pitch, dur) and (pos, dur); null below 8 events."""
    seq = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "pos", "pitch", "dur"))).alias("s"))
    whole = F.transform("s", lambda x: F.struct(x["pos"], x["pitch"], x["dur"]))
    rhythm = F.transform("s", lambda x: F.struct(x["pos"], x["dur"]))
    seq = seq.select(key, whole.alias("e"), rhythm.alias("r"))
    mean = lambda c: F.when(F.size(c) >= REPEAT_EVENTS, 0.5 * (repeat_ratio(F.col(c), 2) + repeat_ratio(F.col(c), 3)))
    return seq.select(key, mean("e").alias("event_repeat"), mean("r").alias("rhythm_repeat"))


def strict_parts(sequences: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, bars, positions) of token arrays up to the first EOS, broken note or other token.

    Notes before any BAR belong to an implicit bar, -1. Positions (`idx`, `bar`, `pos`) also hold that of the broken note
    the reading ends at. BOS, tempo, key and FIM tokens are skipped anywhere. What is read is written to the shared folder
    once, as many aggregates start from it.
    """
    one = lambda t: F.when(t.isin("BOS", "FIM_HOLE", "FIM_MID") | t.startswith("TEMPO_") | t.startswith("KEY_"), "S").when(t == "EOS", "E").when(t == "BAR", "R").when(t.startswith("POS_"), "P").when(t.startswith("INST_"), "I").when(t.startswith("PITCH_"), "C").when(t.startswith("DUR_"), "D").when(t.startswith("VEL_"), "V").otherwise("?")
    code = F.col("_code")
    rows = sequences.select(key, "tokens", F.array_join(F.transform("tokens", one), "").alias("_code")).where(F.length("_code") > 0)
    before = {"I": "P", "C": "I", "D": "C", "V": "D"}

    def stops(i: Column) -> Column:
        sign, last = F.substring(code, i + 1, F.lit(1)), F.when(i == 0, "^").otherwise(F.substring(code, i, F.lit(1)))
        broken = (sign == "P") & (F.substring(code, i + 1, F.lit(5)) != "PICDV")
        astray = F.lit(False)
        for part, want in before.items():
            astray = astray | ((sign == part) & (last != want))
        return sign.isin("E", "?") | broken | astray

    rows = rows.withColumn("_stop", F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.length(code) - 1), stops)), F.length(code)))
    token = rows.select(key, "_stop", "tokens", F.posexplode("tokens").alias("idx", "token")).where("idx < _stop OR (idx = _stop AND token LIKE 'POS%')")
    marks = token.where("token = 'BAR' OR token LIKE 'POS%'")
    bar = F.sum((F.col("token") == "BAR").cast("int")).over(W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    number = lambda k, size: F.substring(F.get("tokens", F.col("idx") + k), size, 20).try_cast("int")
    is_bar, inside = (F.col("token") == "BAR").alias("is_bar"), (F.col("idx") < F.col("_stop")).alias("inside")
    at = materialise(marks.select(key, "idx", is_bar, inside, bar.alias("bar"), number(0, 5).alias("pos"), number(2, 7).alias("pitch"), number(3, 5).alias("dur")), "marks")
    notes = at.where("NOT is_bar AND inside").select(key, "idx", "bar", "pos", "pitch", "dur")
    return notes, at.where("is_bar OR inside").select(key, "bar").distinct(), at.where("NOT is_bar AND pos IS NOT NULL").select(key, "idx", "bar", "pos")


def gathered(key: str, parts: list[DataFrame]) -> DataFrame:
    """`key` and the columns of all parts, each of which has at most one row a key: one aggregate over their union.

    A join of as many tables would sort each of them within one task, and every sort holds memory of its own.
    """
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.groupBy(key).agg(*[F.max(c).alias(c) for c in out.columns if c != key])


def sequence_metrics(sequences: DataFrame, key: str = "file_id", parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per token array: counts, empty and sparse bars, order, overlaps, pitch, rhythm and repetition of what strict_parts reads.

    Arrays without bars or notes have zeros and null ratios. `parts` is what strict_parts read, if it is at hand.
    """
    notes, bars, positions = parts or strict_parts(sequences, key)
    ev = notes.where("pos IS NOT NULL AND pitch IS NOT NULL AND dur IS NOT NULL").withColumn("unit", F.greatest(F.lit(0), "bar") * N.POSITIONS + F.col("pos")).withColumn("event_idx", F.col("idx"))
    per = bars.join(notes.groupBy(key, "bar").agg(F.count("*").alias("k")), [key, "bar"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    counts = per.groupBy(key).agg(F.count("*").alias("bar_count"), F.sum("k").alias("event_count"), F.count_if(F.col("k") == 0).alias("empty_bars"), F.count_if(F.col("k") <= 1).alias("sparse_bars"))
    empty = longest_run(per, [key], "bar", F.when(F.col("k") == 0, 1), "empty_run")
    span = ev.groupBy(key).agg((F.max("pitch") - F.min("pitch")).alias("pitch_span"))
    found = gathered(key, [counts, empty, span, time_order_violations(positions, key), same_pitch_overlaps(ev, key), pitch_collapse(ev, key), rhythm_diversity(ev, key), repetition(ev, key)])
    rows = sequences.select(key).join(found, key, "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("bar_count", "event_count", "empty_bars", "sparse_bars", "empty_run", "pitch_span", "violations", "overlaps", "pitch_events", "pitch_unique", "rhythm_events", "onset_unique")}
    rows = rows.withColumns(zeros).withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    share = lambda c, of: F.coalesce(F.try_divide(F.col(c), F.col(of)), F.lit(0.0))
    return rows.withColumns({
        "empty_bar_rate": share("empty_bars", "bar_count"), "sparse_bar_rate": share("sparse_bars", "bar_count"), "multi_empty_run": F.col("empty_run") >= 2,
        "time_order_valid": F.col("violations") == 0, "overlap_rate": share("overlaps", "event_count"),
    })


def boundary_violations(prefix: DataFrame, middle: DataFrame, suffix: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `into_middle`, `out_of_middle`: whether time runs back where a filled hole meets what is around it.

    Each side is a table of `key`, `idx`, `token`. The last position of the bar that is open at a fragment's end is compared
    with the first position of the next fragment before any bar of its own; where one is missing there is no violation.
    """

    def edges(rows: DataFrame, name: str) -> DataFrame:
        pos = F.when(F.col("token").startswith("POS_"), F.substring("token", 5, 9).try_cast("int"))
        bar = F.col("token") == "BAR"
        r = rows.groupBy(key).agg(
            F.max(F.when(bar, F.col("idx"))).alias("last_bar"), F.min(F.when(bar, F.col("idx"))).alias("first_bar"),
            F.max(F.when(pos.isNotNull(), F.struct("idx", pos.alias("pos")))).alias("l"), F.min(F.when(pos.isNotNull(), F.struct("idx", pos.alias("pos")))).alias("f"),
        )
        last = F.when(F.col("last_bar").isNull() | (F.col("l.idx") > F.col("last_bar")), F.col("l.pos"))
        first = F.when(F.col("first_bar").isNull() | (F.col("f.idx") < F.col("first_bar")), F.col("f.pos"))
        return r.select(key, last.alias(f"{name}_last"), first.alias(f"{name}_first"))

    all_ = edges(prefix, "p").join(edges(middle, "m"), key, "full").join(edges(suffix, "s"), key, "full")
    back = lambda a, b: F.coalesce(F.col(b) < F.col(a), F.lit(False))
    return all_.select(key, back("p_last", "m_first").alias("into_middle"), back("m_last", "s_first").alias("out_of_middle"))


def blocked_onsets(events: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `event_idx`, `pitch`, `free_at`: notes a guard against overlaps would hold back, and the unit from which their pitch is free."""
    w = W.partitionBy(key, "pitch").orderBy("event_idx").rowsBetween(W.unboundedPreceding, -1)
    free = F.max(F.col("unit") + F.greatest(F.lit(1), "dur")).over(w)
    return events.select(key, "event_idx", "pitch", "unit", free.alias("free_at")).where("unit < free_at").drop("unit")
