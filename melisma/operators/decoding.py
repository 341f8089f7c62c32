"""Decoding policies over given logits, decoding records, and their aggregation per checkpoint."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.functions.numeric import SAFE_CLOSE
from melisma.operators import grammar as G
from melisma.operators.sequences import first_unit, histogram_l1
from melisma.operators.structure import boundary_violations, gathered, sequence_metrics, strict_parts
from melisma.tables import materialise


def masked_argmax(logits: Column, legal: Column) -> Column:
    """Struct of next_id (best legal index), raw_id (best of all), raw_is_legal and legal_mass (softmax share of the legal ones). Ties go to the first index; nothing legal gives null and 0."""
    pairs = F.transform(logits, lambda x, i: F.struct(x.alias("x"), (-i).alias("n")))
    best = F.array_max(pairs)
    mine = F.array_max(F.filter(pairs, lambda p: F.array_contains(legal, -p["n"])))
    mass = F.aggregate(F.filter(pairs, lambda p: F.array_contains(legal, -p["n"])), F.lit(0.0), lambda a, p: a + F.exp(p["x"] - best["x"]))
    whole = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.exp(p["x"] - best["x"]))
    raw = -best["n"]
    return F.struct((-mine["n"]).alias("next_id"), raw.alias("raw_id"), F.coalesce(F.array_contains(legal, raw), F.lit(False)).alias("raw_is_legal"), F.coalesce(mass / whole, F.lit(0.0)).alias("legal_mass"))


def top_p_sample(rows: DataFrame, logits: str, temperature: float, top_p: float, draw: Column) -> DataFrame:
    """Adds `next_id`, drawn from the most probable entries that together reach top_p (the first beyond it included); temperature 0 takes the best.

    Each step is a column of its own, so that none is worked out again for every entry. Null and empty logits give null.
    """
    if temperature < 0 or not 0 < top_p <= 1:
        raise ValueError("temperature must be 0 or more, top_p within (0, 1]")
    r = rows.withColumn("_p", F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))))
    if temperature == 0:
        return r.withColumn("next_id", F.get("_p", F.lit(0))["i"]).drop("_p")
    r = r.withColumn("_t", F.get("_p", F.lit(0))["x"]).withColumn("_w", F.transform("_p", lambda p: F.exp((F.col("_t") - p["x"]) / temperature)))
    grow = lambda a, w: F.struct((a["n"] + w).alias("n"), F.concat(a["u"], F.array(a["n"] + w)).alias("u"))
    r = r.withColumn("_u", F.aggregate("_w", F.struct(F.lit(0.0).alias("n"), F.array().cast("array<double>").alias("u")), grow)["u"])
    r = r.withColumn("_all", F.try_element_at("_u", F.lit(-1)) * top_p).withColumn("_k", F.least(F.size("_p"), F.size(F.filter("_u", lambda u: u <= F.col("_all"))) + 1))
    r = r.withColumn("_d", F.get("_u", F.col("_k") - 1) * draw)
    at = F.least(F.col("_k") - 1, F.size(F.filter("_u", lambda u: u <= F.col("_d"))))
    return r.withColumn("next_id", F.get("_p", at)["i"]).drop("_p", "_t", "_w", "_u", "_all", "_k", "_d")


# -- records --------------------------------------------------------------------------------------------------------


def _verdict(rows: DataFrame, tokens: str, prefix: str) -> DataFrame:
    """Adds `prefix`valid and `prefix`reason: the grammar's judgement of a token array."""
    r = rows.withColumn("_code", G.letters(F.col(tokens))).withColumn("_fault", G.first_fault(F.col("_code")))
    r = r.withColumn(f"{prefix}reason", G.fault_reason(F.col(tokens), F.col("_code"), F.col("_fault")))
    return r.withColumn(f"{prefix}valid", F.col(f"{prefix}reason") == "ok").drop("_code", "_fault")


def continuation_traces(rows: DataFrame) -> DataFrame:
    """Rows of `prompt`, `target`, `generated`, `reached_eos` with `reconstructed`, validity, reasons and first-token match.

    failure_reason: ok, syntax_invalid, missing_eos_only (EOS alone would mend it), missing_eos_plus_syntax.
    """
    end = F.array(F.lit("EOS"))
    r = rows.withColumn("_full", F.concat("prompt", "generated", end))
    r = _verdict(r, "_full", "append_eos_")
    eos, ok = F.col("reached_eos"), F.col("append_eos_valid")
    bare = F.filter("target", lambda t: t != "EOS")
    return r.withColumns({
        "reconstructed": F.when(eos, F.col("_full")).otherwise(F.concat("prompt", "generated")), "is_valid": eos & ok,
        "failure_reason": F.when(eos & ok, "ok").when(eos, "syntax_invalid").when(ok, "missing_eos_only").otherwise("missing_eos_plus_syntax"),
        "syntax_reason": F.when(~eos & ok, "missing_eos").otherwise(F.col("append_eos_reason")),
        "first_token_match": F.when(F.size(bare) > 0, F.coalesce(F.get("generated", F.lit(0)) == F.get(bare, F.lit(0)), F.lit(False))),
    }).drop("_full")


def infilling_traces(rows: DataFrame) -> DataFrame:
    """Rows of `prefix`, `middle`, `suffix` with `reconstructed`, `is_valid`, `syntax_reason` and `failure_reason` (ok or syntax_invalid)."""
    r = rows.withColumn("reconstructed", F.concat("prefix", "middle", "suffix", F.array(F.lit("EOS"))))
    r = _verdict(r, "reconstructed", "_")
    return r.withColumn("is_valid", F.col("_valid")).withColumn("syntax_reason", F.col("_reason")).withColumn("failure_reason", F.when(F.col("_valid"), "ok").otherwise("syntax_invalid")).drop("_valid", "_reason")


_GENERATED = ("bar_count", "event_count", "pitch_span", "empty_bar_rate", "sparse_bar_rate", "multi_empty_run", "pitch_events", "pitch_unique", "coverage", "most_common_ratio", "longest_run_ratio", "pitch_diversity", "onset_entropy", "bar_start_ratio", "strong_beat_ratio", "duration_diversity", "rhythm_diversity", "event_repeat", "rhythm_repeat")
_TARGET = ("bar_count", "event_count", "pitch_span", "overlaps", "overlap_rate")
_WHOLE = ("time_order_valid", "violations", "overlaps", "overlap_rate")


#: Fragments of a record that are measured: column prefix and metrics.
_FRAGMENTS = (("generated_", _GENERATED), ("target_", _TARGET), ("", _WHOLE))


def _compared(rows: DataFrame, made: str, key: str, more: list[DataFrame] = []) -> DataFrame:  # noqa: B006
    """Adds metrics of the made fragment, its target and the whole, their differences, the distances of their histograms and the columns of `more` (a row per key).

    The three fragments are measured together, under keys of their own: one plan instead of three.
    """
    each = [F.struct(F.struct(F.lit(k).alias("part"), F.col(key).alias("of")).alias("_key"), F.col(c).alias("tokens")) for k, c in enumerate((made, "_bare", "reconstructed"))]
    each = rows.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    parts = strict_parts(each, "_key")
    part, of = F.col("_key")["part"], F.col("_key")["of"].alias(key)
    own = [F.max(F.when(part == k, F.col(c))).alias(f"{prefix}{c}") for k, (prefix, cols) in enumerate(_FRAGMENTS) for c in cols]
    wide = sequence_metrics(each, "_key", parts).groupBy(of).agg(*own, F.max(F.when(part == 0, F.col("time_order_valid"))).alias("internal_order_valid"))
    found = [wide]
    for bin_, name in (("pos", "onset_l1"), ("dur", "duration_l1")):
        counts = [parts[0].where((part == k) & F.col(bin_).isNotNull()).groupBy(of, bin_).agg(F.count("*").alias("n")) for k in (0, 1)]
        found.append(histogram_l1(*counts, [key], [bin_]).withColumnRenamed("l1", name))
    out = rows.join(gathered(key, [*found, *more]), key).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("onset_l1", "duration_l1")})
    return out.withColumns({
        "first_unit_match": first_unit(F.col(made)).eqNullSafe(first_unit(F.col("_bare"))), "bar_delta": F.col("generated_bar_count") - F.col("target_bar_count"),
        "event_delta": F.col("generated_event_count") - F.col("target_event_count"), "pitch_span_delta": F.col("generated_pitch_span") - F.col("target_pitch_span"),
    })


def enriched_continuations(traces: DataFrame, key: str = "file_id") -> DataFrame:
    """Continuation records with musical diagnostics: pitch and rhythm of what was generated, order and overlaps of the whole. `key` names a record."""
    r = materialise(traces.withColumn("_bare", F.filter("target", lambda t: t != "EOS")), "traces")
    out = _compared(r, "generated", key).withColumn("stop_success", F.col("reached_eos") & F.col("is_valid"))
    return out.withColumn("structural_match", F.col("append_eos_valid")).drop("_bare", "internal_order_valid")


def enriched_infillings(traces: DataFrame, key: str = "file_id") -> DataFrame:
    """Infilling records with the same diagnostics, and whether time order holds inside and at the seams of the hole."""
    r = materialise(traces.withColumn("_bare", F.filter("target", lambda t: t != "EOS")), "traces")
    side = lambda c: r.select(key, F.posexplode(c).alias("idx", "token"))
    out = _compared(r, "middle", key, [boundary_violations(side("prefix"), side("middle"), side("suffix"), key)])
    seams = ["into_middle", "out_of_middle", "internal_order_valid"]
    out = out.select(*[c for c in out.columns if c not in seams], *seams)
    return out.withColumn("boundary_order_valid", ~(F.coalesce("into_middle", F.lit(False)) | F.coalesce("out_of_middle", F.lit(False)))).drop("_bare")


def checkpoint_metrics(records: DataFrame, by: list[str]) -> DataFrame:
    """One row per checkpoint: rates over all records, means over those that have a value, and the share that has one.

    Works on enriched records of either task; columns a task lacks are left out.
    """
    have = set(records.columns)
    rate = lambda c: F.avg(c.cast("int"))
    cols = {"records": F.count("*")}
    flags = {
        "stop_success_rate": "stop_success", "structural_rate": "structural_match" if "structural_match" in have else "is_valid", "time_order_rate": "time_order_valid", "internal_order_rate": "internal_order_valid",
        "boundary_order_rate": "boundary_order_valid", "multi_empty_run_rate": "generated_multi_empty_run", "first_event_hit_rate": "first_unit_match",
    }
    cols |= {n: rate(F.col(c)) for n, c in flags.items() if c in have}
    if "append_eos_valid" in have:
        eos, ok = F.col("reached_eos"), F.col("append_eos_valid")
        cols |= {"missing_eos_rate": rate(~eos), "append_eos_recoverable_rate": rate(~eos & ok), "syntax_invalid_rate": rate(~ok)}
    else:
        cols["syntax_invalid_rate"] = rate(~F.col("is_valid"))
    means = [c for c in ("generated_empty_bar_rate", "generated_sparse_bar_rate", "bar_delta", "event_delta", "pitch_span_delta", "onset_l1", "duration_l1", "overlap_rate", *(f"generated_{c}" for c in _GENERATED[9:])) if c in have]
    cols |= {f"mean_{c.removeprefix('generated_')}": F.avg(c) for c in means}
    some = {"pitch_coverage": _GENERATED[9:12], "rhythm_coverage": _GENERATED[12:17], "repetition_coverage": _GENERATED[17:]}
    for name, parts in some.items():
        present = F.coalesce(*[F.col(f"generated_{c}") for c in parts]).isNotNull()
        cols[name] = rate(present)
    return records.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()])


def top_counts(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """`by`, `value`, `count`, `place`: the k most frequent values, ties by value."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("count"))
    return n.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("count"), value))).where(F.col("place") <= k)


# -- loops ----------------------------------------------------------------------------------------------------------

#: A model: tokens so far -> score by token.
Model = Callable[[list[str]], dict[str, float]]


def succession_table(sequences: DataFrame) -> dict[str, dict[str, float]]:
    """Log shares of the tokens that follow each token: a stand-in for a network. As many rows as the vocabulary has pairs, a bound of some ten thousand."""
    pairs = sequences.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.struct(F.get("tokens", i - 1).alias("a"), F.get("tokens", i).alias("b")))).alias("p"))
    n = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    out: dict[str, dict[str, float]] = {}
    for r in n.collect():
        out.setdefault(r["a"], {})[r["b"]] = math.log(r["n"])
    return out


def _sign(token: str) -> str:
    if token in ("BOS", "EOS", "BAR"):
        return {"BOS": "B", "EOS": "E", "BAR": "R"}[token]
    return {"TEMPO": "T", "KEY": "K", "POS": "P", "INST": "I", "PITCH": "C", "DUR": "D", "VEL": "V"}.get(token.split("_")[0], "?")


class OverlapGuard:
    """Ends of sounding notes by instrument and pitch; says which pitches may not begin yet."""

    def __init__(self, tokens: list[str]) -> None:
        self.bar, self.start, self.inst, self.pitch = -1, 0, "", 0
        self.ends: dict[tuple[str, int], int] = {}
        for t in tokens:
            self.take(t)

    def take(self, token: str) -> None:
        kind, _, value = token.partition("_")
        if token == "BAR":
            self.bar += 1
        elif kind == "POS":
            self.start = max(0, self.bar) * 32 + int(value)
        elif kind == "INST":
            self.inst = value
        elif kind == "PITCH":
            self.pitch = int(value)
        elif kind == "DUR":
            at = (self.inst, self.pitch)
            self.ends[at] = max(self.ends.get(at, 0), self.start + max(1, int(value)))

    def blocks(self, token: str) -> bool:
        return token.startswith("PITCH_") and self.start < self.ends.get((self.inst, int(token[6:])), 0)


def eos_bias(done: int, room: int, state: str) -> float:
    """As functions.numeric.eos_bias, for one step of a loop."""
    if room <= 0 or done < 0:
        return 0.0
    steps = ((done / room >= 0.60, 0.20), (done / room >= 0.78, 0.60), (done / room >= 0.90, 1.35), (room - done <= 6, 0.65), (room - done <= 3, 1.10), (state in SAFE_CLOSE and done >= max(16, min(32, room // 3)), 0.40))
    return sum(w for test, w in steps if test)


def continue_tokens(prompt: list[str], model: Model, room: int) -> dict:
    """Greedy decoding under the grammar: biased towards EOS as room runs out, stopped at a safe boundary, closed if it may end where room is used up."""
    state, made, stats = G.state_after("".join(map(_sign, prompt))), [], {"steps": 0, "dead_ends": 0, "auto_closed": False}
    if state is None:
        return {"generated": [], "reached_eos": False} | stats | {"dead_ends": 1}
    guard = OverlapGuard(prompt)
    while len(made) < room:
        n = len(made)
        may_end = G.step(state, "E") is not None
        near = room - n <= max(3, min(5, room // 10))
        if may_end and state in SAFE_CLOSE and n >= max(16, min(28, room // 3)) and near:
            return {"generated": made, "reached_eos": True} | stats
        scores = model([*prompt, *made])
        legal = {t: s + (eos_bias(n, room, state) if t == "EOS" else 0.0) for t, s in scores.items() if G.step(state, _sign(t)) and not guard.blocks(t)}
        stats["steps"] += 1
        if not legal:
            stats["dead_ends"] += 1
            return {"generated": made, "reached_eos": False} | stats
        token = min(legal, key=lambda t: (-legal[t], t))
        if token == "EOS":
            return {"generated": made, "reached_eos": True} | stats
        state = G.step(state, _sign(token))
        made.append(token)
        guard.take(token)
    closed = G.step(state, "E") is not None
    return {"generated": made, "reached_eos": closed} | stats | {"auto_closed": closed}


def fill_tokens(prefix: list[str], suffix: list[str], model: Model, room: int) -> dict:
    """Greedy decoding of a hole: only tokens after which the suffix can still be reached; ends at the first chance once half the room is used."""
    good = G.compatible_states("".join(map(_sign, suffix)))
    bridge = G.bridgeable_states(good)
    state, made, stats = G.state_after("".join(map(_sign, prefix))), [], {"steps": 0, "dead_ends": 0}
    if state is None or state not in bridge:
        return {"middle": [], "closed": False, "steps": 0, "dead_ends": 1}
    guard = OverlapGuard(prefix)
    while len(made) < room:
        if state in good and len(made) >= room // 2:
            return {"middle": made, "closed": True} | stats
        legal = {t: s for t, s in model([*prefix, *made]).items() if t != "EOS" and G.step(state, _sign(t)) in bridge and not guard.blocks(t)}
        stats["steps"] += 1
        if not legal:
            stats["dead_ends"] += 1
            break
        token = min(legal, key=lambda t: (-legal[t], t))
        state = G.step(state, _sign(token))
        made.append(token)
        guard.take(token)
    return {"middle": made, "closed": state in good} | stats


def _table_model(table: dict[str, dict[str, float]]) -> Model:
    return lambda tokens: table.get(tokens[-1], {})


def decode_continuations(prompts: DataFrame, table: dict, room: int, key: str = "file_id") -> DataFrame:
    """`key`, `generated`, `reached_eos`, `steps`, `dead_ends`, `auto_closed` for rows of `key`, `prompt`. A loop by nature: each token depends on the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _table_model(table)
        for b in batches:
            yield pd.DataFrame([{key: k, **continue_tokens(list(p), model, room)} for k, p in zip(b[key], b["prompt"])], columns=[key, "generated", "reached_eos", "steps", "dead_ends", "auto_closed"])

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, generated array<string>, reached_eos boolean, steps int, dead_ends int, auto_closed boolean")


def decode_infillings(rows: DataFrame, table: dict, room: int, key: str = "file_id") -> DataFrame:
    """`key`, `middle`, `closed`, `steps`, `dead_ends` for rows of `key`, `prefix`, `suffix`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _table_model(table)
        for b in batches:
            yield pd.DataFrame([{key: k, **fill_tokens(list(p), list(s), model, room)} for k, p, s in zip(b[key], b["prefix"], b["suffix"])], columns=[key, "middle", "closed", "steps", "dead_ends"])

    return rows.select(key, "prefix", "suffix").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, middle array<string>, closed boolean, steps int, dead_ends int")
