"""Training and evaluation views: cut points, holes, windows, fill-in-the-middle examples, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.functions import numeric as N
from melisma.operators.corpus import hashed_order
from melisma.operators.phrases import picked
from melisma.operators.sequences import padded, starts_any

#: Holes are at most this long, and as good as the best up to this many tokens more.
WIDEST, NEAR = 96, 4
IGNORE = -100


def uniform(seed: int, *cols: str) -> Column:
    """A number in [0, 1) drawn by digest from the seed and the columns; the same in every engine with MD5."""
    return F.conv(F.substring(hashed_order(seed, *cols), 1, 8), 16, 10).cast("double") / float(2**32)


def units(sequences: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `unit` (from 0), `start`, `end`, `kind`, `group`: BARs and whole notes of token arrays; any other token begins a new group."""
    tok = F.col("tokens")
    names = ("INST_", "PITCH_", "DUR_", "VEL_")

    def whole(i: Column) -> Column:
        ok = F.get(tok, i).startswith("POS_")
        for k, p in enumerate(names, 1):
            ok = ok & F.coalesce(F.get(tok, i + k).startswith(p), F.lit(False))
        return ok

    n = F.size(tok)
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(tok, i) == "BAR") | whole(i))
    rows = sequences.where(n > 0).select(key, "tokens", F.posexplode(at).alias("unit", "start"))
    rows = rows.select(key, "unit", "start", F.when(F.get(tok, F.col("start")) == "BAR", 1).otherwise(5).alias("size"), F.when(F.get(tok, F.col("start")) == "BAR", "bar").otherwise("event").alias("kind"))
    w = W.partitionBy(key).orderBy("unit")
    end = F.col("start") + F.col("size")
    gap = F.when(F.lag(end).over(w) == F.col("start"), 0).otherwise(1)
    rows = rows.withColumn("end", end).withColumn("_gap", gap)
    return rows.withColumn("group", F.sum("_gap").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).select(key, "unit", "start", "end", "kind", "group")


def hole_candidates(parts: DataFrame, lengths: DataFrame, shortest: Column, longest: Column, key: str = "file_id") -> DataFrame:
    """`key`, `start`, `end`: runs of neighbouring units of one group, of `shortest` to `longest` tokens, that touch neither end of the sequence.

    `lengths` gives `key` and `length`; the bounds are expressions over it. The units of a group stand in one array, in which
    each start looks ahead: a unit is a token at least, so it meets no more ends than its longest span. Candidates stay in
    the task that holds their sequence.
    """
    b = lengths.select(key, "length", shortest.alias("lo"), longest.alias("hi"))
    runs = parts.groupBy(key, "group").agg(F.array_sort(F.collect_list(F.struct("unit", "start", "end"))).alias("_u")).join(b, key)
    starts = runs.select(key, "length", "lo", "hi", F.transform("_u", lambda u: u["end"]).alias("_ends"), F.posexplode("_u").alias("_at", "_u")).where("_u.start > 0 AND hi > 0")
    ends = starts.select(key, "length", "lo", "hi", F.col("_u.start").alias("start"), F.explode(F.slice("_ends", F.col("_at") + 1, F.col("hi"))).alias("end"))
    return ends.where("end < length AND end - start BETWEEN lo AND hi").select(key, "start", "end")


def near_best(candidates: DataFrame, gap: Column, slack: float, key: str = "file_id") -> DataFrame:
    """Adds `gap` and keeps those at most `slack` above the smallest of their sequence. The candidates are read past a table of the smallest, never sorted."""
    rows = candidates.withColumn("gap", gap)
    best = rows.groupBy(key).agg(F.min("gap").alias("_best"))
    return rows.join(best.hint("shuffle_hash"), key).where(F.col("gap") <= F.col("_best") + slack).drop("_best")


def fim_examples(sequences: DataFrame, holes: DataFrame, key: str = "file_id", eos: bool = False) -> DataFrame:
    """`key`, `tokens`, `loss_from`: prefix FIM_HOLE suffix FIM_MID middle [EOS]; labels count from `loss_from` on, after FIM_MID."""
    t = F.col("tokens")
    rows = sequences.join(holes, key)
    prefix, middle, suffix = F.slice(t, F.lit(1), F.col("start")), F.slice(t, F.col("start") + 1, F.col("end") - F.col("start")), F.slice(t, F.col("end") + 1, F.size(t) - F.col("end"))
    one = lambda x: F.array(F.lit(x))
    tail = [one("EOS")] if eos else []
    return rows.select(key, F.concat(prefix, one("FIM_HOLE"), suffix, one("FIM_MID"), middle, *tail).alias("tokens"), (F.size(t) - (F.col("end") - F.col("start")) + 2).alias("loss_from"))


def labels(ids: Column, loss_from: Column) -> Column:
    """Ids with IGNORE before `loss_from`."""
    return F.transform(ids, lambda x, i: F.when(i < loss_from, IGNORE).otherwise(x))


def cut_positions(sequences: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `pos`: places where a window may begin or end: 0 and after every control token, BAR and whole note. Arrays with broken notes have none."""
    tok = F.col("tokens")
    plain = lambda t: t.isin("BOS", "EOS", "FIM_HOLE", "FIM_MID", "BAR") | starts_any(t, "TEMPO_", "KEY_")
    code = F.array_join(F.transform(tok, lambda t: F.when(plain(t), "x").when(t.startswith("POS_"), "P").when(t.startswith("INST_"), "I").when(t.startswith("PITCH_"), "C").when(t.startswith("DUR_"), "D").when(t.startswith("VEL_"), "V").otherwise("?")), "")
    rows = sequences.select(key, code.alias("_code"))
    pairs = ["xx", "xP", "Vx", "VP", "PI", "IC", "CD", "DV", "^x", "^P", "x$", "V$"]
    marked = F.concat(F.lit("^"), "_code", F.lit("$"))
    ok = F.forall(F.sequence(F.lit(1), F.length("_code") + 1), lambda i: F.substring(marked, i, F.lit(2)).isin(*pairs))
    after = F.filter(F.sequence(F.lit(1), F.length("_code")), lambda i: F.substring("_code", i, F.lit(1)).isin("x", "V"))
    # not as a filter: pushed below the projection, it would work the code out anew for every place
    return rows.select(key, F.explode(F.when((F.length("_code") > 0) & ok, F.concat(F.array(F.lit(0)), after))).alias("pos"))


def exact_windows(cuts: DataFrame, length: int, key: str = "file_id") -> DataFrame:
    """`key`, `start`: cut positions with another one exactly `length` further on."""
    return cuts.select(key, F.col("pos").alias("start"), (F.col("pos") + length).alias("pos")).join(cuts, [key, "pos"]).select(key, "start")


def bar_aligned(bars: DataFrame, least: int, most: int, key: str = "file_id") -> DataFrame:
    """`key`, `first`, `last` (exclusive), `length`: from the first bar from which some window of `least` to `most` tokens (BOS and EOS apart) begins, the longest such window.

    Sums of the bars' lengths up to each bar replace the measuring of every window.
    """
    head = F.col("tempo").isNotNull().cast("int") + F.col("key_token").isNotNull().cast("int")
    seq = bars.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bar", (1 + F.size("body")).alias("own"), head.alias("head")))).alias("b"))
    upto = F.aggregate("b", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["own"])))
    seq = seq.select(key, "b", upto.alias("upto"))
    fits = F.transform("b", lambda x, i: F.struct(i.alias("first"), F.size(F.filter("upto", lambda u: u - F.get("upto", i) + x["head"] <= most)).alias("last1"), x["head"].alias("head")))
    span = lambda f: F.get("upto", f["last1"] - 1) - F.get("upto", f["first"]) + f["head"]
    good = F.filter(fits, lambda f: (f["last1"] - 1 > f["first"]) & (span(f) >= least))
    best = seq.select(key, "upto", F.get(good, F.lit(0)).alias("f")).where("f IS NOT NULL")
    return best.select(key, F.col("f.first").alias("first"), (F.col("f.last1") - 1).alias("last"), span(F.col("f")).alias("length"))


def split_positions(sequences: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `pos`, `length`: where a continuation's prompt may end, counted in tokens after BOS: after head tempo and key, before every BAR and note."""
    tok = F.col("tokens")
    n = F.size(tok) - 2
    here = lambda i: F.get(tok, i + 1)
    head = F.when(here(F.lit(0)).startswith("TEMPO_"), 1).otherwise(0)
    rows = sequences.where(F.size(tok) > 2).select(key, "tokens", n.alias("length"), head.alias("h1"))
    second = F.when(F.get(tok, F.col("h1") + 1).startswith("KEY_"), F.col("h1") + 1).otherwise(F.col("h1"))
    at = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (here(i) == "BAR") | here(i).startswith("POS_"))
    every = F.array_distinct(F.concat(F.array(F.col("h1"), second), at))
    return rows.select(key, "length", F.explode(every).alias("pos")).where("pos > 0 AND pos < length").select(key, "pos", "length")


def continuation_cut(positions: DataFrame, least: int, low: float, high: float, key: str = "file_id") -> DataFrame:
    """`key`, `pos`: the split nearest the middle of the allowed share, with at least `least` tokens before and 8 after; where none fits, the nearest with `least` before."""
    p = positions.withColumn("a", F.greatest(F.lit(least), N.whole(F.col("length") * low))).withColumn("b", F.least(F.col("length") - 8, N.whole(F.col("length") * high)))
    mid = (low + high) / 2.0
    fits = F.when(F.col("a") > F.col("b"), F.col("pos") >= least).otherwise(F.col("pos").between(F.col("a"), F.col("b")))
    rank = F.struct((~fits).cast("int").alias("no"), F.abs(F.col("pos") / F.col("length") - mid).alias("d"), F.abs(F.col("pos") - N.whole(F.col("length") * mid)).alias("e"), "pos")
    return p.where(F.col("pos") >= least).groupBy(key).agg(F.min(rank).alias("r")).select(key, F.col("r.pos").alias("pos"))


def phrase_holes(bars: DataFrame, phrases: DataFrame, kind: str, shortest: int, longest: int, key: str = "file_id") -> DataFrame:
    """`key`, `start`, `end` (tokens), `score` (less is better): whole bars that may be masked, neither the first nor up to the last.

    Scored by distance from the middle length and place, and by what the kind asks: 'single_phrase' to stay within one,
    'cross_boundary' to hold one boundary, else to hold some or be a phrase.
    """
    total = bars.groupBy(key).agg(F.count("*").alias("bars"))
    b = bars.select(key, "bar", "start_token", "end_token")
    starts = b.join(total, key).where("bars >= 3 AND bar >= 1").select(key, "bars", F.col("bar").alias("first"), "start_token")
    ahead = starts.select(key, "bars", "first", "start_token", F.explode(F.sequence(F.col("first"), F.least(F.col("bars") - 2, F.col("first") + longest))).alias("bar"))
    ahead = ahead.where("bar >= first AND bar <= bars - 2").join(b.select(key, "bar", "end_token"), [key, "bar"]).withColumn("last", F.col("bar") + 1).withColumn("size", F.col("end_token") - F.col("start_token"))
    ahead = ahead.where(F.col("size").between(shortest, longest))
    ph = phrases.groupBy(key).agg(F.collect_list(F.struct("phrase", "first", "last")).alias("_p"))
    rows = ahead.join(ph, key)
    f, l = F.col("first"), F.col("last")
    inside = F.size(F.filter("_p", lambda p: (p["phrase"] > 0) & (p["first"] > f) & (p["first"] < l)))
    exact = F.exists("_p", lambda p: (p["first"] == f) & (p["last"] == l))
    one = F.exists("_p", lambda p: (p["first"] <= f) & (p["last"] >= l))
    base = F.abs(F.col("size") - (shortest + longest) / 2.0) + 2.0 * F.abs((f + l) / 2.0 - F.col("bars") / 2.0)
    bonus = {
        "single_phrase": F.when(one, 0.0).otherwise(40.0) + 12.0 * inside + F.when(exact, -8.0).otherwise(0.0),
        "cross_boundary": F.when(inside <= 0, 40.0).otherwise(10.0 * F.abs(inside - 1)) + F.when(exact, 10.0).otherwise(0.0),
    }.get(kind, F.when((inside >= 1) | exact, 0.0).otherwise(24.0) + F.when(exact, -6.0).otherwise(0.0))
    return rows.select(key, F.col("start_token").alias("start"), F.col("end_token").alias("end"), (base + bonus).alias("score"))


def policy(draw: Column, shares: dict[str, float]) -> Column:
    """The kind a uniform draw falls on, shares laid end to end in their order."""
    whole, upto, out = sum(shares.values()), 0.0, None
    for kind, share in shares.items():
        upto += share / whole
        out = F.when(draw < upto, kind) if out is None else out.when(draw < upto, kind)
    return out.otherwise(list(shares)[-1])


def with_fallback(choices: DataFrame, wanted: Column, order: tuple[str, ...]) -> Column:
    """Of one struct column per kind, the wanted kind's, else the first that isn't null in `order`."""
    first = None
    for k in order:
        first = F.when(wanted == k, F.col(k)) if first is None else first.when(wanted == k, F.col(k))
    return F.coalesce(first, *[F.col(k) for k in order])


def batches(sequences: DataFrame, vocab: DataFrame, length: int, fim_share: float, seed: int, size: int, key: str = "file_id") -> DataFrame:
    """`key`, `batch`, `is_fim`, `input_ids`, `labels`: one example a sequence: a window of whole units, or, by draw, one with a hole moved to its end.

    Windows are the exact ones nearest a drawn start; a sequence without one, or without a hole, has no row. Rows are dealt
    to batches of about `size` by digest.
    """
    from melisma.operators.tokens import encoded

    fim = uniform(seed, key) < fim_share
    base = sequences.select(key, "tokens", fim.alias("is_fim"))
    cuts = cut_positions(base.select(key, "tokens"), key)
    wide = base.select(key, F.when(F.col("is_fim"), length - 2).otherwise(length).alias("len"))
    starts = cuts.join(wide, key).select(key, F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("pos"), "len").join(cuts, [key, "pos"]).select(key, "start", "len")
    chosen = picked(starts, [key], ["start"], seed)
    win = base.join(chosen, key).select(key, "is_fim", F.slice("tokens", F.col("start") + 1, F.col("len")).alias("tokens"))
    holed = win.where("is_fim").select(key, "tokens")
    sizes = holed.select(key, F.size("tokens").alias("length"))
    found = near_best(hole_candidates(units(holed, key), sizes, F.lit(8), F.least(F.lit(WIDEST), F.col("length") - 2), key), F.abs(F.col("end") - F.col("start") - 24), NEAR, key)
    examples = fim_examples(holed, picked(found.select(key, "start", "end"), [key], ["start", "end"], seed + 1), key)
    plain = win.where("NOT is_fim").select(key, "tokens", F.lit(0).alias("loss_from"))
    both = plain.withColumn("is_fim", F.lit(False)).unionByName(examples.withColumn("is_fim", F.lit(True)))
    ids = encoded(both.select(key, "tokens"), vocab, key).where("oov = 0").join(both.select(key, "is_fim", "loss_from"), key)
    out = ids.withColumn("labels", padded(labels(F.col("ids"), F.col("loss_from")), length, IGNORE)).withColumn("input_ids", padded(F.col("ids"), length, 1))
    number = out.select(key).agg(F.greatest(F.lit(1), F.floor(F.count("*") / size)).alias("_n"))  # one row
    return out.join(F.broadcast(number)).withColumn("batch", F.pmod(F.xxhash64(key, F.lit(seed)), F.col("_n"))).select(key, "batch", "is_fim", "input_ids", "labels")
