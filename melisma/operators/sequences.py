"""Token arrays: parsing, cutting, padding, views of bars, n-grams; sorted statistics and running offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.functions import numeric as N
from melisma.functions import text as X

CONTROL = ("TEMPO_", "KEY_")


def starts_any(token: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | token.startswith(p)
    return out


def parsed_events(sequences: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `idx`, `bar`, `pos`, `pitch`, `dur`, `vel`: the whole notes of token arrays, tolerantly.

    A note is a POS followed by INST, PITCH, DUR and VEL with numbers, before a final EOS and after the first BAR; anything
    else is skipped. Positions are clipped to the bar, durations are at least 1. Arrays that don't begin with BOS, are empty
    or null give no rows.
    """
    n = F.size("tokens")
    rows = sequences.where(F.try_element_at("tokens", F.lit(1)) == "BOS").select(key, F.when(F.try_element_at("tokens", F.lit(-1)) == "EOS", n - 1).otherwise(n).alias("end"), "tokens")
    tok = F.col("tokens")
    bars = F.transform(tok, lambda t: F.when(t == "BAR", 1).otherwise(0))
    at = F.filter(F.sequence(F.lit(1), F.col("end") - 5), lambda i: F.get(tok, i).startswith("POS_"))
    rows = rows.where("end > 5").select(key, "tokens", bars.alias("bars"), F.explode(at).alias("idx"))
    part = {c: X.prefixed_int(F.get(tok, F.col("idx") + k), p) for c, k, p in (("pos", 0, "POS_"), ("pitch", 2, "PITCH_"), ("dur", 3, "DUR_"), ("vel", 4, "VEL_"))}
    bar = F.aggregate(F.slice("bars", F.lit(1), F.col("idx")), F.lit(0), lambda a, x: a + x) - 1
    ok = F.get(tok, F.col("idx") + 1).startswith("INST_") & F.get(tok, F.col("idx") + 4).startswith("VEL_")
    rows = rows.where(ok).select(key, "idx", bar.alias("bar"), *[c.alias(k) for k, c in part.items()]).where("bar >= 0 AND pos IS NOT NULL AND pitch IS NOT NULL AND dur IS NOT NULL")
    return rows.select(key, "idx", "bar", N.clip(F.col("pos"), 0, N.POSITIONS - 1).alias("pos"), "pitch", F.greatest(F.lit(1), "dur").alias("dur"), "vel")


def trimmed(tokens: Column) -> Column:
    """Without blanks around and between tokens and without one final EOS."""
    t = F.filter(F.transform(tokens, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.try_element_at(t, F.lit(-1)) == "EOS", F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t)


def first_unit(tokens: Column) -> Column:
    """The first BAR or whole note after control tokens, joined by blanks; null if there is none."""
    t = F.filter(tokens, lambda x: ~x.isin("BOS", "EOS", "FIM_HOLE", "FIM_MID") & ~starts_any(x, *CONTROL))
    names = ("POS_", "INST_", "PITCH_", "DUR_", "VEL_")
    whole = F.lit(True)
    for i, p in enumerate(names):
        whole = whole & F.coalesce(F.get(t, F.lit(i)).startswith(p), F.lit(False))
    return F.when(F.get(t, F.lit(0)) == "BAR", "BAR").when(whole, F.array_join(F.slice(t, 1, 5), " "))


def split_prompt(tokens: Column) -> Column:
    """(prefix, suffix) of an infilling prompt: before FIM_HOLE, and between it and FIM_MID; null unless both stand in that order."""
    t = F.filter(F.transform(tokens, lambda x: F.trim(x)), lambda x: x != "")
    hole, mid = F.array_position(t, "FIM_HOLE").cast("int"), F.array_position(t, "FIM_MID").cast("int")
    ok = (hole > 0) & (mid > hole)
    return F.when(ok, F.struct(trimmed(F.slice(t, F.lit(1), hole - 1)).alias("prefix"), trimmed(F.slice(t, hole + 1, mid - hole - 1)).alias("suffix")))


def structure_prefix(tokens: Column) -> Column:
    """BOS, BAR, tempo and key tokens of a prompt up to FIM_HOLE or EOS; notes are left out."""
    t = F.filter(F.transform(tokens, lambda x: F.trim(x)), lambda x: x != "")
    ends = [F.nullif(F.array_position(t, x), F.lit(0)) for x in ("FIM_HOLE", "EOS")]
    stop = F.coalesce(F.least(*ends), F.size(t) + 1).cast("int")
    return F.filter(F.slice(t, F.lit(1), stop - 1), lambda x: x.isin("BOS", "BAR") | starts_any(x, *CONTROL))


def padded(ids: Column, length: int, filler: int) -> Column:
    """An id array filled up to `length`; a longer one is an error."""
    over = F.raise_error(F.format_string("sequence of %d tokens exceeds %d", F.size(ids), F.lit(length)))
    return F.when(F.size(ids) > length, over.cast("array<int>")).otherwise(F.concat(ids, F.array_repeat(F.lit(filler), F.lit(length) - F.size(ids))))


def bar_table(sequences: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `bar`, `start_token`, `end_token` (exclusive), `tempo`, `key_token` (in force), `body` (bar without its own tempo and key): bars of token arrays.

    Arrays that don't begin with BOS, or hold something else than BAR after the head, have no bars.
    """
    n = F.size("tokens")
    tok = F.col("tokens")
    s = sequences.where(F.try_element_at(tok, F.lit(1)) == "BOS").select(key, "tokens", F.when(F.try_element_at(tok, F.lit(-1)) == "EOS", n - 1).otherwise(n).alias("end"))
    head = F.when(F.get(tok, F.lit(1)).startswith("TEMPO_"), 2).otherwise(1)
    s = s.withColumn("h1", head).withColumn("head", F.when(F.get(tok, F.col("h1")).startswith("KEY_"), F.col("h1") + 1).otherwise(F.col("h1")))
    s = s.where((F.col("head") >= F.col("end")) | (F.get(tok, F.col("head")) == "BAR"))
    starts = F.filter(F.sequence(F.lit(0), F.col("end") - 1), lambda i: F.get(tok, i) == "BAR")
    rows = s.where("end > 0").select(key, "tokens", "end", "h1", "head", F.posexplode(starts).alias("bar", "start_token"), starts.alias("starts"))
    rows = rows.withColumn("end_token", F.coalesce(F.get("starts", F.col("bar") + 1), F.col("end")))
    one, two = F.get(tok, F.col("start_token") + 1), F.get(tok, F.col("start_token") + 2)
    inside = lambda k: F.col("start_token") + k < F.col("end_token")
    tempo = F.when(inside(1) & one.startswith("TEMPO_"), one)
    own_key = F.when(inside(1) & one.startswith("KEY_"), one).when(tempo.isNotNull() & inside(2) & two.startswith("KEY_"), two)
    head_tempo = F.when(F.get(tok, F.lit(1)).startswith("TEMPO_"), F.get(tok, F.lit(1)))
    head_key = F.when(F.get(tok, F.col("h1")).startswith("KEY_"), F.get(tok, F.col("h1")))
    w = W.partitionBy(key).orderBy("bar").rowsBetween(W.unboundedPreceding, W.currentRow)
    skip = 1 + tempo.isNotNull().cast("int") + own_key.isNotNull().cast("int")
    body = F.slice(tok, F.col("start_token") + 1 + skip, F.greatest(F.lit(0), F.col("end_token") - F.col("start_token") - skip))
    rows = rows.select(key, "bar", "start_token", "end_token", tempo.alias("_t"), own_key.alias("_k"), head_tempo.alias("_ht"), head_key.alias("_hk"), body.alias("body"))
    return rows.select(key, "bar", "start_token", "end_token", F.coalesce(F.last("_t", True).over(w), "_ht").alias("tempo"), F.coalesce(F.last("_k", True).over(w), "_hk").alias("key_token"), "body")


def bar_windows(bars: DataFrame, spans: DataFrame, key: str = "file_id") -> DataFrame:
    """`spans` (`key`, `first`, `last` exclusive) -> the same with `tokens`: BOS, tempo and key in force at the first bar, the bars without their own, EOS."""
    inside = spans.join(bars, key).where("bar >= first AND bar < last")
    agg = inside.groupBy(key, "first", "last").agg(F.min_by(F.struct("tempo", "key_token"), "bar").alias("h"), F.array_sort(F.collect_list(F.struct("bar", "body"))).alias("b"))
    body = F.flatten(F.transform("b", lambda x: F.concat(F.array(F.lit("BAR")), x["body"])))
    head = F.filter(F.array(F.lit("BOS"), F.col("h.tempo"), F.col("h.key_token")), lambda x: x.isNotNull())
    return agg.select(key, "first", "last", F.concat(head, body, F.array(F.lit("EOS"))).alias("tokens"))


def repeat_ratio(items: Column, n: int) -> Column:
    """Share of n-windows of an array that repeat an earlier one; 0 for shorter arrays."""
    size = F.size(items)
    grams = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice(items, i, F.lit(n)))
    return F.when(size < n, 0.0).otherwise(1.0 - F.size(F.array_distinct(grams)) / F.size(grams))


def histogram_l1(left: DataFrame, right: DataFrame, by: list[str], bins: list[str]) -> DataFrame:
    """`by`, `l1`: distance of two histograms (`by`, `bins`, `n`), each scaled to sum 1; an empty side counts as zeros, both empty have no row."""
    share = lambda h, name: h.withColumn(name, F.col("n") / F.sum("n").over(W.partitionBy(*by))).select(*by, *bins, name)
    both = share(left, "p").join(share(right, "q"), [*by, *bins], "full")
    return both.groupBy(*by).agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("l1"))


def length_summary(lengths: DataFrame, by: list[str], value: str) -> DataFrame:
    """`by`, `count`, `mean`, `p50`, `p90`, `p99`: truncating ranks, int(q (n - 1)) of the sorted values.

    Values are counted first, so that only different values are sorted, however many rows a group has.
    """
    counts = lengths.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    run = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumn("_upto", F.sum("k").over(run)).withColumn("_n", F.sum("k").over(W.partitionBy(*by)))
    pick = lambda q: F.min(F.when(F.col("_upto") > F.floor(F.lit(q) * (F.col("_n") - 1)), F.col(value)))
    return ranked.groupBy(*by).agg(F.sum("k").alias("count"), (F.sum(F.col(value) * F.col("k")) / F.sum("k")).alias("mean"), *[pick(q).alias(name) for q, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))])


def running_offsets(rows: DataFrame, by: list[str], order: str, value: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before in `order` (an integer), within `by`.

    Two levels: sums of ranges of `width` numbers are laid end to end, then each range is summed within itself, so that
    one large group is spread over many tasks.
    """
    cut = rows.withColumn("_range", F.floor(F.col(order) / width))
    sums = cut.groupBy(*by, "_range").agg(F.sum(value).alias("_n"))
    before = sums.select(*by, "_range", (F.sum("_n").over(W.partitionBy(*by).orderBy("_range")) - F.col("_n")).alias("_before"))
    w = W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inner = cut.withColumn("_inner", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inner.join(before, [*by, "_range"]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_range", "_before", "_inner")


def index_checks(index: DataFrame, key: list[str]) -> DataFrame:
    """`key`, `failure`: every way in which a packed index contradicts itself; rows without failure are left out. Null entries contradict."""
    n = F.size("lengths")
    pairs = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: ~F.coalesce(F.get("offsets", i) == F.get("offsets", i - 1) + F.get("lengths", i - 1), F.lit(False)))
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    tests = [
        (~F.coalesce(F.col("dtype"), F.lit("")).isin("uint16", "uint32"), F.lit("dtype")), (F.size("offsets") != n, F.lit("sizes")), (~F.col("num_sequences").eqNullSafe(n.cast("long")), F.lit("num_sequences")),
        ((n > 0) & ~F.coalesce(F.get("offsets", F.lit(0)) == 0, F.lit(False)), F.lit("first_offset")), ((n > 1) & (F.size(pairs) > 0), F.concat(F.lit("gap@"), F.get(pairs, F.lit(0)).cast("string"))),
        (~F.col("num_tokens").eqNullSafe(total), F.lit("num_tokens")),
    ]
    found = F.filter(F.array(*[F.when(test, name) for test, name in tests]), lambda x: x.isNotNull())
    return index.select(*key, F.explode(found).alias("failure"))
