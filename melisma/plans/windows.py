"""Queries of windows, holes, cases and decoding records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.operators import decoding as D
from melisma.operators import sequences as S
from melisma.operators import tokens as T
from melisma.operators import windows as O
from melisma.operators.corpus import hashed_order, per_bucket
from melisma.operators.phrases import picked, window_candidates
from melisma.plans.records import bucketed
from melisma.plans.registry import query
from melisma.plans.structure import rounded, stored_phrases
from melisma.plans.tokens import _FAULT, _REASON_BODY
from melisma.plans.views import LETTER, faulty_streams, streams, twin
from melisma.tables import materialise, table

_UNITS = """l AS (SELECT file_id, idx, token, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2, lead(token, 3) OVER w AS t3, lead(token, 4) OVER w AS t4 FROM row r WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
u0 AS (SELECT file_id, idx AS start, idx + CASE WHEN token = 'BAR' THEN 1 ELSE 5 END AS "end", CASE WHEN token = 'BAR' THEN 'bar' ELSE 'event' END AS kind, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS unit FROM l
WHERE token = 'BAR' OR (starts_with(token, 'POS_') AND starts_with(t1, 'INST_') AND starts_with(t2, 'PITCH_') AND starts_with(t3, 'DUR_') AND starts_with(t4, 'VEL_'))),
u AS (SELECT *, sum(CASE WHEN p = start THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY unit) AS grp FROM (SELECT *, lag("end") OVER (PARTITION BY file_id ORDER BY unit) AS p FROM u0))"""


@query(twin(f'WITH {_UNITS} SELECT file_id, unit::int AS unit, start::int AS start, "end"::int AS "end", kind, grp::bigint AS "group" FROM u', "row"))
def x10_maskable_units(spark: SparkSession, d: str) -> DataFrame:
    return O.units(faulty_streams(spark, d))


_HOLES = """n AS (SELECT file_id, count(*) AS length FROM row GROUP BY file_id), h AS (SELECT a.file_id, a.start, b."end" FROM u a JOIN n ON n.file_id = a.file_id JOIN u b ON b.file_id = a.file_id AND b.grp = a.grp AND b.unit >= a.unit AND b.unit < a.unit + 24
WHERE a.start > 0 AND b."end" < length AND b."end" - a.start BETWEEN 8 AND least(24, length - 2))"""


def holes(spark: SparkSession, d: str) -> DataFrame:
    s = faulty_streams(spark, d)
    return O.hole_candidates(O.units(s), s.select("file_id", F.size("tokens").alias("length")), F.lit(8), F.least(F.lit(24), F.col("length") - 2))


@query(twin(f'WITH {_UNITS}, {_HOLES} SELECT file_id, start::int AS start, "end"::int AS "end" FROM h', "row"))
def j12_hole_candidates(spark: SparkSession, d: str) -> DataFrame:
    return holes(spark, d)


_NEAR = f"""{_UNITS}, {_HOLES}, g AS (SELECT *, abs("end" - start - 16) AS gap FROM h), nb AS (SELECT * FROM g QUALIFY gap <= min(gap) OVER (PARTITION BY file_id) + 4)"""


def chosen_holes(spark: SparkSession, d: str) -> DataFrame:
    near = O.near_best(holes(spark, d), F.abs(F.col("end") - F.col("start") - 16), O.NEAR)
    return picked(near.select("file_id", "start", "end"), ["file_id"], ["start", "end"], 5)


@query(twin(f"""WITH {_NEAR} SELECT file_id, arg_min(start, k)::int AS start, arg_min("end", k)::int AS "end" FROM (SELECT *, md5('5:' || file_id || ':' || start || ':' || "end") AS k FROM nb) GROUP BY file_id""", "row"))
def x10_infilling_holes(spark: SparkSession, d: str) -> DataFrame:
    return chosen_holes(spark, d)


_PICK = f"""{_NEAR}, pk AS (SELECT file_id, arg_min(start, k)::int AS s, arg_min("end", k)::int AS e FROM (SELECT *, md5('5:' || file_id || ':' || start || ':' || "end") AS k FROM nb) GROUP BY file_id)"""


@query(twin(f"WITH {_PICK} SELECT file_id, array_to_string(tokens[1:s] || ['FIM_HOLE'] || tokens[e + 1:] || ['FIM_MID'] || tokens[s + 1:e], ' ') AS tokens, (len(tokens) - (e - s) + 2)::int AS loss_from FROM pk JOIN btok USING (file_id)", "row"))
def x14_fim_examples(spark: SparkSession, d: str) -> DataFrame:
    return O.fim_examples(faulty_streams(spark, d), chosen_holes(spark, d)).withColumn("tokens", F.array_join("tokens", " "))


_CUTS = """cd AS (SELECT file_id, idx, CASE WHEN token IN ('BOS', 'EOS', 'FIM_HOLE', 'FIM_MID', 'BAR') OR starts_with(token, 'TEMPO_') OR starts_with(token, 'KEY_') THEN 'x' WHEN starts_with(token, 'POS_') THEN 'P' WHEN starts_with(token, 'INST_') THEN 'I' WHEN starts_with(token, 'PITCH_') THEN 'C' WHEN starts_with(token, 'DUR_') THEN 'D' WHEN starts_with(token, 'VEL_') THEN 'V' ELSE '?' END AS s FROM row r),
ok AS (SELECT file_id FROM cd GROUP BY file_id HAVING regexp_full_match(string_agg(s, '' ORDER BY idx), '(x|PICDV)*')), ct AS (SELECT file_id, 0 AS pos FROM ok UNION ALL SELECT file_id, idx + 1 FROM cd WHERE s IN ('x', 'V') AND file_id IN (SELECT file_id FROM ok))"""


@query(twin(f"WITH {_CUTS} SELECT file_id, pos::int AS pos FROM ct", "row"))
def x13_cut_positions(spark: SparkSession, d: str) -> DataFrame:
    return O.cut_positions(faulty_streams(spark, d))


@query(twin(f"WITH {_CUTS} SELECT a.file_id, a.pos::int AS start FROM ct a JOIN ct b ON a.file_id = b.file_id AND b.pos = a.pos + 64", "row"))
def x13_exact_windows(spark: SparkSession, d: str) -> DataFrame:
    return O.exact_windows(O.cut_positions(faulty_streams(spark, d)), 64)


_BODY = """bb AS (SELECT file_id, bar, idx, lead(idx) OVER (PARTITION BY file_id ORDER BY bar) AS nxt FROM (SELECT file_id, idx, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS bar FROM tr WHERE token = 'BAR')),
own AS (SELECT bb.file_id, bar, coalesce(nxt, len(tokens) - 1) - idx AS own FROM bb JOIN tok USING (file_id))"""
_TR = "tr AS (SELECT file_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS idx FROM tok)"
_ALIGNED = f"""{_TR}, {_BODY}, cum AS (SELECT *, sum(own) OVER (PARTITION BY file_id ORDER BY bar) AS upto FROM own),
wn AS (SELECT a.file_id, a.bar AS first, b.bar + 1 AS last, b.upto - a.upto + a.own + 1 AS length FROM cum a JOIN cum b ON a.file_id = b.file_id AND b.bar >= a.bar WHERE b.upto - a.upto + a.own + 1 BETWEEN 40 AND 200)
SELECT file_id, first::int AS first, last::int AS last, length::int AS length FROM wn QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY first, last DESC) = 1"""


@query(twin(f"WITH {_ALIGNED}", "tok"))
def x8_bar_aligned(spark: SparkSession, d: str) -> DataFrame:
    return O.bar_aligned(S.bar_table(streams(spark, d)), 40, 200)


_SPLITS = f"""{_TR}, sp AS (SELECT file_id, idx - 1 AS pos, len(tokens) - 2 AS length FROM tr JOIN tok USING (file_id) WHERE (token = 'BAR' OR starts_with(token, 'POS_')) AND idx > 1 AND idx < len(tokens) - 1 UNION SELECT file_id, 1, len(tokens) - 2 FROM tok WHERE starts_with(tokens[2], 'TEMPO_') AND len(tokens) > 3)"""


@query(twin(f"WITH {_SPLITS} SELECT file_id, pos::int AS pos, length::int AS length FROM sp", "tok"))
def x9_split_positions(spark: SparkSession, d: str) -> DataFrame:
    return O.split_positions(streams(spark, d))


_CUT = f"""{_SPLITS}, ab AS (SELECT *, greatest(16, round_even(length * 0.35::double, 0)) AS a, least(length - 8, round_even(length * 0.7::double, 0)) AS b FROM sp WHERE pos >= 16)
SELECT file_id, arg_min(pos, (NOT CASE WHEN a > b THEN pos >= 16 ELSE pos BETWEEN a AND b END, abs(pos / length::double - (0.35::double + 0.7::double) / 2), abs(pos - round_even(length * ((0.35::double + 0.7::double) / 2), 0)), pos))::int AS pos FROM ab GROUP BY file_id"""


def cuts(spark: SparkSession, d: str) -> DataFrame:
    return O.continuation_cut(O.split_positions(streams(spark, d)), 16, 0.35, 0.7)


@query(twin(f"WITH {_CUT}", "tok"))
def x9_continuation_cut(spark: SparkSession, d: str) -> DataFrame:
    return cuts(spark, d)


@query()
def x11_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark cases: files that have both a continuation and an infilling case, at most 6 of a bucket by digest."""
    s = materialise(streams(spark, d), "streams")
    sizes = s.select("file_id", F.size("tokens").alias("length"))
    found = O.near_best(O.hole_candidates(O.units(s), sizes, F.lit(8), F.least(F.lit(O.WIDEST), F.col("length") - 2)), F.abs(F.col("end") - F.col("start") - F.greatest(F.lit(8), F.lit(24))), O.NEAR)
    hole = picked(found.select("file_id", "start", "end"), ["file_id"], ["start", "end"], 42)
    both = bucketed(spark, d).join(sizes.where("length BETWEEN 30 AND 1024"), "file_id").join(O.continuation_cut(O.split_positions(s), 16, 0.35, 0.7), "file_id").join(hole, "file_id")
    return per_bucket(both, "bucket", [hashed_order(42, "file_id"), "file_id"], 6)


_PHOLE = """bn AS (SELECT seq_id, bar_idx AS bar, max(start_token) AS st, max(end_token) AS en FROM bar_info JOIN (SELECT seq_id, max(analysed_at) AS analysed_at FROM bar_info GROUP BY seq_id) USING (seq_id, analysed_at) GROUP BY ALL HAVING st IS NOT NULL AND en IS NOT NULL),
bt AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS bars FROM bn), cp AS (SELECT seq_id, phrase_idx AS phrase, max(start_bar) AS first, max(end_bar) AS last FROM phrase_spans JOIN (SELECT seq_id, max(analysed_at) AS analysed_at FROM phrase_spans GROUP BY seq_id) USING (seq_id, analysed_at) WHERE start_bar IS NOT NULL AND end_bar > start_bar GROUP BY ALL),
cand AS (SELECT a.seq_id, a.bars, a.bar AS f, b.bar + 1 AS l, a.st AS start, b.en AS "end", b.en - a.st AS size FROM bt a JOIN bt b ON a.seq_id = b.seq_id AND b.bar >= a.bar WHERE a.bars >= 3 AND a.bar >= 1 AND b.bar <= a.bars - 2 AND b.bar <= a.bar + 64 AND b.en - a.st BETWEEN 16 AND 64 AND a.seq_id IN (SELECT seq_id FROM cp)),
sc AS (SELECT cand.*, (SELECT count(*) FROM cp WHERE cp.seq_id = cand.seq_id AND phrase > 0 AND first > f AND first < l) AS ins, EXISTS (SELECT 1 FROM cp WHERE cp.seq_id = cand.seq_id AND first = f AND last = l) AS ex, EXISTS (SELECT 1 FROM cp WHERE cp.seq_id = cand.seq_id AND first <= f AND last >= l) AS one FROM cand)
SELECT seq_id, start, "end", (abs(size - 40.0::double) + 2 * abs((f + l) / 2.0::double - bars / 2.0::double) + CASE WHEN one THEN 0 ELSE 40 END + 12 * ins + CASE WHEN ex THEN -8 ELSE 0 END)::double AS score FROM sc"""


@query(f"WITH {_PHOLE}")
def x15_phrase_holes(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bar_info")
    newest = b.groupBy("seq_id").agg(F.max("analysed_at").alias("analysed_at"))
    now = b.join(newest, ["seq_id", "analysed_at"]).groupBy("seq_id", F.col("bar_idx").alias("bar")).agg(F.max("start_token").alias("start_token"), F.max("end_token").alias("end_token")).where("start_token IS NOT NULL AND end_token IS NOT NULL")
    return O.phrase_holes(now, stored_phrases(spark, d), "single_phrase", 16, 64, "seq_id")


@query()
def x7_policy_windows(spark: SparkSession, d: str) -> DataFrame:
    """A window of the drawn kind for every sequence with phrases, or of the first kind that has one."""
    p = stored_phrases(spark, d)
    kinds = ("single_phrase", "cross_boundary", "long_context")
    rows = p.select("seq_id").distinct()
    for i, k in enumerate(kinds):
        one = picked(window_candidates(p, k, 2, 8, "seq_id").distinct(), ["seq_id"], ["first", "last"], 7 + i)
        rows = rows.join(one.select("seq_id", F.struct(F.lit(k).alias("kind"), "first", "last").alias(k)), "seq_id", "left")
    wanted = O.policy(O.uniform(3, "seq_id"), {"single_phrase": 0.5, "cross_boundary": 0.3, "long_context": 0.2})
    got = rows.select("seq_id", wanted.alias("wanted"), *kinds)
    return got.select("seq_id", "wanted", O.with_fallback(got, F.col("wanted"), kinds).alias("w")).where("w IS NOT NULL").select("seq_id", "wanted", "w.*")


@query()
def x16_batches(spark: SparkSession, d: str) -> DataFrame:
    b = O.batches(streams(spark, d), T.vocabulary(spark), 128, 0.5, 9, 32)
    return b.select("file_id", "batch", "is_fim", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"))


# -- decoding records -----------------------------------------------------------------------------------------------
# prompt: the first 12 tokens; target: the next 20 and EOS; generated: 20 tokens from the 30th on, cut short for every fourth file


def decoded(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("tokens")
    part = lambda a, n: F.slice(t, a, n)
    made = F.when(F.col("file_id") % 4 == 0, part(30, 18)).when(F.col("file_id") % 4 == 1, part(13, 20)).otherwise(part(30, 20))
    return streams(spark, d).where(F.size(t) > 60).select("file_id", (F.col("file_id") % 5).alias("checkpoint"), part(1, 12).alias("prompt"), F.concat(part(13, 20), F.array(F.lit("EOS"))).alias("target"), made.alias("generated"), (F.col("file_id") % 3 == 0).alias("reached_eos"))


_DEC = """dec AS (SELECT file_id, file_id % 5 AS checkpoint, tokens[1:12] AS prompt, tokens[13:32] || ['EOS'] AS target, CASE file_id % 4 WHEN 0 THEN tokens[30:47] WHEN 1 THEN tokens[13:32] ELSE tokens[30:49] END AS generated, file_id % 3 = 0 AS reached_eos FROM tok WHERE len(tokens) > 60),
drow AS (SELECT file_id, unnest(f) AS token, generate_subscripts(f, 1) - 1 AS idx FROM (SELECT file_id, prompt || generated || ['EOS'] AS f FROM dec))"""


# the whole records, EOS appended, as the views that the grammar's twins read
_TRACE = f"""{_DEC.replace("drow AS", "row AS")}, code AS (SELECT file_id, idx, token, {LETTER} AS sign FROM row r), {_FAULT}, rs AS ({_REASON_BODY}),
tr AS (SELECT dec.*, reason, reason = 'ok' AS ok FROM dec JOIN rs USING (file_id))"""


@query(twin(f"""WITH {_TRACE} SELECT file_id, checkpoint, reached_eos, reached_eos AND ok AS is_valid, ok AS append_eos_valid, CASE WHEN reached_eos AND ok THEN 'ok' WHEN reached_eos THEN 'syntax_invalid' WHEN ok THEN 'missing_eos_only' ELSE 'missing_eos_plus_syntax' END AS failure_reason,
CASE WHEN NOT reached_eos AND ok THEN 'missing_eos' ELSE reason END AS syntax_reason, coalesce(generated[1] = target[1], false) AS first_token_match FROM tr""", "tok", "vocab"))
def g21_traces(spark: SparkSession, d: str) -> DataFrame:
    t = D.continuation_traces(decoded(spark, d))
    return t.select("file_id", "checkpoint", "reached_eos", "is_valid", "append_eos_valid", "failure_reason", "syntax_reason", "first_token_match")


@query(twin(f"WITH {_DEC} SELECT file_id, coalesce(generated[1] = target[1], false) AS first_token_match, len(prompt || generated)::int + reached_eos::int AS reconstructed_len FROM dec", "tok"))
def g21_first_match(spark: SparkSession, d: str) -> DataFrame:
    t = D.continuation_traces(decoded(spark, d))
    return t.select("file_id", "first_token_match", F.size("reconstructed").alias("reconstructed_len"))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return D.enriched_continuations(D.continuation_traces(decoded(spark, d)))


@query()
def g20_enriched(spark: SparkSession, d: str) -> DataFrame:
    e = enriched(spark, d)
    return rounded(e, *[f.name for f in e.schema if f.dataType.simpleString() == "double"]).drop("prompt", "target", "generated", "reconstructed")


@query()
def g20_enriched_infilling(spark: SparkSession, d: str) -> DataFrame:
    rows = decoded(spark, d).select("file_id", "checkpoint", F.col("prompt").alias("prefix"), F.col("generated").alias("middle"), F.slice("target", 1, 20).alias("target"), F.slice("target", 10, 11).alias("suffix"), "reached_eos")
    e = D.enriched_infillings(D.infilling_traces(rows))
    return rounded(e, *[f.name for f in e.schema if f.dataType.simpleString() == "double"]).drop("prefix", "middle", "suffix", "target", "reconstructed")


@query(twin(f"""WITH {_TRACE} SELECT checkpoint, count(*) AS records, round(avg((reached_eos AND ok)::int), 6) AS stop_success_rate, round(avg(ok::int), 6) AS structural_rate, round(avg((NOT reached_eos)::int), 6) AS missing_eos_rate, round(avg((NOT reached_eos AND ok)::int), 6) AS append_eos_recoverable_rate, round(avg((NOT ok)::int), 6) AS syntax_invalid_rate FROM tr GROUP BY checkpoint""", "tok", "vocab"))
def g22_checkpoint_rates(spark: SparkSession, d: str) -> DataFrame:
    a = D.checkpoint_metrics(enriched(spark, d), ["checkpoint"])
    cols = ("stop_success_rate", "structural_rate", "missing_eos_rate", "append_eos_recoverable_rate", "syntax_invalid_rate")
    return rounded(a.select("checkpoint", "records", *cols), *cols)


@query()
def g22_checkpoint_agg(spark: SparkSession, d: str) -> DataFrame:
    a = D.checkpoint_metrics(enriched(spark, d), ["checkpoint"])
    return rounded(a, *[f.name for f in a.schema if f.dataType.simpleString() == "double"])


@query(twin(f"""WITH {_TRACE} SELECT * FROM (SELECT checkpoint, reason, count(*) AS count, row_number() OVER (PARTITION BY checkpoint ORDER BY count(*) DESC, reason)::int AS place FROM (SELECT checkpoint, regexp_replace(CASE WHEN NOT reached_eos AND ok THEN 'missing_eos' ELSE reason END, '@.*', '') AS reason FROM tr) GROUP BY checkpoint, reason) WHERE place <= 5""", "tok", "vocab"))
def g23_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.top_counts(D.continuation_traces(decoded(spark, d)).withColumn("reason", F.regexp_replace("syntax_reason", "@.*", "")), ["checkpoint"], "reason", 5)


@query("SELECT l, legal_mass, next_id, raw_id, raw_id % 3 <> 0 AS raw_is_legal FROM (SELECT id AS l, round(sum(exp(x - m)) FILTER (k % 3 <> 0) / sum(exp(x - m)), 6) AS legal_mass, arg_max(k, (x, -k)) FILTER (k % 3 <> 0) AS next_id, arg_max(k, (x, -k)) AS raw_id FROM (SELECT *, max(x) OVER (PARTITION BY id) AS m FROM (SELECT vec_id AS id, unnest(embedding)::double AS x, (generate_subscripts(embedding, 1) - 1)::int AS k FROM embeddings)) GROUP BY id)")
def d1_masked_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Vectors taken as logits of which every third entry is illegal."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("l"), F.col("embedding").cast("array<double>").alias("x"))
    legal = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda i: i % 3 != 0)
    return e.select("l", D.masked_argmax(F.col("x"), legal).alias("c")).select("l", "c.*").withColumn("legal_mass", F.round("legal_mass", 6))


@query()
def d1_top_p(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("l"), F.col("embedding").cast("array<double>").alias("x"))
    return D.top_p_sample(e, "x", 0.9, 0.9, O.uniform(4, "l")).select("l", "next_id")


@query()
def d3_continuations(spark: SparkSession, d: str) -> DataFrame:
    """Decoding under the grammar with a table of token successions as the model."""
    s = streams(spark, d)
    model = D.succession_table(s)
    prompts = s.where(F.size("tokens") > 60).select("file_id", F.slice("tokens", 1, 12).alias("prompt"))
    return D.decode_continuations(prompts, model, 48).select("file_id", F.array_join("generated", " ").alias("generated"), "reached_eos", "steps", "dead_ends", "auto_closed")


@query()
def d4_infillings(spark: SparkSession, d: str) -> DataFrame:
    s = streams(spark, d)
    model = D.succession_table(s)
    rows = s.where(F.size("tokens") > 60).select("file_id", F.slice("tokens", 1, 12).alias("prefix"), F.slice("tokens", F.lit(38), F.size("tokens") - 38).alias("suffix"))
    return D.decode_infillings(rows, model, 40).select("file_id", F.array_join("middle", " ").alias("middle"), "closed", "steps", "dead_ends")
