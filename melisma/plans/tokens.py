"""Queries of token streams, grammar, encoding and packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import text as X
from melisma.operators import grammar as G
from melisma.operators import sequences as S
from melisma.operators import tokens as T
from melisma.plans.registry import query
from melisma.plans.views import faulty_streams, records, streams, token_grid, twin
from melisma.tables import table

_JOIN = "array_to_string(tokens, ' ')"


def joined(tokens) -> F.Column:
    return F.array_join(tokens, " ")


@query(twin("SELECT * FROM vocab", "vocab"))
def a1_vocab(spark: SparkSession, d: str) -> DataFrame:
    return T.vocabulary(spark)


@query(twin(f"SELECT file_id, {_JOIN} AS tokens FROM tok", "tok"))
def x2_token_stream(spark: SparkSession, d: str) -> DataFrame:
    return streams(spark, d).select("file_id", joined("tokens").alias("tokens"))


@query(twin("SELECT bar, pos, count(*) AS notes, sum(dur)::bigint AS durations, sum(vel)::bigint AS velocities FROM ev WHERE event_idx >= 0 GROUP BY ALL", "ev"))
def o2_event_order(spark: SparkSession, d: str) -> DataFrame:
    return T.numbered(token_grid(spark, d)).where("event_idx >= 0").groupBy("bar", "pos").agg(F.count("*").alias("notes"), F.sum("dur").alias("durations"), F.sum("vel").alias("velocities"))


@query(twin("SELECT file_id, string_agg(vocab.id::varchar, ' ' ORDER BY idx) AS ids, count(*) FILTER (vocab.id IS NULL) AS oov FROM row LEFT JOIN vocab USING (token) GROUP BY file_id", "row", "vocab"))
def a2_encode_oov(spark: SparkSession, d: str) -> DataFrame:
    e = T.encoded(faulty_streams(spark, d), T.vocabulary(spark))
    return e.select("file_id", F.nullif(joined(F.transform("ids", lambda i: i.cast("string"))), F.lit("")).alias("ids"), "oov")


@query(twin("SELECT token, id, count(*) AS uses FROM row LEFT JOIN vocab USING (token) GROUP BY ALL", "row", "vocab"))
def j1_token_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = faulty_streams(spark, d).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    return rows.join(F.broadcast(T.vocabulary(spark)), "token", "left").select("token", "id", "uses")


@query(twin("SELECT file_id, (SELECT id FROM vocab WHERE token = tokens[1]) AS first, (SELECT id FROM vocab WHERE token = tokens[-1]) AS last, len(tokens)::int AS size FROM tok", "tok", "vocab"))
def a3_encode_strict(spark: SparkSession, d: str) -> DataFrame:
    e = T.encoded(streams(spark, d), T.vocabulary(spark))
    strict = F.when(F.col("oov") > 0, F.raise_error(F.lit("unknown token")).cast("array<int>")).otherwise(F.col("ids"))
    return e.select("file_id", strict.alias("ids")).select("file_id", F.get("ids", F.lit(0)).alias("first"), F.element_at("ids", -1).alias("last"), F.size("ids").alias("size"))


@query(twin("SELECT file_id, array_to_string(list_transform(list_resize(tokens[1:20], 24, 'EOS'), lambda t: t), ' ') AS input, array_to_string(list_resize(list_transform(tokens[1:20], lambda t: (CASE WHEN starts_with(t, 'POS_') THEN 1 ELSE 0 END)), 24, -100), ' ') AS labels FROM tok", "tok"))
def a4_padded_rows(spark: SparkSession, d: str) -> DataFrame:
    s = streams(spark, d).select("file_id", F.slice("tokens", 1, 20).alias("t"))
    marks = F.transform("t", lambda x: F.when(x.startswith("POS_"), 1).otherwise(0))
    filled = F.concat("t", F.array_repeat(F.lit("EOS"), F.lit(24) - F.size("t")))
    return s.select("file_id", joined(filled).alias("input"), joined(F.transform(S.padded(marks, 24, -100), lambda i: i.cast("string"))).alias("labels"))


@query(twin("SELECT file_id, array_to_string(CASE WHEN t[-1] = 'EOS' THEN t[:-2] ELSE t END, ' ') AS tokens FROM (SELECT file_id, list_filter(list_transform([' '] || tokens, lambda x: trim(x)), lambda x: x <> '') AS t FROM btok)", "btok"))
def a5_trimmed(spark: SparkSession, d: str) -> DataFrame:
    return faulty_streams(spark, d).select("file_id", joined(S.trimmed(F.concat(F.array(F.lit(" ")), "tokens"))).alias("tokens"))


_UNIT = """WITH u AS (SELECT file_id, list_filter(tokens, lambda x: x NOT IN ('BOS', 'EOS', 'FIM_HOLE', 'FIM_MID') AND NOT starts_with(x, 'TEMPO_') AND NOT starts_with(x, 'KEY_')) AS t FROM btok), v AS (SELECT file_id, t FROM u UNION ALL SELECT file_id, t[2:] FROM u)
SELECT file_id, CASE WHEN t[1] = 'BAR' THEN 'BAR' WHEN starts_with(t[1], 'POS_') AND starts_with(t[2], 'INST_') AND starts_with(t[3], 'PITCH_') AND starts_with(t[4], 'DUR_') AND starts_with(t[5], 'VEL_') THEN array_to_string(t[1:5], ' ') END AS unit FROM v"""


@query(twin(_UNIT, "btok"))
def a6_first_unit(spark: SparkSession, d: str) -> DataFrame:
    s = faulty_streams(spark, d)
    bare = F.filter("tokens", lambda x: ~x.isin("BOS", "EOS", "FIM_HOLE", "FIM_MID") & ~S.starts_any(x, *S.CONTROL))
    rest = s.select("file_id", F.slice(bare, F.lit(2), F.greatest(F.lit(0), F.size(bare) - 1)).alias("tokens"))
    return s.unionByName(rest).select("file_id", S.first_unit(F.col("tokens")).alias("unit"))


# an infilling prompt of every sequence: a hole over the tokens 11 to 20
_PROMPT = "SELECT file_id, tokens[1:10] || ['FIM_HOLE'] || tokens[21:] || ['FIM_MID'] AS p, tokens[11:20] AS hole FROM tok WHERE len(tokens) > 22"


def prompts(spark: SparkSession, d: str) -> DataFrame:
    s = streams(spark, d).where(F.size("tokens") > 22)
    return s.select("file_id", F.concat(F.slice("tokens", 1, 10), F.array(F.lit("FIM_HOLE")), F.slice("tokens", F.lit(21), F.size("tokens") - 20), F.array(F.lit("FIM_MID"))).alias("p"), F.slice("tokens", 11, 10).alias("hole"))


_CUT = "list_position(p, 'FIM_HOLE')"
_MID = "list_position(p, 'FIM_MID')"
_STRUCT = f"list_filter(p[1:{_CUT} - 1], lambda x: x IN ('BOS', 'BAR') OR starts_with(x, 'TEMPO_') OR starts_with(x, 'KEY_'))"


@query(twin(f"SELECT file_id, array_to_string(p[1:{_CUT} - 1], ' ') AS prefix, array_to_string(list_filter(p[{_CUT} + 1:{_MID} - 1], lambda x: x <> 'EOS'), ' ') AS suffix FROM ({_PROMPT})", "tok"))
def a7_split_prompt(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("file_id", S.split_prompt(F.col("p")).alias("s")).select("file_id", joined("s.prefix").alias("prefix"), joined("s.suffix").alias("suffix"))


@query(twin(f"SELECT file_id, array_to_string({_STRUCT}, ' ') AS prefix FROM ({_PROMPT})", "tok"))
def a8_structure_prefix(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("file_id", joined(S.structure_prefix(F.col("p"))).alias("prefix"))


@query(twin(f"SELECT file_id, array_to_string({_STRUCT} || hole || ['EOS'], ' ') AS target, array_to_string(p[1:{_CUT} - 1] || hole || list_filter(p[{_CUT} + 1:{_MID} - 1], lambda x: x <> 'EOS') || ['EOS'], ' ') AS reference FROM ({_PROMPT})", "tok"))
def a9_rebuilt_sequences(spark: SparkSession, d: str) -> DataFrame:
    s, end = S.split_prompt(F.col("p")), F.array(F.lit("EOS"))
    hole = S.trimmed(F.col("hole"))
    return prompts(spark, d).select("file_id", joined(F.concat(S.structure_prefix(F.col("p")), hole, end)).alias("target"), joined(F.concat(s["prefix"], hole, s["suffix"], end)).alias("reference"))


_BARS = """b AS (SELECT file_id, idx, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS bar, lead(idx) OVER (PARTITION BY file_id ORDER BY idx) AS nxt FROM row WHERE token = 'BAR'),
n AS (SELECT file_id, count(*) - (max_by(token, idx) = 'EOS')::int AS fin FROM row GROUP BY file_id)"""


@query(twin(f"WITH {_BARS} SELECT file_id, array_to_string(['BOS', tempo] || flatten(list(['BAR'] || body ORDER BY bar)) || ['EOS'], ' ') AS tokens FROM (SELECT b.file_id, bar, t.tokens[2] AS tempo, t.tokens[idx + 2:coalesce(nxt, fin)] AS body FROM b JOIN n USING (file_id) JOIN btok t USING (file_id) WHERE file_id % 8 = 0 AND bar BETWEEN 1 AND 3) GROUP BY file_id, tempo", "row"))
def a10_bar_window(spark: SparkSession, d: str) -> DataFrame:
    bars = S.bar_table(faulty_streams(spark, d).where("file_id % 8 = 0"))
    spans = bars.where("bar = 1").select("file_id", F.lit(1).alias("first"), F.lit(4).alias("last"))
    return S.bar_windows(bars, spans).select("file_id", joined("tokens").alias("tokens"))


_PROFILE = "[6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]"


@query(f"SELECT r.range::int AS root, i.range::int AS pitch_class, ({_PROFILE})[(i.range - r.range + 12) % 12 + 1]::double AS weight FROM range(12) r, range(12) i")
def a13_rotated_profile(spark: SparkSession, d: str) -> DataFrame:
    from melisma.operators.keys import MAJOR

    grid = spark.range(12).select(F.col("id").cast("int").alias("root"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pitch_class"))
    return grid.select("root", "pitch_class", F.element_at(F.array(*[F.lit(x) for x in MAJOR]), (F.col("pitch_class") - F.col("root") + 12) % 12 + 1).alias("weight"))


_PARSE = """WITH w AS (SELECT r.file_id, idx, token, lead(token, 1) OVER o AS t1, lead(token, 2) OVER o AS t2, lead(token, 3) OVER o AS t3, lead(token, 4) OVER o AS t4, sum((token = 'BAR')::int) OVER o - 1 AS bar,
count(*) OVER p - (last_value(token) OVER (PARTITION BY r.file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) = 'EOS')::int AS fin, first_value(token) OVER o AS head FROM row r WINDOW o AS (PARTITION BY file_id ORDER BY idx), p AS (PARTITION BY file_id))
SELECT file_id, idx::int AS idx, bar::int AS bar, least(31, greatest(0, try_cast(substr(token, 5) AS int))) AS pos, try_cast(substr(t2, 7) AS int) AS pitch, greatest(1, try_cast(substr(t3, 5) AS int)) AS dur, try_cast(substr(t4, 5) AS int) AS vel FROM w
WHERE head = 'BOS' AND idx > 0 AND bar >= 0 AND idx + 4 < fin AND starts_with(token, 'POS_') AND starts_with(t1, 'INST_') AND starts_with(t2, 'PITCH_') AND starts_with(t3, 'DUR_') AND starts_with(t4, 'VEL_')"""


@query(twin(_PARSE, "row"))
def a14_parsed_events(spark: SparkSession, d: str) -> DataFrame:
    return S.parsed_events(faulty_streams(spark, d))


@query(twin("SELECT file_id, CASE WHEN split = 'train' THEN 'continuation' ELSE 'infilling' END AS task, printf('%04d_full.mid', file_id) AS full_name, printf('%04d_%s.mid', file_id, CASE WHEN split = 'train' THEN 'continuation' ELSE 'infilling' END) AS partial_name FROM cur", "cur"))
def a15_output_names(spark: SparkSession, d: str) -> DataFrame:
    task = F.when(F.col("split") == "train", "continuation").otherwise("infilling")
    return records(spark, d).select("file_id", task.alias("task"), F.format_string("%04d_full.mid", "file_id").alias("full_name"), F.format_string("%04d_%s.mid", F.col("file_id"), task).alias("partial_name"))


@query(twin("SELECT file_id, to_json({'file_id': file_id, 'split': split, 'note_count': note_count})::varchar AS payload FROM cur WHERE split IS NOT NULL AND note_count IS NOT NULL", "cur"))
def a16_case_payload(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("split IS NOT NULL AND note_count IS NOT NULL").select("file_id", F.to_json(F.struct("file_id", "split", "note_count")).alias("payload"))


@query(twin(f"SELECT file_id, CASE WHEN len(tokens) > 24 THEN array_to_string(tokens[1:24], ' ') || ' ...' ELSE {_JOIN} END AS preview FROM tok", "tok"))
def f40_preview(spark: SparkSession, d: str) -> DataFrame:
    return streams(spark, d).select("file_id", X.preview(F.col("tokens")).alias("preview"))


_FAULT = """f AS (SELECT file_id, string_agg(sign, '' ORDER BY idx) AS code, min(idx) FILTER (NOT ok) AS fault FROM (SELECT *, CASE WHEN head THEN
prev || sign IN ('^B', 'BT', 'BK', 'BR', 'BE', 'TK', 'TR', 'TE', 'KR', 'KE') ELSE prev || sign IN ('RT', 'RK', 'RP', 'RR', 'RE', 'TK', 'TP', 'TR', 'TE', 'KP', 'KR', 'KE', 'PI', 'IC', 'CD', 'DV', 'VP', 'VR', 'VE') END AS ok
FROM (SELECT *, coalesce(lag(sign) OVER w, '^') AS prev, coalesce(sum((sign = 'R')::int) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS head FROM code WINDOW w AS (PARTITION BY file_id ORDER BY idx))) GROUP BY file_id)"""


@query(twin(f"WITH {_FAULT} SELECT file_id, fault::int AS fault, code, regexp_full_match(code, 'BT?K?(RT?K?(PICDV)*)*E') AS valid FROM f", "code"))
def g1_grammar(spark: SparkSession, d: str) -> DataFrame:
    s = faulty_streams(spark, d).select("file_id", G.letters(F.col("tokens")).alias("code"))
    return s.select("file_id", "code", G.first_fault(F.col("code")).alias("fault"), G.prefix_valid(F.col("code")).alias("valid"))


_REASON_BODY = """SELECT f.file_id, CASE WHEN fault IS NOT NULL THEN CASE WHEN c.sign = '?' AND c.token NOT LIKE 'FIM%' THEN 'unknown_token' ELSE
CASE WHEN fault = 0 THEN 'expected_bos' WHEN instr(code, 'R') = 0 OR fault < instr(code, 'R') THEN CASE code[fault] WHEN 'B' THEN 'expected_tempo_key_bar_or_eos' WHEN 'T' THEN 'expected_key_bar_or_eos' WHEN 'K' THEN 'expected_bar_or_eos' ELSE 'unexpected_token_after_eos' END
ELSE CASE code[fault] WHEN 'R' THEN 'expected_tempo_key_pos_bar_or_eos' WHEN 'T' THEN 'expected_key_pos_bar_or_eos' WHEN 'K' THEN 'expected_pos_bar_or_eos' WHEN 'P' THEN 'expected_inst' WHEN 'I' THEN 'expected_pitch' WHEN 'C' THEN 'expected_dur'
WHEN 'D' THEN 'expected_vel' WHEN 'V' THEN 'expected_pos_bar_or_eos' ELSE 'unexpected_token_after_eos' END END END || '@' || fault || ':' || c.token
WHEN code[-1] = 'E' THEN 'ok' ELSE CASE code[-1] WHEN 'P' THEN 'incomplete_note_tuple_expected_inst' WHEN 'I' THEN 'incomplete_note_tuple_expected_pitch' WHEN 'C' THEN 'incomplete_note_tuple_expected_dur' WHEN 'D' THEN 'incomplete_note_tuple_expected_vel' ELSE 'missing_eos' END END AS reason
FROM f LEFT JOIN code c ON c.file_id = f.file_id AND c.idx = f.fault"""
_REASON = f"WITH {_FAULT} {_REASON_BODY}"


def reasons(sequences: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, `tokens`, `reason`: the grammar's verdict on token arrays."""
    s = sequences.withColumn("_code", G.letters(F.col("tokens"))).withColumn("_fault", G.first_fault(F.col("_code")))
    return s.withColumn("reason", G.fault_reason(F.col("tokens"), F.col("_code"), F.col("_fault"))).drop("_code", "_fault")


@query(twin(_REASON, "code"))
def g1_fault_reason(spark: SparkSession, d: str) -> DataFrame:
    return reasons(faulty_streams(spark, d)).select("file_id", "reason")


def orders(sequences: DataFrame) -> DataFrame:
    """Adds `valid` (order by prefixes) and `oov` to token arrays. The letters are a column of their own first, lest every place works them out again."""
    s = sequences.withColumn("_loose", G.letters(F.col("tokens"), strict=False))
    return s.withColumn("valid", G.prefix_valid(F.col("_loose"))).withColumn("oov", G.oov_count(F.col("tokens"))).drop("_loose")


_LOOSE = "CASE WHEN token IN ('BOS', 'EOS', 'BAR') THEN token[1] ELSE CASE split_part(token, '_', 1) WHEN 'TEMPO' THEN 'T' WHEN 'KEY' THEN 'K' WHEN 'POS' THEN 'P' WHEN 'INST' THEN 'I' WHEN 'PITCH' THEN 'C' WHEN 'DUR' THEN 'D' WHEN 'VEL' THEN 'V' ELSE '?' END END"


@query(twin(f"SELECT file_id, regexp_full_match(string_agg(CASE WHEN token = 'BAR' THEN 'R' ELSE {_LOOSE} END, '' ORDER BY idx), 'BT?K?(RT?K?(PICDV)*)*E') AS valid, count(*) FILTER (token NOT IN (SELECT token FROM vocab))::int AS oov FROM row GROUP BY file_id", "row", "vocab"))
def p8_token_order(spark: SparkSession, d: str) -> DataFrame:
    return orders(faulty_streams(spark, d)).select("file_id", "valid", "oov")


def complete_errors(sequences: DataFrame) -> DataFrame:
    """Adds `error`, the first reason why a token array is no whole sequence: empty, structural or task tokens, unknown tokens, order; null if none."""
    s = orders(sequences.withColumn("tokens", F.transform("tokens", lambda x: F.trim(x))))
    t = F.col("tokens")
    forbidden = F.array_sort(F.array_distinct(F.filter(t, lambda x: x.isin("FIM_HOLE", "FIM_MID"))))
    s = s.withColumn("_u", F.array_sort(F.array_distinct(F.filter(t, G.is_oov)))).withColumn("_f", forbidden)
    found = (
        F.when(F.coalesce(F.size(t), F.lit(0)) <= 0, "empty").when(F.size("_f") > 0, F.concat(F.lit("structural: "), F.array_join("_f", ", "))).when(F.exists(t, lambda x: x.startswith("TASK_")), "task tokens")
        .when(F.size("_u") > 0, F.concat(F.lit("unknown: "), F.array_join(F.slice("_u", 1, 8), ", "))).when(~F.col("valid"), "order")
    )
    return s.withColumn("error", found).drop("_u", "_f", "valid", "oov")


@query(twin(f"""SELECT file_id, CASE WHEN count(*) FILTER (token LIKE 'FIM%') > 0 THEN 'structural: ' || string_agg(DISTINCT token, ', ') FILTER (token LIKE 'FIM%') WHEN count(*) FILTER (token NOT IN (SELECT token FROM vocab)) > 0 THEN 'unknown: ' || string_agg(DISTINCT token, ', ') FILTER (token NOT IN (SELECT token FROM vocab))
WHEN NOT regexp_full_match(string_agg(CASE WHEN token = 'BAR' THEN 'R' ELSE {_LOOSE} END, '' ORDER BY idx), 'BT?K?(RT?K?(PICDV)*)*E') THEN 'order' END AS error FROM row GROUP BY file_id""", "row", "vocab"))
def p9_complete_sequence(spark: SparkSession, d: str) -> DataFrame:
    return complete_errors(faulty_streams(spark, d)).select("file_id", "error")


@query()
def g2_suffix_states(spark: SparkSession, d: str) -> DataFrame:
    """State after the first half of every sequence and the states from which its second half ends well. Sequential: table lookups per sequence in Arrow batches."""

    @F.pandas_udf("prefix string, compatible string, bridgeable string")
    def states(code: pd.Series) -> pd.DataFrame:
        rows = []
        for c in code:
            body = c[:-1] if c.endswith("E") else c
            good = G.compatible_states(body[len(body) // 2 :])
            rows.append((G.state_after(body[: len(body) // 2]), " ".join(sorted(good)), " ".join(sorted(G.bridgeable_states(good)))))
        return pd.DataFrame(rows, columns=["prefix", "compatible", "bridgeable"])

    return faulty_streams(spark, d).select("file_id", states(G.letters(F.col("tokens"))).alias("s")).select("file_id", "s.*")


@query(twin("SELECT (max(try_cast(substr(token, 5) AS int)) + 1)::int AS positions FROM vocab WHERE starts_with(token, 'POS_')", "vocab"))
def g29_positions_per_bar(spark: SparkSession, d: str) -> DataFrame:
    return T.vocabulary(spark).agg((F.max(X.prefixed_int(F.col("token"), "POS_")) + 1).alias("positions"))


@query(twin("SELECT t.split, 0::int AS \"offset\", count(*) AS variants FROM cur t WHERE split IS NOT NULL GROUP BY ALL UNION ALL SELECT split, o, count(*) FROM (SELECT file_id, o FROM notes, (SELECT unnest([-12, -5, -3, 3, 5, 12]) AS o) WHERE pitch BETWEEN 21 AND 108 AND end_tick > start_tick GROUP BY ALL HAVING bool_and(pitch + o BETWEEN 21 AND 108)) JOIN cur USING (file_id) WHERE split = 'train' GROUP BY ALL", "cur", "notes"))
def x3_tokenised_variants(spark: SparkSession, d: str) -> DataFrame:
    """Sequences written per split and transposition: every file as it is, training files also at each offset that fits."""
    from melisma.plans.views import notes

    files = records(spark, d).where("split IS NOT NULL").select("file_id", "split")
    plain = files.select("split", F.lit(0).alias("offset"))
    moved = T.transposed(T.tokenizer_notes(notes(spark, d))).select("file_id", "offset").distinct().join(files.where("split = 'train'"), "file_id").select("split", "offset")
    return plain.unionByName(moved).groupBy("split", "offset").agg(F.count("*").alias("variants"))


@query(twin(f"SELECT split, count(*) AS rows, count(*) FILTER (NOT valid) AS invalid, sum(oov)::bigint AS oov, round(count(*) FILTER (NOT valid) / count(*)::double, 6) AS invalid_ratio FROM (SELECT file_id, regexp_full_match(string_agg(CASE WHEN token = 'BAR' THEN 'R' ELSE {_LOOSE} END, '' ORDER BY idx), 'BT?K?(RT?K?(PICDV)*)*E') AS valid, count(*) FILTER (token NOT IN (SELECT token FROM vocab)) AS oov FROM row GROUP BY file_id) JOIN cur USING (file_id) GROUP BY ROLLUP (split)", "row", "vocab", "cur"))
def g10_token_stats(spark: SparkSession, d: str) -> DataFrame:
    s = orders(faulty_streams(spark, d))
    bad = F.count_if(~F.col("valid"))
    return s.join(records(spark, d).select("file_id", "split"), "file_id").rollup("split").agg(F.count("*").alias("rows"), bad.alias("invalid"), F.sum("oov").alias("oov"), F.round(bad / F.count("*"), 6).alias("invalid_ratio"))


@query(twin("SELECT k.source_kind, vocab.token, coalesce(n, 0) AS uses FROM vocab, (SELECT DISTINCT source_kind FROM phrase_spans WHERE source_kind IS NOT NULL UNION ALL SELECT NULL) k LEFT JOIN (SELECT source_kind, key_token, count(*) AS n FROM phrase_spans WHERE source_kind IS NOT NULL AND key_token IS NOT NULL GROUP BY GROUPING SETS ((source_kind, key_token), (key_token))) c ON c.key_token = vocab.token AND c.source_kind IS NOT DISTINCT FROM k.source_kind WHERE starts_with(vocab.token, 'KEY_')", "vocab"))
def g9_key_token_stats(spark: SparkSession, d: str) -> DataFrame:
    """Uses of every key token, unused ones included, by kind of phrase and (kind null) in all."""
    p = table(spark, d, "phrase_spans").where("source_kind IS NOT NULL AND key_token IS NOT NULL")
    counts = p.groupBy("source_kind", "key_token").agg(F.count("*").alias("n"))
    every = counts.unionByName(counts.groupBy("key_token").agg(F.sum("n").alias("n")).withColumn("source_kind", F.lit(None).cast("string")))
    kinds = table(spark, d, "phrase_spans").where("source_kind IS NOT NULL").select("source_kind").distinct().unionByName(spark.range(1).select(F.lit(None).cast("string").alias("source_kind")))
    keys = F.array(*[F.lit(f"KEY_{r}_{m}") for m in ("MAJ", "MIN") for r in T.ROOTS], F.lit("KEY_UNCERTAIN"))
    spine = kinds.select(F.col("source_kind").alias("k"), F.explode(keys).alias("token"))
    return spine.join(every, F.col("k").eqNullSafe(F.col("source_kind")) & (F.col("token") == F.col("key_token")), "left").select(F.col("k").alias("source_kind"), "token", F.coalesce("n", F.lit(0)).alias("uses"))


_SUMMARY = "SELECT split, count(*) AS count, round(avg(n), 6) AS mean, list_sort(list(n))[floor(0.5::double * (count(*) - 1))::int + 1] AS p50, list_sort(list(n))[floor(0.9::double * (count(*) - 1))::int + 1] AS p90, list_sort(list(n))[floor(0.99::double * (count(*) - 1))::int + 1] AS p99 FROM (SELECT split, unnest(lengths) AS n FROM packed_index) WHERE n IS NOT NULL GROUP BY split"


@query(_SUMMARY)
def g8_length_summary(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "packed_index").select("split", F.explode("lengths").alias("n"))
    return S.length_summary(items, ["split"], "n").withColumn("mean", F.round("mean", 6))


@query(twin("SELECT cur.split, file_id, len(tokens)::int AS length, (sum(len(tokens)) OVER (PARTITION BY cur.split ORDER BY file_id) - len(tokens))::bigint AS \"offset\" FROM tok JOIN cur USING (file_id) WHERE cur.split IS NOT NULL", "tok", "cur"))
def k3_packed_offsets(spark: SparkSession, d: str) -> DataFrame:
    s = streams(spark, d).join(records(spark, d).where("split IS NOT NULL").select("file_id", "split"), "file_id").select("split", "file_id", F.size("tokens").alias("length"))
    return S.running_offsets(s, ["split"], "file_id", "length", "offset")


@query("SELECT shard_id, written_at, item_no::int AS item_no, n AS length, (sum(coalesce(n, 0)) OVER (PARTITION BY shard_id, written_at, id ORDER BY item_no) - coalesce(n, 0))::bigint AS \"offset\" FROM (SELECT shard_id, written_at, id, unnest(lengths) AS n, generate_subscripts(lengths, 1) - 1 AS item_no FROM (SELECT *, row_number() OVER () AS id FROM packed_index))")
def w21_offsets(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "packed_index").select("shard_id", "written_at", "lengths", F.posexplode("lengths").alias("item_no", "length"))
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("item_no")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return items.select("shard_id", "written_at", "item_no", "length", before.alias("offset"))


_CHECKS = """WITH p AS (SELECT shard_id, written_at, dtype, num_sequences, num_tokens, offsets AS o, lengths AS l, len(lengths) AS n FROM packed_index),
g AS (SELECT *, list_filter(range(1, n), lambda i: NOT coalesce(o[i + 1] = o[i] + l[i], false)) AS gaps FROM p)
SELECT shard_id, written_at, failure FROM (SELECT shard_id, written_at, unnest([CASE WHEN coalesce(dtype, '') NOT IN ('uint16', 'uint32') THEN 'dtype' END, CASE WHEN len(o) <> n THEN 'sizes' END, CASE WHEN num_sequences IS DISTINCT FROM n THEN 'num_sequences' END,
CASE WHEN n > 0 AND NOT coalesce(o[1] = 0, false) THEN 'first_offset' END, CASE WHEN n > 1 AND len(gaps) > 0 THEN 'gap@' || gaps[1] END, CASE WHEN num_tokens IS DISTINCT FROM coalesce(list_sum(l), 0)::bigint THEN 'num_tokens' END]) AS failure FROM g) WHERE failure IS NOT NULL"""


@query(_CHECKS)
def p11_index_checks(spark: SparkSession, d: str) -> DataFrame:
    return S.index_checks(table(spark, d, "packed_index"), ["shard_id", "written_at"])


@query(twin("SELECT file_id, len(tokens)::int AS length FROM tok WHERE len(tokens) >= 512", "tok"))
def p13_eligible(spark: SparkSession, d: str) -> DataFrame:
    return streams(spark, d).select("file_id", F.size("tokens").alias("length")).where("length >= 512")


@query(twin("SELECT count(*) AS sequences FROM tok", "tok"))
def p14_strict_oov(spark: SparkSession, d: str) -> DataFrame:
    """Counts the sequences; a single unknown token fails the query."""
    return streams(spark, d).select(F.assert_true(G.oov_count(F.col("tokens")) == 0, F.lit("unknown token")).alias("ok")).agg(F.count(F.when(F.col("ok").isNull(), 1)).alias("sequences"))


@query(twin("SELECT file_id, round(1 - len(list_distinct(g))::double / len(g), 6) AS ratio FROM (SELECT file_id, list_transform(range(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2]) AS g FROM tok WHERE len(tokens) >= 3)", "tok"))
def a11_ngram_repeat(spark: SparkSession, d: str) -> DataFrame:
    return streams(spark, d).where(F.size("tokens") >= 3).select("file_id", F.round(S.repeat_ratio(F.col("tokens"), 3), 6).alias("ratio"))


_L1 = """WITH h AS (SELECT file_id, dur, count(*) FILTER (bar < 4) AS a, count(*) FILTER (bar >= 4) AS b FROM grid GROUP BY ALL)
SELECT file_id, round(sum(abs(coalesce(a / nullif(ta, 0)::double, 0) - coalesce(b / nullif(tb, 0)::double, 0))), 6) AS l1 FROM (SELECT *, sum(a) OVER (PARTITION BY file_id) AS ta, sum(b) OVER (PARTITION BY file_id) AS tb FROM h) GROUP BY file_id"""


@query(twin(_L1, "grid"))
def a12_hist_l1(spark: SparkSession, d: str) -> DataFrame:
    g = token_grid(spark, d).groupBy("file_id", "dur", (F.col("bar") < 4).alias("early")).agg(F.count("*").alias("n"))
    return S.histogram_l1(g.where("early").drop("early"), g.where("NOT early").drop("early"), ["file_id"], ["dur"]).withColumn("l1", F.round("l1", 6))


@query(twin("SELECT coalesce(a.pos, b.pos) AS pos, coalesce(a.n, 0) AS early, coalesce(b.n, 0) AS late FROM (SELECT pos, count(*) AS n FROM grid WHERE bar < 4 GROUP BY pos) a FULL JOIN (SELECT pos, count(*) AS n FROM grid WHERE bar >= 4 GROUP BY pos) b USING (pos)", "grid"))
def j13_full_outer_histogram(spark: SparkSession, d: str) -> DataFrame:
    g = token_grid(spark, d).groupBy("pos", (F.col("bar") < 4).alias("early")).agg(F.count("*").alias("n"))
    a, b = g.where("early").select("pos", F.col("n").alias("early")), g.where("NOT early").select("pos", F.col("n").alias("late"))
    return a.join(b, "pos", "full").select("pos", F.coalesce("early", F.lit(0)).alias("early"), F.coalesce("late", F.lit(0)).alias("late"))
