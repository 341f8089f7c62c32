"""Queries of structure metrics, key timelines and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import numeric as N
from melisma.operators import keys as K
from melisma.operators import phrases as P
from melisma.operators import sequences as S
from melisma.operators import structure as O
from melisma.operators import tokens as T
from melisma.plans.registry import query
from melisma.plans.views import faulty_streams, streams, token_grid, twin
from melisma.tables import table


def events(spark: SparkSession, d: str) -> DataFrame:
    return T.numbered(token_grid(spark, d))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_INFO = """spine AS (SELECT file_id, unnest(range(0, max(bar) + 1)) AS bar FROM grid GROUP BY file_id),
cells AS (SELECT file_id, bar, count(DISTINCT c) AS cells FROM (SELECT file_id, bar, unnest(range(pos, least(31, pos + dur - 1) + 1)) AS c FROM grid) GROUP BY ALL),
info AS (SELECT s.file_id, s.bar, count(g.pitch) AS note_count, count(DISTINCT g.pos) AS onset_count, 1 - coalesce(max(cells), 0) / 32.0::double AS rest_ratio, coalesce(max(g.pitch) - min(g.pitch), 0)::int AS pitch_span, coalesce(avg(g.dur), 0)::double AS mean_duration
FROM spine s LEFT JOIN grid g ON g.file_id = s.file_id AND g.bar = s.bar LEFT JOIN cells c ON c.file_id = s.file_id AND c.bar = s.bar GROUP BY s.file_id, s.bar)"""


def summary(spark: SparkSession, d: str) -> DataFrame:
    ev = token_grid(spark, d)
    return O.bar_info(ev, O.bar_spine(ev))


@query(twin(f"WITH {_INFO} SELECT file_id, bar, note_count, onset_count, rest_ratio, pitch_span, round(mean_duration, 6) AS mean_duration FROM info", "grid"))
def g14_bar_info(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary(spark, d), "mean_duration")


@query(twin("SELECT file_id, count(*) FILTER (o) AS overlaps FROM (SELECT file_id, unit < max(unit + greatest(1, dur)) OVER (PARTITION BY file_id, pitch ORDER BY event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM ev) GROUP BY file_id", "ev"))
def w5_same_pitch_overlap(spark: SparkSession, d: str) -> DataFrame:
    return O.same_pitch_overlaps(events(spark, d))


_RUN = """r AS (SELECT file_id, max(n) AS run FROM (SELECT file_id, pitch, count(*) AS n FROM (SELECT file_id, pitch, event_idx - row_number() OVER (PARTITION BY file_id, pitch ORDER BY event_idx) AS g FROM ev) GROUP BY file_id, pitch, g) GROUP BY file_id)"""


@query(twin(f"WITH {_RUN} SELECT * FROM r", "ev"))
def w6_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return O.longest_run(events(spark, d), ["file_id"], "event_idx", F.col("pitch"), "run")


@query(twin(f"WITH {_INFO} SELECT file_id, max(n) AS run FROM (SELECT file_id, count(*) AS n FROM (SELECT file_id, bar, bar - row_number() OVER (PARTITION BY file_id ORDER BY bar) AS g FROM info WHERE note_count = 0) GROUP BY file_id, g) GROUP BY file_id", "grid"))
def w6_empty_bar_run(spark: SparkSession, d: str) -> DataFrame:
    return O.longest_run(summary(spark, d), ["file_id"], "bar", F.when(F.col("note_count") == 0, 1), "run")


# the notes of a file in the order they were stored in: out of order in time
_STORED = "SELECT file_id, bar, pos, pitch, dur, row_number() OVER (PARTITION BY file_id ORDER BY pitch, dur, vel, bar, pos) - 1 AS idx FROM grid"


def stored(spark: SparkSession, d: str) -> DataFrame:
    return token_grid(spark, d).withColumn("idx", F.expr("row_number() OVER (PARTITION BY file_id ORDER BY pitch, dur, vel, bar, pos) - 1"))


@query(twin(f"SELECT file_id, count(*) FILTER (pos < p) AS violations FROM (SELECT *, lag(pos) OVER (PARTITION BY file_id, bar ORDER BY idx) AS p FROM ({_STORED})) GROUP BY file_id", "grid"))
def w9_time_order(spark: SparkSession, d: str) -> DataFrame:
    return O.time_order_violations(stored(spark, d))


def _div(e: str, u: str, ref: int) -> str:
    return f"greatest(0.0::double, least(1.0::double, 0.6 * CASE WHEN {u} > 1 THEN {e} / ln({u}::double) ELSE 0 END + 0.4 * least({u}, {ref}) / {ref}.0::double))"


def _ent(col: str, name: str) -> str:
    return f"{name} AS (SELECT file_id, sum(k)::bigint AS n, count(*) AS u, max(k) AS t, -sum(k / tt * ln(k / tt)) AS h FROM (SELECT *, (sum(k) OVER (PARTITION BY file_id))::double AS tt FROM (SELECT file_id, {col}, count(*) AS k FROM ev GROUP BY ALL)) GROUP BY file_id)"


@query(twin(f"WITH {_ent('pitch', 'p')}, {_RUN} SELECT file_id, n AS pitch_events, u AS pitch_unique, round(least(1.0, n / 6.0::double), 6) AS coverage, CASE WHEN n >= 6 THEN round(t / n::double, 6) END AS most_common_ratio, CASE WHEN n >= 6 THEN round(run / n::double, 6) END AS longest_run_ratio, CASE WHEN n >= 6 THEN round({_div('h', 'u', 12)}, 6) END AS pitch_diversity FROM p JOIN r USING (file_id)", "ev"))
def g15_pitch_collapse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.pitch_collapse(events(spark, d)), "coverage", "most_common_ratio", "longest_run_ratio", "pitch_diversity")


_RHYTHM = f"""WITH {_ent('pos', 'o')}, {_ent('dur', 'l')}, b AS (SELECT file_id, avg((pos = 0)::int) AS st, avg((pos % 8 = 0)::int) AS sg FROM ev GROUP BY file_id)
SELECT file_id, o.n AS rhythm_events, o.u AS onset_unique, CASE WHEN o.n >= 6 THEN round(greatest(0, least(1, o.h / ln(32.0::double))), 6) END AS onset_entropy, CASE WHEN o.n >= 6 THEN round(st, 6) END AS bar_start_ratio, CASE WHEN o.n >= 6 THEN round(sg, 6) END AS strong_beat_ratio,
CASE WHEN o.n >= 6 THEN round({_div('l.h', 'l.u', 6)}, 6) END AS duration_diversity,
CASE WHEN o.n >= 6 THEN round(0.35 * greatest(0, least(1, o.h / ln(32.0::double))) + 0.2 * least(o.u, 8) / 8.0::double + 0.2 * {_div('l.h', 'l.u', 6)} + 0.15 * (1 - sg) + 0.1 * (1 - st), 6) END AS rhythm_diversity FROM o JOIN l USING (file_id) JOIN b USING (file_id)"""


@query(twin(_RHYTHM, "ev"))
def g16_rhythm_diversity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.rhythm_diversity(events(spark, d)), "onset_entropy", "bar_start_ratio", "strong_beat_ratio", "duration_diversity", "rhythm_diversity")


_REP = "(0.5 * (1 - (count(DISTINCT {a}2) FILTER ({a}2 IS NOT NULL))::double / (count(*) - 1) + 1 - (count(DISTINCT {a}3) FILTER ({a}3 IS NOT NULL))::double / (count(*) - 2)))"
_REPEAT = f"""WITH s AS (SELECT file_id, event_idx, pos || ',' || pitch || ',' || dur AS e, pos || ',' || dur AS r FROM ev),
g AS (SELECT file_id, e || ' ' || lead(e) OVER w AS e2, e || ' ' || lead(e) OVER w || ' ' || lead(e, 2) OVER w AS e3, r || ' ' || lead(r) OVER w AS r2, r || ' ' || lead(r) OVER w || ' ' || lead(r, 2) OVER w AS r3 FROM s WINDOW w AS (PARTITION BY file_id ORDER BY event_idx))
SELECT file_id, CASE WHEN count(*) >= 8 THEN round({_REP.format(a='e')}, 6) END AS event_repeat, CASE WHEN count(*) >= 8 THEN round({_REP.format(a='r')}, 6) END AS rhythm_repeat FROM g GROUP BY file_id"""


@query(twin(_REPEAT, "ev"))
def g17_repetition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.repetition(events(spark, d)), "event_repeat", "rhythm_repeat")


_STRICT = """sg AS (SELECT file_id, idx, token, CASE WHEN token IN ('BOS', 'FIM_HOLE', 'FIM_MID') OR starts_with(token, 'TEMPO_') OR starts_with(token, 'KEY_') THEN 'S' WHEN token = 'EOS' THEN 'E' WHEN token = 'BAR' THEN 'R' WHEN starts_with(token, 'POS_') THEN 'P'
WHEN starts_with(token, 'INST_') THEN 'I' WHEN starts_with(token, 'PITCH_') THEN 'C' WHEN starts_with(token, 'DUR_') THEN 'D' WHEN starts_with(token, 'VEL_') THEN 'V' ELSE '?' END AS s FROM row r),
w AS (SELECT *, coalesce(lag(s) OVER o, '^') || s AS pair, s || coalesce(lead(s, 1) OVER o, '') || coalesce(lead(s, 2) OVER o, '') || coalesce(lead(s, 3) OVER o, '') || coalesce(lead(s, 4) OVER o, '') AS five, lead(token, 2) OVER o AS t2, lead(token, 3) OVER o AS t3 FROM sg WINDOW o AS (PARTITION BY file_id ORDER BY idx)),
st AS (SELECT file_id, coalesce(min(idx) FILTER (s IN ('E', '?') OR (s = 'P' AND five <> 'PICDV') OR (s IN ('I', 'C', 'D', 'V') AND pair NOT IN ('PI', 'IC', 'CD', 'DV'))), count(*)) AS stop FROM w GROUP BY file_id),
a AS (SELECT w.*, stop, sum((s = 'R')::int) OVER (PARTITION BY w.file_id ORDER BY idx) - 1 AS bar FROM w JOIN st USING (file_id) WHERE idx < stop OR (idx = stop AND s = 'P')),
pe AS (SELECT file_id, idx, bar, substr(token, 5)::int AS pos, substr(t2, 7)::int AS pitch, substr(t3, 5)::int AS dur FROM a WHERE s = 'P' AND idx < stop),
sp AS (SELECT DISTINCT file_id, bar FROM a WHERE s IN ('P', 'R') AND (idx < stop)), k AS (SELECT sp.file_id, sp.bar, count(pe.pos) AS n FROM sp LEFT JOIN pe ON pe.file_id = sp.file_id AND pe.bar = sp.bar GROUP BY ALL),
c AS (SELECT file_id, count(*) AS bar_count, sum(n)::bigint AS event_count, count(*) FILTER (n = 0) AS empty_bars, count(*) FILTER (n <= 1) AS sparse_bars FROM k GROUP BY file_id),
er AS (SELECT file_id, max(m) AS empty_run FROM (SELECT file_id, count(*) AS m FROM (SELECT file_id, bar - row_number() OVER (PARTITION BY file_id ORDER BY bar) AS g FROM k WHERE n = 0) GROUP BY file_id, g) GROUP BY file_id),
vi AS (SELECT file_id, count(*) FILTER (pos < p) AS violations FROM (SELECT file_id, pos, lag(pos) OVER (PARTITION BY file_id, bar ORDER BY idx) AS p FROM (SELECT file_id, bar, idx, try_cast(substr(token, 5) AS int) AS pos FROM a WHERE s = 'P')) GROUP BY file_id),
v AS (SELECT file_id, count(*) FILTER (greatest(0, bar) * 32 + pos < e) AS "overlaps", max(pitch) - min(pitch) AS pitch_span FROM (SELECT *, max(greatest(0, bar) * 32 + pos + dur) OVER (PARTITION BY file_id, pitch ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM pe) GROUP BY file_id)"""


def analysed(spark: SparkSession, d: str) -> DataFrame:
    return O.sequence_metrics(faulty_streams(spark, d))


@query(twin(f"""WITH {_STRICT} SELECT st.file_id, coalesce(bar_count, 0) AS bar_count, coalesce(event_count, 0) AS event_count, coalesce(empty_bars, 0) AS empty_bars, coalesce(sparse_bars, 0) AS sparse_bars, coalesce(empty_run, 0) AS empty_run, coalesce(violations, 0) AS violations, coalesce("overlaps", 0) AS "overlaps",
coalesce(pitch_span, 0) AS pitch_span, round(coalesce(empty_bars / nullif(bar_count, 0)::double, 0), 6) AS empty_bar_rate, round(coalesce("overlaps" / nullif(event_count, 0)::double, 0), 6) AS overlap_rate, coalesce(violations, 0) = 0 AS time_order_valid FROM st LEFT JOIN c USING (file_id) LEFT JOIN er USING (file_id) LEFT JOIN vi USING (file_id) LEFT JOIN v USING (file_id)""", "row"))
def g18_sequence_metrics(spark: SparkSession, d: str) -> DataFrame:
    cols = ["file_id", "bar_count", "event_count", "empty_bars", "sparse_bars", "empty_run", "violations", "overlaps", "pitch_span", "empty_bar_rate", "overlap_rate", "time_order_valid"]
    return rounded(analysed(spark, d), "empty_bar_rate", "overlap_rate").select(*cols)


_EDGE = """r AS (SELECT file_id, idx, token, CASE WHEN idx < 20 THEN 'p' WHEN idx < 31 THEN 'm' ELSE 's' END AS part FROM (SELECT file_id, (idx * 7) % 61 AS idx, token FROM row WHERE idx < 61)),
e AS (SELECT file_id, part, max(idx) FILTER (token = 'BAR') AS lb, min(idx) FILTER (token = 'BAR') AS fb, max(idx) FILTER (token LIKE 'POS%') AS lp, min(idx) FILTER (token LIKE 'POS%') AS fp,
arg_max(try_cast(substr(token, 5) AS int), idx) FILTER (token LIKE 'POS%') AS l, arg_min(try_cast(substr(token, 5) AS int), idx) FILTER (token LIKE 'POS%') AS f FROM r GROUP BY ALL),
x AS (SELECT file_id, part, CASE WHEN lb IS NULL OR lp > lb THEN l END AS l, CASE WHEN fb IS NULL OR fp < fb THEN f END AS f FROM e)
SELECT file_id, coalesce(max(f) FILTER (part = 'm') < max(l) FILTER (part = 'p'), false) AS into_middle, coalesce(max(f) FILTER (part = 's') < max(l) FILTER (part = 'm'), false) AS out_of_middle FROM x GROUP BY file_id"""


@query(twin(f"WITH {_EDGE}", "row"))
def g19_boundary_violations(spark: SparkSession, d: str) -> DataFrame:
    """The first 61 places of every sequence, shuffled by a fixed rule so that time runs back somewhere, cut in prefix, middle and suffix."""
    rows = faulty_streams(spark, d).select("file_id", F.posexplode("tokens").alias("p", "token")).where("p < 61").select("file_id", (F.col("p") * 7 % 61).alias("idx"), "token")
    return O.boundary_violations(rows.where("idx < 20"), rows.where("idx >= 20 AND idx < 31"), rows.where("idx >= 31"))


_BARTOK = """h AS (SELECT file_id, CASE WHEN starts_with(tokens[2], 'TEMPO_') THEN tokens[2] END AS ht, CASE WHEN starts_with(tokens[2], 'KEY_') THEN tokens[2] WHEN starts_with(tokens[2], 'TEMPO_') AND starts_with(tokens[3], 'KEY_') THEN tokens[3] END AS hk FROM btok
WHERE tokens[1] = 'BOS' AND tokens[CASE WHEN starts_with(tokens[2], 'TEMPO_') AND starts_with(tokens[3], 'KEY_') THEN 4 WHEN starts_with(tokens[2], 'TEMPO_') OR starts_with(tokens[2], 'KEY_') THEN 3 ELSE 2 END] = 'BAR'),
bt AS (SELECT r.file_id, idx, row_number() OVER (PARTITION BY r.file_id ORDER BY idx) - 1 AS bar, ht, hk FROM row r JOIN h USING (file_id) WHERE token = 'BAR')"""


@query(twin(f"WITH {_BARTOK} SELECT file_id, bar::int AS bar, idx::int AS start_token, ht AS tempo, hk AS key_token FROM bt", "row"))
def w11_effective_tempo(spark: SparkSession, d: str) -> DataFrame:
    return S.bar_table(faulty_streams(spark, d)).select("file_id", "bar", "start_token", "tempo", "key_token")


# bars of the analysed sequences, their newest analysis, one row a bar
_CURBAR = """cb AS (SELECT seq_id, bar_idx, max(effective_tempo_token) AS tempo FROM bar_info JOIN (SELECT seq_id, max(analysed_at) AS analysed_at FROM bar_info GROUP BY seq_id) USING (seq_id, analysed_at) GROUP BY ALL)"""


def current_bars(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bar_info")
    newest = b.groupBy("seq_id").agg(F.max("analysed_at").alias("analysed_at"))
    return b.join(newest, ["seq_id", "analysed_at"]).groupBy("seq_id", "bar_idx").agg(F.max("effective_tempo_token").alias("tempo"))


@query(f"WITH {_CURBAR} SELECT seq_id, bar_idx, tempo FROM (SELECT *, lag(tempo) OVER (PARTITION BY seq_id ORDER BY bar_idx) AS p FROM cb) WHERE tempo IS NOT NULL AND tempo IS DISTINCT FROM p")
def w10_tempo_on_change(spark: SparkSession, d: str) -> DataFrame:
    before = F.expr("lag(tempo) OVER (PARTITION BY seq_id ORDER BY bar_idx)")
    return current_bars(spark, d).withColumn("p", before).where("tempo IS NOT NULL AND NOT (tempo <=> p)").drop("p")


@query(f"WITH {_CURBAR}, ch AS (SELECT seq_id, bar_idx, tempo FROM (SELECT *, lag(tempo) OVER (PARTITION BY seq_id ORDER BY bar_idx) AS p FROM cb) WHERE tempo IS NOT NULL AND tempo IS DISTINCT FROM p), q AS (SELECT DISTINCT seq_id, start_bar FROM phrase_spans WHERE start_bar IS NOT NULL), f AS (SELECT seq_id, arg_min(tempo, bar_idx) AS first FROM ch GROUP BY seq_id) SELECT q.seq_id, q.start_bar, coalesce(ch.tempo, f.first) AS tempo FROM q ASOF LEFT JOIN ch ON q.seq_id = ch.seq_id AND q.start_bar >= ch.bar_idx LEFT JOIN f ON f.seq_id = q.seq_id")
def j5_asof_tempo(spark: SparkSession, d: str) -> DataFrame:
    """Tempo in force at every phrase's first bar; before the first change the first tempo."""
    changes = w10_tempo_on_change(spark, d).select("seq_id", F.col("bar_idx").alias("bar"), "tempo", F.lit(0).alias("asks"))
    asks = table(spark, d, "phrase_spans").where("start_bar IS NOT NULL").select("seq_id", F.col("start_bar").alias("bar")).distinct().select("seq_id", "bar", F.lit(None).cast("string").alias("tempo"), F.lit(1).alias("asks"))
    both = changes.unionByName(asks)
    upto = F.expr("last_value(tempo) IGNORE NULLS OVER (PARTITION BY seq_id ORDER BY bar, asks ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    first = F.expr("first_value(tempo) IGNORE NULLS OVER (PARTITION BY seq_id ORDER BY bar, asks ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    return both.select("seq_id", "bar", "asks", F.coalesce(upto, first).alias("tempo")).where("asks = 1").select("seq_id", F.col("bar").alias("start_bar"), "tempo")


# -- keys -----------------------------------------------------------------------------------------------------------

_FRAMES = """tot AS (SELECT file_id, greatest((max(bar) + 1) * 32, max(unit + dur))::bigint AS total FROM ev GROUP BY file_id), l AS (SELECT file_id, greatest(32, total) - 32 AS last FROM tot),
fr AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start) - 1 AS frame, start, start + 32 AS "end" FROM (SELECT file_id, unnest(range(0, last + 1, 16)) AS start FROM l UNION SELECT file_id, last FROM l))"""


def file_bars(ev: DataFrame) -> DataFrame:
    return ev.groupBy("file_id").agg((F.max("bar") + 1).alias("bars"))


def frame_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, d)
    return ev, K.frames(K.units_total(ev, file_bars(ev)))


@query(twin(f'WITH {_FRAMES} SELECT file_id, frame::int AS frame, start, "end" FROM fr', "ev"))
def w12_key_frames(spark: SparkSession, d: str) -> DataFrame:
    return frame_parts(spark, d)[1]


_OVER = """ov AS (SELECT ev.file_id, frame, pitch, pos, least("end", unit + dur) - greatest(start, unit) AS overlap FROM ev JOIN fr ON fr.file_id = ev.file_id AND unit < "end" AND unit + dur > start)"""


@query(twin(f"WITH {_FRAMES}, {_OVER} SELECT file_id, frame::int AS frame, pitch, pos, overlap, count(*) AS notes FROM ov GROUP BY ALL", "ev"))
def j7_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = K.frame_overlaps(*frame_parts(spark, d))
    return o.groupBy("file_id", "frame", "pitch", "pos", "overlap").agg(F.count("*").alias("notes"))


_HIST = """hs AS (SELECT fr.file_id, fr.frame, p.range AS pc, coalesce(sum(overlap * CASE WHEN pos = 0 THEN 16 WHEN pos % 8 = 0 THEN 13 ELSE 10 END), 0)::bigint / 10 AS w FROM fr CROSS JOIN range(12) p LEFT JOIN ov ON ov.file_id = fr.file_id AND ov.frame = fr.frame AND pitch % 12 = p.range GROUP BY ALL)"""


def histograms(spark: SparkSession, d: str) -> DataFrame:
    ev, fr = frame_parts(spark, d)
    return K.pitch_class_histogram(K.frame_overlaps(ev, fr), fr)


@query(twin(f"WITH {_FRAMES}, {_OVER}, {_HIST} SELECT file_id, frame::int AS frame, pc::int AS pitch_class, w::double AS weight FROM hs", "ev"))
def g13_pitch_class_hist(spark: SparkSession, d: str) -> DataFrame:
    return histograms(spark, d).select("file_id", "frame", F.posexplode("hist").alias("pitch_class", "weight"))


def _profile(name: str, values: tuple) -> str:
    return f"SELECT '{name}' AS m, [{', '.join(map(str, values))}]::double[] AS v"


_CORR = f"""prof AS ({_profile('maj', K.MAJOR)} UNION ALL {_profile('min', K.MINOR)}), ks AS (SELECT (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[r.range + 1] || ':' || m AS name, p.range AS pc, v[(p.range - r.range + 12) % 12 + 1] AS y FROM prof, range(12) r, range(12) p),
sc AS (SELECT file_id, frame, name, coalesce(CASE WHEN var_pop(w) > 1e-12 THEN corr(w, y) END, 0) AS score FROM hs JOIN ks USING (pc) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY file_id, frame ORDER BY round(score, 9) DESC, name) AS place FROM sc)"""


@query(twin(f"WITH {_FRAMES}, {_OVER}, {_HIST}, {_CORR} SELECT a.file_id, a.frame::int AS frame, round(a.score, 6) AS best, round(greatest(0, a.score - b.score), 6) AS margin FROM rk a JOIN rk b ON a.file_id = b.file_id AND a.frame = b.frame AND a.place = 1 AND b.place = 2", "ev"))
def g30_raw_key_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.raw_frames(histograms(spark, d)).select("file_id", "frame", "best", "margin"), "best", "margin")


_SUPPORT = """WITH {f}, {o}, {h}, {c} SELECT a.file_id, a.frame::int AS frame, a.name, round(sum(greatest(0, b.score) * pow(0.65::double, abs(a.frame - b.frame))), 6) AS support FROM sc a JOIN sc b ON a.file_id = b.file_id AND a.name = b.name AND abs(a.frame - b.frame) <= 3 WHERE a.name IN ('C:maj', 'A:min') GROUP BY ALL"""


@query(twin(_SUPPORT.format(f=_FRAMES, o=_OVER, h=_HIST, c=_CORR), "ev"))
def w13_neighbourhood_support(spark: SparkSession, d: str) -> DataFrame:
    rows = K.neighbourhood_support(K.raw_frames(histograms(spark, d)))
    names = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(K.KEYS.index(k)).alias("i")) for k in ("C:maj", "A:min")])
    return rows.select("file_id", "frame", "support", F.explode(names).alias("k")).select("file_id", "frame", F.col("k.name").alias("name"), F.round(F.get("support", F.col("k.i")), 6).alias("support"))


def key_parts(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    return K.timeline(ev, file_bars(ev))[1]


@query()
def w14_key_segments(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed path and stable segments (W14, W15); checked against brute force in tests."""
    return rounded(key_parts(spark, d), "mean_score", "support")


@query()
def w16_modulations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.modulations(key_parts(spark, d)), "support")


@query()
def g27_dominant_key(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.dominant_key(key_parts(spark, d)), "coverage")


@query()
def g28_key_review(spark: SparkSession, d: str) -> DataFrame:
    """Summary strings of a key timeline: segments as A -> B, modulations as from->to@bar:pos."""
    segs = key_parts(spark, d)
    path = segs.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "name"))), lambda x: x["name"]), " -> ").alias("keys"))
    text = F.concat("from_key", F.lit("->"), "to_key", F.lit("@"), F.col("bar").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    mods = K.modulations(segs).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar", "pos", text.alias("t")))), lambda x: x["t"]), ", ").alias("modulations"))
    return path.join(mods, "file_id", "left").select("file_id", "keys", F.coalesce("modulations", F.lit("none")).alias("modulations"))


@query()
def x0_key_timeline(spark: SparkSession, d: str) -> DataFrame:
    """First key, numbers of segments and modulations of every file; files without a stable key are uncertain."""
    ev = events(spark, d)
    segs = K.timeline(ev, file_bars(ev))[1]
    per = segs.groupBy("file_id").agg(F.min_by("name", "segment").alias("initial_key"), F.count("*").alias("segments"))
    return file_bars(ev).join(per, "file_id", "left").select("file_id", F.coalesce("initial_key", F.lit(K.UNCERTAIN)).alias("initial_key"), F.coalesce("segments", F.lit(0)).alias("segments"))


@query()
def x1_injected_keys(spark: SparkSession, d: str) -> DataFrame:
    s = streams(spark, d)
    bars = S.bar_table(s).select("file_id", "bar", F.lit(None).cast("string").alias("tempo"), F.col("tempo").alias("head_tempo"), F.array_join("body", " ").alias("notes"))
    return K.with_keys(bars, key_parts(spark, d)).select("file_id", F.sha1("text").alias("digest"), F.size(F.split("text", " ")).alias("tokens"))


# -- phrases --------------------------------------------------------------------------------------------------------


def _ratio(c: str) -> str:
    return f"least(1.0::double, greatest(0.0::double, abs(b.{c} - a.{c}) / greatest(1.0::double, abs(a.{c}), abs(b.{c}))))"


_BOUND = f"""bs AS (SELECT b.file_id, b.bar, 0.4 * CASE WHEN a.note_count = 0 OR b.note_count = 0 THEN 1.0 ELSE greatest(a.rest_ratio, b.rest_ratio) END::double AS r, 0.24 * {_ratio('note_count')} AS n, 0.18 * {_ratio('onset_count')} AS o, 0.12 * {_ratio('pitch_span')} AS p, 0.06 * {_ratio('mean_duration')} AS u
FROM info a JOIN info b ON a.file_id = b.file_id AND b.bar = a.bar + 1), sc AS (SELECT *, r + n + o + p + u AS score FROM bs)"""


@query(twin(f"WITH {_INFO}, {_BOUND} SELECT file_id, bar, round(score, 6) AS score, concat_ws(',', CASE WHEN r >= 0.1 THEN 'rest_gap' END, CASE WHEN n >= 0.1 THEN 'note_density_delta' END, CASE WHEN o >= 0.1 THEN 'onset_density_delta' END, CASE WHEN p >= 0.1 THEN 'pitch_span_delta' END, CASE WHEN u >= 0.1 THEN 'duration_delta' END) AS reasons FROM sc", "grid"))
def w17_boundary_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.boundary_scores(summary(spark, d)), "score").withColumn("reasons", F.array_join("reasons", ","))


@query(twin(f"WITH {_INFO} SELECT b.file_id, b.bar, a.note_count AS left_notes, b.note_count AS right_notes FROM info a JOIN info b ON a.file_id = b.file_id AND b.bar = a.bar + 1", "grid"))
def j9_adjacent_bars(spark: SparkSession, d: str) -> DataFrame:
    left = F.expr("lag(note_count) OVER (PARTITION BY file_id ORDER BY bar)")
    return summary(spark, d).select("file_id", "bar", left.alias("left_notes"), F.col("note_count").alias("right_notes")).where("left_notes IS NOT NULL")


@query(twin(f"WITH {_INFO}, {_BOUND}, q AS (SELECT file_id, list_sort(list(round(score, 9)))[round_even((count(*) - 1) * 0.75, 0)::int + 1] AS q FROM sc GROUP BY file_id) SELECT file_id, q AS threshold FROM q", "grid"))
def g12_quantile_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = P.boundary_scores(summary(spark, d)).groupBy("file_id").agg(F.array_sort(F.collect_list(F.round("score", 9))).alias("s"))
    return s.select("file_id", F.element_at("s", N.whole((F.size("s") - 1) * 0.75) + 1).alias("threshold"))


@query(twin(f"WITH {_INFO}, {_BOUND}, r AS (SELECT file_id, bar, round(score, 9) AS score FROM sc), q AS (SELECT file_id, list_sort(list(score))[round_even((count(*) - 1) * 0.75, 0)::int + 1] AS q FROM r GROUP BY file_id) SELECT file_id, bar FROM (SELECT *, coalesce(lag(score) OVER w, -1) AS p, coalesce(lead(score) OVER w, -1) AS n FROM r JOIN q USING (file_id) WINDOW w AS (PARTITION BY file_id ORDER BY bar)) WHERE score >= q AND score >= p AND score >= n", "grid"))
def w18_candidate_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return P.candidate_boundaries(P.boundary_scores(summary(spark, d)).withColumn("score", F.round("score", 9))).select("file_id", "bar")


def phrases(spark: SparkSession, d: str) -> DataFrame:
    info = summary(spark, d)
    return P.phrase_spans(P.boundary_scores(info), info.groupBy("file_id").agg(F.count("*").alias("bars")))


@query()
def w19_phrase_spans(spark: SparkSession, d: str) -> DataFrame:
    return phrases(spark, d)


@query()
def x5_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases with their own token windows, as digest and length."""
    w = S.bar_windows(S.bar_table(streams(spark, d)), phrases(spark, d).select("file_id", "first", "last"))
    return w.select("file_id", "first", "last", F.sha1(F.array_join("tokens", " ")).alias("digest"), F.size("tokens").alias("length"))


_CURPH = """cp AS (SELECT seq_id, phrase_idx AS phrase, max(start_bar) AS first, max(end_bar) AS last FROM phrase_spans JOIN (SELECT seq_id, max(analysed_at) AS analysed_at FROM phrase_spans GROUP BY seq_id) USING (seq_id, analysed_at) WHERE start_bar IS NOT NULL AND end_bar > start_bar GROUP BY ALL)"""


def stored_phrases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "phrase_spans")
    newest = p.groupBy("seq_id").agg(F.max("analysed_at").alias("analysed_at"))
    now = p.join(newest, ["seq_id", "analysed_at"]).where("start_bar IS NOT NULL AND end_bar > start_bar")
    return now.groupBy("seq_id", F.col("phrase_idx").alias("phrase")).agg(F.max("start_bar").alias("first"), F.max("end_bar").alias("last"))


@query(f"WITH {_CURPH} SELECT w.seq_id, w.phrase, count(m.first)::int AS boundaries FROM cp w LEFT JOIN cp m ON m.seq_id = w.seq_id AND m.phrase > 0 AND m.first > w.first - 3 AND m.first < w.last + 3 GROUP BY w.seq_id, w.phrase")
def j8_boundaries_inside(spark: SparkSession, d: str) -> DataFrame:
    """Phrase starts strictly within three bars around every stored phrase."""
    p = stored_phrases(spark, d)
    w = p.select("seq_id", "phrase", (F.col("first") - 3).alias("first"), (F.col("last") + 3).alias("last"))
    return P.boundary_counts(w, p, "seq_id").select("seq_id", "phrase", "boundaries")


@query(f"WITH {_CURPH} SELECT DISTINCT a.seq_id, a.first, b.last FROM cp a JOIN cp b ON a.seq_id = b.seq_id AND b.phrase > a.phrase AND b.phrase < a.phrase + 12 AND b.last - a.first BETWEEN 6 AND 12")
def j11_phrase_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.window_candidates(stored_phrases(spark, d), "long_context", 6, 12, "seq_id").distinct()


_SINGLE = "SELECT seq_id, first, last FROM cp WHERE last - first BETWEEN 2 AND 4 UNION ALL SELECT seq_id, s, s + n FROM (SELECT seq_id, last, n, unnest(range(first, last - n + 1)) AS s FROM cp, (SELECT unnest([2, 3, 4]) AS n) WHERE last - first > 4)"
_CROSS = "SELECT seq_id, mark - l, mark + n - l FROM (SELECT seq_id, first, last AS mark, lead(last) OVER (PARTITION BY seq_id ORDER BY phrase) AS fin FROM cp), (SELECT a.n, b.l FROM (SELECT unnest([2, 3, 4]) AS n) a, (SELECT unnest([1, 2, 3]) AS l) b WHERE l < n) WHERE fin IS NOT NULL AND l <= mark - first AND n - l <= fin - mark"


@query(f"WITH {_CURPH} SELECT kind, seq_id, first::int AS first, last::int AS last FROM (SELECT 'single_phrase' AS kind, * FROM ({_SINGLE}) UNION ALL SELECT 'cross_boundary', * FROM ({_CROSS}))")
def x6_window_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = stored_phrases(spark, d)
    kinds = [P.window_candidates(p, k, 2, 4, "seq_id").select(F.lit(k).alias("kind"), "seq_id", "first", "last") for k in ("single_phrase", "cross_boundary")]
    return kinds[0].unionByName(kinds[1])


@query(f"WITH {_CURPH} SELECT seq_id, arg_min(first, h)::int AS first, arg_min(last, h)::int AS last FROM (SELECT seq_id, first, last, md5('7:' || seq_id || ':' || first || ':' || last) AS h FROM (SELECT DISTINCT * FROM ({_SINGLE}))) GROUP BY seq_id")
def x6_picked_window(spark: SparkSession, d: str) -> DataFrame:
    c = P.window_candidates(stored_phrases(spark, d), "single_phrase", 2, 4, "seq_id").distinct()
    return P.picked(c, ["seq_id"], ["first", "last"], 7)


@query(twin("SELECT file_id, event_idx, pitch, free_at FROM (SELECT *, max(unit + greatest(1, dur)) OVER (PARTITION BY file_id, pitch ORDER BY event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS free_at FROM ev) WHERE unit < free_at", "ev"))
def d2_blocked_onsets(spark: SparkSession, d: str) -> DataFrame:
    return O.blocked_onsets(events(spark, d))
