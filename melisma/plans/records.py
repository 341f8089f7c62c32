"""Queries of corpus housekeeping, training logs, checkpoint choice and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import text as X
from melisma.operators import corpus as C
from melisma.operators import training as T
from melisma.plans.functions import checkpoint_names
from melisma.plans.registry import query
from melisma.plans.views import checkpoints, records, training_log, twin
from melisma.tables import table


@query(twin("SELECT file_id, content_hash FROM cur WHERE content_hash IS NULL OR file_id IN (SELECT arg_min(file_id, rel_path) FROM cur WHERE content_hash IS NOT NULL AND rel_path IS NOT NULL GROUP BY content_hash)", "cur"))
def o14_dedup(spark: SparkSession, d: str) -> DataFrame:
    return C.first_of_each(records(spark, d).where("content_hash IS NULL OR rel_path IS NOT NULL").select("file_id", "rel_path", "content_hash"), "content_hash", ["rel_path"]).select("file_id", "content_hash")


@query(twin("SELECT midi_path, min(file_id) AS file_id FROM cur WHERE midi_path IS NOT NULL GROUP BY midi_path", "cur"))
def o15_distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    return C.first_of_each(records(spark, d).where("midi_path IS NOT NULL").select("midi_path", "file_id"), "midi_path", ["file_id"])


_GROUPS = """, e AS (SELECT file_id AS a, min(file_id) OVER (PARTITION BY content_hash) AS b FROM cur WHERE content_hash IS NOT NULL UNION SELECT file_id, min(file_id) OVER (PARTITION BY family_key) FROM cur WHERE family_key IS NOT NULL),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT file_id AS a, file_id AS b FROM cur UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b)"""


@query(twin(f"WITH x AS (SELECT 1){_GROUPS} SELECT a AS file_id, min(b) AS \"group\" FROM reach GROUP BY a", "cur").replace("WITH ", "WITH RECURSIVE ", 1))
def o16_leakage_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.leakage_groups(records(spark, d), ["family_key", "content_hash"])


@query()
def o17_split(spark: SparkSession, d: str) -> DataFrame:
    groups = C.leakage_groups(records(spark, d), ["family_key", "content_hash"])
    targets = [(r[0], r[1]) for r in table(spark, d, "split_targets").where("split_name IS NOT NULL AND target_share IS NOT NULL").orderBy("split_name").collect()]
    return C.split_groups(groups, targets)


@query(twin("SELECT file_id FROM (SELECT file_id, row_number() OVER (ORDER BY md5('49:' || file_id), file_id) AS n, count(*) OVER () AS t FROM cur WHERE split = 'test') WHERE n <= greatest(1, round_even(t * 0.2::double, 0))", "cur"))
def o18_fixed_eval(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the test files, at least one, drawn by digest."""
    t = records(spark, d).where("split = 'test'").select("file_id")
    n = t.agg(F.greatest(F.lit(1), F.rint(F.count("*") * 0.2)).cast("int").alias("n")).first()["n"]
    return C.hashed_sample(t, n, 49, "file_id")


@query(twin("SELECT file_id, rel_path FROM cur WHERE rel_path IS NOT NULL ORDER BY md5('11:' || file_id), file_id LIMIT 20", "cur"))
def o19_file_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.hashed_sample(records(spark, d).where("rel_path IS NOT NULL").select("file_id", "rel_path"), 20, 11, "file_id").orderBy("rel_path", "file_id")


@query(twin("SELECT file_id, rel_path FROM cur WHERE rel_path IS NOT NULL ORDER BY rel_path, file_id LIMIT 25", "cur"))
def o1_sorted_limit(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("rel_path IS NOT NULL").select("file_id", "rel_path").orderBy("rel_path", "file_id").limit(25)


@query(twin("SELECT file_id FROM cur WHERE rel_path IS NOT NULL AND lower(rel_path) SIMILAR TO '.*\\.midi?'", "cur"))
def s1_listed_files(spark: SparkSession, d: str) -> DataFrame:
    """The listing rule of the file source, over recorded paths: .mid and .midi in any case."""
    from melisma.sources.files import is_midi

    return records(spark, d).where(is_midi(F.col("rel_path"))).select("file_id")


_CUTS = "q AS (SELECT s[round_even((len(s) - 1) * 0.25, 0)::int + 1] AS q1, s[round_even((len(s) - 1) * 0.5, 0)::int + 1] AS q2, s[round_even((len(s) - 1) * 0.75, 0)::int + 1] AS q3 FROM (SELECT list_sort(list({c}::double)) AS s FROM cur WHERE {c} IS NOT NULL))"
_CASES = f"""{_CUTS.format(c='note_count')}, p AS ({_CUTS.format(c='duration_sec')[6:-1]}), cs AS (SELECT file_id, 'note_q' || CASE WHEN note_count <= q.q1 THEN 0 WHEN note_count <= q.q2 THEN 1 WHEN note_count <= q.q3 THEN 2 ELSE 3 END || '_dur_q' || CASE WHEN duration_sec <= p.q1 THEN 0 WHEN duration_sec <= p.q2 THEN 1 WHEN duration_sec <= p.q3 THEN 2 ELSE 3 END AS bucket
FROM cur, q, p WHERE note_count IS NOT NULL AND duration_sec IS NOT NULL)"""


def bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Files with the label of their quartiles of notes and duration. The cuts are one row each."""
    cur = records(spark, d).select("file_id", "note_count", "duration_sec")
    q, p = C.quartile_cuts(cur, "note_count"), C.quartile_cuts(cur, "duration_sec")
    rows = cur.where("note_count IS NOT NULL AND duration_sec IS NOT NULL").join(F.broadcast(q.select(*[F.col(c).alias(f"n_{c}") for c in q.columns]))).join(F.broadcast(p.select(*[F.col(c).alias(f"d_{c}") for c in p.columns])))
    label = X.bucket_label(C.quartile_bucket(F.col("note_count"), "n_"), C.quartile_bucket(F.col("duration_sec"), "d_"))
    return rows.select("file_id", label.alias("bucket"))


@query(twin(f"WITH {_CASES} SELECT * FROM cs", "cur"))
def g11_quartile_buckets(spark: SparkSession, d: str) -> DataFrame:
    return bucketed(spark, d)


@query(twin(f"WITH {_CASES} SELECT bucket, count(*) AS files FROM cs GROUP BY bucket", "cur"))
def f38_bucket_label(spark: SparkSession, d: str) -> DataFrame:
    return bucketed(spark, d).groupBy("bucket").agg(F.count("*").alias("files"))


@query(twin(f"WITH {_CASES} SELECT bucket, file_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY file_id) AS turn FROM cs) ORDER BY turn, bucket LIMIT 12", "cur"))
def o4_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return C.round_robin(bucketed(spark, d), "bucket", ["file_id"], 12)


@query(twin(f"WITH {_CASES} SELECT bucket, file_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:' || file_id), file_id) AS n FROM cs) WHERE n <= 6 ORDER BY bucket, file_id LIMIT 40", "cur"))
def o5_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    kept = C.per_bucket(bucketed(spark, d), "bucket", [C.hashed_order(42, "file_id"), "file_id"], 6)
    return kept.orderBy("bucket", "file_id").limit(40)


@query(twin(f"WITH {_CASES} SELECT cs.bucket, cs.file_id, note_count FROM cs JOIN cur USING (file_id) WHERE file_id IN (SELECT file_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY file_id) AS turn FROM cs) ORDER BY turn, bucket LIMIT 12)", "cur"))
def x12_capture_manifest(spark: SparkSession, d: str) -> DataFrame:
    picked = C.round_robin(bucketed(spark, d), "bucket", ["file_id"], 12).select("file_id")
    return bucketed(spark, d).join(records(spark, d).select("file_id", "note_count"), "file_id").join(F.broadcast(picked), "file_id", "left_semi").select("bucket", "file_id", "note_count")


@query(twin("SELECT file_id FROM cur WHERE file_id IN (SELECT file_id FROM note_events)", "cur"))
def j14_semi_capture(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("file_id").join(table(spark, d, "note_events").select("file_id").distinct(), "file_id", "left_semi")


@query(twin("SELECT file_id FROM cur WHERE file_id NOT IN (SELECT file_id FROM note_events WHERE file_id IS NOT NULL)", "cur"))
def j15_anti_unseen(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("file_id").join(table(spark, d, "note_events").select("file_id"), "file_id", "left_anti")


@query(twin("SELECT source FROM cur WHERE source IS NOT NULL UNION SELECT source FROM documents WHERE source IS NOT NULL", "cur"))
def o11_key_union(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("source").union(table(spark, d, "documents").select("source")).where("source IS NOT NULL").distinct()


@query("SELECT source FROM documents WHERE source IS NOT NULL EXCEPT SELECT source FROM mix_targets")
def o12_key_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").where("source IS NOT NULL").exceptAll(table(spark, d, "mix_targets").select("source")).distinct().join(table(spark, d, "mix_targets").select("source"), "source", "left_anti")


@query("SELECT source FROM documents WHERE source IS NOT NULL INTERSECT SELECT source FROM mix_targets")
def o13_key_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").where("source IS NOT NULL").intersect(table(spark, d, "mix_targets").select("source"))


# -- training log ---------------------------------------------------------------------------------------------------

_EMA = """s AS (SELECT *, sum((event = 'train' AND logged_ema IS NOT NULL)::int) OVER w AS stretch FROM log WINDOW w AS (PARTITION BY run ORDER BY line_no)),
em AS (SELECT run, line_no, event, loss, valid_loss, logged_ema, list_reduce(list(CASE WHEN event = 'train' THEN coalesce(logged_ema, loss) END) FILTER (event = 'train' AND coalesce(logged_ema, loss) IS NOT NULL) OVER (PARTITION BY run, stretch ORDER BY line_no), lambda a, x: 0.1::double * x + (1 - 0.1::double) * a) AS ema FROM s)"""


@query(twin(f"WITH {_EMA} SELECT run, line_no, ema FROM em", "log"))
def w7_loss_ema(spark: SparkSession, d: str) -> DataFrame:
    return T.loss_ema(training_log(spark, d)).select("run", "line_no", "ema")


@query(twin(f"WITH {_EMA} SELECT run, line_no, ema FROM em WHERE event = 'eval'", "log"))
def j6_latest_ema(spark: SparkSession, d: str) -> DataFrame:
    """What every eval row sees: the latest training mean written before it."""
    return T.loss_ema(training_log(spark, d)).where("event = 'eval'").select("run", "line_no", "ema")


@query(twin("SELECT run, line_no, min(valid_loss) OVER (PARTITION BY run ORDER BY line_no) AS best FROM log QUALIFY event = 'eval'", "log"))
def w8_best_so_far(spark: SparkSession, d: str) -> DataFrame:
    best = F.expr("min(valid_loss) OVER (PARTITION BY run ORDER BY line_no)")
    return training_log(spark, d).withColumn("best", best).where("event = 'eval'").select("run", "line_no", "best")


_ALIGN = f"{_EMA}, al AS (SELECT run, line_no // 2 AS step, event, line_no, loss, valid_loss, ema, CASE WHEN event = 'eval' THEN min(valid_loss) OVER (PARTITION BY run ORDER BY line_no) END AS best_so_far, valid_loss - ema AS overfit_gap, greatest(0, line_no // 2) * 8 * 512 AS tokens_seen FROM em QUALIFY row_number() OVER (PARTITION BY run, event, line_no // 2 ORDER BY line_no DESC) = 1)"


def aligned(spark: SparkSession, d: str) -> DataFrame:
    log = training_log(spark, d).withColumn("line_no", F.col("line_no").cast("long")).withColumn("step", F.expr("line_no div 2"))
    return T.aligned_log(log, 8, 512)


@query(twin(f"WITH {_ALIGN} SELECT run, step, event, line_no, ema, best_so_far, overfit_gap, tokens_seen FROM al", "log"))
def g25_aligned_log(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("run", "step", "event", "line_no", "ema", "best_so_far", "overfit_gap", "tokens_seen")


@query(twin("SELECT run, step, event, line_no, loss, valid_loss FROM (SELECT *, line_no // 2 AS step FROM log) QUALIFY row_number() OVER (PARTITION BY run, event, step ORDER BY line_no DESC) = 1 ORDER BY run, event, step", "log"))
def s12_history(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("run", "step", "event", "line_no", "loss", "valid_loss").orderBy("run", "event", "step")


_SUM = f"""WITH {_ALIGN}, b AS (SELECT run, arg_min(step, (valid_loss, step)) AS best_step FROM al WHERE valid_loss IS NOT NULL GROUP BY run)
SELECT al.run, count(*) FILTER (event = 'train') AS train_rows, count(*) FILTER (event = 'eval') AS eval_rows, max(step) FILTER (event = 'train') AS last_train_step, max(step) FILTER (event = 'eval') AS last_eval_step,
max_by(loss, step) FILTER (event = 'train') AS latest_train_loss, max_by(valid_loss, step) FILTER (event = 'eval') AS latest_valid_loss, min(valid_loss) AS best_valid_loss, max(best_step) AS best_valid_step, count(*) FILTER (event = 'eval' AND step > best_step) AS plateau,
round(avg(loss), 10) AS train_loss_mean, round(median(loss), 6) AS train_loss_median, CASE WHEN count(loss) > 1 THEN round(stddev_pop(loss), 6) END AS train_loss_std, min(loss) AS train_loss_min, min(ema) FILTER (event = 'train') AS train_ema_min FROM al LEFT JOIN b USING (run) GROUP BY al.run"""


@query(twin(_SUM, "log"))
def g26_training_summary(spark: SparkSession, d: str) -> DataFrame:
    s = T.log_summary(aligned(spark, d))
    return s.withColumns({c: F.round(c, 10 if c == "train_loss_mean" else 6) for c in ("train_loss_mean", "train_loss_median", "train_loss_std")})


@query(twin(f"WITH {_ALIGN}, b AS (SELECT run, arg_min(step, (valid_loss, step)) AS best_step FROM al WHERE valid_loss IS NOT NULL GROUP BY run) SELECT run, count(*) FILTER (step > best_step) AS plateau FROM al JOIN b USING (run) WHERE event = 'eval' GROUP BY run", "log"))
def w22_plateau(spark: SparkSession, d: str) -> DataFrame:
    return T.log_summary(aligned(spark, d)).where("best_valid_step IS NOT NULL").select("run", "plateau")


@query(twin("SELECT event, count(*) AS lines, count(loss) AS losses, count(valid_loss) AS valid_losses, count(logged_ema) AS logged FROM log GROUP BY event", "log"))
def s9_log_scan(spark: SparkSession, d: str) -> DataFrame:
    return training_log(spark, d).groupBy("event").agg(F.count("*").alias("lines"), F.count("loss").alias("losses"), F.count("valid_loss").alias("valid_losses"), F.count("logged_ema").alias("logged"))


_STEPLOSS = "SELECT step, checkpoint, CASE WHEN step % 5 = 0 THEN NULL ELSE valid_loss END AS valid_loss FROM ckpt"


def with_gaps(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints(spark, d).withColumn("valid_loss", F.expr("CASE WHEN step % 5 <> 0 THEN valid_loss END"))


@query(twin(f"SELECT step, checkpoint, place FROM (SELECT *, row_number() OVER (ORDER BY kind, CASE WHEN kind = 1 THEN valid_loss ELSE 0 END, step)::int AS place FROM (SELECT *, CASE WHEN valid_loss IS NULL THEN 2 WHEN row_number() OVER (PARTITION BY valid_loss IS NULL ORDER BY step) <= 4 THEN 0 ELSE 1 END AS kind FROM ({_STEPLOSS}))) WHERE place <= 16", "ckpt"))
def o8_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return T.prefiltered(with_gaps(spark, d), 16, 4).select("step", "checkpoint", "place")


@query(twin("SELECT step FROM (SELECT step, row_number() OVER (ORDER BY step) - 1 AS i, count(*) OVER () AS t FROM ckpt) WHERE t <= 7 OR list_contains(list_transform(range(7), lambda k: round_even(k * (t - 1) / 6.0::double, 0)::int), i)", "ckpt"))
def o9_evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    return T.evenly_spaced(checkpoints(spark, d).select("step"), 7, "step")


_NAMES = "(SELECT DISTINCT name FROM (SELECT checkpoint AS name FROM ckpt UNION ALL SELECT unnest(['best.pt', 'last.pt', 'latest.pt', 'step_x.pt', 'notes.pt'])))"


@query(twin(f"SELECT name, row_number() OVER (ORDER BY CASE WHEN regexp_matches(name, '^step_[0-9]+\\.pt$') THEN 0 WHEN name = 'best.pt' THEN 1 WHEN name = 'last.pt' THEN 2 WHEN name = 'latest.pt' THEN 3 ELSE 4 END, coalesce(try_cast(regexp_extract(name, '^step_([0-9]+)\\.pt$', 1) AS bigint), 0), name)::int AS place FROM {_NAMES}", "ckpt"))
def o10_discovered(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    names = checkpoint_names(spark, d).distinct()
    order = W.orderBy(X.checkpoint_class(F.col("name")), F.coalesce(X.checkpoint_step(F.col("name")), F.lit(0)), "name")
    return names.select("name", F.row_number().over(order).alias("place"))


# -- choice and scores ----------------------------------------------------------------------------------------------


def _rank(c: str, goal: str) -> str:
    order = "DESC" if goal == "max" else "ASC"
    return f"(SELECT step, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE 1 - (rank() OVER (ORDER BY {c} {order}) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::double) / (count(*) OVER () - 1) END::double AS r FROM ckpt WHERE {c} IS NOT NULL)"


@query(twin(f"SELECT ckpt.step, round(a.r, 6) AS structural_rank, round(b.r, 6) AS loss_rank FROM ckpt LEFT JOIN {_rank('structural', 'max')} a ON a.step = ckpt.step LEFT JOIN {_rank('valid_loss', 'min')} b ON b.step = ckpt.step", "ckpt"))
def w20_rank_score(spark: SparkSession, d: str) -> DataFrame:
    c = checkpoints(spark, d)
    return c.select("step", F.round(T.rank_score(F.col("structural"), "max"), 6).alias("structural_rank"), F.round(T.rank_score(F.col("valid_loss"), "min"), 6).alias("loss_rank"))


_GATES = """gt AS (SELECT *, concat_ws(',', CASE WHEN stop < 0.2 THEN 'stop<0.2000' END, CASE WHEN budget > 0.4 THEN 'budget>0.4000' END, CASE WHEN time_order < 0.77 THEN 'time_order<0.7700' END, CASE WHEN structural IS NULL THEN 'structural=NA' WHEN structural < 0.8 THEN 'structural<0.8000' END) AS failed FROM ckpt)"""
_SPECS = [("stop", "max", 0.20), ("budget", "min", 0.40), ("time_order", "max", 0.77), ("structural", "max", 0.80)]


@query(twin(f"WITH {_GATES} SELECT step, failed = '' AS passed, failed FROM gt", "ckpt"))
def p10_gates(spark: SparkSession, d: str) -> DataFrame:
    return T.gates(checkpoints(spark, d), _SPECS).select("step", "passed", F.array_join("failed", ",").alias("failed"))


_W = T.PROFILE["weights"]
_BALANCED = (
    "bl AS (SELECT ckpt.*, (" + " + ".join(f"coalesce(r{i}.r * {w}, 0)" for i, (_, _, w) in enumerate(_W)) + ") / nullif(" + " + ".join(f"CASE WHEN r{i}.r IS NULL THEN 0 ELSE {w} END" for i, (_, _, w) in enumerate(_W)) + ", 0)::double AS score, ("
    + " + ".join(f"CASE WHEN r{i}.r IS NULL THEN 0 ELSE {w} END" for i, (_, _, w) in enumerate(_W)) + ")::double AS coverage FROM ckpt " + " ".join(f"LEFT JOIN {_rank(c, g)} r{i} ON r{i}.step = ckpt.step" for i, (c, g, _) in enumerate(_W)) + ")"
)
_BOARD = """bo AS (SELECT step, score, coverage, coalesce(stop >= 0.2 AND budget <= 0.75 AND time_order >= 0.85, false) AS passed, structural, time_order, stop, valid_loss FROM bl),
pl AS (SELECT *, CASE WHEN score IS NOT NULL AND (passed OR NOT any_passed) THEN row_number() OVER (PARTITION BY passed OR NOT any_passed ORDER BY round(score, 12) DESC, structural DESC NULLS LAST, time_order DESC NULLS LAST, stop DESC NULLS LAST, valid_loss ASC NULLS LAST, step DESC)::int END AS place FROM (SELECT *, bool_or(passed) OVER () AS any_passed FROM bo))"""


@query(twin(f"WITH {_BALANCED}, {_BOARD} SELECT step, place, round(score, 6) AS score, round(coverage, 6) AS coverage, passed FROM pl", "ckpt"))
def o6_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    b = T.leaderboard(checkpoints(spark, d))
    return b.select("step", "place", F.round("balanced_score", 6).alias("score"), F.round("coverage", 6).alias("coverage"), "passed")


@query(twin(f"WITH {_BALANCED}, {_BOARD} SELECT step, place FROM pl WHERE place <= 3", "ckpt"))
def o7_top_three(spark: SparkSession, d: str) -> DataFrame:
    return T.leaderboard(checkpoints(spark, d)).where("place <= 3").select("step", "place")


@query("SELECT unnest(['structural', 'time_order', 'empty_bar', 'stop', 'budget', 'first_event', 'syntax_invalid', 'valid_loss', 'step']) AS metric, unnest(range(9))::int AS place")
def o6b_board_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the board: weighted metrics, then tie-breakers, each once."""
    names = [n for n, _, _ in T.PROFILE["weights"]] + [n for n, _ in T.PROFILE["ties"]]
    return spark.range(1).select(F.posexplode(F.array_distinct(F.array(*[F.lit(n) for n in names]))).alias("place", "metric"))


_FAST = "fa AS (SELECT step, checkpoint, stop AS score, time_order FROM ckpt), fo AS (SELECT step, structural AS score FROM ckpt WHERE step % 3 = 0)"


@query(twin(f"WITH {_FAST} SELECT fa.step, fa.score AS fast_score, CASE WHEN fo.step IS NOT NULL THEN fo.score ELSE fa.score END AS score, fo.step IS NOT NULL AS formal FROM fa LEFT JOIN fo ON fo.step = fa.step", "ckpt"))
def j3_override_merge(spark: SparkSession, d: str) -> DataFrame:
    """A formal result overrides the fast one, even with a missing value."""
    c = checkpoints(spark, d)
    formal = c.where("step % 3 = 0").select("step", F.col("structural").alias("f"), F.lit(True).alias("formal"))
    both = c.select("step", F.col("stop").alias("fast_score")).join(formal, "step", "left")
    return both.select("step", "fast_score", F.when(F.col("formal"), F.col("f")).otherwise(F.col("fast_score")).alias("score"), F.coalesce("formal", F.lit(False)).alias("formal"))


@query(twin(f"WITH {_ALIGN} SELECT c.step, e.valid_loss AS logged_loss, CASE WHEN e.step IS NOT NULL THEN e.tokens_seen ELSE t.tokens_seen END AS tokens_seen FROM ckpt c LEFT JOIN al e ON e.step = c.step AND e.event = 'eval' AND e.run = 1 LEFT JOIN al t ON t.step = c.step AND t.event = 'train' AND t.run = 1", "log", "ckpt"))
def j4_training_at_step(spark: SparkSession, d: str) -> DataFrame:
    log = aligned(spark, d).where("run = 1")
    ev = log.where("event = 'eval'").select("step", F.col("valid_loss").alias("logged_loss"), F.col("tokens_seen").alias("e"), F.lit(True).alias("has"))
    tr = log.where("event = 'train'").select("step", F.col("tokens_seen").alias("t"))
    c = checkpoints(spark, d).select("step").join(ev, "step", "left").join(tr, "step", "left")
    return c.select("step", "logged_loss", F.when(F.col("has"), F.col("e")).otherwise(F.col("t")).alias("tokens_seen"))


# metrics of the absolute score that the checkpoint rows have
_HAS = {"stop_success": "stop", "budget_stop": "budget", "cont_structural": "structural", "cont_time_order": "time_order", "empty_bar": "empty_bar", "cont_syntax_invalid": "syntax_invalid", "first_event": "first_event", "valid_loss": "valid_loss"}


def _absolute_sql() -> str:
    def smooth(t: str) -> str:
        t = f"greatest(0.0::double, least(1.0::double, {t}))"
        return f"({t} * {t} * (3 - 2 * {t}))"

    def piece(v: str, goal: str, bad: float, ok: float, ideal: float) -> str:
        if goal == "max":
            return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= {bad} THEN 0 WHEN {v} >= {ideal} THEN 100 WHEN {v} <= {ok} THEN 60 * {smooth(f'({v} - {bad}) / ({ok} - {bad})::double')} ELSE 60 + 40 * {smooth(f'({v} - {ok}) / ({ideal} - {ok})::double')} END::double"
        return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} >= {bad} THEN 0 WHEN {v} <= {ideal} THEN 100 WHEN {v} >= {ok} THEN 60 * {smooth(f'({bad} - {v}) / ({bad} - {ok})::double')} ELSE 60 + 40 * {smooth(f'({ok} - {v}) / ({ok} - {ideal})::double')} END::double"

    parts, total, have = [], [], []
    for (name, weight), metrics in T.DIMENSIONS.items():
        mine = [(w, piece(_HAS[m], g, b, o, i), _HAS[m]) for m, g, w, b, o, i in metrics if m in _HAS]
        full = sum(x[2] for x in metrics)
        used = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for w, _, c in mine) or "0"
        parts.append(f"({' + '.join(f'coalesce({w} * {s}, 0)' for w, s, _ in mine) or '0'})::double / nullif({used}, 0)::double AS {name}, ({used}) / {full}::double AS u_{name}")
        total.append(f"{weight} * u_{name} * coalesce({name}, 0)")
        have.append(f"{weight} * u_{name}")
    names = [n for n, _ in T.DIMENSIONS]
    return f"SELECT step, {', '.join(f'round({n}, 6) AS {n}' for n in names)}, round(({' + '.join(total)}) / nullif({' + '.join(have)}, 0), 6) AS absolute_score, round(({' + '.join(have)}) / {sum(w for _, w in T.DIMENSIONS)}, 6) AS coverage FROM (SELECT step, {', '.join(parts)} FROM ckpt)"


@query(twin(_absolute_sql(), "ckpt"))
def g24_absolute_score(spark: SparkSession, d: str) -> DataFrame:
    c = checkpoints(spark, d).select("step", *[F.col(c).alias(m) for m, c in _HAS.items()])
    s = T.absolute_scores(c, ["step"])
    return s.select("step", *[F.round(c, 6).alias(c) for c in s.columns if c != "step"])
