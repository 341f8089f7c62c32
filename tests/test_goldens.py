"""Published numbers and hand-made cases, and folds against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from melisma.functions import numeric as N
from melisma.operators import corpus, decoding, grammar, keys, notes, phrases, sequences, structure, tokens, training, windows
from melisma.sources import files, midi


def test_vocabulary_ids(spark):
    ids = {r["token"]: r["id"] for r in tokens.vocabulary(spark).collect()}
    assert len(ids) == 268
    assert [ids[t] for t in ("BAR", "TEMPO_40", "TEMPO_220", "KEY_C_MAJ", "KEY_B_MIN", "KEY_UNCERTAIN")] == [4, 152, 242, 243, 266, 267]


def events(spark, rows):
    return spark.createDataFrame([(1, i, 0, i, p, 1) for i, p in enumerate(rows)], "file_id long, event_idx long, bar long, pos int, pitch int, dur int").withColumn("unit", F.col("pos"))


def test_pitch_ratios(spark):
    r = structure.pitch_collapse(events(spark, [60, 60, 60, 60, 60, 64, 67, 69])).first()
    assert r["most_common_ratio"] == 5 / 8
    r = structure.pitch_collapse(events(spark, [60, 62, 64, 64, 64, 64, 64, 67])).first()
    assert r["longest_run_ratio"] == 5 / 8
    assert structure.pitch_collapse(events(spark, [60, 62])).first()["most_common_ratio"] is None


def test_training_log_numbers(spark):
    log = spark.createDataFrame([(1, 1, "train", 5.0, None, None), (1, 2, "train", 3.0, None, None), (1, 3, "eval", None, 2.5, None)], "run int, line_no long, event string, loss double, valid_loss double, logged_ema double")
    rows = {r["line_no"]: r for r in training.aligned_log(log.withColumn("step", F.lit(2).cast("long")), 4, 8).collect()}
    assert rows[3]["ema"] == pytest.approx(4.8) and rows[3]["overfit_gap"] == pytest.approx(-2.3) and rows[3]["tokens_seen"] == 64


def stack_pairs(stream):
    open_, out = [], []
    for n, d in enumerate(stream):
        if d > 0:
            open_.append(n)
        elif open_:
            out.append((open_.pop(), n))
    return sorted(out)


def test_pairing_equals_a_stack(spark):
    rng = random.Random(5)
    streams = {k: [rng.choice((1, 1, -1)) if k % 2 else rng.choice((1, -1, -1)) for _ in range(30)] for k in range(40)}
    rows = spark.createDataFrame([(k, n, d) for k, s in streams.items() for n, d in enumerate(s)], "k int, n long, d int")
    got = {}
    for r in notes.paired_notes(rows, ["k"], ["n"], ["n"]).collect():
        got.setdefault(r["k"], []).append((r["start_n"], r["end_n"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: stack_pairs(s) for k, s in streams.items() if stack_pairs(s)}


def test_grammar_against_the_states(spark):
    rng = random.Random(3)
    signs = {"B": "BOS", "E": "EOS", "R": "BAR", "T": "TEMPO_120", "K": "KEY_C_MAJ", "P": "POS_0", "I": "INST_PIANO", "C": "PITCH_60", "D": "DUR_4", "V": "VEL_8"}
    codes = ["".join(rng.choice(list(signs)) for _ in range(rng.randint(1, 6))) for _ in range(200)] + ["BE", "BTE", "BTKRE", "BRPICDVE", "BTKRTKPICDVPICDVRE", "BTPICDVE", "BRKTE", "BRPICE"]
    rows = spark.createDataFrame([(n, [signs[c] for c in code]) for n, code in enumerate(codes)], "n int, tokens array<string>").withColumn("code", grammar.letters(F.col("tokens")))
    got = {r["n"]: (r["fault"], r["valid"]) for r in rows.select("n", grammar.first_fault(F.col("code")).alias("fault"), grammar.prefix_valid(F.col("code")).alias("valid")).collect()}
    for n, code in enumerate(codes):
        fault = next((i for i in range(len(code)) if grammar.state_after(code[: i + 1]) is None), None)
        assert got[n] == (fault, grammar.state_after(code) == "terminal"), code


def test_key_path_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.RandomState(2)
    scores, bias = rng.rand(3, 24), rng.rand(24) - 0.5
    emit = scores + keys.GLOBAL_BIAS * np.maximum(0, bias)
    best = max(itertools.product(range(24), repeat=3), key=lambda p: sum(emit[t, k] for t, k in enumerate(p)) - keys.CHANGE * sum(a != b for a, b in zip(p, p[1:])))
    assert keys.best_path(scores, bias) == list(best)


def test_segments_need_confirmation():
    assert keys.segments(["uncertain", "C:maj", "G:maj", "C:maj", "G:maj", "G:maj"]) == [("C:maj", 1, 4), ("G:maj", 4, 6)]
    assert keys.segments(["uncertain"]) == []


def test_phrase_spans():
    assert phrases.spaced([(2, 0.5), (3, 0.9), (6, 0.1)]) == [3, 6]
    assert phrases.spans(4, []) == [(0, 4)]
    assert phrases.spans(5, [1]) == [(0, 5)]
    assert phrases.spans(20, []) == [(0, 4), (4, 8), (8, 12), (12, 20)]


def piece(spark, pitches):
    rows = [(1, n // 8, n % 8 * 4, p, 4, 8) for n, p in enumerate(pitches)]
    return tokens.numbered(spark.createDataFrame(rows, "file_id long, bar long, pos int, pitch int, dur int, vel int"))


def test_key_of_plain_scales(spark):
    for scale, want in (([60, 64, 67, 60, 62, 64, 65, 67], "C:maj"), ([69, 72, 76, 69, 71, 72, 74, 76], "A:min")):
        ev = piece(spark, scale * 4)
        segs = keys.timeline(ev, ev.groupBy("file_id").agg((F.max("bar") + 1).alias("bars")))[1].collect()
        assert [s["name"] for s in segs] == [want]


def test_seven_frames_for_four_bars(spark):
    ev = piece(spark, [60] * 32)
    totals = keys.units_total(ev, ev.groupBy("file_id").agg((F.max("bar") + 1).alias("bars")))
    assert keys.frames(totals).count() == 7


def test_midi_bytes_round_trip():
    seq = "BOS TEMPO_120 BAR POS_0 INST_PIANO PITCH_60 DUR_4 VEL_8 POS_8 INST_PIANO PITCH_64 DUR_8 VEL_8 BAR TEMPO_90 POS_0 INST_PIANO PITCH_60 DUR_1 VEL_3 EOS".split()
    ticks, rows = midi.parse(midi.tokens_to_midi(seq, list(range(1, 17))))
    assert ticks == 480 and [r[4] for r in rows].count("note_on") == 3 and [r[8] for r in rows if r[4] == "program_change"] == [0]
    assert [r[3] for r in rows if r[4] == "set_tempo"] == [0, 1920]
    for bad in (b"", b"MThd", b"RIFF" + bytes(20)):
        with pytest.raises(midi.MidiError):
            midi.parse(bad)


def test_midi_source_and_errors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.MID").write_bytes(midi.tokens_to_midi("BOS TEMPO_120 BAR POS_0 INST_PIANO PITCH_60 DUR_4 VEL_8 EOS".split(), list(range(1, 17))))
    (tmp_path / "y.midi").write_bytes(b"nothing")
    (tmp_path / "z.txt").write_bytes(b"no")
    midi.register(spark)
    rows = spark.read.format("midi").load(str(tmp_path)).collect()
    assert sum(r["type"] == "note_on" for r in rows) == 1 and sum(r["error"] is not None for r in rows) == 1
    assert files.midi_files(spark, str(tmp_path), content=False).count() == 2


def test_packed_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, [5, 6, 7]), (1, [1]), (3, [])], "k int, ids array<int>")
    index = files.write_packed(rows, str(tmp_path), "train", "k")
    assert index["offsets"] == [0, 1] and index["lengths"] == [1, 3] and files.packed_size_faults(str(tmp_path), index) == []
    assert [r["ids"] for r in files.read_packed(spark, str(tmp_path), "train").orderBy("seq_no").collect()] == [[1], [5, 6, 7]]
    with pytest.raises(ValueError):
        files.write_packed(spark.createDataFrame([(1, [70000])], "k int, ids array<int>"), str(tmp_path), "bad", "k")


def test_settings(tmp_path):
    p = tmp_path / "benchmark_fast.yaml"
    p.write_text("sample_count: 96\nother: 1\n")
    assert files.benchmark_settings(str(p))["tier"] == "fast" and files.benchmark_settings(str(p))["sample_count"] == 96
    with pytest.raises(ValueError):
        files.read_settings(str(p), {"sample_count": 1}, strict=True)


def test_archive(tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    (run / "best.pt").write_text("x")
    (run / "metrics.jsonl").write_text("{}")
    a, b = (files.archive(str(run), str(tmp_path / "out"), " my run! ") for _ in range(2))
    assert a["checkpoint"] == "best.pt" and a["folder"].endswith("my-run") and b["folder"].endswith("my-run__02")


def test_decoding_obeys_the_grammar():
    table = {"BOS": {"POS_0": 9.0, "BAR": 1.0}, "BAR": {"POS_0": 2.0, "EOS": 0.5}, "POS_0": {"INST_PIANO": 1.0}, "INST_PIANO": {"PITCH_60": 1.0, "PITCH_62": 0.5}, "PITCH_60": {"DUR_4": 1.0}, "PITCH_62": {"DUR_4": 1.0}, "DUR_4": {"VEL_1": 1.0}, "VEL_1": {"POS_0": 1.0, "BAR": 0.9, "EOS": 0.1}}
    out = decoding.continue_tokens(["BOS"], lambda t: table.get(t[-1], {}), 40)
    code = "".join(decoding._sign(t) for t in ["BOS", *out["generated"]])
    assert grammar.state_after(code) is not None
    fill = decoding.fill_tokens(["BOS", "BAR", "POS_0"], ["DUR_4", "VEL_1"], lambda t: table.get(t[-1], {}), 8)
    assert fill["closed"] and fill["middle"] == ["INST_PIANO", "PITCH_60", "DUR_4", "VEL_1", "POS_0", "INST_PIANO", "PITCH_62"][: len(fill["middle"])]


def test_absolute_score_is_independent_and_bounded(spark):
    rows = spark.createDataFrame([(1, 0.3, 0.9), (2, 0.6, 0.5)], "step int, stop_success double, valid_loss double")
    both = {r["step"]: r["absolute_score"] for r in training.absolute_scores(rows, ["step"]).collect()}
    one = training.absolute_scores(rows.where("step = 1"), ["step"]).first()["absolute_score"]
    assert both[1] == one and 50 < both[1] < 100 and both[2] > both[1]


@pytest.mark.parametrize("make", [lambda s, n: structure.pitch_collapse(n), lambda s, n: notes.max_polyphony(n), lambda s, n: notes.melodic_tracks(n), lambda s, n: structure.repetition(n), lambda s, n: structure.rhythm_diversity(n)])
def test_empty_tables_give_no_rows(spark, make):
    empty = spark.createDataFrame([], "file_id long, track_idx int, start_tick long, end_tick long, pitch int, event_idx long, bar long, pos int, dur int, unit long")
    assert make(spark, empty).count() == 0


def test_groups_and_splits_keep_together(spark):
    rows = spark.createDataFrame([(i, f"f{i // 3}", f"h{i % 50}" if i % 7 == 0 else None) for i in range(300)], "file_id long, family_key string, content_hash string")
    g = corpus.leakage_groups(rows, ["family_key", "content_hash"])
    s = corpus.split_groups(g, [("train", 0.9), ("valid", 0.05), ("test", 0.05)])
    assert s.count() == 300 and s.groupBy("group").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_tolerant_parse_of_odd_arrays(spark):
    rows = spark.createDataFrame([(1, []), (2, None), (3, ["BOS"]), (4, ["BAR"]), (5, "BOS BAR POS_x INST_A PITCH_1 DUR_1 VEL_1 POS_40 INST_A PITCH_61 DUR_0 VEL_1 EOS".split())], "file_id long, tokens array<string>")
    got = sequences.parsed_events(rows).collect()
    assert [(r["file_id"], r["pos"], r["pitch"], r["dur"]) for r in got] == [(5, 31, 61, 1)]
    assert structure.sequence_metrics(rows.where("tokens IS NOT NULL")).count() == 4
    assert windows.units(rows.where("size(tokens) > 0")).where("kind = 'bar'").count() == 2


def test_velocity_bins_of_all_values(spark):
    import math

    def plain(v):
        x = (min(127, max(1, v)) - 64) / 63
        return min(15, max(0, round((math.copysign(math.log1p(8 * abs(x)) / math.log1p(8), x) + 1) / 2 * 15)))

    got = {r["id"]: r["b"] for r in spark.range(-2, 130).select("id", N.velocity_bin(F.col("id")).alias("b")).collect()}
    assert got == {v: plain(v) for v in got}


def test_small_files(spark, tmp_path):
    p = str(tmp_path / "deep" / "r.json")
    files.write_report({"a": "ü"}, p)
    assert files.read_object(p) == {"a": "ü"}
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.read_object(str(tmp_path / "list.json"))
    log = str(tmp_path / "metrics.jsonl")
    assert files.metrics_path(str(tmp_path)) is None
    for step in (1, 2):
        files.append_event(spark.createDataFrame([("train", step, 0.5)], "event string, step long, loss double"), log)
    rows = files.read_log(spark, log).collect()
    assert files.metrics_path(str(tmp_path)) and sorted(r["step"] for r in rows) == [1, 2] and sorted(r["line_no"] for r in rows) == [1, 2]
    assert files.markdown_table(["a"], [["1"]]) == "| a |\n| --- |\n| 1 |\n" and "no data" in files.markdown_table(["a"], [])
    files.clean(str(tmp_path / "deep"), "*.json")
    files.clean(str(tmp_path / "fresh"))
    assert not list((tmp_path / "deep").iterdir()) and (tmp_path / "fresh").is_dir()
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0


def test_top_p_takes_the_best_at_zero_temperature(spark):
    rows = spark.createDataFrame([(1, [0.1, 2.0, 1.0]), (2, [])], "k int, x array<double>")
    assert [r["next_id"] for r in decoding.top_p_sample(rows, "x", 0.0, 1.0, F.lit(0.5)).orderBy("k").collect()] == [1, None]
    picks = {decoding.top_p_sample(rows.where("k = 1"), "x", 1.0, 0.6, F.lit(u)).first()["next_id"] for u in (0.0, 0.3, 0.99)}
    assert picks == {1}


def test_holes_keep_to_groups_and_ends(spark):
    seq = "BOS TEMPO_120 BAR POS_0 INST_PIANO PITCH_60 DUR_4 VEL_8 TEMPO_90 BAR EOS".split()
    rows = spark.createDataFrame([(1, seq)], "file_id long, tokens array<string>")
    found = windows.hole_candidates(windows.units(rows), rows.select("file_id", F.size("tokens").alias("length")), F.lit(1), F.lit(96))
    assert sorted((r["start"], r["end"]) for r in found.collect()) == [(2, 3), (2, 8), (3, 8), (9, 10)]
    one = windows.fim_examples(rows, spark.createDataFrame([(1, 3, 8)], "file_id long, start int, end int")).first()
    assert one["tokens"][-6] == "FIM_MID" and one["loss_from"] == len(one["tokens"]) - 5


def test_sequence_metrics_put_tables_side_by_side_without_a_join_each(spark):
    rows = spark.createDataFrame([(1, "BOS BAR POS_0 INST_PIANO PITCH_60 DUR_4 VEL_8 BAR BAR EOS".split()), (2, ["EOS"])], "file_id long, tokens array<string>")
    found = structure.sequence_metrics(rows)
    assert str(found._jdf.queryExecution().optimizedPlan()).count("Join ") <= 6
    got = {r["file_id"]: r for r in found.collect()}
    assert (got[1]["bar_count"], got[1]["event_count"], got[1]["empty_run"], got[1]["pitch_span"]) == (3, 1, 2, 0)
    assert (got[2]["bar_count"], got[2]["empty_run"], got[2]["pitch_diversity"]) == (0, 0, None)


def test_messages_are_handed_on_in_bounded_batches():
    import pyarrow as pa

    data = midi.tokens_to_midi(["BOS", "TEMPO_120", "BAR", *("POS_0 INST_PIANO PITCH_60 DUR_4 VEL_8".split() * 2000), "EOS"], list(range(1, 17)))
    batch = pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in range(30)] + ["bad"], "content": [data] * 30 + [b"none"]})
    out = list(midi.message_batches(iter([batch]), "path", "content", pa.string()))
    assert max(b.num_rows for b in out) <= midi.ROWS and sum(b.num_rows for b in out) == 30 * 4004 + 1
    assert out[-1].column("error")[-1].as_py() == "no header"


def test_appended_rows_of_a_stream_are_files(spark, tmp_path):
    from melisma.streaming import events as stream

    rows = spark.createDataFrame([(u, i, float((i * 7) % 5)) for u in range(3) for i in range(20)], "run long, line_no long, loss double")
    rows.write.parquet(str(tmp_path / "in"))
    for folder, n in (("in", 60), ("none", 0)):
        (tmp_path / folder).mkdir(exist_ok=True)
        out = stream.drained(stream.running_mean(stream.file_stream(spark, str(tmp_path / folder), rows.schema, "*.parquet")), f"t_{folder}", "append")
        assert out.count() == n and bool(out.inputFiles()) == (n > 0)


def test_order_is_told_in_one_pass_as_by_the_first_fault(spark):
    rng = random.Random(5)
    codes = ["", "E", "BE", "BTKE", "BKTE", "BTTE", "BRE", "BRKTE", "BRTKPICDVE", "BRPICDVPICDVREE", "BR?E", "BRPICDE", "BRBE", "RE", "BP", "B", "BRPICDV"] + ["B" + "".join(rng.choices("RTKE", k=3)) + "E" for _ in range(40)] + ["".join(rng.choices("BRTKPICDVE?", k=4)) for _ in range(60)]
    rows = spark.createDataFrame([(c,) for c in codes], "c string")
    old = (F.length("c") > 0) & grammar.first_fault(F.col("c")).isNull() & F.col("c").endswith("E")
    assert rows.where(~old.eqNullSafe(grammar.prefix_valid(F.col("c")))).count() == 0 and rows.where(grammar.prefix_valid(F.col("c"))).count() > 5
    assert "rlike" in str(rows.select(grammar.prefix_valid(F.col("c")))._jdf.queryExecution().optimizedPlan()).lower()


def test_hole_candidates_stay_with_their_sequence(spark):
    rows = spark.createDataFrame([(k, ["BOS", *(["BAR"] * 12), "EOS"]) for k in range(9)], "file_id long, tokens array<string>")
    found = windows.hole_candidates(windows.units(rows), rows.select("file_id", F.size("tokens").alias("length")), F.lit(2), F.lit(5))
    near = windows.near_best(found, F.abs(F.col("end") - F.col("start") - 3), 0, "file_id")
    assert found.where("file_id = 3").count() == 11 + 10 + 9 + 8 and near.count() == 9 * 10
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("ShuffledHashJoin")[0] and "end" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "group" in x)
