from melisma.plans import pipeline


def test_stages_in_turn(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    done = pipeline.run(spark, d, str(tmp_path))
    assert done["validate"].count() == 0 and done["pack"].count() == done["tokenize"].count() > 0
    assert done["split"].groupBy("group").agg({"split": "min"}).count() == done["split"].select("group", "split").distinct().count()
    again = pipeline.run(spark, d, str(tmp_path), start="pack", stop="pack")
    assert set(again) == {"clean", "split", "tokenize", "pack"}


def test_ranges_of_stages():
    order = list(pipeline.STAGES)
    assert [s for s in order if pipeline.should_run(s, order, "split", "pack")] == ["split", "tokenize", "pack"]
