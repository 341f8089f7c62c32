from melisma.llm import spam

STUFFED = (
    "Get hot karaoke discs here. More hot karaoke discs, less hot karaoke discs, always hot karaoke discs! "
    "Our hot karaoke discs are the hot karaoke discs for you! Who needs hot karaoke discs? You need hot karaoke discs. "
    "instant piano tabs and hot karaoke discs today. "
)
PROSE = (
    "We listened to the slow movement twice and could not agree on its key. If you transpose it by six semitones, the top note leaves the range of the clarinet. "
    "Bar 62 holds more notes than the whole introduction, which nobody noticed until the rehearsal. She rewrote the guitar line for a smaller hand. "
    "The checkpoint ends its phrases too early, so the next run uses longer windows and a lower learning rate."
)
LYRICS = "\n".join(
    f"{a} {b} by the {c} {d}" for a, b in (("She hums", "home"), ("They wait", "still"), ("We ran", "late"), ("I sat", "home")) for c in ("tall", "grey", "slow") for d in ("ferry", "meadow")
)


def test_punctuated_stuffing_is_flagged():
    assert spam.spam_share(STUFFED * 4, "en") > spam.SHARE


def test_prose_lyrics_and_a_repeated_passage_are_not():
    assert spam.spam_share(PROSE, "en") == 0
    assert spam.spam_share(PROSE + "\n" + PROSE, "en") == 0
    assert spam.spam_share(LYRICS, "en") == 0


def test_long_token_listing_ends():
    assert spam.segments("BOS TEMPO_122 " + "BAR POS_7 INST_BASS PITCH_79 " * 40 + "a")


def test_p9_found_lists_the_stuffed_document(spark, tmp_path):
    from __spark_entry__ import queries

    spark.createDataFrame([(1, STUFFED * 4, "en"), (2, PROSE, "en"), (3, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in queries()["p9_found"](spark, str(tmp_path)).collect()] == [1]


def test_script_is_judged_over_the_whole_block():
    assert spam.language("en", "a b " * 600 + "这个文件共有音符" * 100) == "zh"


def test_a_long_line_is_measured_block_by_block():
    import random

    words = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=7)) for k in range(2000)]
    line = " ".join(words[:600]) + " " + "hot karaoke discs " * 120
    assert 0.2 < spam.spam_share(line, "en") < 0.5


def test_short_oddities_are_not_pages_of_spam():
    for text in ("\x07\x1b[0m bell", "tab\tseparated\t\tvalues\n\n\n\nand    runs  of spaces   ", "<|endoftext|>", "0" * 40 + " 1234567890123", "", " \n "):
        assert spam.spam_share(text, None) <= spam.SHARE


def test_patterns_stay_linear_on_long_lines():
    import time

    for line in ("A_" * 400_000, "a" * 800_000, "C/" * 400_000, "1, " * 300_000, "- " * 400_000, "#" * 500_000, "www." * 200_000, "A B" * 300_000 + "_"):
        began = time.time()
        spam.segments(line)
        assert time.time() - began < 20
