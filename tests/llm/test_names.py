import random

from melisma.llm import names


def test_automaton_finds_what_edit_distance_finds():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    for _ in range(1500):
        a, b = word(), word()
        for k in (1, 2):
            t = names.Trie()
            t.add(b, 7)
            assert (list(t.near(a, k)) == [7]) == (names.distance(a, b, 5) <= k)


def linked(spark, artists, titles=()):
    rows = [(i, a, None) for i, a in enumerate(artists)] + [(900 + i, None, t) for i, t in enumerate(titles)]
    return {(r["name_a"], r["name_b"]) for r in names.name_pairs(spark.createDataFrame(rows, "file_id long, artist string, title string")).collect()}


def test_orders_swaps_and_placeholders(spark):
    found = linked(spark, ["Anna Berta Clara", "Berta Anna Clara", "Clara, Anna Berta", "Anan Berta Clara", "unknown", "Unknown Artist", None, "  ", "Otto Lindmark", "Otto Lindmrak", "Otto Kastrup"])
    mine = ["Anna Berta Clara", "Berta Anna Clara", "Clara, Anna Berta", "Anan Berta Clara"]
    assert {(a, b) for a in mine for b in mine if a < b} | {("Otto Lindmark", "Otto Lindmrak")} == found


def test_numbers_and_parts_stay_apart(spark):
    found = linked(spark, [], ["The Silver Meadow No. 3", "Silver Meadow no 3", "The Silver Meadow No. 4", "Silver Meadow, Part II", "Untitled", "Track 04"])
    assert found == {("Silver Meadow no 3", "The Silver Meadow No. 3")}


def test_shards_hold_every_pair_within_the_bound():
    import pandas as pd

    rng = random.Random(5)

    def edited(s):
        s = list(s)
        for _ in range(2):
            i, kind = rng.randrange(len(s) - 1), rng.randrange(4)
            if kind == 0:
                s.insert(i, rng.choice("abcdefgh"))
            elif kind == 1:
                del s[i]
            elif kind == 2:
                s[i] = rng.choice("abcdefgh")
            else:
                s[i], s[i + 1] = s[i + 1], s[i]
        return "".join(s)

    rows = []
    for n in range(3000):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 16)))
        b = edited(a)
        if len(b) >= names.LONG and names.distance(a, b, 2) <= 2:
            rows += [(n, "s", a, "index"), (n, "s", b, "probe")]
    rows += [(-1, "s", "dezogeesk", "index"), (-1, "s", "deozgegesk", "probe")]
    out = next(names._shards(iter([pd.DataFrame(rows, columns=["id", "space", "key", "role"])])))
    met = out[out["probe"] == 0].merge(out[out["probe"] == 1], on=["shard", "id"])
    assert set(met["id"]) == {r[0] for r in rows}
    assert out["probe"].sum() <= 26 * len(rows) / 2  # shards a probe is looked up in


def test_a_trie_is_searched_only_for_probes_near_another_ids_key(monkeypatch):
    import pandas as pd

    searched, near = [], names.Trie.near
    monkeypatch.setattr(names.Trie, "near", lambda trie, key, k: searched.append(key) or near(trie, key, k))
    keys = [("x", 1, "silvermeadow"), ("x", 2, "goldenmeadow"), ("y", 3, "bananabread"), ("y", 4, "bredenbreda"), ("z", 5, "quietriver"), ("z", 6, "queitriver")]
    rows = pd.DataFrame([(*r, probe) for s in "xyz" for probe in (0, 1) for r in keys if r[0] == s], columns=["shard", "id", "key", "probe"])
    found = pd.concat(names._match(iter([rows[:5], rows[5:]])))
    assert found.values.tolist() == [[5, 6], [6, 5]] and searched == ["quietriver", "queitriver"]


def test_no_probe_within_the_bound_is_kept_from_the_trie():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in "ab")
        assert (names.letters_mask(a) ^ names.letters_mask(b)).bit_count() <= 2 * names.distance(a, b, 9)
