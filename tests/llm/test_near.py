import numpy as np

from melisma.llm import near


def tables(spark, records):
    """(onset in quarter beats, pitch) lists by file_id -> file_records, note_events."""
    files = spark.createDataFrame([(f, "2024-01-01", 480) for f in records], "file_id long, ingested_at string, ticks_per_beat int")
    notes = [(f, 0, 0, int(o) * 120, int(o) * 120 + 60, int(p)) for f, rows in records.items() for o, p in rows]
    return files, spark.createDataFrame(notes, "file_id long, track_idx int, channel int, start_tick long, end_tick long, pitch int")


def scattered(rng, size=60, share=0.28):
    base = list(zip(range(size), rng.randint(40, 90, size).tolist()))
    hit = set(rng.choice(size, int(size * share), replace=False).tolist())
    return base, [(o, p + 1 if o in hit else p) for o, p in base]


def test_scattered_edits_are_found(spark):
    rng = np.random.RandomState(7)
    records = {}
    for k in range(40):
        records[2 * k], records[2 * k + 1] = scattered(rng)
    found = {tuple(r) for r in near.same_music_pairs(*tables(spark, records)).collect()}
    assert found == {(2 * k, 2 * k + 1) for k in range(40)}


def test_blocks_cover_every_compatible_pair():
    assert near.size_blocks([(10, 3), (11, 2), (12, 9)], rows=5) == [(10, 11, 1), (12, 12, 2)]


def test_pairs_are_found_among_many_records_of_one_motif(spark):
    rng = np.random.RandomState(3)
    motif = [60, 62, 64, 65, 67, 65, 64, 62] * 2
    records = {}
    for k in range(150):  # records of different works that share the motif
        records[k] = list(enumerate(motif + rng.randint(30, 100, 44).tolist()))
    for k in range(30):
        hit = set(rng.choice(np.arange(16, 60), 16, replace=False).tolist())
        records[900 + k] = [(o, p + 1 if o in hit else p) for o, p in records[k]]
    found = {tuple(r) for r in near.same_music_pairs(*tables(spark, records)).collect()}
    assert found == {(k, 900 + k) for k in range(30)}


def test_blocks_are_written_once_however_many_they_meet(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near.size_blocks, "__defaults__", (8, near.BLOCK_NOTES))
    monkeypatch.setattr(near, "shared_dir", lambda _: str(tmp_path))
    rng = np.random.RandomState(5)
    records = {}
    for k in range(48):
        records[2 * k], records[2 * k + 1] = scattered(rng)
    signed = near.signed_records(*tables(spark, records))
    found = {tuple(r) for r in near.verified_links(signed).collect()}
    assert found == {(2 * k, 2 * k + 1) for k in range(48)}
    (folder,) = tmp_path.glob("blocks-*")
    assert len(list(folder.glob("block=*"))) > 8
    assert spark.read.parquet(str(folder)).count() == 96


def test_products_bound_what_records_have_in_common():
    rng = np.random.RandomState(11)
    for most, scale in ((384, 2), (60, 3), (40, 200), (30, 5)):
        counts = rng.poisson(rng.gamma(0.7, scale, (80, 24))).astype(np.int32)
        common = np.minimum(counts[:, None], counts[None]).sum(axis=2)
        bound = near.product_columns(counts, most)
        assert bound.shape[1] <= most and (bound @ bound.T >= common * (1 - 1e-5)).all()
    exact = near.product_columns(counts % 4)
    assert (exact @ exact.T == np.minimum(counts[:, None] % 4, counts[None] % 4).sum(axis=2)).all()


def test_few_pairs_reach_the_minhash_values_in_records_of_any_length(monkeypatch):
    rng = np.random.RandomState(2)
    for notes in (60, 6000):
        pitches = [rng.choice(128, notes, p=rng.dirichlet(np.full(128, 0.2))).astype(np.uint8).tobytes() for _ in range(300)]
        counts, n, all_rows = near.pitch_counts(pitches), np.full(300, notes), np.arange(300)
        looked = []
        monkeypatch.setattr(near, "least_agreement", lambda: (0, 0))
        mins = np.zeros((300, near.HASHES), np.uint8).view(Counted)
        mins.looked = looked
        pairs = {tuple(sorted(p)) for i, j in near.alike(n, mins, counts, all_rows, all_rows) for p in zip(i.tolist(), j.tolist())}
        common = np.minimum(counts[:, None], counts[None]).sum(axis=2)
        assert pairs == {(i, j) for i in range(300) for j in range(i + 1, 300) if common[i, j] >= near.SHARE * notes - 1e-6}
        assert sum(looked) / 4 < 300 * 299 / 2 / 3  # two chunks of two sides each


class Counted(np.ndarray):
    def __getitem__(self, at):
        if isinstance(at, tuple):
            self.looked.append(np.size(at[0]))
        return np.asarray(self)[at]


def test_minhash_values_are_the_least_over_all_occurrences():
    pitch = np.array([60] * 200 + [61] + [254] * 3, np.uint8)
    record = np.array([0] * 150 + [1] * 54)
    got = near.min_hashes(record, pitch, np.array([0, 150]))
    for r in (0, 1):
        own = pitch[record == r].astype(np.int64).tolist()
        tokens = np.array([p + 256 * own[:i].count(p) for i, p in enumerate(own)], np.uint64)
        assert got[r].tolist() == [int(near._hashed(tokens, k).min()) & 255 for k in range(near.HASHES)]


def test_product_of_a_record_with_itself_is_its_number_of_notes():
    counts = np.random.RandomState(4).poisson(2, (50, 24)).astype(np.int32)
    bound = near.product_columns(counts, 80)
    assert bound.shape[1] <= 80 < 24 * counts.max()
    np.testing.assert_allclose((bound * bound).sum(axis=1), counts.sum(axis=1), rtol=1e-5)
