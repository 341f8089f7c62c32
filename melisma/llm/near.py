"""Near-duplicate note records: MinHash compared incrementally with Bayesian pruning, exact verification (problem 6).

Of two records that are a case, 70 % of the larger one's notes have partners of the same pitch, wherever they stand. So the
sets of (pitch, how often it came before) of the two have a Jaccard similarity of at least 0.7 / 1.3: unlike n-grams this
bound follows from the definition. MinHash values of those sets are compared a chunk at a time, and a pair is dropped once
it is all but impossible, at TOLERATED, that its similarity reaches the bound.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melisma.operators.graph import components
from melisma.tables import current_rows, materialise, shared_dir

#: Onsets are held in this many units a beat; every usual ticks-per-beat value divides it.
UNITS = 1920
#: Half a sixteenth note.
TOLERANCE = UNITS // 8
#: Share of the larger record's notes that must have partners.
SHARE = 0.7
#: MinHash values of a record, each cut to a byte, and how many have been compared at each decision.
HASHES, STEPS = 64, (32, 64)
#: Least Jaccard similarity of the (pitch, occurrence) sets of a case.
LEAST = SHARE / (2 - SHARE)
#: A pair is dropped when the posterior probability that it reaches LEAST is below this.
TOLERATED = 1e-4
#: Pitches are counted in so many bins (higher ones fold onto lower), and first compared by products of so many columns, or one a bin if those are more.
BINS, COLUMNS = 128, 192
#: Share of the notes that may lie in the less exact one of those columns, and bins that are left where more would.
UNCOVERED, COARSE = 0.4, 24
#: Records compared with each other at once, and their notes; a task holds two such blocks.
BLOCK, BLOCK_NOTES = 16384, 8_000_000
#: Records that are first compared with a block together.
TILE = 128
#: Tasks that pairs of blocks are dealt to at most.
MOST_TASKS = 10_000
#: Roles of records between which links are looked for.
TRAIN, HELD = 1, 2
#: Pairs whose offsets are looked through together, and pairs whose counts are.
PAIRS, COUNTED = 256, 1 << 15
#: Occurrences of a pitch whose hashes are kept in a table.
_OFTEN = 64
#: A passage that stands elsewhere must hold this share of the larger record's notes, and this many notes.
PASSAGE_SHARE, PASSAGE_NOTES = 0.12, 8

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _hashed(token: np.ndarray, k: int) -> np.ndarray:
    return (_mix(token * np.uint64(HASHES) + np.uint64(k)) >> np.uint64(32)).astype(np.uint32)


@lru_cache(1)
def _table() -> np.ndarray:
    """Least hash values of the first 1, 2, .. _OFTEN occurrences of each pitch: HASHES rows."""
    token = np.arange(256 * _OFTEN, dtype=np.uint64)
    each = np.stack([_hashed(token, k) for k in range(HASHES)]).reshape(HASHES, _OFTEN, 256)
    return np.minimum.accumulate(each, axis=1).reshape(HASHES, -1)


def min_hashes(record: np.ndarray, pitch: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Notes of whole records (`record` ascending from 0, beginning at `start`) -> low bytes of the MinHash values, a row per record."""
    count = np.bincount(record * 256 + pitch, minlength=len(start) * 256)
    cell = np.flatnonzero(count)
    often, first = count[cell], np.searchsorted(cell, np.arange(len(start)) * 256)
    at = cell % 256 + 256 * (np.minimum(often, _OFTEN) - 1)
    more = np.maximum(often - _OFTEN, 0)
    owner = np.repeat(np.arange(len(cell)), more)
    rare = (cell[owner] % 256 + 256 * (_OFTEN + _runs(more))).astype(np.uint64)
    table, out = _table(), np.empty((len(start), HASHES), np.uint8)
    for k in range(HASHES):
        value = table[k][at]
        if len(rare):
            np.minimum.at(value, owner, _hashed(rare, k))
        out[:, k] = np.minimum.reduceat(value, first)
    return out


@lru_cache(8)
def least_agreement(tolerated: float = TOLERATED) -> tuple[int, ...]:
    """At each step, the fewest equal values with which a pair is kept.

    With a flat prior, m equal values of n make the posterior Beta(m + 1, n - m + 1), whose mass from LEAST on is
    P(Bin(n + 1, LEAST) <= m).
    """
    out = []
    for n in STEPS:
        mass, m = 0.0, 0
        while True:
            mass += comb(n + 1, m) * LEAST**m * (1 - LEAST) ** (n + 1 - m)
            if mass >= tolerated:
                break
            m += 1
        out.append(m)
    return tuple(out)


def signature_columns(file_id: np.ndarray, onset: np.ndarray, pitch: np.ndarray) -> pa.RecordBatch:
    """Rows of one or more whole records, sorted by file, onset and pitch -> one row per record."""
    start = np.flatnonzero(np.r_[True, file_id[1:] != file_id[:-1]])
    size = np.diff(np.r_[start, len(file_id)])
    rel = onset - np.repeat(onset[start], size)
    exact = np.add.reduceat(_mix(rel.astype(np.uint64) * np.uint64(131) + pitch.astype(np.uint64) + np.uint64(1)), start)
    exact = _mix(exact ^ _mix(size.astype(np.uint64)))
    steps = np.diff(rel, prepend=0).astype(np.int32)  # ticks since the note before; small numbers, which compress
    steps[start] = 0
    pi = pitch.astype(np.uint8)
    mins = min_hashes(np.repeat(np.arange(len(start)), size), pi, start)
    cut = list(zip(start.tolist(), (start + size).tolist()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(file_id[start]),
            pa.array(size.astype(np.int32)),
            pa.array(exact.view(np.int64)),
            pa.array([steps[a:b].tobytes() for a, b in cut], pa.binary()),
            pa.array([pi[a:b].tobytes() for a, b in cut], pa.binary()),
            pa.array([row.tobytes() for row in mins], pa.binary()),
        ],
        names=["file_id", "n", "exact", "steps", "pitch", "mins"],
    )


_SIGNED = "file_id long, n int, exact long, steps binary, pitch binary, mins binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file_id; a record may run over several batches. Repeated rows of a record count once."""
    names = ("file_id", "start_tick", "pitch", "end_tick", "lane", "tpb")
    rest: list[np.ndarray] | None = None

    def done(cols: list[np.ndarray]) -> pa.RecordBatch:
        f, s, p, e, lane, tpb = cols
        o = np.lexsort((lane, e, p, s, f))
        f, s, p, e, lane, tpb = f[o], s[o], p[o], e[o], lane[o], tpb[o]
        new = np.r_[True, (f[1:] != f[:-1]) | (s[1:] != s[:-1]) | (p[1:] != p[:-1]) | (e[1:] != e[:-1]) | (lane[1:] != lane[:-1])]
        f, s, p, tpb = f[new], s[new], p[new], tpb[new]
        return signature_columns(f, np.rint(s * (UNITS / tpb)).astype(np.int64), p)

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        if not len(cols[0]):
            continue
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut > 0:
            yield done([c[:cut] for c in cols])
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield done(rest)


def counted_notes(notes: DataFrame) -> DataFrame:
    """The notes that count: closed, readable and not of the drum channel (index 9); null track or channel is a lane of its own."""
    return notes.where("file_id IS NOT NULL AND start_tick IS NOT NULL AND end_tick IS NOT NULL AND pitch BETWEEN 0 AND 254 AND (channel IS NULL OR channel <> 9)").select(
        "file_id", "start_tick", "pitch", "end_tick", F.expr("coalesce(track_idx, -1) * 64 + coalesce(channel, 32)").alias("lane")
    )


def signed_records(records: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per current record with notes: file_id, n, exact (hash of its notes), steps (onsets, each since the one before, from the first note on), pitch, mins (MinHash bytes).

    A null ticks_per_beat, or one that isn't positive, counts as 480. Notes whose file has no current record are left out.
    """
    tpb = current_rows(records.select("file_id", "ingested_at", "ticks_per_beat"), "file_id", "ingested_at").selectExpr("file_id", "cast(CASE WHEN ticks_per_beat > 0 THEN ticks_per_beat ELSE 480 END as double) as tpb")
    return counted_notes(notes).join(tpb, "file_id").repartition("file_id").sortWithinPartitions("file_id").mapInArrow(_sign, _SIGNED)


#: What a block holds of its records.
_BLOCK_SCHEMA = pa.schema([("file_id", pa.int64()), ("n", pa.int32()), ("steps", pa.binary()), ("pitch", pa.binary()), ("mins", pa.binary()), ("role", pa.int32())])


def _least(n: np.ndarray | int) -> np.ndarray | int:
    """SHARE of n, a hair lower, so that rounding never drops a pair."""
    return SHARE * n - 1e-6


def size_blocks(counts: list[tuple[int, int]], rows: int = BLOCK, notes: int = BLOCK_NOTES) -> list[tuple[int, int, int]]:
    """(notes, records with so many notes), ascending -> (least notes, most notes, parts) of runs of about `rows` records, fewer where they hold more than `notes`.

    A single number of notes that has more records is cut in parts by hash.
    """
    out: list[tuple[int, int, int]] = []
    held = 0
    for n, k in counts:
        fit = max(1, min(rows, notes // max(1, n)))
        if out and held + k <= fit:
            out[-1] = (out[-1][0], n, 1)
            held += k
        else:
            out.append((n, n, -(-k // fit)))
            held = k
    return out


def pitch_counts(pitches: list[bytes]) -> np.ndarray:
    """Records' pitches -> BINS counts each."""
    size = np.fromiter(map(len, pitches), np.int64, len(pitches))
    bins = np.frombuffer(b"".join(pitches), np.uint8) % np.uint8(BINS)
    return np.bincount(np.repeat(np.arange(len(pitches)), size) * BINS + bins, minlength=len(pitches) * BINS).reshape(-1, BINS).astype(np.int32)


def _narrow(counts: np.ndarray, most: int) -> np.ndarray:
    """Counts in the smallest type that holds `most`, the largest sum of a row."""
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)


def _sides(counts: np.ndarray) -> np.ndarray:
    """Of each row of pitch counts, the notes within some sets of pitches: the lower half, the middle half, the white keys, two triads."""
    mass = counts.sum(axis=0, dtype=np.int64).cumsum()
    low, mid, high = (int(np.searchsorted(mass, mass[-1] * q)) for q in (0.25, 0.5, 0.75))
    at = np.arange(counts.shape[1])
    sets = [at <= mid, (at > low) & (at <= high), *(np.isin(at % 12, c) for c in ((0, 2, 4, 5, 7, 9, 11), (0, 4, 7), (2, 7, 11)))]
    return np.stack([counts[:, s].sum(axis=1) for s in sets])


def _tiles(n: np.ndarray, sides: np.ndarray, x: np.ndarray) -> Iterator[np.ndarray]:
    """Positions in x, TILE at a time: neighbours in two of the sides' shares, then in size."""
    rank = [np.argsort(np.argsort(sides[s][x] / n[x], kind="stable"), kind="stable") * 4 // max(1, len(x)) for s in (0, 2)]
    order = np.lexsort((n[x], *rank))
    for s in range(0, len(x), TILE):
        yield order[s : s + TILE]


def _in_reach(n: np.ndarray, sides: np.ndarray, tile: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of y can have SHARE of the larger one's notes in common with some row of the tile.

    Of two such records neither has more notes outside the other than it can spare, so neither has within any set of
    pitches more than the other by a larger number. No pair is lost.
    """
    least, least_y = _least(n[tile]), _least(n[y])
    spare = n[tile].max() - np.maximum(least.max(), least_y)
    spare_y = n[y] - np.maximum(least.min(), least_y)
    kept = np.ones(len(y), bool)
    for side in sides:
        mine, theirs = side[tile], side[y]
        kept &= (mine.min() - theirs <= spare) & (theirs - mine.max() <= spare_y)
    return np.flatnonzero(kept)


def product_columns(counts: np.ndarray, most: int = COLUMNS) -> np.ndarray:
    """Rows of pitch counts -> rows whose dot products are at least the notes that two records have in common.

    min(a, b) is the number of t with a >= t and b >= t, so a column for every t makes the product exact. The commonest t
    get one; the root of what a count exceeds them by is one column more, as the root of a product is no less than the
    smaller factor. Where more than UNCOVERED of the notes would lie in that, as in long records, pitches are counted in COARSE
    bins of about equal weight, and if need be 2, 4, .. notes at a time, rounded up.
    """
    mass = counts.sum(axis=0, dtype=np.int64)
    used, step = np.flatnonzero(mass), 1
    if not len(used):
        return np.zeros((len(counts), 1), np.float32)
    own = np.ascontiguousarray(counts[:, used].T)
    while True:
        held = -(-own // step)
        reached = []
        for b, row in enumerate(held):
            often = np.bincount(np.minimum(row, most))[::-1].cumsum()[::-1]
            reached.extend((-int(f), t, b) for t, f in enumerate(often[1:], 1))
        picked = sorted(reached)[: max(0, most - len(own))]
        if held.sum(dtype=np.int64) * (1 - UNCOVERED) <= -sum(f for f, _, _ in picked) or held.max() == 1:
            break
        if len(own) > COARSE:
            group = np.minimum((mass[used].cumsum() * COARSE - 1) // int(mass.sum()), COARSE - 1)
            own = np.stack([own[group == g].sum(axis=0) for g in np.unique(group)])
        else:
            step *= 2
    levels = np.bincount(np.array([b for _, _, b in picked], np.int64), minlength=len(own)).tolist()
    out = [row >= t for row, upto in zip(held, levels) for t in range(1, upto + 1)]
    out += [np.sqrt(np.maximum(row - upto, 0)) for row, upto in zip(held, levels) if row.max() > upto]
    return np.stack([c.astype(np.float32) for c in out], axis=1) * np.float32(step**0.5)


def alike(n: np.ndarray, mins: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y), pair by pair, that may be cases; of equal sets x and y each pair once.

    Four sieves: notes within a few sets of pitches, for TILE rows at once; a product of matrices that bounds the pitches in
    common; MinHash values, step by step; the pitches themselves, of which SHARE of the larger record must be common.
    """
    itself = x is y
    sides = _sides(counts)
    y = y[np.argsort(n[y], kind="stable")]
    x = y if itself else x
    columns = product_columns(counts)
    counts = _narrow(counts[:, counts.any(axis=0)], int(n.max(initial=0)))
    n_y, columns_y = n[y], columns[y]
    lo, hi = np.searchsorted(n_y, _least(n[x])), np.searchsorted(n_y, (n[x] + 1e-6) / SHARE, side="right")
    if itself:
        lo = np.arange(1, len(x) + 1)
    fewest = least_agreement()
    least = np.ceil(_least(n)).astype(np.int64)
    fair = (least * (1 - 1e-4) - 0.5).astype(np.float32)  # rounding of large products drops no pair
    for tile in _tiles(n, sides, x):
        reach = _in_reach(n, sides, x[tile], y)
        lo_t, hi_t = np.searchsorted(reach, lo[tile]), np.searchsorted(reach, hi[tile])
        reach, first = reach[lo_t.min() : hi_t.max()], lo_t.min()
        if not len(reach):
            continue
        common = columns[x[tile]] @ columns_y[reach].T
        i, at = np.divmod(np.flatnonzero(common >= fair[y[reach]]), len(reach))
        kept = (at >= lo_t[i] - first) & (at < hi_t[i] - first)
        kept &= common[i, at] >= fair[x[tile]][i]
        i, at = x[tile][i[kept]], y[reach[at[kept]]]
        for s in range(0, len(i), COUNTED):
            one, other = i[s : s + COUNTED], at[s : s + COUNTED]
            equal = np.zeros(len(one), np.uint8)
            for (done, upto), few in zip(zip((0, *STEPS), STEPS), fewest):
                equal += (mins[other, done:upto] == mins[one, done:upto]).view(np.uint8).sum(axis=1, dtype=np.uint8)
                kept = equal >= few
                one, other, equal = one[kept], other[kept], equal[kept]
            kept = np.minimum(counts[one], counts[other]).sum(axis=1) >= np.maximum(least[one], least[other])
            if kept.any():
                yield one[kept], other[kept]


def _join_blocks(one: pa.Table, other: pa.Table | None) -> pa.RecordBatch:
    """The rows of two blocks (of one with itself without `other`) -> the pairs that are cases."""
    group = (one if other is None else pa.concat_tables([one, other])).combine_chunks()
    if not len(group):
        return pa.RecordBatch.from_pylist([], pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    ids, n = (group.column(c).to_numpy() for c in ("file_id", "n"))
    mins = np.frombuffer(b"".join(group.column("mins").to_pylist()), np.uint8).reshape(-1, HASHES)
    pitches = group.column("pitch").to_pylist()
    counts = pitch_counts(pitches)
    rows = Records(n, counts, np.frombuffer(b"".join(group.column("steps").to_pylist()), np.int32), np.frombuffer(b"".join(pitches), np.uint8))
    x = np.arange(len(one))
    y = x if other is None else np.arange(len(one), len(group))
    pairs = []

    def settle(one: np.ndarray, other: np.ndarray) -> None:
        lo, hi = np.where(ids[one] < ids[other], one, other), np.where(ids[one] < ids[other], other, one)
        for s in range(0, len(lo), PAIRS):
            left = promising(rows, lo[s : s + PAIRS], hi[s : s + PAIRS])
            pairs.extend((ids[a], ids[b]) for a, b in zip(lo[s : s + PAIRS][left].tolist(), hi[s : s + PAIRS][left].tolist()) if is_case(*rows.notes(a), *rows.notes(b)))

    role = group.column("role").to_numpy()
    if (role == 0).all():
        sets = [(x, y)]
    else:
        one, two = TRAIN, HELD
        sets = [(x[role[x] & a > 0], y[role[y] & b > 0]) for a, b in ((one, two), (two, one))[: 1 if x is y else 2]]
    for left, right in sets:
        for i, j in alike(n, mins, counts, left, right):
            settle(i[i != j], j[i != j])
    pairs = list(dict.fromkeys(pairs))
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _read_block(folder: str, block: int) -> pa.Table:
    """One block as verified_links wrote it; a block no record fell into was not written and is empty."""
    at, path = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    path = f"{path}/block={block}"
    if at.get_file_info(path).type == fs.FileType.NotFound:
        return _BLOCK_SCHEMA.empty_table()
    return pq.read_table(path, columns=_BLOCK_SCHEMA.names, filesystem=at, partitioning=None).cast(_BLOCK_SCHEMA)


def verified_links(signed: DataFrame) -> DataFrame:
    """Signed records -> `a` < `b`: every two records whose notes satisfy the definition.

    With a column `role` (bits TRAIN and HELD), only pairs of one record of each role are looked for.

    Records are cut in blocks by their number of notes, and each block is compared with those whose numbers are near enough,
    so no pair is left to the chance of sharing a band. Every block is written once to the shared folder, and each task reads
    the two it compares: copies for every other block would grow with the square of the records. The comparisons still do;
    all but a few in a thousand end in the first three sieves.
    """
    counts = [(r["n"], r["k"]) for r in signed.groupBy("n").agg(F.count("*").alias("k")).orderBy("n").collect()]
    parts, where = [], []
    sizes = [n for n, _ in counts]
    for lo, hi, of in size_blocks(counts):
        where.extend((n, len(parts), of) for n in sizes[bisect_left(sizes, lo) : bisect_right(sizes, hi)])
        parts.extend([(lo, hi)] * of)
    meets = [(x, y) for x in range(len(parts)) for y in range(x, len(parts)) if parts[x][1] >= _least(parts[y][0])]
    spark = signed.sparkSession
    signed = signed if "role" in signed.columns else signed.withColumn("role", F.lit(0))
    block = F.expr("first + cast(pmod(xxhash64(file_id), parts) as int)").alias("block")
    placed = signed.join(F.broadcast(spark.createDataFrame(where, "n int, first int, parts int")), "n").select(block, *_BLOCK_SCHEMA.names)
    folder = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    placed.repartition(max(1, len(parts)), "block").write.partitionBy("block").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                x, y = meets[k]
                yield _join_blocks(_read_block(folder, x), _read_block(folder, y) if x != y else None)

    return spark.range(0, len(meets), 1, max(1, min(len(meets), MOST_TASKS))).mapInArrow(run, "a long, b long")


def same_pitch(p_a: np.ndarray, p_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of notes of one pitch, without a matrix of all pairs."""
    if len(p_a) * len(p_b) <= 1 << 16:
        return np.nonzero(p_a[:, None] == p_b[None, :])
    order = np.argsort(p_b, kind="stable")
    lo, hi = (np.searchsorted(p_b[order], p_a, side=s) for s in ("left", "right"))
    size = hi - lo
    i = np.repeat(np.arange(len(p_a)), size)
    j = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    return i, order[j]


def _passage(big: int) -> int:
    """Notes a passage that stands elsewhere must hold."""
    return max(PASSAGE_NOTES, int(np.ceil(PASSAGE_SHARE * big)))


class Records:
    """Notes of many records end to end: as they are, and in order of pitch, with where each pitch begins."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, steps: np.ndarray, pitch: np.ndarray) -> None:
        self.n, self.counts, self.pitch = n.astype(np.int64), counts, pitch
        self.end = np.cumsum(self.n)
        self.start = self.end - self.n
        onset = np.cumsum(steps, dtype=np.int64)
        onset -= np.repeat(onset[self.start], self.n)  # a record's first step is 0
        self.onset = onset.astype(np.int32)
        self.last = self.onset[self.end - 1].astype(np.int64)
        # note numbers in order of record and pitch: sorted together with these, which a plain sort does fastest
        bits = len(pitch).bit_length()
        key = np.repeat(np.arange(len(n)) * BINS, self.n) + pitch % np.uint8(BINS) << bits | np.arange(len(pitch))
        key.sort()
        order = key & (1 << bits) - 1
        self.bins, self.flat = (pitch % np.uint8(BINS))[order], self.onset[order]
        self.first = self.start[:, None] + np.cumsum(counts, axis=1) - counts

    def notes(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Onsets and pitches of one record."""
        at = slice(int(self.start[row]), int(self.end[row]))
        return self.onset[at], self.pitch[at]


def _runs(size: np.ndarray) -> np.ndarray:
    """0, 1, .. of each size, end to end."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def promising(rows: Records, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (rows a, rows b) can be cases by the offsets at which their notes of one pitch meet.

    Offsets are counted in cells a little wider than the window of one passage, so every window lies in two neighbouring
    cells, whose sum bounds what it holds. A passage needs enough notes, so all passages lie in the cells of such
    windows, and those must hold SHARE of the larger record's notes together. No case is lost.
    """
    step = 2 * TOLERANCE + 32
    width = (rows.last[a] + rows.last[b]) // step + 2  # an empty cell between two pairs
    at = np.cumsum(width) - width
    size = rows.n[a]
    mine = np.repeat(rows.start[a] - (np.cumsum(size) - size), size)
    mine += np.arange(len(mine))
    cell = np.repeat(b * BINS, size) + rows.bins[mine]
    meet = rows.counts.ravel()[cell].astype(np.int64)
    theirs = np.repeat(rows.first.ravel()[cell] - (np.cumsum(meet) - meet), meet)
    theirs += np.arange(len(theirs))
    d = np.repeat(np.repeat(at * step + rows.last[a], size) - rows.flat[mine], meet)  # from 0 on, each pair in its own cells
    d += rows.flat[theirs]
    held = np.bincount(d // step, minlength=int(width.sum()) + 1)
    big, small = np.maximum(rows.n[a], rows.n[b]), np.minimum(rows.n[a], rows.n[b])
    least = np.minimum(np.maximum(PASSAGE_NOTES, np.ceil(PASSAGE_SHARE * big)), small)
    window = np.r_[False, held[:-1] + held[1:] >= np.repeat(least, width), False]
    inside = np.where(window[:-1] | window[1:], held, 0)
    return np.add.reduceat(inside[:-1], at) >= SHARE * big - 1e-6


def matched_notes(on_a: np.ndarray, p_a: np.ndarray, on_b: np.ndarray, p_b: np.ndarray) -> int:
    """Notes of the two records that can be paired one to one: same pitch, same onset within TOLERANCE, passage by passage.

    The passage offset that pairs most notes is taken first; its notes leave; then the next, while a passage still
    holds PASSAGE_SHARE of the larger record's notes. Notes within a passage pair in order of onset.
    """
    need = _passage(max(len(p_a), len(p_b)))
    i, j = same_pitch(p_a, p_b)
    d = on_b[j].astype(np.int64) - on_a[i]
    o = np.argsort(d, kind="stable")
    i, j, d = i[o], j[o], d[o]
    total, small = 0, min(len(p_a), len(p_b))
    while len(d):
        width = np.searchsorted(d, d + 2 * TOLERANCE, side="right") - np.arange(len(d))
        s = int(np.argmax(width))
        x, y = i[s : s + width[s]], j[s : s + width[s]]
        if s < len(d) and np.searchsorted(d, -TOLERANCE) < len(d):  # unmoved music counts around offset zero first
            z0, z1 = np.searchsorted(d, -TOLERANCE), np.searchsorted(d, TOLERANCE, side="right")
            if z1 - z0 >= width[s]:
                x, y = i[z0:z1], j[z0:z1]
        order = np.lexsort((y, x))
        used_a, used_b = np.zeros(len(p_a), bool), np.zeros(len(p_b), bool)
        for u, v in zip(x[order].tolist(), y[order].tolist()):
            if not used_a[u] and not used_b[v]:
                used_a[u] = used_b[v] = True
        got = int(used_a.sum())
        if got < min(need, small):
            break
        total += got
        left = ~used_a[i] & ~used_b[j]
        i, j, d = i[left], j[left], d[left]
    return total


def is_case(on_a: np.ndarray, p_a: np.ndarray, on_b: np.ndarray, p_b: np.ndarray) -> bool:
    big = max(len(p_a), len(p_b))
    return big > 0 and min(len(p_a), len(p_b)) >= SHARE * big and matched_notes(on_a, p_a, on_b, p_b) >= SHARE * big


def music_links(records: DataFrame, notes: DataFrame, roles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: `file_id`, `rep` - the smallest file_id with exactly the same notes. links: every verified `a` < `b` between
    such representatives; with `roles` (`file_id`, `role`) only those between a group that has a TRAIN and one that has a
    HELD record.
    """
    signed = materialise(signed_records(records, notes), "signed")
    least = signed.groupBy("exact", "n").agg(F.min("file_id").alias("rep"))
    members = materialise(signed.select("file_id", "exact", "n").join(least, ["exact", "n"]).select("file_id", "rep"), "members")
    if roles is None:
        reps = signed.join(members.where("file_id = rep").select("file_id"), "file_id", "left_semi")
    else:
        own = members.join(roles, "file_id").groupBy(F.col("rep").alias("file_id")).agg(F.bit_or("role").alias("role"))
        reps = signed.join(own, "file_id")
    return members, materialise(verified_links(reps), "links")


def same_music_pairs(records: DataFrame, notes: DataFrame) -> DataFrame:
    """`file_id_a` < `file_id_b`: every two records whose notes are the same but for small edits; equal records included.

    Records without countable notes have no pairs; an empty table gives no rows; extra columns are ignored.
    """
    members, rep_pairs = music_links(records, notes)
    ma = members.select(F.col("rep").alias("a"), F.col("file_id").alias("fa"))
    mb = members.select(F.col("rep").alias("b"), F.col("file_id").alias("fb"))
    between = rep_pairs.join(ma, "a").join(mb, "b").select("fa", "fb")
    copies = ma.join(mb.withColumnRenamed("b", "a"), "a").where("fa < fb").select("fa", "fb")
    return between.unionByName(copies).select(F.least("fa", "fb").alias("file_id_a"), F.greatest("fa", "fb").alias("file_id_b"))


def music_classes(records: DataFrame, notes: DataFrame) -> DataFrame:
    """`file_id`, `class_id` (smallest file_id of the class), `links` (verified links of its representative): one row per record with notes."""
    members, links = music_links(records, notes)
    ends = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    cls = components(ends)
    degree = ends.select(F.explode(F.array("src", "dst")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    named = members.join(cls.select(F.col("node").alias("rep"), "root"), "rep", "left").join(degree, "rep", "left")
    return named.select("file_id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
