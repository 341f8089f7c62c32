"""Standard MIDI files: bytes to message rows and back, token sequences to bytes, and the data source `midi`."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type

MESSAGES = "track_idx int, msg_idx int, delta long, abs_tick long, type string, channel int, note int, velocity int, program int, tempo_us int, numerator int, denominator int"
# Programs of the instrument classes, ticks a beat of written files.
PROGRAMS = {"PIANO": 0, "GUITAR": 24, "BASS": 32, "STRINGS": 48, "LEAD": 80, "PAD": 88}
TICKS = 480
#: Files or sequences taken from an Arrow batch at once, and messages handed on at once: a batch of files may hold millions.
FILES, ROWS = 64, 16_384
_KINDS = {0x8: "note_off", 0x9: "note_on", 0xA: "polytouch", 0xB: "control_change", 0xC: "program_change", 0xD: "aftertouch", 0xE: "pitchwheel"}


class MidiError(ValueError):
    """Bytes that are no MIDI file."""


def _quantity(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number and the place after it."""
    value = 0
    for k in range(at, at + 4):
        if k >= len(data):
            raise MidiError("number cut off")
        value = value << 7 | data[k] & 0x7F
        if data[k] < 0x80:
            return value, k + 1
    raise MidiError("number too long")


def parse(data: bytes) -> tuple[int, list[tuple]]:
    """Ticks a beat and rows in the order of MESSAGES. Data bytes above 127 are clipped; files of type 2 and of SMPTE time are refused."""
    if data[:4] != b"MThd" or len(data) < 14:
        raise MidiError("no header")
    size, kind, tracks, division = struct.unpack(">IHHH", data[4:14])
    if kind == 2 or division & 0x8000 or division == 0:
        raise MidiError("unsupported type or time division")
    at, track, rows = 8 + size, 0, []
    while at + 8 <= len(data) and track < tracks:
        name, length = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + length]
        at += 8 + length
        if name != b"MTrk":
            continue
        rows.extend(_track(body, track))
        track += 1
    return division, rows


def _track(body: bytes, track: int) -> Iterator[tuple]:
    at, tick, status, n = 0, 0, 0, 0
    while at < len(body):
        delta, at = _quantity(body, at)
        tick += delta
        if at >= len(body):
            raise MidiError("message cut off")
        if body[at] >= 0x80:
            lead, at = body[at], at + 1
            status = lead if lead < 0xF0 else status
        elif status:
            lead = status  # running status
        else:
            raise MidiError("data without status")
        row = dict.fromkeys(("type", "channel", "note", "velocity", "program", "tempo_us", "numerator", "denominator"))
        if lead == 0xFF:
            meta, at = body[at], at + 1
            size, at = _quantity(body, at)
            value, at = body[at : at + size], at + size
            row["type"] = {0x51: "set_tempo", 0x58: "time_signature", 0x2F: "end_of_track"}.get(meta, f"meta_{meta:02x}")
            if meta == 0x51 and size >= 3:
                row["tempo_us"] = int.from_bytes(value[:3], "big")
            elif meta == 0x58 and size >= 2:
                row["numerator"], row["denominator"] = value[0], 1 << value[1]
        elif lead in (0xF0, 0xF7):
            size, at = _quantity(body, at)
            at += size
            row["type"] = "sysex"
        elif lead >= 0xF0:
            row["type"], at = "system", at + {0xF2: 2, 0xF1: 1, 0xF3: 1}.get(lead, 0)
        else:
            op, row["channel"] = lead >> 4, lead & 0x0F
            row["type"] = _KINDS[op]
            size = 1 if op in (0xC, 0xD) else 2
            value = [min(127, x) for x in body[at : at + size]]
            if len(value) < size:
                raise MidiError("message cut off")
            at += size
            if op in (0x8, 0x9):
                row["note"], row["velocity"] = value
            elif op == 0xC:
                row["program"] = value[0]
        yield (track, n, delta, tick, *row.values())
        n += 1
        if row["type"] == "end_of_track":
            return


def _number(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(out[::-1])


def write(events: list[tuple[int, bytes]], ticks: int = TICKS) -> bytes:
    """(tick, message bytes) in order -> a file of one track."""
    body, last = bytearray(), 0
    for tick, message in events:
        body += _number(tick - last) + message
        last = tick
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, ticks) + b"MTrk" + struct.pack(">I", len(body)) + bytes(body)


def tokens_to_midi(tokens: list[str], velocities: list[int]) -> bytes:
    """A whole token sequence as a file: 4/4, a tempo message at every tempo token, offs before ons at one tick. `velocities` gives the value of each bin."""
    unit = TICKS * 4 // 32
    out: list[tuple[int, int, int, bytes]] = [(0, 0, 0, b"\xff\x58\x04\x04\x02\x18\x08")]
    bar, i, channels = -1, 0, {}
    while i < len(tokens):
        kind, _, value = tokens[i].partition("_")
        if tokens[i] == "BAR":
            bar += 1
        elif kind == "TEMPO":
            us = round(60_000_000 / int(value))
            out.append((max(0, bar) * 32 * unit, 0, 1, b"\xff\x51\x03" + us.to_bytes(3, "big")))
        elif kind == "POS":
            inst = tokens[i + 1].removeprefix("INST_")
            if inst not in channels:
                ch = len(channels) + (len(channels) >= 9)  # the drum channel stays free
                channels[inst] = ch
                out.append((0, 1, ch, bytes([0xC0 | ch, PROGRAMS[inst]])))
            pitch, dur, vel = (int(t.split("_")[1]) for t in tokens[i + 2 : i + 5])
            start = (max(0, bar) * 32 + int(value)) * unit
            ch = channels[inst]
            out.append((start, 3, pitch, bytes([0x90 | ch, pitch, velocities[vel]])))
            out.append((start + dur * unit, 2, pitch, bytes([0x80 | ch, pitch, 0])))
            i += 4
        i += 1
    out.sort(key=lambda e: e[:3])
    return write([(t, m) for t, _, _, m in out])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Batches FILES rows at a time, as lists by column."""
    for batch in batches:
        for s in range(0, batch.num_rows, FILES):
            yield batch.slice(s, FILES).to_pydict()


def message_batches(batches: Iterator[pa.RecordBatch], key: str, content: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Files -> their messages, about ROWS a batch; `kind` is the type of `key`."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(key, kind), ("ticks_per_beat", pa.int32()), *((n, kinds[k]) for n, k in (c.split() for c in MESSAGES.split(", "))), ("error", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows: list[tuple] = []
    for part in _parts(batches):
        for k, data in zip(part[key], part[content]):
            try:
                ticks, found = parse(data or b"")
                rows.extend((k, ticks, *r, None) for r in found)
            except (MidiError, IndexError, struct.error) as e:
                rows.append((k, *[None] * (len(schema) - 2), str(e) or "cut off"))
            while len(rows) >= ROWS:
                yield batch(rows[:ROWS])
                rows = rows[ROWS:]
    if rows:
        yield batch(rows)


def messages(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """`key`, `ticks_per_beat`, MESSAGES and `error`: one row per message; a file that can't be read is one row with its error."""
    kind = to_arrow_type(files.schema[key].dataType)
    return files.select(key, content).mapInArrow(lambda b: message_batches(b, key, content, kind), f"{key} {files.schema[key].dataType.simpleString()}, ticks_per_beat int, {MESSAGES}, error string")


def midi_bytes(sequences: DataFrame, velocities: list[int], key: str = "file_id") -> DataFrame:
    """`key`, `content`: token sequences as MIDI files."""
    kind = to_arrow_type(sequences.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(part[key], kind), pa.array([tokens_to_midi(t, velocities) for t in part["tokens"]], pa.binary())], names=[key, "content"])

    return sequences.select(key, "tokens").mapInArrow(run, f"{key} {sequences.schema[key].dataType.simpleString()}, content binary")


class _Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.batch = options["path"], int(options.get("files_per_partition", "256"))

    def partitions(self) -> list[_Part]:
        from pathlib import Path

        found = sorted(str(p) for p in Path(self.folder).rglob("*") if p.suffix.lower() in (".mid", ".midi"))
        return [_Part(found[i : i + self.batch]) for i in range(0, len(found), self.batch)] or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        from pathlib import Path

        for p in part.paths:
            try:
                ticks, rows = parse(Path(p).read_bytes())
                yield from ((p, ticks, *r, None) for r in rows)
            except (MidiError, IndexError, struct.error) as e:
                yield (p, *[None] * 13, str(e) or "cut off")


class MidiSource(DataSource):
    """`spark.read.format("midi").load(folder)`: message rows of all MIDI files below a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return f"path string, ticks_per_beat int, {MESSAGES}, error string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MidiSource)


def notes_of(rows: DataFrame, key: str = "path") -> DataFrame:
    """`key`, `track_idx`, `channel`, `pitch`, `start_tick`, `end_tick`, `velocity` of message rows, last on first off."""
    from melisma.operators.notes import paired_notes

    on = (F.col("type") == "note_on") & (F.col("velocity") > 0)
    tone = rows.where("type IN ('note_on', 'note_off') AND channel <> 9").withColumn("d", F.when(on, 1).otherwise(-1))
    pairs = paired_notes(tone.withColumnRenamed("abs_tick", "tick"), [key, "track_idx", "channel", "note"], ["msg_idx"], ["tick", "velocity"])
    return pairs.select(key, "track_idx", "channel", F.col("note").alias("pitch"), "start_tick", "end_tick", F.col("start_velocity").alias("velocity"))
