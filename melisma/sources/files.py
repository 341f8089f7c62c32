"""File sources and sinks: listings, JSON lines, token lines, packed binaries, reports."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DTYPES = {"uint16": np.uint16, "uint32": np.uint32}


def is_midi(path: Column) -> Column:
    return F.lower(path).rlike(r"\.midi?$")


def midi_files(spark: SparkSession, folder: str, limit: int | None = None, content: bool = True) -> DataFrame:
    """`path`, `length` and `content` of all MIDI files below a folder, in any case, sorted if limited. Only files kept are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][iI][dD]*").load(folder).where(is_midi(F.col("path")))
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    return files.select("path", "length", *(["content"] if content else []))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON objects, one a line; blank lines and lines that hold no object are skipped, a missing file gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema))
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("r")).where("r IS NOT NULL").select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included, as a folder of part files."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_event(df: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """`row_id` (dense, from 0, in file order) and `value` of the non-blank lines. Counts per partition give each its first number."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_i", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_i", 33)
    counts = lines.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.expr("sum(_n) OVER (ORDER BY _p) - _n")
    place = F.expr("row_number() OVER (PARTITION BY _p ORDER BY _i) - 1")
    return lines.withColumn("_p", part).withColumn("_r", place).join(F.broadcast(counts.select("_p", before.alias("_before"))), "_p").select((F.col("_before") + F.col("_r")).alias("row_id"), "value")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables by position (`row_id`); different numbers of rows are an error."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows on the left, {b} on the right")
    return left.join(right, "row_id")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """`row_id`, `tokens` of a file of token lines; empty tokens are dropped."""
    return numbered_lines(spark, path).select("row_id", F.filter(F.split("value", " "), lambda t: t != "").alias("tokens"))


def write_tokens(df: DataFrame, path: str, tokens: str = "tokens") -> None:
    df.select(F.array_join(tokens, " ").alias("value")).write.mode("overwrite").text(path)


def read_object(path: str) -> dict:
    """A JSON object of a small settings file; anything else is an error."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value


def read_settings(path: str, defaults: dict | None = None, strict: bool = False) -> dict:
    """A YAML mapping over defaults; an empty file counts as empty. Unknown keys are ignored, or an error if `strict`."""
    import yaml

    value = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    if defaults is None:
        return value
    extra = sorted(set(value) - set(defaults))
    if strict and extra:
        raise ValueError(f"unknown keys: {', '.join(extra)}")
    return defaults | {k: v for k, v in value.items() if k in defaults}


# Settings of a benchmark that its file need not give.
BENCHMARK = {"seed": 42, "sample_count": None, "per_bucket_limit": None, "min_prefix_tokens": 16, "continuation_prefix_ratio_min": 0.35, "continuation_prefix_ratio_max": 0.70, "infilling_hole_ratio_min": 0.10, "infilling_hole_ratio_max": 0.25, "export_sample_count": 12, "top_k": 3, "max_window_tokens": 1024}


def benchmark_settings(path: str) -> dict:
    """Settings of a benchmark with defaults; the tier is the file's name after 'benchmark_'."""
    return read_settings(path, BENCHMARK) | {"tier": re.sub(r"^benchmark_", "", Path(path).stem)}


def write_report(value: dict, path: str) -> None:
    """A JSON report, UTF-8, indented."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def vocabulary_table(spark: SparkSession, payload: dict) -> DataFrame:
    """`id`, `token` of a vocabulary: its list if it has one, else the inverted mapping with <UNK> in the gaps."""
    if payload.get("id_to_token"):
        rows = list(enumerate(payload["id_to_token"]))
    else:
        known = {int(i): t for t, i in payload["token_to_id"].items()}
        rows = [(i, known.get(i, "<UNK>")) for i in range(max(known, default=-1) + 1)]
    return spark.createDataFrame(rows, "id int, token string")


def write_packed(sequences: DataFrame, folder: str, split: str, key: str, dtype: str = "uint16") -> dict:
    """Writes `ids` arrays as one flat binary with an index of offsets and lengths in tokens; returns the index.

    Sequences come in order of `key` and are streamed to the driver one partition at a time, since the result is one file.
    Empty sequences are skipped; an id beyond the type is an error.
    """
    os.makedirs(folder, exist_ok=True)
    offsets, lengths, at = [], [], 0
    with open(f"{folder}/{split}.bin", "wb") as out:
        for row in sequences.orderBy(key).toLocalIterator():
            if not row["ids"]:
                continue
            if max(row["ids"]) > np.iinfo(DTYPES[dtype]).max:
                raise ValueError(f"id {max(row['ids'])} exceeds {dtype}")
            out.write(np.asarray(row["ids"], DTYPES[dtype]).tobytes())
            offsets.append(at)
            lengths.append(len(row["ids"]))
            at += lengths[-1]
    index = {"split": split, "dtype": dtype, "num_sequences": len(lengths), "num_tokens": at, "offsets": offsets, "lengths": lengths}
    write_report(index, f"{folder}/{split}.idx.json")
    return index


def read_packed(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """`seq_no`, `ids` of a packed binary; each task maps the file and reads its own sequences only."""
    index = read_object(f"{folder}/{split}.idx.json")
    path, kind = f"{folder}/{split}.bin", DTYPES[index["dtype"]]
    rows = spark.createDataFrame([(i, o, n) for i, (o, n) in enumerate(zip(index["offsets"], index["lengths"]))], "seq_no int, offset long, length int")

    def load(batches):
        flat = np.memmap(path, kind, "r") if index["num_tokens"] else np.empty(0, kind)
        for b in batches:
            yield b[["seq_no"]].assign(ids=[flat[o : o + n].astype(np.int32).tolist() for o, n in zip(b["offset"], b["length"])])

    return rows.mapInPandas(load, "seq_no int, ids array<int>")


def packed_size_faults(folder: str, index: dict) -> list[str]:
    """Contradictions between an index and its files: lines of the token file, bytes of the binary."""
    out, split = [], index["split"]
    tok, binary = Path(folder, f"{split}.tok"), Path(folder, f"{split}.bin")
    if tok.exists() and (n := sum(bool(x.strip()) for x in tok.open(encoding="utf-8"))) != index["num_sequences"]:
        out.append(f"{n} token lines, {index['num_sequences']} sequences")
    want = index["num_tokens"] * np.dtype(DTYPES[index["dtype"]]).itemsize
    if binary.exists() and binary.stat().st_size != want:
        out.append(f"{binary.stat().st_size} bytes, {want} expected")
    return out


def metrics_path(folder: str, given: str | None = None) -> str | None:
    """A run's metrics file, or null if there is none."""
    path = Path(given or f"{folder}/metrics.jsonl")
    return str(path.resolve()) if path.exists() else None


LOG = "event string, step long, loss double, valid_loss double, train_loss_ema double, best_valid_loss_so_far double, overfit_gap double, tokens_seen long, effective_batch int, seq_len int, tok_per_sec double, fim_ratio_in_batch double"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A metrics log with `line_no`; lines that are no object are skipped."""
    return numbered_lines(spark, path).select((F.col("row_id") + 1).alias("line_no"), F.from_json("value", LOG).alias("r")).where("r IS NOT NULL").select("line_no", "r.*")


def write_samples(df: DataFrame, path: str) -> None:
    """Sample cases by checkpoint and task, as JSON in folders."""
    df.write.mode("overwrite").partitionBy("checkpoint", "task").json(path)


def markdown_table(headers: list[str], rows: list[list[str]]) -> str:
    if not rows:
        return "_no data_\n"
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(headers), line(["---"] * len(headers)), *map(line, rows)]) + "\n"


def clean(path: str, pattern: str | None = None) -> None:
    """Empties a folder, or removes a file, or only the children that match; a missing path is fine."""
    import shutil

    p = Path(path)
    for x in p.glob(pattern) if pattern else ([p] if p.exists() else []):
        shutil.rmtree(x) if x.is_dir() else x.unlink()
    if pattern is None and not p.suffix:
        p.mkdir(parents=True, exist_ok=True)


def archive(run: str, target: str, tag: str, checkpoint: str | None = None, report: dict | None = None) -> dict:
    """Copies a run's chosen checkpoint and reports to a new folder and returns the manifest.

    The checkpoint is the one named, else the report's recommendation, else best, latest or last; a taken name gets a suffix.
    """
    import shutil

    safe = re.sub(r"[^A-Za-z0-9_.-]+", "-", tag.strip()).strip("-._") or "run"
    names = [checkpoint, ((report or {}).get("recommended_checkpoint") or {}).get("checkpoint_name"), "best.pt", "latest.pt", "last.pt"]
    chosen = next((n for n in names if n and Path(run, n).exists()), None)
    if chosen is None:
        raise FileNotFoundError(f"no checkpoint in {run}")
    out, n = Path(target, safe), 1
    while out.exists():
        n += 1
        out = Path(target, f"{safe}__{n:02d}")
    out.mkdir(parents=True)
    copied = [x.name for x in sorted(Path(run).iterdir()) if x.name == chosen or x.suffix in (".json", ".jsonl", ".md")]
    for name in copied:
        shutil.copy2(Path(run, name), out / name)
    manifest = {"run": str(run), "checkpoint": chosen, "files": copied}
    write_report(manifest, str(out / "manifest.json"))
    return manifest | {"folder": str(out)}


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
