"""Encoding and decoding of whole texts with a public byte-level BPE tokenizer (problem 7)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Characters handed to the tokenizer at once; a single longer text goes alone.
CALL_CHARS = 2_000_000


def _tokenizer(folder: str, name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{name}.json")
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def _calls(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CALL_CHARS together, so that one call's memory is bounded."""
    run: list[str] = []
    first = size = 0
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(t or "")
        if size >= CALL_CHARS:
            yield first, run
            run, first, size = [], i + 1, 0
    if run:
        yield first, run


def _flat(arrays: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    ends = [0]
    for a in arrays:
        ends.append(ends[-1] + len(a))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for a in arrays for x in a], kind))


def _encode(folder: str, name: str, spans: bool, lengths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(folder, name)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for first, part in _calls(texts):
                coded = tok.encode_batch(part, add_special_tokens=False) if spans else tok.encode_batch_fast(part, add_special_tokens=False)
                own = keys.slice(first, len(part))
                if lengths:
                    yield pa.RecordBatch.from_arrays([own, pa.array([len(c.ids) for c in coded], pa.int32())], names=["key", "tokens"])
                    continue
                cols = [own, _flat([c.ids for c in coded], pa.int32())]
                if spans:
                    cols += [_flat([[o[k] for o in c.offsets] for c in coded], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "ids", "starts", "ends"][: len(cols)])

    return run


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """The two columns under names of their own, so that no other column can clash."""
    return df.select(F.col(key).alias("key"), F.col(text).alias("text"))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """`key`, `ids` array<int>: one row per input row; empty and null texts give an empty list. Special tokens' strings are ordinary text."""
    return _named(df, key, text).mapInArrow(_encode(folder, name, False, False), f"key {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def encode_spans(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """As encode, with `starts` and `ends`: each token's characters in the text. Tokens that share one split character all span it."""
    return _named(df, key, text).mapInArrow(_encode(folder, name, True, False), f"key {df.schema[key].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """`key`, `tokens` int."""
    return _named(df, key, text).mapInArrow(_encode(folder, name, False, True), f"key {df.schema[key].dataType.simpleString()}, tokens int").withColumnRenamed("key", key)


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes write themselves, the others the letters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _decode(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = byte_letters()
        piece = {i: bytes(letter[c] for c in w) for w, i in _tokenizer(folder, name).get_vocab(with_added_tokens=False).items() if all(c in letter for c in w)}
        for batch in batches:
            # joined as bytes first: a character split over tokens comes together again before decoding
            texts = [b"".join(piece.get(i, b"") for i in ids or []).decode("utf-8", errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return run


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """`key`, `text`: the texts of lists of ids. Unknown ids give nothing; bytes that make no character give U+FFFD; an empty or null list gives ''."""
    return df.select(F.col(key).alias("key"), ids).mapInArrow(_decode(folder, name), f"key {df.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)
