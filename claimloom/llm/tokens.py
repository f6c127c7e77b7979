"""Encoding of texts by a public byte-level BPE vocabulary through sentencepiece.

A sentencepiece model is serialised straight from the vocabulary file: each token's bytes are mapped to
printable characters (one per byte), its score is the negative rank, and normalisation is the identity.
Texts are cut into pre-tokens by the vocabulary's pattern, each pre-token is byte-mapped and encoded by the
model, whose best-score merges are then the merges of lowest rank. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that cuts texts into pre-tokens for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens up to this length are remembered, at most so many of them in a worker.
REMEMBER_LENGTH, REMEMBER = 40, 400_000
_NORMAL, _UNKNOWN = 1, 2


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself where printable, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the id after the last is for unknown pieces.

    Ranks must run from 0 without gaps and include the 256 single bytes, so that nothing is ever unknown.
    """
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0..n-1 and include every single byte")
    shown = byte_characters()
    pieces = b"".join(_piece("".join(shown[b] for b in token), -float(rank), _NORMAL) for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]))
    unknown = _piece("<unk>", 0.0, _UNKNOWN)
    none = 2**64 - 1  # -1: there are no begin, end and padding pieces
    trainer = _message(2, _number(3, 2) + _number(40, len(ranks)) + _number(41, none) + _number(42, none) + _number(43, none))
    normaliser = _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return pieces + unknown + trainer + normaliser


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64(token) rank``."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


@dataclass
class Encoder:
    """Encodes in one process; the model and its cache are made on first use there."""

    model: bytes
    pattern: str = PATTERN

    def __getstate__(self) -> dict:
        return {"model": self.model, "pattern": self.pattern}

    @cached_property
    def _processor(self):  # noqa: ANN202
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def _cut(self):  # noqa: ANN202
        import regex

        return regex.compile(self.pattern).findall

    @cached_property
    def _shown(self) -> dict[int, str]:
        return byte_characters()

    @cached_property
    def _seen(self) -> dict[str, list[int]]:
        return {}

    def _encode_piece(self, pre: str) -> list[int]:
        ids = self._processor.encode(pre.encode().decode("latin-1").translate(self._shown))
        if len(pre) <= REMEMBER_LENGTH:
            if len(self._seen) >= REMEMBER:
                self._seen.clear()
            self._seen[pre] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; [] for null and empty text."""
        if not text:
            return []
        seen, out = self._seen, []
        for pre in self._cut(text):
            ids = seen.get(pre)
            out += self._encode_piece(pre) if ids is None else ids
        return out

    def decode(self, ids: list[int]) -> str:
        back = self.__dict__.setdefault("_back", {c: b for b, c in self._shown.items()})
        pieces = "".join(map(self._processor.id_to_piece, ids))
        return bytes(back[c] for c in pieces).decode("utf-8", errors="replace")


def encoder(vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> Encoder:
    return Encoder(serialise_model(load_ranks(vocabulary)), pattern)


def encode_texts(df: DataFrame, key: str, text: str, enc: Encoder, ids: str = "ids") -> DataFrame:
    """(key, ids array<int>) of each row of ``df``; null and empty texts give an empty array.

    Narrow: rows are encoded where they are read. Other columns are not read. Repeated rows stay repeated.
    The model (some MB, fixed by the vocabulary) is sent to the workers once as a broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(enc)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for batch in batches:
            made = pa.array([e.encode(t) for t in batch.column(1).to_pylist()], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["k", "ids"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), F.col("ids").alias(ids))


def count_tokens(df: DataFrame, key: str, text: str, enc: Encoder, count: str = "n_tokens") -> DataFrame:
    """(key, number of tokens) of each row; 0 for null and empty texts. Ids do not leave the workers."""
    shared = df.sparkSession.sparkContext.broadcast(enc)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for batch in batches:
            made = pa.array([len(e.encode(t)) for t in batch.column(1).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["k", "n"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n bigint").select(F.col("k").alias(key), F.col("n").alias(count))


def decode_ids(df: DataFrame, key: str, ids: str, enc: Encoder, text: str = "text") -> DataFrame:
    """(key, text) of each row's ids by the inverse mapping; null and empty ids give ''."""
    shared = df.sparkSession.sparkContext.broadcast(enc)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for batch in batches:
            made = pa.array([e.decode(x or []) for x in batch.column(1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["k", "t"])

    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, t string").select(F.col("k").alias(key), F.col("t").alias(text))
