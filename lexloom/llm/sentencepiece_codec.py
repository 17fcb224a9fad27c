"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here field by field; from it come the normaliser's switches, the white-space marker, the pieces with their
scores and kinds, and byte fallback. A unigram model becomes tokenizers' Unigram; a BPE model becomes its BPE with the merges that the
scores imply (every split of a piece into two pieces, best piece first). Pieces that join across a separator would make a text
indivisible, so the separators (before a marker that follows something else, around line breaks) are kept only after a look at every
piece; between them each distinct chunk is encoded once, in multithreaded batches.

Defined cases: a null text is empty and has no ids; a null id in a decoded list is left out; other columns of the input are not read.
A compiled character map goes to the library's `Precompiled` normaliser as it is. Models with user-defined pieces, or with the marker as a suffix,
are refused.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .wordcache import ChunkCache

#: Fixed values of the format: kinds of pieces, model types, the marker.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; nested messages stay bytes, floats their four bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    type: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True
    char_map: bytes = b""
    suffix: bool = False
    unknown_text: str = " ⁇ "

    @classmethod
    def load(cls, path: str) -> Model:
        out = cls()
        with open(path, "rb") as f:
            data = f.read()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                out.pieces.append(piece.get(1, b"").decode())
                out.scores.append(float(np.frombuffer(piece.get(2, b"\0" * 4), dtype="<f4")[0]))
                out.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
                out.type, out.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
                out.suffix, out.unknown_text = bool(trainer.get(24, 0)), trainer.get(44, " ⁇ ".encode()).decode()
            elif number == 3:
                norm = dict(fields(value))
                out.char_map, out.dummy_prefix, out.strip_spaces, out.escape_spaces = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        return out


def backend(m: Model):
    """The model of the tokenizers library that gives the same ids within a chunk."""
    from tokenizers import Tokenizer, models

    unk = m.kinds.index(UNKNOWN)
    if m.type == UNIGRAM:
        low = min(s for s, k in zip(m.scores, m.kinds, strict=True) if k == NORMAL) - 10
        return Tokenizer(models.Unigram([(p, s if k == NORMAL else low) for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True)], unk_id=unk, byte_fallback=m.byte_fallback))
    if m.type != BPE:
        raise ValueError("only unigram and BPE models are read")
    vocab = {p: i for i, p in enumerate(m.pieces)}
    usable = {p for p, k in zip(m.pieces, m.kinds, strict=True) if k in (NORMAL, USER)}
    ranked = sorted((i for i, p in enumerate(m.pieces) if p in usable and len(p) > 1), key=lambda i: (-m.scores[i], i))
    merges = [(p[:k], p[k:]) for p in (m.pieces[i] for i in ranked) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
    return Tokenizer(models.BPE(vocab, merges, unk_token=m.pieces[unk], fuse_unk=True, byte_fallback=m.byte_fallback))


class Codec:
    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import regex
        from tokenizers import normalizers

        self.m = m = Model.load(path)
        if m.suffix:
            raise ValueError("the marker is a suffix in this model")
        self.mapped = normalizers.Precompiled(m.char_map).normalize_str if m.char_map else None
        self.engine = backend(m)
        self.id = {p: i for i, p in enumerate(m.pieces)}
        if any(k == USER for k in m.kinds):
            raise ValueError("user-defined pieces are matched before the model and aren't rebuilt here")
        long = [p for p, k in zip(m.pieces, m.kinds, strict=True) if k == NORMAL and len(p) > 1]
        #: A marker inside a piece, behind something else, would join two chunks; so would a line break in a longer piece.
        lines = not any("\n" in p for p in long)
        if any(MARK in p.lstrip(MARK) for p in long):
            self.split = None
        else:
            self.split = regex.compile(rf"\n+|{MARK}*[^{MARK}\n]+|{MARK}+" if lines else rf"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.cache = ChunkCache(self._fill)
        # what each id adds to a text
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else m.unknown_text.encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.is_byte = np.array([k == BYTE for k in m.kinds])

    def _fill(self, chunk: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(chunk), 50_000):
            out += [np.array(e.ids, dtype=np.int32).tobytes() for e in self.engine.encode_batch_fast(chunk[i : i + 50_000], add_special_tokens=False)]
        return out

    def normal(self, text: str) -> str:
        if self.mapped:
            text = self.mapped(text)
        if self.m.strip_spaces:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.m.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.m.escape_spaces else text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.split(x) if self.split else [x] * bool(x) for x in map(self.normal, texts)]
        known = self.cache.get(set().union(*parts)) if parts else {}
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), dtype=np.int32) for p in parts]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        if self.m.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


@lru_cache(maxsize=2)
def codec(path: str, threads: int = 2) -> Codec:
    return Codec(path, threads)


def encode(docs: DataFrame, path: str, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, threads)
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(own.encode(part["text"]), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds the decoded text; null ids give a null text."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([None if ids is None else own.decode([int(i) for i in ids if i is not None]) for ids in column])

    return encoded.withColumn("decoded", run(F.col(ids_col)))


def digests(docs: DataFrame, path: str, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: counts, the ids' CRC-32 (little-endian unsigned 32-bit), and whether the text came back."""
    schema = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, threads)
        for part in chunks(batches):
            rows = []
            for doc_id, text, ids in zip(part["doc_id"], part["text"], own.encode(part["text"]), strict=True):
                back = own.decode(ids.tolist())
                want = own.normal(text).replace(MARK, " ")
                rows.append((doc_id, len(ids), int(own.is_byte[ids].sum()), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode()), back == (want[1:] if own.m.dummy_prefix else want)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (*[pa.int64()] * 5, pa.bool_()), strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
