"""Operator 8: byte-level BPE encoding and decoding with vectorised pre-tokenisation (see bpe.py)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import encoder
from .common import with_columns


def _encoded(enc, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
    """(ids, offsets) of each text."""
    got, at = enc.encode(texts)
    ids, offsets = [], []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        own = got[i:j]
        ends = np.cumsum(enc.width[own])
        ids.append(own.astype("<u4").tobytes())
        offsets.append((ends - enc.width[own]).astype("<u4").tobytes())
    return ids, offsets


def _decoded(enc, ids: bytes | None, offsets: bytes | None) -> bytes:
    data, at = enc.decode(np.frombuffer(ids or b"", "<u4"))
    if not np.array_equal(at[:-1], np.frombuffer(offsets or b"", "<u4")):
        raise ValueError("offsets don't match the ids")
    return data


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """Adds ids and offsets, both little-endian unsigned 32-bit binaries: each token's id and the byte of the text where it
    begins. A null text counts as empty and has no ids; rows are independent, so repeated rows, ties and any text length
    give what each row alone would; columns of these names are replaced."""

    def run(cols):
        out, starts = _encoded(encoder(ranks_path), [t or "" for t in cols[0].to_pylist()])
        return [pa.array(out, pa.binary()), pa.array(starts, pa.binary())]

    return with_columns(df, [text], run, [T.StructField(ids, T.BinaryType()), T.StructField(offsets, T.BinaryType())])


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", offsets: str = "offsets", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that ids stand for. Each token's bytes go to its retained offset, and an offset that doesn't follow
    from the tokens before it is an error. Null or empty ids give empty bytes; a column named decoded is replaced."""

    def run(cols):
        enc = encoder(ranks_path)
        return [pa.array([_decoded(enc, a.as_py(), b.as_py()) for a, b in zip(cols[0], cols[1])], pa.binary())]

    return with_columns(df, [ids, offsets], run, [T.StructField(decoded, T.BinaryType())])


def encode_decode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", offsets: str = "offsets", decoded: str = "decoded") -> DataFrame:
    """What decode(encode(df)) gives, in one pass: a task then has one Python worker, not two, beside the JVM."""

    def run(cols):
        enc = encoder(ranks_path)
        out, starts = _encoded(enc, [t or "" for t in cols[0].to_pylist()])
        return [pa.array(x, pa.binary()) for x in (out, starts, [_decoded(enc, a, b) for a, b in zip(out, starts)])]

    return with_columns(df, [text], run, [T.StructField(c, T.BinaryType()) for c in (ids, offsets, decoded)])
