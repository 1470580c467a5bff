"""Byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from facetline.llm.common import by_batch, read
from facetline.llm.tokens import byte_tokens


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", offsets: str | None = None) -> DataFrame:
    """df with a column of token ids (array<int>) and, if offsets is named, each token's first character (array<long>).

    A null text counts as empty and has no ids. Ids are those of the library's greedy merges within each match of the
    pattern; special tokens are ordinary text. Columns named like the new ones are replaced. One narrow pass: no shuffle.
    """
    new = [(out, "array<int>")] + [(offsets, "array<bigint>")] * bool(offsets)
    base = df.drop(*[n for n, _ in new])
    schema = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in new))
    schema = StructType(base.schema.fields + schema.fields)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        t = byte_tokens(ranks_path, pattern)
        ids = [np.frombuffer(t.encode(x or ""), "<u4") for x in b.column(b.schema.get_field_index(text)).to_pylist()]
        cols = [_lists(ids, pa.int32())]
        if offsets:
            cols.append(_lists([t.offsets(x) for x in ids], pa.int64()))
        return pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *[n for n, _ in new]])

    return by_batch(base, fn, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column: the bytes of a column of token ids. Null ids count as none; ids outside the table raise."""
    base = df.drop(out)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        t = byte_tokens(ranks_path, pattern)
        texts = [t.decode(x) for x in _arrays(b.column(b.schema.get_field_index(ids)))]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*b.schema.names, out])

    return by_batch(base, fn, StructType(base.schema.fields + StructType.fromDDL(f"`{out}` binary").fields))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype())))


def _arrays(col: pa.ListArray) -> list[np.ndarray]:
    flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [flat[a:b] if ok else flat[:0] for a, b, ok in zip(at, at[1:], col.is_valid().to_pylist(), strict=False)]


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded documents."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = _arrays(b.column(b.schema.get_field_index(ids)))
        sha = [hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in rows]
        raw = [hashlib.sha256(x or b"").hexdigest() for x in b.column(b.schema.get_field_index(decoded)).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(list(map(len, rows)), pa.int64()), pa.array(sha, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batch(df, fn, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = P.path("byte_bpe_50k.tiktoken")
    return digests(decode(encode(docs, path, P.PATTERN).select("doc_id", "ids"), path, P.PATTERN))
