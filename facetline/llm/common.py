"""What several of these operators share: words, batches, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetline.session import Scratch

#: Bytes of input per Arrow batch: whole texts are long, so batches are bounded by size, not by rows.
BATCH_BYTES = 4_000_000
#: Bytes that are hashed at once; longer words are hashed one by one.
PIECE = 1 << 16


def words_of(raw: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``; bytes.split() cuts at exactly these characters."""
    return raw.split()


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes in sessions that leave them unbounded: one value for all operators, set once, so that
    plans built before or after one another behave alike. A session's own setting stands."""
    if spark.conf.get(LIMIT, None) is None:
        spark.conf.set(LIMIT, str(BATCH_BYTES))


LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def binary(col: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes, null as b""."""
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str) -> DataFrame:
    """mapInArrow of a function of one batch, in batches of bounded size."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def _powers(p: int) -> np.ndarray:
    out = np.full(PIECE + 1, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_POWERS, _BACK = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
#: A random value for each byte, A-Z as a-z.
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins and the last ends; null as empty."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, at, data = col.buffers()
    at = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1] if at else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return data, at - at[0]


def hash_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z as a-z), one after another, and where each text's words begin; the
    last entry is their number.

    A word's hash is a polynomial of its bytes' values, taken from running sums over the whole batch: a few passes of
    numpy instead of a look-up for each word.
    """
    data, at = flat(col)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = _SPACE[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:], last[:-1] = space[:-1], space[1:]
    first[at[:-1][at[:-1] < len(data)]] = True
    last[at[1:][at[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + PIECE, "right"))
        if j == i:
            import xxhash

            out[i] = xxhash.xxh3_64_intdigest(data[lo : ends[i]].tobytes().lower())
            i += 1
            continue
        sums = np.zeros(ends[j - 1] - lo + 1, np.uint64)
        np.cumsum(_VALUES[data[lo : ends[j - 1]]] * _POWERS[: len(sums) - 1], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * _BACK[s]
        i = j
    return mix(out), np.searchsorted(starts, at)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as one compressed value: the bytes of one significance next to each other."""
    import zstandard

    head = np.array([len(arrays), *[n for a in arrays for n in (a.dtype.itemsize, len(a))]], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays))


def unpacked(blob: bytes) -> list[np.ndarray]:
    """What packed() was given, as unsigned integers."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    sizes, out, at = raw[8 : 8 + 16 * n].view("<i8").reshape(n, 2).tolist(), [], 8 + 16 * n
    for size, length in sizes:
        out.append(np.ascontiguousarray(raw[at : at + size * length].reshape(size, length).T).view(f"<u{size}").reshape(-1))
        at += size * length
    return out


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(key, its blobs) of rows (key, blob) that are sorted by key."""
    key, held = None, []
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(blob)
    if held:
        yield key, held


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values evenly."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words: sums of the words' hashes, each times a power of an odd number by its place."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    return out


def shingle_sets(h: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Of texts' words as hash_words() gives them: the sorted distinct k-word shingles of each text; with fewer words the
    whole sequence is one; none without words."""
    every = windows(h, k) if len(h) >= k else h[:0]
    out = []
    for i, j in zip(at.tolist(), at[1:].tolist(), strict=False):
        n = j - i
        out.append(distinct(every[i : j - k + 1]) if n >= k else windows(h[i:j], n) ^ np.uint64(n * 0x51ED27) if n else h[:0])
    return out


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge. edges: (a, b), any orderable type.

    Alternating large-star and small-star rounds; each round is one written table, each key's rows are reduced by
    partial minima, and the joins are plain so that skewed hubs can be split. Null ends and loops link nothing.
    """
    e = scratch.cut(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new = scratch.cut(small)
        scratch.drop(e)
        e = new
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(e: DataFrame) -> bool:
    """Whether every node is a root or hangs on one root: sums by node, no join."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
