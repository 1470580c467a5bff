"""Packing documents' tokens into sequences of a fixed length: best-two-fit over a histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetline.llm.common import binary, bounded, read
from facetline.llm.tokens import word_tokens
from facetline.session import Scratch

SLIM = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def plan(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as ([(length, how many)], copies), covering each length exactly counts[length] times.

    A bin is filled greedily with the longest piece that fits; then its smallest piece makes room for two unpacked ones
    that together fill the widened gap better, if there are such. Bins with the same content are made at once, as many
    as the counts allow; so the plan's size follows the number of different lengths (at most size), not of pieces.
    """
    left = np.zeros(size + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    ids = np.arange(size + 1)
    out = []
    while left.any():
        free, gap, bin_ = left.copy(), size, {}
        while gap:
            here = np.flatnonzero(free[1 : gap + 1])
            if not len(here):
                break
            k = int(here[-1]) + 1
            n = int(min(free[k], gap // k))
            if not bin_:
                n = 1 if 2 * k > size else n
            bin_[k] = bin_.get(k, 0) + n
            free[k] -= n
            gap -= k * n
        if gap and len(bin_) and sum(bin_.values()) > 1:
            s = min(bin_)
            room = gap + s
            under = np.maximum.accumulate(np.where(free > 0, ids, 0))  # the longest unpacked piece of at most this length
            a = np.flatnonzero(free[: room + 1] > 0)
            if len(a):
                b = under[room - a]
                same = (b == a) & (free[a] < 2)
                b[same] = under[np.maximum(a[same] - 1, 0)]
                both = np.where(b > 0, a + b, 0)
                if (best := int(both.max())) > s:
                    i = int(np.flatnonzero(both == best)[-1])
                    bin_[s] -= 1
                    for k in (int(a[i]), int(b[i])):
                        bin_[k] = bin_.get(k, 0) + 1
                    bin_ = {k: n for k, n in bin_.items() if n}
        copies = int(min(left[k] // n for k, n in bin_.items()))
        for k, n in bin_.items():
            left[k] -= n * copies
        out.append((sorted(bin_.items(), reverse=True), copies))
    return out


def layout(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each length and run of ranks within it: the first sequence, pieces a sequence, and the first one's offset."""
    rows, taken, base = [], {}, 0
    for content, copies in bins:
        at = 0
        for k, n in content:
            rows.append((k, taken.get(k, 0), base, n, at))
            taken[k] = taken.get(k, 0) + n * copies
            at += k * n
        base += copies
    rows.sort()
    x = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (x[:, 0] << 48) | x[:, 1], "start": x[:, 1], "base": x[:, 2], "per": x[:, 3], "at": x[:, 4]}


def pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of at most size tokens, with the task that made it (part) and how many of its length that task
    had made before (nth)."""
    bounded(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, made = word_tokens(tokenizer_path), TaskContext.get().partitionId(), [0] * (size + 1)
        for b in batches:
            out, ids = ([], [], [], [], [], [], []), []
            for doc, raw in zip(b.column(0).to_pylist(), binary(b.column(1)), strict=True):
                own = tokens.text(raw) + end
                for i, at in enumerate(range(0, len(own), 4 * size)):
                    x = own[at : at + 4 * size]
                    n = len(x) // 4
                    for col, v in zip(out, (doc, i, at // 4, n, zlib.crc32(x), part, made[n]), strict=True):
                        col.append(v)
                    made[n] += 1
                    if keep_ids:
                        ids.append(np.frombuffer(x, "<i4"))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            cols = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, SLIM + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece's place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if kept.

    Only documents longer than size are cut. A null or empty text is its end id alone; repeated rows are packed each
    for itself; a null id is kept; other columns are not read; no rows give no rows. The driver sees one count for each
    length (at most size of them) and plans from these; a piece finds its place by its length and its rank among the
    pieces of that length, ranks being counted within tasks and added up, so nothing passes through a single task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    made = scratch.cut(pieces(docs, tokenizer_path, size, end_id, keep_ids, id_col, text_col))
    sums = scratch.cut(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    x = layout(plan(counts, size))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            length, rank = col["length"].to_numpy(), col["nth"].to_numpy() + col["before"].to_numpy()
            i = np.searchsorted(x["key"], (length << 48) | rank, "right") - 1
            copy, slot = np.divmod(rank - x["start"][i], x["per"][i])
            col |= {"sequence_id": pa.array(x["base"][i] + copy), "offset": pa.array(x["at"][i] + slot * length)}
            keep = [n for n in col if n not in ("part", "nth", "before")]
            yield pa.RecordBatch.from_arrays([col[n] for n in keep], names=keep)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, " + "ids array<int>, " * keep_ids + "sequence_id bigint, offset bigint"
    return made.join(before.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "nth", "before").mapInArrow(place, schema)


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(read(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
