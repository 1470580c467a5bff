"""Language-model scoring: context-tree weighting over bytes, beside a unigram base."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetline.llm.common import binary, bounded, read
from facetline.session import Scratch

DEPTH = 5
#: A byte that UTF-8 never holds: it stands before each text as context and after it as the end.
EDGE = 0xFF
#: Bytes of text that are looked up at once.
PART_BYTES = 24_000_000
#: Bytes whose strings are looked up in one go.
AT_ONCE = 400_000
END = b"\n"  # the end token; no word holds it
_ASCII = np.arange(256, dtype=np.uint8)
_ASCII[65:91] += 32


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0 by Stirling's series, shifted to where it is exact to double precision."""
    shift, y = np.zeros_like(x, float), np.asarray(x, float).copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """For every position from depth on: the context, nearest byte first, then the byte, in one integer."""
    n = len(data) - depth
    key = np.zeros(n, np.int64)
    for j in range(1, depth + 1):
        key = (key << 8) | data[depth - j : depth - j + n]
    return (key << 8) | data[depth : depth + n]


def packed(t: pa.RecordBatch | pa.Table) -> bytes:
    """Rows as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write(t)
    raw = sink.getvalue()
    return raw.size.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> pa.Table:
    size = int.from_bytes(blob[:8], "little")
    return pa.ipc.open_stream(pa.decompress(blob[8:], decompressed_size=size, codec="zstd")).read_all()


class Strings:
    """Counts of integers, gathered array by array in bounded memory."""

    def __init__(self, most: int = 2_000_000):
        self.u, self.c, self.new, self.size, self.most = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, most

    def add(self, x: np.ndarray) -> None:
        self.new.append(x)
        self.size += len(x)
        if self.size > self.most:
            self.counts()

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            u, c = np.unique(np.concatenate(self.new), return_counts=True)
            both, inv = np.unique(np.concatenate([self.u, u]), return_inverse=True)
            self.c = np.bincount(inv, np.concatenate([self.c, c]), len(both)).astype(np.int64)
            self.u, self.new, self.size = both, [], 0
        return self.u, self.c


def padded(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case, each after `depth` edges and before one, and where each one's positions end."""
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join(edge * depth + t + edge for t in texts), np.uint8)
    return _ASCII[data].astype(np.int64), np.cumsum([len(t) + 1 + depth for t in texts])


class Tree:
    """The nodes of one group of grams, at depths 2 to depth; the group holds all grams of its two nearest context bytes.

    Each byte is eight binary decisions; decision node v (1, then two more for each bit) has its own context tree.
    Nodes are (context, v) with counts of zeros and ones. A context never seen in training gives its parent's estimate.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, top: int = 2):
        self.depth, self.top = depth, top
        byte, context = keys & 255, keys >> 8
        self.levels: dict[int, dict[str, np.ndarray]] = {}
        below = None
        for d in range(depth, top - 1, -1):
            ctx = context >> (8 * (depth - d))
            node = np.concatenate([(ctx << 8) | ((1 << k) | (byte >> (8 - k))) for k in range(8)]) if len(keys) else np.zeros(0, np.int64)
            one = np.concatenate([(byte >> (7 - k)) & 1 for k in range(8)]) if len(keys) else node
            w = np.tile(n, 8)
            ids, inv = np.unique(node, return_inverse=True)
            b = np.bincount(inv, weights=w * one, minlength=len(ids))
            a = np.bincount(inv, weights=w, minlength=len(ids)) - b
            kt = log_kt(a, b)
            if below is None:
                weighted, stay = kt, np.ones(len(ids))
            else:
                up = ((below["id"] >> 16) << 8) | (below["id"] & 255)
                kids = np.bincount(np.searchsorted(ids, up), weights=below["pw"], minlength=len(ids))
                weighted = np.logaddexp(kt, kids) - math.log(2)
                stay = np.exp(kt - math.log(2) - weighted)
            below = self.levels[d] = {"id": ids, "a": a, "b": b, "pw": weighted, "stay": stay}

    def log10(self, keys: np.ndarray, mixed: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of each gram's byte given its context. mixed, rest: for each gram (row) and decision (8 columns), what
        depths 0 and 1 give to a one and the weight that they leave to deeper ones; where rest is negative, no deeper."""
        byte, context = keys & 255, keys >> 8
        out = np.zeros(len(keys))
        for k in range(8):
            v = (1 << k) | (byte >> (8 - k))
            p, left = mixed[:, k].copy(), rest[:, k].copy()
            last = np.full(len(keys), 0.5)
            live = left >= 0
            left = np.maximum(left, 0)
            for d in range(self.top, self.depth + 1):
                lev = self.levels[d]
                node = ((context >> (8 * (self.depth - d))) << 8) | v
                i = np.minimum(np.searchsorted(lev["id"], node), max(len(lev["id"]) - 1, 0))
                seen = live & (lev["id"][i] == node) if len(lev["id"]) else np.zeros(len(keys), bool)
                gone = live & ~seen
                p[gone] += left[gone] * last[gone]  # nothing deeper was seen: the parent's estimate takes the weight
                left[gone] = 0
                kt = (lev["b"][i] + 0.5) / (lev["a"][i] + lev["b"][i] + 1) if len(lev["id"]) else last
                stay = lev["stay"][i] if len(lev["id"]) else last
                p[seen] += left[seen] * stay[seen] * kt[seen]
                left[seen] *= 1 - stay[seen]
                last = np.where(seen, kt, last)
                live = seen
            p[live] += left[live] * last[live]
            one = ((byte >> (7 - k)) & 1).astype(bool)
            out += np.log10(np.where(one, p, 1 - p))
        return out


def roots(stats: pd.DataFrame) -> dict[str, np.ndarray]:
    """Depths 0 and 1 from the sums at depth 2: rows (c1, v, a, b, pw), at most 256 by 255. Returns arrays by [c1, v]:
    what these depths give to a one, the weight they leave (negative: context not seen), and their last estimate."""
    a, b, kids = (np.zeros((256, 256)) for _ in range(3))
    c, v = stats["c1"].to_numpy(int), stats["v"].to_numpy(int)
    a[c, v], b[c, v], kids[c, v] = stats["a"], stats["b"], stats["pw"]
    seen1 = a + b > 0
    kt1 = log_kt(a, b)
    pw1 = np.where(seen1, np.logaddexp(kt1, kids) - math.log(2), 0)
    a0, b0 = a.sum(0), b.sum(0)
    kt0, seen0 = log_kt(a0, b0), a0 + b0 > 0
    pw0 = np.logaddexp(kt0, pw1.sum(0)) - math.log(2)
    stay0, p0 = np.exp(kt0 - math.log(2) - pw0), (b0 + 0.5) / (a0 + b0 + 1)
    stay1, p1 = np.exp(kt1 - math.log(2) - pw1), (b + 0.5) / (a + b + 1)
    mixed = np.where(seen1, stay0 * p0 + (1 - stay0) * stay1 * p1, p0)
    rest = np.where(seen1, (1 - stay0) * (1 - stay1), -1.0)
    mixed = np.where(seen0, mixed, 0.5)
    return {"mixed": mixed, "rest": rest, "last": p1}


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def score(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] = (7, 2)) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte.

    The model learns from rows whose crc32(id as text) mod held[0] is not held[1]; a null id counts as an empty text for
    this. Texts are lower-cased (A-Z); null is empty. score: log10 of the probability that context-tree weighting gives
    the bytes of the text and its end, with all of the training counts; so it sums to one over texts. base_score: the
    unigram sum. Counts cover all rows; texts are cut nowhere. Empty tables give no rows.

    Texts are dealt to parts of about 24 MB as they are read. Distinct words and byte strings of each part are counted
    over parts by partial sums, joined with their counts and probabilities, and meet the part's texts again by its
    number (a part that was read in two tasks brings a word twice, which changes nothing): no table that grows with the corpus is broadcast or collected. Trees are built in groups of eight
    neighbours in the two nearest context bytes, at most 8 * 256 ** (depth - 1) strings each; the driver sees sums for depth 1, at most 256 by 255.
    """
    spark = docs.sparkSession
    bounded(spark)
    scratch = Scratch(spark, "lm")
    text = F.col(text_col).cast("string")
    out_of = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(held[0])) == held[1]
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), out_of.alias("held_out"), text.alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, room = TaskContext.get().partitionId(), 0, PART_BYTES
        for b in batches:
            size = b.nbytes
            if room < size:
                part, room = part + 1, PART_BYTES
            room -= size
            yield pa.RecordBatch.from_arrays([pa.array([at << 32 | part], pa.int64()), pa.array([packed(b)], pa.binary())], names=["part", "blob"])

    texts = scratch.cut(slim.mapInArrow(deal, "part bigint, blob binary"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        part, words, strings, size = None, [Counter(), Counter()], [Strings(), Strings()], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal words, strings, size
            train, other = words
            w = sorted(set(train) | set(other))
            n = np.array([train.get(x, 0) for x in w], np.int64)
            (u0, c0), (u1, _) = (x.counts() for x in strings)
            g = np.union1d(u0, u1)
            gn = np.zeros(len(g), np.int64)
            gn[np.searchsorted(g, u0)] = c0
            for i in range(0, len(w), 50_000):
                x = w[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(x), pa.int64()), pa.array(x, pa.binary()), pa.nulls(len(x), pa.int64()), pa.array(n[i : i + 50_000])], names=["part", "word", "gram", "n"])
            for i in range(0, len(g), 50_000):
                x = g[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(x), pa.int64()), pa.nulls(len(x), pa.binary()), pa.array(x), pa.array(gn[i : i + 50_000])], names=["part", "word", "gram", "n"])
            words, strings, size = [Counter(), Counter()], [Strings(), Strings()], 0

        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part or size > PART_BYTES:
                    if part is not None:
                        yield from flush()
                    part = p
                docs = unpacked(blob)
                for h, raw in zip(docs.column("held_out").to_pylist(), binary(docs.column("text")), strict=True):
                    words[h].update(_words(raw))
                    words[h][END] += 1
                    data, _ = padded([raw], depth)
                    strings[h].add(grams(data, depth))
                    size += len(raw)
        if part is not None:
            yield from flush()

    found = scratch.cut(texts.mapInArrow(gather, "part bigint, word binary, gram bigint, n bigint"))
    w = Window.partitionBy("word").orderBy("part")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the parts that hold a word are the rows of its window: one pass gives each of them the word's count
    words = scratch.cut(found.where("word is not null").select("part", "word", F.sum("n").over(whole).alias("c"), F.row_number().over(w).alias("nth")))
    scratch.release()
    total = words.where("c > 0 and nth = 1").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_types = total.n, total.v
    all_grams = scratch.cut(found.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).withColumn("near", F.shiftright("gram", 8 * (depth - 1) + 3)))

    def sums(p: pd.DataFrame) -> pd.DataFrame:
        p = p[p["n"] > 0]
        if not len(p):
            return pd.DataFrame({"c1": [], "v": [], "a": [], "b": [], "pw": []})
        lev = Tree(p["gram"].to_numpy(), p["n"].to_numpy(float), depth).levels[2]
        return pd.DataFrame({"c1": lev["id"] >> 16, "v": lev["id"] & 255, "a": lev["a"], "b": lev["b"], "pw": lev["pw"]})

    top = all_grams.groupBy("near").applyInPandas(sums, "c1 int, v int, a double, b double, pw double")
    root = roots(top.groupBy("c1", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("pw")).toPandas())

    def probabilities(p: pd.DataFrame) -> pd.DataFrame:
        keys = p["gram"].to_numpy()
        trained = (p["n"] > 0).to_numpy()
        tree = Tree(keys[trained], p["n"].to_numpy(float)[trained], depth)
        c1, byte = keys >> (8 * depth), keys & 255
        v = np.stack([(1 << k) | (byte >> (8 - k)) for k in range(8)], 1)
        mixed, rest, last = (root[n][c1[:, None], v] for n in ("mixed", "rest", "last"))
        return pd.DataFrame({"gram": keys, "p": tree.log10(keys, *_entered(tree, keys, mixed, rest, last))})

    model = all_grams.groupBy("near").applyInPandas(probabilities, "gram bigint, p double")
    model = scratch.cut(model)
    known = words.select("part", "word", F.lit(None).cast("bigint").alias("gram"), F.col("c").cast("double").alias("x"))
    given = found.where("gram is not null").select("part", "gram").join(model, "gram").select("part", F.lit(None).cast("binary").alias("word"), "gram", F.col("p").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).sort_by([("part", "ascending"), ("word", "ascending"), ("gram", "ascending")])
            parts = t.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for i, j in zip(edges, edges[1:], strict=False):
                one = t.slice(i, j - i).select(["word", "gram", "x"]).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([parts[i]], pa.int64()), pa.array([packed(one)], pa.binary())], names=["part", "blob"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > 1_000_000:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    # packed by part before they are dealt to parts: sorted strings take a few bytes each
    looked = scratch.cut(known.unionByName(given).mapInArrow(pack, "part bigint, blob binary"))
    for done in (found, words, all_grams, model):
        scratch.drop(done)
    scratch.release()
    unit = math.log10(n_all + n_types + 1)

    def judge(t: pa.Table, k: pa.Table) -> pa.Table:
        t, k = (pa.concat_tables([unpacked(x) for x in side.column("blob").to_pylist()]) for side in (t, k))
        is_word = k.column("word").is_valid()
        w, g = k.filter(is_word), k.filter(k.column("gram").is_valid())
        # 0 for words that training lacks
        logs = dict(zip(w.column("word").to_pylist(), np.log10(w.column("x").to_numpy() + 1).tolist(), strict=True))
        keys, p = g.column("gram").to_numpy(), g.column("x").to_numpy()
        order = np.argsort(keys)
        keys, p = keys[order], p[order]
        raws = binary(t.column("text"))
        rows = []
        for raw in raws:
            own = [*_words(raw), END]
            own_logs = [logs[x] for x in own]
            rows.append((len(own), sum(map(bool, own_logs)), math.fsum(own_logs) - len(own) * unit))
        scores: list[float] = []
        while len(scores) < len(raws):
            i, j, size = len(scores), len(scores), 0
            while j < len(raws) and (j == i or size + len(raws[j]) <= AT_ONCE):
                size += len(raws[j])
                j += 1
            data, ends = padded(raws[i:j], depth)
            key = grams(data, depth)
            ends = ends - depth
            starts = np.concatenate([[0], ends[:-1] + depth])
            here = np.zeros(len(key), bool)
            for s, e in zip(starts, ends, strict=True):
                here[s:e] = True
            u, inv = np.unique(key[here], return_inverse=True)
            lp = np.zeros(len(key))
            lp[here] = p[np.searchsorted(keys, u)][inv]
            scores += [float(lp[s:e].sum()) for s, e in zip(starts, ends, strict=True)]
        n = np.array(list(map(len, raws)), np.int64)
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        bits = -np.array(scores) / math.log10(2) / np.maximum(n + 1, 1)
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()), "train_tokens": pa.array([n_all] * len(raws), pa.int64()), "base_score": pa.array(cols[2], pa.float64()), "score": pa.array(scores, pa.float64()), "n_bytes": pa.array(n), "bits_per_byte": pa.array(bits, pa.float64())})

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"
    return texts.groupBy("part").cogroup(looked.groupBy("part")).applyInArrow(judge, schema)


def _entered(tree: Tree, keys: np.ndarray, mixed: np.ndarray, rest: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where depth 1 was seen but depth 2 was not, depth 1's estimate takes the weight that is left."""
    byte, context = keys & 255, keys >> 8
    ids = tree.levels[tree.top]["id"]
    mixed, rest = mixed.copy(), rest.copy()
    for k in range(8):
        node = ((context >> (8 * (tree.depth - tree.top))) << 8) | ((1 << k) | (byte >> (8 - k)))
        i = np.minimum(np.searchsorted(ids, node), max(len(ids) - 1, 0))
        seen = ids[i] == node if len(ids) else np.zeros(len(keys), bool)
        gone = ~seen & (rest[:, k] >= 0)
        mixed[gone, k] += rest[gone, k] * last[gone, k]
        rest[gone, k] = -1
    return mixed, rest


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
