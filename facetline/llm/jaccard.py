"""N-gram Jaccard join: prefix filters under three token orders, intersected before texts are compared exactly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetline.llm.common import bounded, by_key, connected_components, hash_words, packed, read, shingle_sets, unpacked
from facetline.session import Scratch

#: Buckets of the frequency table that the first token order goes by: 4 MB whatever the input's size.
BUCKET_BITS = 20
BLOCKS = 16
#: Odd numbers; the further token orders go by the products with them.
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Prefix tokens that are sorted together before they are dealt, and that a range of tokens has on average.
GROUP, RANGE = 1_000_000, 500_000
#: Random orders by whose first tokens texts meet before all prefix tokens are dealt.
KEYS = tuple(pow(f, e, 1 << 64) for e in (3, 5) for f in ORDERS)
#: Values of a sketch, those that have to agree, texts of one key that the others are held against, and texts that are
#: looked at together for that.
BINS, AGREE, HEADS, TOGETHER = 128, 80, 8, 50_000
#: Pairs that a task holds before it gives them out.
PAIRS = 1_000_000


def shingles(col: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct k-word shingles, A-Z in lower case."""
    return shingle_sets(*hash_words(col), k)


def prefix_size(n: int, num: int, den: int) -> int:
    """A set of n tokens and one that is similar enough share a token among so many first ones, in any common order."""
    return n - -(-num * n // den) + 1


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def frequencies(texts: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """How often each bucket of shingles occurs in all of the texts, as a rank of 16 bits: a global order that puts rare
    tokens first; and the number of shingles. Tasks send blocks of counts, which are added up block by block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            own = shingles(b.column(0), k)
            if own:
                n += np.bincount(_buckets(np.concatenate(own)), minlength=len(n))
        blocks = n.reshape(BLOCKS, -1)
        keep = [i for i in range(BLOCKS) if blocks[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in keep], pa.binary())], names=["block", "n"])

    def add(p: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in p["n"])
        rank = np.minimum(np.log2(total + 1.0) * 64, 65535).astype(np.uint16)
        return pd.DataFrame({"block": [p["block"].iloc[0]], "rank": [rank.tobytes()], "n": [int(total.sum())]})

    out = np.zeros((BLOCKS, (1 << BUCKET_BITS) // BLOCKS), np.uint16)
    rows = texts.mapInArrow(count, "block int, n binary").groupBy("block").applyInPandas(add, "block int, rank binary, n bigint").collect()
    for r in rows:
        out[r.block] = np.frombuffer(r["rank"], np.uint16)
    return out.reshape(-1), sum(r.n for r in rows)


def further(s: np.ndarray, p: int) -> np.ndarray:
    """A set's first p tokens in each further order, in 32 bits each: sets that differ in all of these share none."""
    out = []
    for factor in ORDERS:
        q = s * np.uint64(factor)
        out.append(((np.partition(q, p - 1)[:p] if p < len(q) else q) >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(out)


def meet(a: bytes, b: bytes) -> bool:
    """Whether two sets share a prefix token in every further order, from what further() gave."""
    x, y = (np.frombuffer(v, "<u4").reshape(len(ORDERS), -1) for v in (a, b))
    return all(np.isin(p, q).any() for p, q in zip(x, y, strict=True))


def sketch(s: np.ndarray) -> bytes:
    """Four bits each of the first token at or after each of BINS places: of two sets about as many agree as are shared."""
    at = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS))
    v = (s[at % len(s)] & np.uint64(15)).astype(np.uint8)
    return (v[::2] << 4 | v[1::2]).tobytes()


def described(base: DataFrame, k: int) -> DataFrame:
    """Of (rid, doc_id, text): (rid, doc_id, h1, h2 (of the whole set), n, its first token by each of KEYS, its sketch)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            n, hashes, keys, low = [], [], [], []
            for s in shingles(b.column(2), k):
                n.append(len(s))
                hashes.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8"))
                keys.append([i << 32 | int((s * np.uint64(f)).min()) >> 32 for i, f in enumerate(KEYS)] if len(s) else [0] * len(KEYS))
                low.append(sketch(s) if len(s) else b"")
            h = np.array(hashes, np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(KEYS)), pa.array(np.array(keys, np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n, pa.int64()), lists, pa.array(low, pa.binary())], names=["rid", "doc_id", "h1", "h2", "n", "keys", "low"])

    return base.mapInArrow(describe, "rid bigint, doc_id bigint, h1 bigint, h2 bigint, n bigint, keys array<bigint>, low binary")


def likely(nodes: DataFrame) -> DataFrame:
    """Of (node, keys, low): pairs (a, b) that share a key and agree in AGREE values of their sketches. Not all similar
    pairs: the texts of a key are held against a few of them, so that groups of near copies cost as much as they have
    texts. What they leave apart is for the prefix tokens to find."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            pairs = []
            for key, node, low in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != last or len(held) >= TOGETHER:
                    pairs += around(held)
                    held = held[:1] if key == last else []  # what is looked at next has one of these
                    last = key
                held.append((node, low))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pairs, strict=True) if pairs else [[], []])], names=["a", "b"])
        pairs = around(held)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])

    rows = nodes.select(F.explode("keys").alias("key"), "node", "low")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(hold, "a bigint, b bigint").distinct()


def around(held: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """Of texts (node, sketch's bytes): pairs of a text and one of those in the middle of them. In the middle is the one
    that has most of the values most of them have: of near copies likely the one that they come from. Then the same of the
    texts that are not like it, HEADS times at most."""
    out = []
    if len(held) < 2:
        return out
    node = np.array([x[0] for x in held], np.int64)
    m = np.frombuffer(b"".join(x[1] for x in held), np.uint8).reshape(len(held), -1)
    m = np.concatenate([m >> 4, m & 15], 1)
    for _ in range(HEADS):
        if len(node) < 2:
            break
        head = 0
        if len(node) > 2:
            usual = np.array([np.bincount(c).argmax() for c in m.T])
            head = int((m == usual).sum(1).argmax())
        like = (m == m[head]).sum(1) >= AGREE
        out += [(min(x, y), max(x, y)) for x in [int(node[head])] for y in node[like].tolist() if x != y]
        node, m = node[~like], m[~like]
    return out


def signatures(texts: DataFrame, k: int, num: int, den: int, rank: np.ndarray, bits: int) -> DataFrame:
    """Of (node, component, text): rows (bucket, blob) of prefix tokens in the order of rarity, dealt to 2 ** bits ranges
    of tokens."""
    spread = texts.sparkSession.sparkContext.broadcast(rank)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = spread.value
        held: list[tuple[int, int, int, np.ndarray]] = []
        size = 0

        def deal() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            node, comp, n = (np.array([x[i] for x in held], np.int64) for i in range(3))
            own = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[3]) for x in held])
            pos = np.concatenate([np.arange(len(x[3]), dtype=np.uint32) for x in held])
            token = np.concatenate([x[3] for x in held])
            at = np.argsort(token)
            token, own, pos = token[at] >> np.uint64(32 - bits), own[at], pos[at]
            which = (token >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]]))
            low = token.astype(np.uint32)
            buckets, blobs = [], []
            for i, j in zip(edges, edges[1:], strict=False):
                here, mine = np.unique(own[i:j], return_inverse=True)
                buckets.append(int(which[i]))
                blobs.append(packed(np.diff(low[i:j], prepend=np.uint32(0)), mine.astype(np.uint32), pos[i:j], np.diff(node[here], prepend=np.int64(0)), node[here] - comp[here], n[here].astype(np.uint32)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for b in batches:
            for node, comp, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingles(b.column(2), k), strict=True):
                p = prefix_size(len(s), num, den)
                held.append((node, comp, len(s), s[np.argsort(order[_buckets(s)], kind="stable")[:p]]))
                size += p
                if size >= GROUP:
                    yield deal()
                    size = 0
        if held:
            yield deal()

    return texts.select("node", "component", "text").mapInArrow(sign, "bucket int, blob binary")


def candidates(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """Of (bucket, blob): (a, b, ca, cb, n) for texts of different components that share n tokens of a range whose places
    in both sets, and the sets' sizes, leave room for enough overlap. The texts of one token are held against each other
    in order of size, so none against one that is too large."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_key(batches):
            parts, base = [], 0
            for blob in blobs:
                low, own, pos, steps, comp, n = unpacked(blob)
                node = np.cumsum(steps.view(np.int64))
                parts.append((np.cumsum(low, dtype=np.uint32), own.astype(np.int64) + base, pos, node, node - comp.view(np.int64), n))
                base += len(n)
            low, own, pos, node, comp, n = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
            del parts
            at = np.argsort(low, kind="stable")
            low, own, pos = low[at], own[at], pos[at]
            first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            often = np.diff(np.concatenate([first, [len(low)]]))
            c = comp[own]
            some = np.repeat(np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first), often)
            low, own, pos = low[some], own[some], pos[some]
            at = np.lexsort((n[own], low))
            low, own, pos = low[at], own[at], pos[at]
            size, c = n[own], comp[own]
            room = size - pos
            i, d, found, count = np.arange(len(low)), 1, [], 0
            while len(i):
                i = i[i + d < len(low)]
                j = i + d
                near = (low[i] == low[j]) & (num * size[j] <= den * size[i])
                i, j = i[near], j[near]
                fits = (c[i] != c[j]) & (num * (size[i] + size[j]) <= (num + den) * np.minimum(room[i], room[j]))
                found.append((own[i[fits]], own[j[fits]]))
                count += int(fits.sum())
                d += 1
                if count >= PAIRS:
                    yield out(node, comp, found)
                    found, count = [], 0
            if count:
                yield out(node, comp, found)

    def out(node: np.ndarray, comp: np.ndarray, found: list) -> pa.RecordBatch:
        x, y = (np.concatenate(v) for v in zip(*found, strict=True))
        keys, often = np.unique((np.minimum(x, y) << 32) | np.maximum(x, y), return_counts=True)
        x, y = keys >> 32, keys & 0xFFFFFFFF
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (node[x], node[y], comp[x], comp[y], often.astype(np.int64))], names=["a", "b", "ca", "cb", "n"])

    rows = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(gather, "a bigint, b bigint, ca bigint, cb bigint, n bigint")


def verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of rids, a written table, that are similar enough. Before whole sets are compared they must share
    prefix tokens in the further orders too. texts (rid, text) that are dealt by rid stay where they are: a pair is moved
    to the one text, and with this one to the other, whatever the number of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for u, v in zip(shingles(b.column(2), k), shingles(b.column(3), k), strict=True):
                if meet(*(further(s, prefix_size(len(s), num, den)) for s in (u, v))):
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    ok.append(den * both >= num * (len(u) + len(v) - both))
                else:
                    ok.append(False)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    if pairs.isEmpty():
        return pairs
    one, two = (texts.withColumnsRenamed({"rid": c, "text": f"x{c}"}).hint("merge") for c in ("a", "b"))
    out = scratch.cut(pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint"))
    scratch.release()
    return out


def join(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs. Two rows link when num / den or more of the union of
    their sets of k-word shingles is shared; component_id is the smallest doc_id reachable by links.

    Rows with one set are one node. Nodes whose first tokens in random orders agree are compared first, so that groups of
    near copies are mostly one component before prefix tokens are dealt. Then a link between two components needs a common
    token among the first ones of both sets in each of three orders: rarity (by a table of bucket counts over all rows),
    and two random ones. The first order makes candidates of all nodes: nodes of different components that meet by prefix
    token, and a token counts only where the sizes and its places in both sets still allow enough overlap. Candidates must
    share prefix tokens in the other orders too before whole sets are compared (64-bit hashes of shingles, equal shingles
    equal). Of the candidates of two components the one that shares most is compared first, the others only if these two
    are still apart. So groups of near copies are not expanded: the operator gives components, not all links inside them.

    No word, empty or null text: no shingle, no links, component_id is the row's own id. A null id is kept and can't
    name a component. Rows are told apart by a number of their own, so rows of one id or without any are compared as
    any others are. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "rows")
    rows = scratch.dealt(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rid")
    out = numbered(rows, k, num, den, "id", "text", "rid").drop("row", "component_row")
    scratch.drop(rows)
    return out


def numbered(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", row_col: str = "__rid") -> DataFrame:
    """join() of rows that have a number of their own, with these (row) and component_row: the number of the row that
    stands for the component, one with the smallest id. docs are read several times, and numbers must stay: a written
    table, best one that is dealt by its numbers, as texts are then joined where they are. What is returned does not read
    docs."""
    spark = docs.sparkSession
    bounded(spark)
    scratch = Scratch(spark, "jaccard")
    base = docs.select(F.col(row_col).alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = base.select("rid", "text")
    rank, total = frequencies(base.select("text"), k)
    bits = max(0, int(np.ceil(np.log2(max(1, total * (den - num) / den / RANGE)))))
    rows = scratch.cut(described(base, k))

    # rows of one set are one node; nodes that are likely to be similar are compared first
    nodes = scratch.cut(rows.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("rid", "keys", "low")).alias("m")).select("h1", "h2", F.col("m.rid").alias("node"), "m.keys", "m.low"))
    good = verified(scratch, scratch.cut(likely(nodes)), texts, k, num, den)
    comp = connected_components(scratch, good)
    known = scratch.cut(nodes.select("h1", "h2", "node").join(comp, "node", "left").select("h1", "h2", "node", F.coalesce("component", "node").alias("component")))
    scratch.drop(nodes)
    scratch.release()

    # then all nodes of different components that the prefix tokens leave
    own = texts.withColumnRenamed("rid", "node").join(known.select("node", "component").hint("merge"), "node")
    pairs = candidates(signatures(own, k, num, den, rank, bits), num, den).groupBy("a", "b", "ca", "cb").agg(F.sum("n").alias("n"))
    pairs = scratch.cut(pairs)
    scratch.release()
    sides = [F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")]
    head = scratch.cut(pairs.groupBy(*sides).agg(F.max(F.struct("n", "a", "b")).alias("m")).select("m.a", "m.b", "c1", "c2"))
    met = verified(scratch, head.select("a", "b"), texts, k, num, den)
    over = scratch.cut(connected_components(scratch, met.join(head, ["a", "b"]).select(F.col("c1").alias("a"), F.col("c2").alias("b"))))
    ends = [over.select(F.col("node").alias(c), F.col("component").alias(f"o{c}")) for c in ("ca", "cb")]
    left = pairs.join(head.select("a", "b"), ["a", "b"], "left_anti").join(ends[0], "ca", "left").join(ends[1], "cb", "left")
    left = scratch.cut(left.select("a", "b", F.coalesce("oca", "ca").alias("ca"), F.coalesce("ocb", "cb").alias("cb")).where("ca != cb"))
    more = verified(scratch, left.select("a", "b"), texts, k, num, den)
    last = connected_components(scratch, more.join(left, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    scratch.drop(pairs)
    scratch.release()

    # rows to sets, sets to nodes, nodes to components
    named = known.join(over.select(F.col("node").alias("component"), F.col("component").alias("c1")), "component", "left").select("h1", "h2", F.coalesce("c1", "component").alias("c"))
    named = named.join(last.select(F.col("node").alias("c"), F.col("component").alias("c2")), "c", "left").select("h1", "h2", F.coalesce("c2", "c").alias("component"))
    owned = scratch.cut(rows.where("n > 0").select("rid", "doc_id", "n", "h1", "h2").join(named, ["h1", "h2"]).select("rid", "doc_id", "n", "component"))
    least = owned.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("m")).select("component", F.col("m.doc_id").alias("least"), F.col("m.rid").alias("least_row"))
    alone = scratch.cut(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("rid").alias("row"), F.col("rid").alias("component_row")))
    scratch.drop(rows)
    scratch.release()
    out = owned.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("rid").alias("row"), F.col("least_row").alias("component_row"))
    return out.unionByName(alone)


def op6_multi_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))
