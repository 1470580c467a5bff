"""Near-duplicate vectors by an inverted multi-index over vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetline.llm.common import bounded, connected_components, read
from facetline.session import Scratch

BLOCK = 2048


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of rows by Lloyd's method; fewer if there are fewer different rows."""
    rng = np.random.default_rng(seed)
    u = np.unique(x, axis=0)
    c = u[rng.permutation(len(u))[:k]].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, and for every centroid the least squared distance from the row to its region."""
    d = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)
    near = d.argmin(1)
    apart = np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * c @ c.T, 1e-30))
    least = (d - d[np.arange(len(x)), near][:, None]) / (2 * apart[near])
    least[np.arange(len(x)), near] = 0
    return near, np.maximum(least, 0) ** 2


def traverse(a: np.ndarray, b: np.ndarray, stop: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) of the product grid by rising a[i] + b[j], up to stop: the multi-sequence walk over two sorted lists."""
    ia, ib = a.argsort(kind="stable"), b.argsort(kind="stable")
    heap, seen = [(float(a[ia[0]] + b[ib[0]]), 0, 0)], {(0, 0)}
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > stop:
            return
        yield int(ia[i]), int(ib[j])
        for m, n in ((i + 1, j), (i, j + 1)):
            if m < len(ia) and n < len(ib) and (m, n) not in seen:
                seen.add((m, n))
                heapq.heappush(heap, (float(a[ia[m]] + b[ib[n]]), m, n))


def spanning(mask: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) of a boolean matrix that connect all that it connects; at most rows + columns of them."""
    part, out = np.arange(mask.shape[1]), []
    for i in np.flatnonzero(mask.any(1)):
        cols = np.flatnonzero(mask[i])
        parts, first = np.unique(part[cols], return_index=True)
        out += [(int(i), int(cols[f])) for f in first]
        if len(parts) > 1:
            part[np.isin(part, parts[1:])] = parts[0]
    return out


def _unit(col: pa.Array) -> list[np.ndarray | None]:
    out = []
    for x in col.to_pylist():
        v = None
        if x and None not in x:
            a = np.array(x, float)
            if np.isfinite(a).all() and a.any():
                a = a / np.abs(a).max()  # so that squares neither overflow nor vanish
                v = a / np.sqrt((a * a).sum())
        out.append(v)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cells: int = 24, sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, n_links, component_id, kept for every row; links hold between rows of one label whose cosine, in
    double precision, reaches the threshold.

    Unit vectors are cut into halves; each half has its own codebook of `cells` centroids, fitted on at most `sample`
    vectors (those with the smallest hashes). Every vector is in the cell of its two nearest centroids. A vector walks
    the product grid from the nearest cell on and stops where the least possible distance to a cell's region exceeds
    that of the threshold: recall is 1 by geometry, so the target is met with no cap on cells or candidates. Candidates
    are verified by their cosines, in blocks of at most 2048 by 2048 (a large cell is many blocks), which return counts
    and a spanning forest instead of pairs. Equal vectors of one label are one class, counted by its size.

    Null, empty or zero vectors, or with null or non-finite components, and null labels link with nothing, nor do
    vectors of different lengths; a null id can't be a component's id. Repeated ids count as rows of their own.
    """
    spark = vectors.sparkSession
    bounded(spark)
    scratch = Scratch(spark, "vectors")
    slim = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            units = _unit(b.column(2))
            key = [None if u is None or lab is None else xxhash.xxh3_128_digest((np.array(v, float) + 0.0).tobytes() + repr(lab).encode()) for u, lab, v in zip(units, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(key, pa.binary()), pa.array([None if k is None else u for u, k in zip(units, key, strict=True)], pa.list_(pa.float64()))], names=["vec_id", "label", "cls", "u"])

    rows = scratch.cut(slim.mapInArrow(classes, "vec_id bigint, label string, cls binary, u array<double>"))
    groups = scratch.cut(rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("u").alias("u")))
    some = groups.orderBy(F.xxhash64("cls"), "cls").select("u").limit(sample).collect()
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {len(r.u) for r in some}:
        x = np.array([r.u for r in some if len(r.u) == n])
        books[n] = codebook(x[:, : n // 2], cells) if n > 1 else np.zeros((1, 0)), codebook(x[:, n // 2 :], cells)
    stop = (2 - 2 * threshold) * (1 + 1e-6) + 1e-12

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (big.slice(i, BLOCK) for big in batches for i in range(0, big.num_rows, BLOCK)):
            units = b.column(b.schema.get_field_index("u")).to_pylist()
            own, visits = [], []
            for n in {len(u) for u in units}:
                pick = [i for i, u in enumerate(units) if len(u) == n]
                x = np.array([units[i] for i in pick])
                # a length that the sample lacks has one cell
                one, two = books.get(n) or (np.zeros((1, n // 2)), np.zeros((1, n - n // 2)))
                (na, la), (nb, lb) = bounds(x[:, : n // 2], one), bounds(x[:, n // 2 :], two)
                for k, i in enumerate(pick):
                    mine = (int(na[k]), int(nb[k]))
                    own.append((i, n << 32 | mine[0] << 16 | mine[1]))
                    visits += [(i, n << 32 | c[0] << 16 | c[1], c == mine) for c in traverse(la[k], lb[k], stop) if c >= mine]
            at = pa.array([i for i, _ in own] + [x[0] for x in visits])
            cell = pa.array([c for _, c in own] + [x[1] for x in visits], pa.int64())
            role = pa.array([False] * len(own) + [True] * len(visits))
            home = pa.array([True] * len(own) + [x[2] for x in visits])
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns], cell, role, home], names=[*b.schema.names, "cell", "visitor", "home"])

    walked = scratch.cut(groups.select("cls", "w", "label", "u").mapInArrow(walk, "cls binary, w bigint, label string, u array<double>, cell bigint, visitor boolean, home boolean"))
    sizes = walked.groupBy("label", "cell").agg(F.sum(F.expr("cast(not visitor as int)")).alias("m"), F.sum(F.expr("cast(visitor as int)")).alias("n"))
    sizes = scratch.cut(sizes.where("m > 0").select("label", "cell", F.ceil(F.col("m") / BLOCK).alias("mb"), F.ceil(F.col("n") / BLOCK).alias("nb")))
    slot = F.pmod(F.xxhash64("cls"), F.when(F.col("visitor"), F.col("nb")).otherwise(F.col("mb")))
    other = F.explode(F.expr("sequence(0L, if(visitor, mb, nb) - 1)"))
    dealt = walked.join(sizes, ["label", "cell"]).withColumn("slot", slot).withColumn("other", other)
    dealt = dealt.select("label", "cell", F.expr("if(visitor, other, slot)").alias("mk"), F.expr("if(visitor, slot, other)").alias("nk"), "cls", "w", "u", "visitor", "home")

    def verify(p: pd.DataFrame) -> pd.DataFrame:
        m, v = p[~p["visitor"]], p[p["visitor"]]
        if not len(m) or not len(v):
            return pd.DataFrame({"cls": [], "n": [], "other": []})
        mask = np.stack(v["u"]) @ np.stack(m["u"]).T >= threshold
        mid, vid = m["cls"].to_numpy(), v["cls"].to_numpy()
        for i in np.flatnonzero(v["home"].to_numpy()):
            mask[i] &= mid < vid[i]  # within a cell each pair counts once
        mw, vw = m["w"].to_numpy(), v["w"].to_numpy()
        n = np.concatenate([mask @ mw, vw @ mask])
        some = n > 0
        ids = np.concatenate([vid, mid])[some]
        links = spanning(mask)
        return pd.DataFrame({"cls": [*ids, *[vid[i] for i, _ in links]], "n": [*n[some], *[0] * len(links)], "other": [*[None] * len(ids), *[mid[j] for _, j in links]]})

    found = scratch.cut(dealt.groupBy("label", "cell", "mk", "nk").applyInPandas(verify, "cls binary, n bigint, other binary"))
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    comp = connected_components(scratch, found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    comp = comp.withColumnRenamed("node", "cls").join(groups.select("cls", "rep"), "cls")
    least = comp.groupBy("component").agg(F.min("rep").alias("least"))
    named = comp.join(least, "component").select("cls", "least")
    info = groups.select("cls", "rep", "w").join(counts, "cls", "left").join(named, "cls", "left")
    info = scratch.cut(info.select("cls", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")))
    out = rows.select("vec_id", "label", "cls").join(info, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")
