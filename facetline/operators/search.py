"""Exact nearest-neighbour search over variants, and what follows from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetline.functions import exprs as X
from facetline.functions.constants import MATCH_THRESHOLD

#: Rows of a block on either side: a block pair is a product of two small matrices.
BLOCK = 4096
#: Distances are equal where these decimals are, so that ties are told by id, whatever the order of sums.
DECIMALS = 9


def _by_length(col: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors with a direction, and their unit rows."""
    rows = [np.zeros(0) if v is None else np.asarray(v, float) for v in col]
    size = np.array([len(r) for r in rows])
    out = {}
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        m = np.stack([rows[i] for i in at])
        norm = np.sqrt((m * m).sum(1))
        ok = norm > 0
        out[n] = at[ok], m[ok] / norm[ok, None]
    return out


def _distances(a: pd.DataFrame, b: pd.DataFrame, others: bool) -> np.ndarray:
    """1 between vectors of different lengths or without a direction, whatever else is in their blocks; infinite where an
    id would meet itself and only others are wanted."""
    x, y = _by_length(a["vec"]), _by_length(b["vec"])
    d = np.ones((len(a), len(b)))
    for n in x.keys() & y.keys():
        (i, u), (j, v) = x[n], y[n]
        d[np.ix_(i, j)] = np.round(1 - u @ v.T, DECIMALS) + 0.0
    if others:
        d[a["query_id"].to_numpy()[:, None] == b["variant_id"].to_numpy()[None]] = np.inf
    return d


def _block_pairs(queries: DataFrame, variants: DataFrame, block: int):
    """Both sides dealt to blocks, each block of one side meeting each of the other: no side is broadcast or gathered."""
    nq = max(1, -(-queries.count() // block))
    nv = max(1, -(-variants.count() // block))
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select("*", F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("qb"), others(nv).alias("vb"))
    v = variants.select("*", others(nq).alias("qb"), F.pmod(F.xxhash64("variant_id"), F.lit(nv)).alias("vb"))
    return q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb"))


def nearest(queries: DataFrame, variants: DataFrame, k: int, threshold: float | None = None, block: int = BLOCK, others: bool = False) -> DataFrame:
    """(query_id, variant_id, distance, rank) of the k nearest variants, by cosine distance and then id.

    queries: (query_id, vec), variants: (variant_id, vec). With a threshold, only distances strictly below it. Vectors
    without a direction, and of different lengths, have distance 1. With others, a query does not find the variant of its
    own id. Each pair of blocks gives the k best of each query, so a query's rows are k times the blocks.
    """

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "variant_id": [], "distance": []})
        b = b.sort_values("variant_id", kind="stable")
        d = _distances(a, b, others)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), best.shape[1]), "variant_id": b["variant_id"].to_numpy()[best.ravel()], "distance": np.take_along_axis(d, best, 1).ravel()})
        return out[out["distance"] < (np.inf if threshold is None else threshold)]

    pairs = _block_pairs(queries.select("query_id", "vec"), variants.select("variant_id", "vec"), block)
    found = pairs.applyInPandas(pair, "query_id long, variant_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "variant_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_clusters(queries: DataFrame, members: DataFrame, k: int = 2, block: int = BLOCK, others: bool = False) -> DataFrame:
    """(query_id, cluster, score, rank) of the k clusters whose nearest member is nearest, by score and then cluster.

    members: (variant_id, cluster, vec). A cluster that is among the k best is so in the block of its nearest member, so
    each pair of blocks gives k rows a query.
    """

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "cluster": [], "score": []})
        ids, inv = np.unique(b["cluster"].to_numpy(), return_inverse=True)
        least = np.full((len(a), len(ids)), np.inf)
        np.minimum.at(least.T, inv, _distances(a, b, others).T)
        best = np.argsort(least, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), best.shape[1]), "cluster": ids[best.ravel()], "score": np.take_along_axis(least, best, 1).ravel()})
        return out[out["score"] < np.inf]

    pairs = _block_pairs(queries.select("query_id", "vec"), members.select("variant_id", "cluster", "vec"), block)
    found = pairs.applyInPandas(pair, "query_id long, cluster long, score double").groupBy("query_id", "cluster").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "cluster")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def named(matches: DataFrame, variants: DataFrame, identities: DataFrame) -> DataFrame:
    """Matches with the ids and display names of the variant and its identity; a variant without one keeps its row."""
    v = variants.select(F.col("id").alias("variant_id"), "identity_id", F.col("name").alias("vname"))
    i = identities.select(F.col("id").alias("identity_id"), F.col("name").alias("iname"))
    out = matches.join(v, "variant_id").join(i, "identity_id", "left")
    return out.withColumn("identity", X.display_identity(F.col("iname"), F.col("identity_id"))).withColumn("variant", X.display_variant(F.col("vname"))).drop("iname", "vname")


def closest(queries: DataFrame, variants: DataFrame, threshold: float = MATCH_THRESHOLD, others: bool = False) -> DataFrame:
    """(query_id, variant_id, distance): the nearest variant below the threshold, or -1."""
    found = nearest(queries, variants, 1, threshold, others=others).drop("rank")
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("variant_id", F.lit(-1)).alias("variant_id"), "distance")


def staged_actions(queries: DataFrame, variants: DataFrame, threshold: float = MATCH_THRESHOLD, others: bool = False) -> DataFrame:
    """(query_id, nearest_id, d1, d2, confidence, action) from the two nearest variants."""
    two = nearest(queries, variants, 2, others=others)
    both = two.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("variant_id"))).alias("nearest_id"),
        F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"),
    )
    out = queries.select("query_id").join(both, "query_id", "left")
    return out.select("query_id", "nearest_id", X.round_to(F.col("d1"), 3).alias("d1"), X.round_to(F.col("d2"), 3).alias("d2"), X.confidence(F.col("d1")).alias("confidence"), X.action_band(F.col("d1"), F.col("d2"), threshold).alias("action"))
