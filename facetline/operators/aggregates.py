"""Aggregates over identities, commits, tracks and clusters. All are partial sums, minima or maxima of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetline.functions import exprs as X
from facetline.functions.constants import TOP_FRAMES


def identity_summary(identities: DataFrame, variants: DataFrame) -> DataFrame:
    """(id, name, face_count, variant_count) for every identity, those without variants too. Variants are summed before
    they are joined."""
    per = variants.groupBy("identity_id").agg(F.sum("face_count").alias("faces"), F.count("id").alias("n"))
    out = identities.join(per, identities["id"] == per["identity_id"], "left")
    return out.select("id", X.display_identity(F.col("name"), F.col("id")).alias("name"), F.coalesce("faces", F.lit(0)).cast("int").alias("face_count"), F.coalesce("n", F.lit(0)).cast("long").alias("variant_count"))


def commit_summary(commits: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, status, created_at, face_count, track_count) for every commit, empty ones too."""
    per = ledger.groupBy("commit_id").agg(F.sum("added_count").alias("faces"), F.count("id").alias("n"))
    out = commits.join(per, commits["id"] == per["commit_id"], "left")
    return out.select("id", "status", "created_at", F.coalesce("faces", F.lit(0)).cast("long").alias("face_count"), F.coalesce("n", F.lit(0)).cast("long").alias("track_count"))


def centroids(rows: DataFrame, key: str, vec: str, weight: Column) -> DataFrame:
    """(key, total, centroid): sum of vec * weight over sum of weights, weights of 0 or less counting as 1, element by
    element, so that it sums partially. Vectors of another length than the group's longest are left out."""
    w = F.when(weight > 0, weight).otherwise(1).cast("double")
    rows = rows.withColumn("__w", w).withColumn("__d", F.size(vec))
    dims = rows.groupBy(key).agg(F.max("__d").alias("__dim"))
    rows = rows.join(dims, key).where("__d = __dim")
    flat = rows.select(key, "__w", F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    means = flat.groupBy(key, "i").agg((F.sum(F.col("x") * F.col("__w")) / F.sum("__w")).alias("m"), F.sum("__w").alias("total"))
    # one element for each dimension: bounded
    return means.groupBy(key).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(key, "total", F.col("c.m").alias("centroid"))


def extremes(frames: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """Per key: count, and the order of the best, lowest, first and last row; the first wins ties."""
    return frames.groupBy(*key).agg(
        F.count("*").alias("n"),
        (-F.max(F.struct(F.col(score), -F.col(order)))["col2"]).alias("best"),
        F.min(F.struct(F.col(score), F.col(order)))[order].alias("lowest"),
        F.min(order).alias("first"),
        F.max(order).alias("last"),
    )


def top_frames(frames: DataFrame, key: list[str], score: str, order: str, k: int = TOP_FRAMES) -> DataFrame:
    """The k best rows of each key; earlier ones win ties. Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), F.col(order))
    return frames.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def representatives(frames: DataFrame, means: DataFrame, key: str, vec: str, order: str) -> DataFrame:
    """(key, order, distance) of the row that is nearest to the key's mean, within distance 2; the first wins ties."""
    d = F.round(X.cosine_distance(F.col(vec), F.col("centroid")), 9)
    rows = frames.join(means, key).withColumn("distance", d).where("distance < 2.0")
    return rows.groupBy(key).agg(F.min(F.struct("distance", order)).alias("m")).select(key, F.col(f"m.{order}").alias(order), "m.distance")


def consensus(members: DataFrame, key: list[str], column: str) -> DataFrame:
    """Per key: the value that all members agree on after trimming, else blank."""
    t = F.trim(F.coalesce(F.col(column), F.lit("")))
    return members.groupBy(*key).agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count("*").alias("n")).select(*key, "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias(column))


def suggestion(members: DataFrame, key: str) -> DataFrame:
    """Per group: the action, identity and variant to offer. All members must agree on the action; a merge needs one
    identity and one variant, a new variant one identity, else the action is blank. An identity that all agree on is
    offered even where actions differ, but not with a new identity or a discard."""
    columns = ("action", "identity", "variant")
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in columns}
    agreed = [F.when(F.min(t) == F.max(t), F.min(t)).otherwise("").alias(c) for c, t in text.items()]
    out = members.groupBy(key).agg(*agreed)
    action, identity, variant = (F.col(c) for c in columns)
    alone = action.isin("new_identity", "discard")
    merge = (action == "merge") & (identity != "") & (variant != "")
    new = (action == "new_variant") & (identity != "")
    return out.select(key, F.when(alone | merge | new, action).otherwise("").alias("action"), F.when(alone, "").otherwise(identity).alias("identity"), F.when(merge, variant).otherwise("").alias("variant"))


def duplicates(rows: DataFrame, name: Column) -> DataFrame:
    """(name, n) of the names that occur more than once, whatever their case."""
    return rows.where(name.isNotNull()).groupBy(F.lower(F.trim(name)).alias("name")).agg(F.count("*").alias("n")).where("n > 1")
