"""Joins: timelines, overlaps of spans, and what two sides lack of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetline.functions import exprs as X


def timeline(intervals: DataFrame, variants: DataFrame, videos: DataFrame, identity: int) -> DataFrame:
    """(path, video_id, start_time, end_time, face_count, variant_id) of one identity's appearances."""
    own = variants.where(F.col("identity_id") == identity).select(F.col("id").alias("variant_id"))
    v = videos.select(F.col("id").alias("video_id"), "path")
    return intervals.join(own, "variant_id").join(v, "video_id").select("path", "video_id", "start_time", "end_time", "face_count", "variant_id")


def timeline_report(rows: DataFrame) -> DataFrame:
    """(path, video_id, n, first, last) and the spans in order, one row per video."""
    return rows.groupBy("path", "video_id").agg(F.count("*").alias("n"), F.min("start_time").alias("first"), F.max("end_time").alias("last"), F.array_sort(F.collect_list(F.struct("start_time", "end_time"))).alias("spans"))


def overlap_pairs(spans: DataFrame, key: str, ident: str, start: str, end: str, bin_size: float) -> DataFrame:
    """(key, a, b) for spans of one key that overlap, a < b.

    Spans are dealt to the time bins that they touch and meet within a bin only; a pair counts in the bin where the
    later of the two begins, so no pair is made twice. Spans that touch do not overlap; spans without length neither
    begin nor end inside themselves, and overlap what surrounds them.
    """
    lo, hi = F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size)
    rows = spans.where(F.col(start) <= F.col(end)).select(F.col(key).alias("k"), F.col(ident).alias("i"), F.col(start).alias("s"), F.col(end).alias("e"), F.explode(F.sequence(lo, hi)).alias("bin"))
    a, b = (rows.select("k", "bin", *[F.col(c).alias(c + n) for c in ("i", "s", "e")]) for n in "12")
    home = F.floor(F.greatest("s1", "s2") / bin_size) == F.col("bin")
    pairs = a.join(b, ["k", "bin"]).where((F.col("i1") < F.col("i2")) & home & X.overlaps(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))
    return pairs.select(F.col("k").alias(key), F.col("i1").alias("a"), F.col("i2").alias("b"))


def mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that one side lacks: side is the one that has it."""
    a = left.select(key).distinct().withColumn("__a", F.lit(1))
    b = right.select(key).distinct().withColumn("__b", F.lit(1))
    out = a.join(b, key, "full_outer").where("__a is null or __b is null")
    return out.select(key, F.when(F.col("__a").isNull(), "right").otherwise("left").alias("side"))


def unassigned(raw: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """The rows of raw whose key no group has."""
    return raw.join(assigned.select(key), key, "left_anti")
