"""Window-shaped operators over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetline.functions.constants import SAMPLE_DELTA, SAMPLE_FLOOR


def gap_sessions(rows: DataFrame, key: list[str], at: str, gap: float) -> DataFrame:
    """rows with session (from 0) of their key: a new one begins where the gap to the row before exceeds the limit."""
    w = Window.partitionBy(*key).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def delta_samples(rows: DataFrame, key: list[str], order: str, score: str) -> DataFrame:
    """The rows that differ by a tenth or more from the last row kept (whose score must exceed a floor); the first is kept.

    It compares with what was kept, not with the row before, so it is a fold over each key's ordered rows; the rows of
    one key (one track) are one array.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(score).cast("double").alias("s"))))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        keep = last.isNull() | ((last > SAMPLE_FLOOR) & (F.abs(x["s"] - last) >= SAMPLE_DELTA * last))
        return F.struct(
            F.when(keep, x["s"]).otherwise(last).alias("last"),
            F.when(keep, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
        )

    zero = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(f"array<struct<o:{dict(rows.dtypes)[order]},s:double>>").alias("kept"))
    folded = rows.groupBy(*key).agg(ordered.alias("r")).select(*key, F.explode(F.aggregate("r", zero, step)["kept"]).alias("x"))
    return folded.select(*key, F.col("x.o").alias(order), F.col("x.s").alias(score))


def last_seen(rows: DataFrame, key: list[str], at: str, value: str, within: float) -> DataFrame:
    """rows with the last non-null value of their key seen before, if no longer ago than the limit."""
    w = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v"))), ignorenulls=True).over(w)
    return rows.withColumn("__s", seen).withColumn("held", F.when(F.col(at) - F.col("__s.at") <= within, F.col("__s.v"))).drop("__s")


def later_commit(commits: DataFrame, video: str, at: str, ident: str, live: Column) -> DataFrame:
    """(ident, blocker) of each commit: the earliest strictly later one of its video that is live, or null.

    One sort per video instead of a join with all later commits: the next larger time's first live commit.
    """
    first = commits.where(live).groupBy(video, at).agg(F.min(ident).alias("__live"))
    times = commits.select(video, at).distinct().join(first, [video, at], "left")
    w = Window.partitionBy(video).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    nxt = times.select(video, at, F.first("__live", ignorenulls=True).over(w).alias("blocker"))
    return commits.join(nxt, [video, at], "left").select(ident, "blocker")
