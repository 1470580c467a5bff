"""Changes of tables as new tables: upsert, replace, deltas, cascades, and the order of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetline.functions import exprs as X

#: The order in which a commit's actions run; fixed values.
PHASES = {"new_identity": 0, "new_variant": 1, "merge": 2}


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new: a row of new replaces the one with its key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(old.columns))


def replace_for(old: DataFrame, new: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """old without the rows of the given keys, and with the new rows."""
    return old.join(keys.select(key).distinct(), key, "left_anti").unionByName(new.select(old.columns))


def apply_deltas(variants: DataFrame, deltas: DataFrame) -> DataFrame:
    """Variants (id, embedding, face_count, ...) after adding sums and counts (id, delta, n); those left with no faces go.

    Deltas of one variant are added up element by element first.
    """
    flat = deltas.select("id", "n", F.posexplode(F.col("delta").cast("array<double>")).alias("i", "x"))
    sums = flat.groupBy("id", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("d")).select("id", F.col("d.x").alias("__d"))
    counts = deltas.groupBy("id").agg(F.sum("n").alias("__n"))
    out = variants.join(counts, "id", "left").join(sums, "id", "left")
    n = F.col("face_count") + F.coalesce("__n", F.lit(0))
    mean = F.when(F.col("__d").isNull(), F.col("embedding")).otherwise(X.stored_vector(X.apply_delta(F.col("embedding"), F.col("face_count"), F.col("__d"), F.col("__n"))))
    return out.where(n > 0).withColumn("embedding", mean).withColumn("face_count", n.cast(dict(variants.dtypes)["face_count"])).select(variants.columns)


def cascade(parents: DataFrame, child: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """The rows of child whose parent is still there, or that have none."""
    kept = parents.select(F.col(key).alias(fk))
    return child.where(F.col(fk).isNull()).unionByName(child.where(F.col(fk).isNotNull()).join(kept, fk, "left_semi").select(child.columns))


def phase(action: Column) -> Column:
    out = F.lit(len(PHASES))
    for name, n in PHASES.items():
        out = F.when(action == name, n).otherwise(out)
    return out


def order_actions(actions: DataFrame, action: str, pos: str) -> DataFrame:
    """Actions by phase, and within a phase as they came."""
    return actions.orderBy(phase(F.col(action)), pos)
