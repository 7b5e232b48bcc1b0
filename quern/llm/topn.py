"""The N best items of every group: salted ranking in two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32  # subgroups of a group; a task of the first stage holds one, of the second at most n * SALTS rows of a group


def top_per_group(df: DataFrame, group: list[str], item: str, score: str, n: int, salts: int = SALTS) -> DataFrame:
    """The ``n`` items of each group with the highest score, ties by item ascending: ``group``, item, score, ``rank`` (from 1).

    An item counts once per group, with its highest score. Rows with null item, null or NaN score count for nothing; null group
    values form a group of their own. Fewer than ``n`` items: all of them; an empty table gives an empty result. Other columns
    are ignored, so names like ``rank`` may clash. Stage one hashes each group into ``salts`` subgroups by item, so repeated
    rows of an item meet there, and keeps ``n`` of each; stage two ranks the survivors. Only stage one shuffles input rows, by
    group and salt, so no task holds a whole hot group.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be at least 1")
    keys = [f"_g{i}" for i in range(len(group))]
    order = [F.col("_score").desc(), F.col("_item").asc()]
    rows = (
        df.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(item).alias("_item"), F.col(score).cast("double").alias("_score"))
        .where(F.col("_item").isNotNull() & F.col("_score").isNotNull() & ~F.isnan("_score"))
        .withColumn("_salt", F.pmod(F.xxhash64("_item"), F.lit(salts)).cast("int"))
        .repartition(*keys, "_salt")
    )
    best = rows.groupBy(*keys, "_salt", "_item").agg(F.max("_score").alias("_score"))
    kept = best.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_salt")
    ranked = kept.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n)
    return ranked.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], F.col("_item").alias(item), F.col("_score").alias(score), F.col("_r").alias("rank"))
