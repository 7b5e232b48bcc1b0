"""Joins on keys that a large part of both sides may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut

CELL, MOST = 5_000, 10_000  # rows of a key and side from which it is split; the limit grows so that no more than MOST keys of a side are


def grid(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``a`` and ``b`` with the cells ``_lc`` and ``_rc`` in which their rows meet: each pair of rows with equal keys in one; both sides are read twice.

    A key with many rows is dealt to a grid of cells by a hash of its rows: one of ``a`` meets each column of ``b`` once. So no cell gets
    more than a limit's rows of a key from either side. What says how keys are split is broadcast: at most ``MOST`` keys of each side.
    """
    sides = a.select(key, F.lit(True).alias("_a")).unionByName(b.select(key, F.lit(False).alias("_a")))
    counts = cut(sides.groupBy(key).agg(F.count_if("_a").alias("_l"), F.count_if(~F.col("_a")).alias("_r")).where(F.greatest("_l", "_r") > CELL))
    rows = counts.agg(F.coalesce(F.sum("_l"), F.lit(0)), F.coalesce(F.sum("_r"), F.lit(0))).first()
    limits = [max(CELL, n // MOST) for n in rows]
    cells = [F.ceil(F.col(c) / n).cast("int").alias(c) for c, n in zip(("_l", "_r"), limits)]
    hot = F.broadcast(counts.select(key, *cells).where((F.greatest("_l", "_r") > 1) & (F.least("_l", "_r") > 0)))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        n = lambda c: F.coalesce(F.col(c), F.lit(1))
        own = F.pmod(F.xxhash64(*df.columns), n(mine)).cast("int")
        return df.join(hot, key, "left").select(*df.columns, own.alias(f"{mine}c"), F.explode(F.sequence(F.lit(0), n(other) - 1)).alias(f"{other}c"))

    return dealt(a, "_l", "_r"), dealt(b, "_r", "_l")


def grid_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``a`` and ``b`` joined on ``key``, all pairs of equal keys, as a plain inner join gives them; keys with many rows are split, see ``grid``."""
    names = [*a.columns, *[c for c in b.columns if c != key]]
    left, right = grid(a, b, key)
    return left.join(right, [key, "_lc", "_rc"]).select(*names)
