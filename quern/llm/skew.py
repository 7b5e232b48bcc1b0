"""Joins of many rows with few facts per key, safe where one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut

FEW = 200_000  # facts that are broadcast without asking for hot keys
MOST, LEAST = 10_000, 1_000  # a key is hot with more than one in MOST of all rows (and LEAST rows), so there are at most MOST hot keys


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``facts`` (at most one row per key) on ``keys``.

    Up to ``FEW`` facts are broadcast as they are. Of more, rows of hot keys meet their facts by broadcast, of at most ``MOST`` facts; the others meet them by a plain join, in which no
    key has more than one in ``MOST`` of the rows. Null keys find nothing; with ``left`` such rows stay.
    """
    facts = cut(facts)
    if facts.count() <= FEW:
        return rows.join(F.broadcast(facts), keys, how)
    rows = cut(rows)
    limit = max(LEAST, rows.count() // MOST)
    hot = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys))
    known = F.broadcast(hot)
    some = F.broadcast(facts.join(known, keys, "left_semi"))
    return rows.join(known, keys, "left_semi").join(some, keys, how).unionByName(rows.join(known, keys, "left_anti").join(facts, keys, how))
