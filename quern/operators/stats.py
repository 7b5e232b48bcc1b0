"""Statistics on extracted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, c: str) -> Column:
    """Arrays: not null and not empty; others: not null."""
    return (F.size(c) > 0) & F.col(c).isNotNull() if dict(df.dtypes)[c].startswith("array") else F.col(c).isNotNull()


def filled(df: DataFrame, c: str) -> Column:
    """As ``present``, and strings not blank."""
    return present(df, c) & (F.trim(c) != "") if dict(df.dtypes)[c] == "string" else present(df, c)


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, non_null, non_empty, total, pct): one pass over the records; the share is of ``non_null``, null for no records."""
    sums = [F.count(F.lit(1)).alias("_n")]
    for k, f in enumerate(fields):
        sums += [F.count_if(present(df, f)).alias(f"_a{k}"), F.count_if(filled(df, f)).alias(f"_b{k}")]
    one = df.agg(*sums)
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"_a{k}").alias("non_null"), F.col(f"_b{k}").alias("non_empty")) for k, f in enumerate(fields)]
    out = one.select("_n", F.explode(F.array(*rows)).alias("_r")).select("_r.*", F.col("_n").alias("total"))
    return out.withColumn("pct", F.round(F.try_divide(F.col("non_null") * 100.0, F.col("total")), 1))


def top_values(df: DataFrame, c: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values, blank ones dropped after the cut; ties by value."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(c).asc_nulls_last()).limit(k).where(F.coalesce(F.col(c), F.lit("")) != "")


def distribution(df: DataFrame, c: str) -> DataFrame:
    """(value, n) of all values that aren't blank."""
    return df.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(c).agg(F.count(F.lit(1)).alias("n"))
