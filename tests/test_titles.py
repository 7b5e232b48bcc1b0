"""Linking of titles in arrays against candidates as rows."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import joins, link, titles
from quern.plans import queries

DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("few", [0, 4096])
def test_pairs_in_arrays_equal_candidate_rows(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "CELL", 40)  # cells of hot words
    monkeypatch.setattr(titles, "FEW", few)
    monkeypatch.setattr(titles, "TILE", 64)
    monkeypatch.setattr(link, "AT_ONCE", 500)
    pick = random.Random(5)
    some = ["duck", "lemon", "soup", "pie", "cake", "crème", "豆腐", "\U0001f986", "ragout", "d" * 15, "e" * 33]
    made = [" ".join(pick.choices(some, k=n)) for n in (1, 2, 3, 4, 5, 12, 20) for _ in range(14)]
    left = spark.createDataFrame([(k, t) for k, t in enumerate([*made, *made[:9], "", None, "the and"])], "i int, t string").withColumn("cleaned_title", F.col("t")).withColumn("filtered_tokens", T.title_tokens("t"))
    right = left.select(F.concat(F.lit("p"), "i").alias("p"), F.reverse("t").alias("t")).withColumn("cleaned_title", F.when(F.col("p") > "p4", F.col("t")).otherwise(F.concat(F.reverse("t"), F.lit(" x")))).withColumn("filtered_tokens", T.title_tokens("cleaned_title"))
    monkeypatch.setattr(titles, "COLUMNS", 16)
    for least in (0.45, 0.0):
        plain = link.scored_pairs(link.candidate_pairs(left, right, "i", "p"), least)
        assert rows(link.similar_pairs(left, right, "i", "p", least)) == rows(plain) and plain.count() > 100
        assert rows(link.best_matches(left, right, "i", "p", least)) == rows(link.best_pairs(plain))
    assert link.similar_pairs(left.limit(0), right, "i", "p").count() == 0 and link.best_matches(left, right.limit(0), "i", "p").count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["link_all_left", "link_best", "link_scored"])
def test_candidates_of_linking_are_no_rows(spark, name):
    plan = queries.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "right_title" not in plan
