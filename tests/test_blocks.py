"""Search with many queries: blocks of documents and queries against sums in plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import blocks, search


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("method", ["classic", "robertson"])
@pytest.mark.parametrize("dense", [0.01, 2.0])
def test_blocks_find_the_best(spark, monkeypatch, method, dense):
    pick = random.Random(3)
    words = [f"word{k}" for k in range(40)]
    texts = [pick.choices(words, weights=[1 / (k + 1) for k in range(40)], k=pick.randint(1, 9)) for _ in range(700)]
    texts += texts[:60]  # documents that tie
    p = spark.createDataFrame([(w, f"d{k}") for k, t in enumerate(texts) for w in t], "term string, doc_id string").groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    q = spark.createDataFrame([(k, " ".join(pick.choices([*words, "unknown"], k=pick.randint(1, 12)))) for k in range(60)] + [(98, "unknown"), (99, "")], "query_id int, query string")
    asked, counts, n = [(r["query_id"], Counter(r["query"].split())) for r in q.collect()], [Counter(t) for t in texts], len(texts)
    df = Counter(w for c in counts for w in c)
    weight = {w: math.log(n / x) if method == "classic" else math.log((n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    few = []
    for i, terms in asked:
        found = [(-round(math.fsum(c[w] * times * weight[w] for w, times in terms.items() if w in c), 9), f"d{k}") for k, c in enumerate(counts)]
        few += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(x for x in found if x[0] < 0)[:5], 1)]
    for name, value in (("PAIRS", 0), ("BLOCK", 500), ("ASKED", 150)):
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(blocks, "DENSE", dense)
    monkeypatch.setattr(blocks, "CELLS", 2000)
    assert rows(search.score_queries(p, len(texts), q, method=method)) == few and len(few) > 200
    assert search.score_queries(p.limit(0), 0, q, method=method).count() == 0


def test_pairs_of_many_queries_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST", 0)
    p = spark.createDataFrame([("soup", "d1", 2), ("lemon", "d2", 1)], "term string, doc_id string, tf bigint")
    q = spark.createDataFrame([(1, "soup lemon")], "query_id int, query string")
    plan = search.score_queries(p, 2, q, method="classic")._jdf.queryExecution().optimizedPlan().toString()
    assert "weight#" not in plan and "MapInArrow" in plan
