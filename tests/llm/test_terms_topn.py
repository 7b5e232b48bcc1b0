"""Top N, postings, bitmaps and weights against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import terms, topn

INDEX = "term string, segment int, document_frequency int, postings map<string,int>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def top_plain(data, n):
    best = defaultdict(dict)
    for g, i, s in data:
        if i is not None and s is not None and not math.isnan(s):
            best[g][i] = max(best[g].get(i, -math.inf), s)
    return sorted(((g, i, s, k) for g, m in best.items() for k, (i, s) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0]))[:n], 1)), key=str)


@pytest.mark.parametrize("salts", [1, 7])
def test_top_n_against_brute_force(spark, salts):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, float("nan"), 0.5, 0.5, rng.random()])) for _ in range(600)]
    df = spark.createDataFrame(data, "g string, i long, s double").withColumn("rank", F.lit("clash")).withColumn("_salt", F.lit("clash"))
    assert rows(topn.top_per_group(df, ["g"], "i", "s", 3, salts)) == top_plain(data, 3)


def test_top_n_edges(spark):
    df = spark.createDataFrame([("g", 2, 1.0), ("g", 2, 1.0), ("g", 1, 1.0)], "g string, i long, s double")
    assert rows(topn.top_per_group(df, ["g"], "i", "s", 5)) == [("g", 1, 1.0, 1), ("g", 2, 1.0, 2)]
    assert topn.top_per_group(df.limit(0), ["g"], "i", "s", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_per_group(df, ["g"], "i", "s", 0)


def sample_index():
    rng = random.Random(5)
    out = []
    for k in range(60):
        docs = {f"d{rng.randrange(40)}": rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))}
        out.append((rng.choice([f"t{k}", f" T{k}\t"]), 0, rng.choice([None, 1]), docs))
        if k % 5 == 0:
            out.append((f"t{k} ", 0, 99, docs))
    return [*out, ("gone", 1, 4, None), (None, 1, 1, {"d1": 1}), ("  ", 1, 1, {"d1": 1}), ("none", 1, 0, {})]


def plain_postings(data):
    p = defaultdict(dict)
    for t, _, _, docs in data:
        if t is not None and t.strip():
            for d, n in (docs or {}).items():
                p[t.strip().lower()][d] = max(n or 0, p[t.strip().lower()].get(d, 0))
    return {t: d for t, d in p.items() if d}


def test_term_frequencies_against_brute_force(spark):
    data = sample_index()
    df = spark.createDataFrame(data, INDEX).withColumn("doc_id", F.lit(1)).withColumn("tf", F.lit(1))
    p = plain_postings(data)
    total = len({d for m in p.values() for d in m})
    want = sorted(((t, sum(m.values()), len(m), total, "rare" if len(m) <= 2 else "common" if len(m) > 0.2 * total else None) for t, m in p.items()), key=str)
    assert rows(terms.term_frequencies(df)) == want


@pytest.mark.parametrize("size", [100, 1 << 30])
def test_buckets_do_not_show(spark, monkeypatch, size):
    monkeypatch.setattr(terms, "BUCKET", size)
    data = sample_index()
    df = spark.createDataFrame(data, INDEX)
    got = {r["term"]: (r["documents"], r["occurrences"]) for r in terms.term_frequencies(df).collect()}
    assert got == {t: (len(m), sum(m.values())) for t, m in plain_postings(data).items()}


@pytest.mark.parametrize("container", [16, 64, 1 << 16])
def test_bitmaps_give_back_what_they_hold(monkeypatch, container):
    monkeypatch.setattr(terms, "CONTAINER", container)
    rng = random.Random(8)
    kinds = set()
    for dense in (0.01, 0.3, 0.5, 0.97):
        pairs = sorted({(t, d) for t in range(5) for d in range(3000) if rng.random() < dense} | {(7, d) for d in range(100, 2500)})
        t, d = (np.array(x) for x in zip(*pairs))
        maps = terms.Bitmaps.of(t, d)
        kinds |= set(maps.kind.tolist())
        assert [x.tolist() for x in maps.pairs()] == [t.tolist(), d.tolist()]
        assert maps.cardinalities(9).tolist() == [sum(a == k for a, _ in pairs) for k in range(9)]
        assert maps.data.nbytes <= 2 * len(pairs) and maps.data.nbytes <= sum(container // 8 for _ in maps.n)
    assert kinds == {16: {terms.ARRAY, terms.BITMAP}, 64: {terms.ARRAY, terms.RUN, terms.BITMAP}, 1 << 16: {terms.ARRAY, terms.RUN}}[container]
    empty = terms.Bitmaps.of(np.zeros(0, dtype=int), np.zeros(0, dtype=int))
    assert len(empty.pairs()[0]) == 0 and empty.cardinalities(2).tolist() == [0, 0]


def test_union_keeps_the_highest_counter():
    pairs, counts = terms.union((np.array([3, 1]), np.array([1.0, 5.0])), (np.array([1, 2, 3]), np.array([9.0, 1.0, 0.0])))
    assert pairs.tolist() == [1, 2, 3] and counts.tolist() == [9.0, 1.0, 1.0]


def test_empty_index(spark):
    e = spark.createDataFrame([], INDEX)
    assert terms.term_frequencies(e).count() == 0
    assert terms.distinctive_terms(terms.postings(e)).count() == 0


def test_distinctive_terms_against_brute_force(spark, monkeypatch):
    data = sample_index()
    p = plain_postings(data)
    total = len({d for m in p.values() for d in m})
    scores = defaultdict(list)
    for t, m in p.items():
        if len(m) >= 2:
            for d, n in m.items():
                scores[d].append((-round(n * math.log(total / len(m)), 6), t))
    want = sorted((d, t) for d, s in scores.items() for _, t in sorted(s)[:3])
    df = spark.createDataFrame(data, INDEX)
    for size in (1 << 30, 50):
        monkeypatch.setattr(terms, "BUCKET", size)
        got = terms.distinctive_terms(terms.postings(df))
        assert sorted((r["doc_id"], r["term"]) for r in got.collect()) == want
    flat = spark.createDataFrame([(d, t, n) for t, m in p.items() for d, n in m.items()] + [(None, "t", 1), ("d1", None, 1)], "doc_id string, term string, w int").withColumn("score", F.lit("clash"))
    assert sorted((r["doc_id"], r["term"]) for r in terms.distinctive_terms(terms.weighted(flat, "w")).collect()) == want


def test_graph_degrees_against_brute_force(spark):
    texts = ["duck lemon duck soup pepper lemon", "soup", "", None, "duck duck duck", " ".join(f"word{k % 7}x" for k in range(400))]
    df = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)] + [("d0", texts[0])], "id string, text string").withColumn("term", F.lit(1))
    want = []
    for k, t in enumerate(texts):
        ws = (t or "").split()
        near = defaultdict(set)
        for i, a in enumerate(ws):
            near[a] |= {b for j, b in enumerate(ws) if abs(i - j) <= 3 and b != a}
        want += [(f"d{k}", w, n, len(near[w])) for w, n in Counter(ws).items()]
    assert rows(terms.graph_degrees(df, "id", "text")) == sorted(want, key=str)
