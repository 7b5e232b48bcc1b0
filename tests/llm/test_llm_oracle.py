"""The subpackage's queries on the smallest tables."""

from __future__ import annotations

import pytest

from quern.llm import leak, queries, sql
from tests.test_oracle import DIR, compare, duck, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, queries.queries()[name], sql.oracle_sql()[name])


COLUMNS = {"p1_found": ["field", "row_key"], "p4_found": ["field", "url", "line_no"], "p6_found": ["url", "page_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["source"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs(spark, name):
    df = queries.queries()[name](spark, DIR)
    found = df.collect()
    assert len(found) == len(set(map(str, found))) and found
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]


def test_leaks_of_the_tables_against_brute_force(spark):
    docs = [(r["doc_id"], leak.words(r["text"])) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    items = [(r["item_id"], leak.words(r["text"])) for r in spark.read.parquet(f"{DIR}/eval_items.parquet").collect()]
    grams = {}
    for i, w in items:
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {(d, i) for d, w in docs for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
    assert {tuple(r) for r in queries.p8_found(spark, DIR).collect()} == want
