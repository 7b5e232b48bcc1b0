"""Ranked search over postings: tf times idf, single queries and whole tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from quern.config import TOP_K
from quern.functions.text import tokenize_query
from quern.operators.blocks import packed, scored
from quern.operators.index import document_frequencies
from quern.session import cut


def classic_idf(n: Column, df: Column) -> Column:
    return F.log(n / df)


def robertson_idf(n: Column, df: Column) -> Column:
    """Negative for terms in more than half of the documents."""
    return F.log((n - df + 0.5) / (df + 0.5))


def idf(method: str, n: Column, df: Column) -> Column:
    """``classic``, else Robertson's."""
    return classic_idf(n, df) if method == "classic" else robertson_idf(n, df)


#: Rows (query, term) up to which queries are broadcast to the postings, and pairs of these rows with postings up to which pairs are rows.
BROADCAST, PAIRS = 500_000, 20_000_000
#: Postings of a block of documents, about, and rows (query, term) of a block of queries.
BLOCK, ASKED = 3_000_000, 20_000_000


def score_queries(postings: DataFrame, total: Column | int, queries: DataFrame, k: int = TOP_K, method: str = "robertson") -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of each query of (query_id, query).

    A document that has any of a query's terms scores the sum of tf times idf over the query's tokens, repeated ones counting
    again; only positive scores are kept. Ties go to the lower doc_id. Queries without known terms have no rows. Only postings
    of terms that are asked for are counted and scored. Few queries come to the postings, dealt by document,
    so pairs of query and document are summed where they arise, and only ``k`` of a task and query are shuffled. Of more
    than ``BROADCAST`` rows or ``PAIRS`` pairs, blocks of documents meet blocks of queries in products of matrices, see ``best_of_blocks``.
    """
    terms = cut(queries.select("query_id", F.explode(tokenize_query("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))
    few = terms.count() <= BROADCAST
    known = terms.groupBy("term").agg(F.count(F.lit(1)).alias("_q"))
    asked = postings.join(F.broadcast(known.select("term")) if few else known.select("term"), "term", "left_semi")
    n = total if isinstance(total, Column) else F.lit(float(total))
    weights = cut(document_frequencies(asked).select("term", "document_frequency", idf(method, n.cast("double"), F.col("document_frequency").cast("double")).alias("idf")))
    pairs = weights.join(known, "term").agg(F.sum(F.col("document_frequency").cast("double") * F.col("_q")), F.sum("document_frequency"), F.sum("_q")).first()
    if few and (pairs[0] or 0) <= PAIRS:
        weighted = terms.join(weights, "term").select("query_id", "term", (F.col("idf") * F.col("times")).alias("weight"))
        best = asked.repartition("doc_id").join(F.broadcast(weighted), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("weight")).alias("score"))
    else:
        best = best_of_blocks(postings, terms, weights, pairs[1] or 0, pairs[2] or 0, k)
    ranked = best.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())))
    return ranked.where(F.col("rank") <= k)


def best_of_blocks(postings: DataFrame, terms: DataFrame, weights: DataFrame, n_postings: int, n_asked: int, k: int) -> DataFrame:
    """(query_id, doc_id, score): for each query and block of documents the ``k`` best, by score and doc_id; only positive scores.

    Pairs of queries and postings are never rows. Both sides are packed, terms as numbers, and dealt to cells by hashes: each block of documents meets each
    of queries once. What is shuffled is the postings once for each block of queries and the queries once for each block of documents.
    """
    cores = postings.sparkSession.sparkContext.defaultParallelism
    blocks, groups = max(1, min(2 * cores, n_postings // (BLOCK // 20)), n_postings // BLOCK), max(1, n_asked // ASKED)
    numbers = cut(weights.select("term", "idf", (F.row_number().over(Window.orderBy("term")) - 1).alias("number")))  # a row for each term asked for
    types = {c: df.schema[c].dataType for df, c in ((postings, "doc_id"), (terms, "query_id"))}
    packs = lambda df, c: df.mapInArrow(packed(c, "number", "n"), StructType([StructField("key", types[c]), StructField("pack", BinaryType())]))
    docs = packs(postings.join(numbers, "term").select("doc_id", "number", F.col("tf").alias("n")), "doc_id")
    asked = packs(terms.join(numbers, "term").select("query_id", "number", F.col("times").alias("n")).repartition(max(1, min(2 * cores, n_asked // 50_000)), "query_id"), "query_id")
    asked = asked.groupBy("key").agg(F.collect_list("pack").alias("pack")).select("key", F.expr("aggregate(pack, X'', (x, y) -> concat(x, y))").alias("pack"))
    none = lambda kind: F.lit(None).cast(kind)
    own = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = [
        numbers.select(every(blocks * groups).alias("cell"), F.lit(0).alias("side"), none(types["doc_id"]).alias("doc_id"), none(types["query_id"]).alias("query_id"), none("binary").alias("pack"), "number", "idf"),
        docs.select("*", own(blocks).alias("_b"), every(groups).alias("_g")).select((F.col("_b") * groups + F.col("_g")).cast("int"), F.lit(1), "key", none(types["query_id"]), "pack", none("int"), none("double")),
        asked.select("*", own(groups).alias("_g"), every(blocks).alias("_b")).select((F.col("_b") * groups + F.col("_g")).cast("int"), F.lit(2), none(types["doc_id"]), "key", "pack", none("int"), none("double")),
    ]
    met = rows[0].union(rows[1]).union(rows[2]).repartitionById(blocks * groups, F.col("cell")).sortWithinPartitions("cell", "side")
    return met.mapInArrow(scored(k), StructType([StructField("query_id", types["query_id"]), StructField("doc_id", types["doc_id"]), StructField("score", DoubleType())]))


def search(postings: DataFrame, docs: DataFrame, total: int, query: str, k: int = TOP_K, method: str = "robertson") -> DataFrame:
    """The ``k`` best documents of one query with what is shown of them; a document without metadata is left out."""
    one = postings.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    hits = score_queries(postings, total, one, k, method)
    return hits.drop("query_id").join(docs, "doc_id").orderBy("rank")
