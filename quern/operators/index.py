"""Building a text index: postings with term frequencies, documents, statistics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import full_text, tokenize_index
from quern.functions.tokens import token_count


class Index(NamedTuple):
    postings: DataFrame  # term, doc_id, tf
    docs: DataFrame  # doc_id and what is shown of a document
    stats: DataFrame  # one row


DOC_COLUMNS = ("url", "title", "chef", "difficulty", "prep_time", "servings", "ingredients")


def document_key(url: Column | str) -> Column:
    """A document's id from its url, the same in every run."""
    return F.format_string("%016x", F.xxhash64(url))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: that with the greatest values in ``order``; rows that tie in all columns are equal. Null keys are dropped.

    A sorted aggregate instead of a window: combined map-side, so a key with many rows doesn't gather them in one task.
    """
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}") for c in rest]).select(*df.columns)


def recipe_text(df: DataFrame) -> Column:
    """Title, description, ingredients and method in one text."""
    return full_text("title", "description", F.concat_ws(" ", "ingredients"), "method")


def term_rows(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """(doc_id, term): a row for each token."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokenize_index(text)).alias("term"))


def term_counts(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """(term, doc_id, tf), counted map-side first."""
    return term_rows(docs, doc_id, text).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"))


def postings_maps(postings: DataFrame) -> DataFrame:
    """(term, document_frequency, postings as a map), for export: a term's map is held in one row."""
    pairs = F.sort_array(F.collect_list(F.struct("doc_id", F.col("tf").cast("int").alias("tf"))))
    return postings.groupBy("term").agg(F.count(F.lit(1)).cast("int").alias("document_frequency"), F.map_from_entries(pairs).alias("postings"))


def corpus_stats(docs: DataFrame, postings: DataFrame, pages: DataFrame | None = None, tokenizer: str | None = None) -> DataFrame:
    """One row: documents, vocabulary, language-model tokens, bytes of the distinct pages and their MB, rounded to 2 places.

    ``docs`` has ``text``; each aggregate is combined map-side, and they meet as three one-row tables.
    """
    spark = docs.sparkSession
    a = docs.agg(F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.sum(token_count("text", tokenizer)), F.lit(0)).alias("total_tokens"))
    b = postings.agg(F.count_distinct("term").alias("vocabulary_size"))
    if pages is None:
        c = spark.range(1).select(F.lit(0).cast("long").alias("size_bytes"))
    else:
        c = pages.groupBy("url").agg(F.max(F.octet_length("html")).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("size_bytes"))
    one = F.lit(1).alias("_one")
    rows = a.select("*", one).join(b.select("*", one), "_one").join(c.select("*", one), "_one")
    return rows.select("total_documents", "vocabulary_size", "total_tokens", "size_bytes", F.round(F.col("size_bytes") / 1048576, 2).alias("size_mb"))


def build_index(recipes: DataFrame, pages: DataFrame | None = None, tokenizer: str | None = None) -> Index:
    """The index of a table of recipes, one document per url (the latest crawl where that is known)."""
    order = [c for c in ("crawled_at", "loaded_at") if c in recipes.columns]
    one = latest(recipes, "url", order)
    docs = one.withColumn("doc_id", document_key("url")).withColumn("text", recipe_text(one))
    postings = term_counts(docs, "doc_id", F.col("text"))
    blank = [F.coalesce(F.col(c), F.lit("") if c != "ingredients" else F.array().cast("array<string>")).alias(c) for c in DOC_COLUMNS]
    return Index(postings, docs.select("doc_id", *blank), corpus_stats(docs, postings, pages, tokenizer))
