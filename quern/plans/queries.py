"""The registered queries of the core: each over whole tables, with the operators' usual parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.functions import wiki as W
from quern.functions.markdown import html_to_markdown, md_title, short_units, valid_difficulty
from quern.functions.tokens import token_count
from quern.operators import crawl, extract, fields, index, link, search, stats, units
from quern.session import cut, load, spread
from quern.sinks.files import result_lines
from quern.sources.dump import parse_index

QUERY = "chicken and lemon soup soup"
WIKI = "https://en.wikipedia.org/wiki/"
SHOWN = ["title", "description", "method", "chef"]
BOOSTS = {"title": 3.0, "ingredients": 2.5, "description": 1.5, "method": 1.0, "chef": 0.5}


def recipes(spark: SparkSession, d: str) -> DataFrame:
    return index.latest(load(spark, d, "recipes"), "url", ["crawled_at", "loaded_at"])


def postings(spark: SparkSession, d: str) -> DataFrame:
    one = recipes(spark, d)
    return index.term_counts(one, "url", index.recipe_text(one))


def dedupe_url(spark: SparkSession, d: str) -> DataFrame:
    return recipes(spark, d).select("url", "title", "crawled_at", "loaded_at", "method", "prep_time")


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    one = recipes(spark, d)
    return index.term_rows(one, "url", index.recipe_text(one)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("term").alias("terms"))


def tf_counts(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d)


def df_vocab(spark: SparkSession, d: str) -> DataFrame:
    return index.document_frequencies(postings(spark, d))


def postings_rows(spark: SparkSession, d: str) -> DataFrame:
    maps = index.postings_maps(postings(spark, d))
    return maps.select("term", "document_frequency", F.explode("postings").alias("doc_id", "tf"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    one = recipes(spark, d).withColumn("text", index.recipe_text(recipes(spark, d)))
    return index.corpus_stats(one, postings(spark, d), load(spark, d, "raw_pages")).drop("total_tokens")


def corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Language-model tokens by source of the documents; the tokenizer is no SQL function."""
    return spread(load(spark, d, "documents"), "doc_id").select("source", token_count("text").alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"))


def _search(spark: SparkSession, d: str, method: str) -> DataFrame:
    rows = cut(postings(spark, d))
    one = spark.createDataFrame([(0, QUERY)], "query_id int, query string")
    hits = search.score_queries(rows, rows.select("doc_id").distinct().count(), one, method=method)
    return hits.join(recipes(spark, d).select(F.col("url").alias("doc_id"), "title"), "doc_id").select("rank", "doc_id", "title", F.round("score", 6).alias("score"))


def search_classic(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "classic")


def search_robertson(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "robertson")


def search_batch(spark: SparkSession, d: str) -> DataFrame:
    """The five best recipes for each document whose id is divisible by 20, its whole text as query."""
    rows = cut(postings(spark, d))
    asked = load(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    hits = search.score_queries(rows, rows.select("doc_id").distinct().count(), asked, method="classic")
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "eval_items").select("item_id", F.posexplode(T.tokenize_query("text")).alias("pos", "token"))


def title_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = link.prepare_titles(load(spark, d, "dump_index").select("page_id", "wiki_title").distinct(), "wiki_title")
    return rows.select("page_id", "cleaned_title", F.array_join("filtered_tokens", " ").alias("tokens"))


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = link.prepare_titles(recipes(spark, d).where("title IS NOT NULL").select("url", "title"), "title")
    pages = load(spark, d, "dump_index").groupBy("page_id").agg(F.min("wiki_title").alias("wiki_title"))
    return left, link.prepare_titles(pages, "wiki_title")


def link_candidates_count(spark: SparkSession, d: str) -> DataFrame:
    """Candidate rows per recipe, one for each shared token."""
    left, right = _titles(spark, d)
    freq = right.select(F.explode("filtered_tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return link.exploded(left, "url").join(freq, "token").groupBy(F.col("_k").alias("url")).agg(F.sum("n").alias("candidates"))


def link_scored(spark: SparkSession, d: str) -> DataFrame:
    left, right = _titles(spark, d)
    rows = link.similar_pairs(left, right, "url", "page_id")
    return rows.select(F.col("left_id").alias("url"), F.col("right_id").alias("page_id"), F.round("similarity", 6).alias("similarity"))


def link_best(spark: SparkSession, d: str) -> DataFrame:
    left, right = _titles(spark, d)
    rows = link.best_matches(left, right, "url", "page_id")
    return rows.select(F.col("left_id").alias("url"), F.col("right_id").alias("page_id"), F.round("similarity", 6).alias("similarity"))


def link_all_left(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "dump_index").select("wiki_offset", "page_id", "wiki_title")
    out = link.link(load(spark, d, "recipes"), pages, base=WIKI)
    return out.select("recipe_url", "recipe_title", "method", "page_id", "wiki_title", "wiki_url", "wiki_offset", F.round("similarity", 6).alias("similarity"), "wiki_description")


def match_rate(spark: SparkSession, d: str) -> DataFrame:
    return link.match_rate(load(spark, d, "wiki_recipes")).withColumn("described_pct", F.round("described_pct", 6))


def top_articles(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_values(load(spark, d, "wiki_recipes").where("wiki_title IS NOT NULL"), "wiki_title", 20)


def dump_index_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "dump_index").select(F.concat_ws(":", "wiki_offset", "page_id", "wiki_title").alias("value"))
    broken = load(spark, d, "dump_index").select(F.concat_ws(":", "wiki_title", "page_id").alias("value"))
    return parse_index(lines.unionByName(broken)).groupBy("wiki_offset", "page_id", "wiki_title").agg(F.count(F.lit(1)).alias("n"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "raw_pages").groupBy("url").agg(F.max("html").alias("html"))
    return pages.select("url", T.clean_text(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"), T.clean_text(md_title(html_to_markdown("html"))).alias("heading"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return crawl.page_links(load(spark, d, "raw_pages")).groupBy("link").agg(F.count(F.lit(1)).alias("pages"))


def page_links_internal(spark: SparkSession, d: str) -> DataFrame:
    return crawl.page_edges(load(spark, d, "raw_pages"))


def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "raw_pages").groupBy("url").agg(F.max("html").alias("html"))
    seeds = pages.groupBy(U.part("url", "HOST").alias("host")).agg(F.min("url").alias("url"))
    return crawl.crawl(cut(pages), seeds)


def bfs_counts(spark: SparkSession, d: str) -> DataFrame:
    return crawl.level_counts(bfs_levels(spark, d))


def recipe_like_urls(spark: SparkSession, d: str) -> DataFrame:
    edges = crawl.page_edges(load(spark, d, "raw_pages")).select(F.col("dst_url").alias("url"))
    urls = edges.union(load(spark, d, "recipes").select("url")).distinct()
    return urls.select("url", U.is_recipe_url("url").alias("recipe"), U.is_sitemap_recipe("url").alias("sitemap_recipe"), U.skipped_suffix("url").alias("skipped"), U.is_search_url("url").alias("search"))


def url_diff_missing(spark: SparkSession, d: str) -> DataFrame:
    return crawl.missing_urls(load(spark, d, "recipes"), load(spark, d, "raw_pages"))


def url_diff_status(spark: SparkSession, d: str) -> DataFrame:
    both = crawl.reconcile(load(spark, d, "recipes"), load(spark, d, "raw_pages").select("url"))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def filename_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "recipes").select("url", "html_file").distinct()
    return rows.select("url", U.url_to_file("url").alias("file"), U.file_to_url(U.url_to_file("url")).alias("back"), U.page_file("url").alias("saved"), U.slashes("html_file").alias("path"))


def field_completeness(spark: SparkSession, d: str) -> DataFrame:
    return stats.completeness(load(spark, d, "recipes"), ["title", "description", "ingredients", "method", "chef", "difficulty", "prep_time", "servings", "html_file"])


def top_chefs(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_values(recipes(spark, d), "chef")


def difficulty_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(load(spark, d, "recipes").select(valid_difficulty("difficulty").alias("difficulty")), "difficulty")


def prep_time_parse(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recipes").select("url", T.clean_text(short_units("prep_time")).alias("prep_time")).distinct()


def wikitext_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "wiki_recipes").where("wiki_description <> ''").groupBy("page_id").agg(F.max("wiki_description").alias("t"))
    return pages.select("page_id", W.wiki_clean("t").alias("clean"))


def wiki_sections(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "wiki_recipes").where("wiki_description <> ''").groupBy("page_id").agg(F.max("wiki_description").alias("t"))
    article = F.concat(F.lit("<text>intro\n== About ==\n"), F.col("t"), F.lit("\n</text>"))
    return pages.select("page_id", W.wiki_section(article).alias("section"))


def wiki_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts of the pages' descriptions."""
    pages = load(spark, d, "wiki_recipes").where("wiki_description <> ''").groupBy("page_id").agg(F.max("wiki_description").alias("t"))
    return pages.select("page_id", W.wiki_abstract(F.concat(F.lit("<text>"), F.col("t"), F.lit("</text>"))).alias("abstract"))


def wiki_url(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "dump_index").select("page_id", W.wiki_url("wiki_title", WIKI).alias("wiki_url")).distinct()


def _fields(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = recipes(spark, d).withColumn("doc_id", F.col("url"))
    return fields.field_postings(docs, "doc_id", list(BOOSTS)), docs


def field_terms(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d)[0].select("field", "term", "doc_id", "tf", "length")


def field_bm25(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their score for two words over the boosted fields."""
    rows = cut(_fields(spark, d)[0])
    terms = spark.createDataFrame([("lemon",), ("soup",)], "term string")
    scores = fields.term_scores(rows, terms, BOOSTS)
    return scores.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


def field_query(spark: SparkSession, d: str) -> DataFrame:
    """The query language: a phrase, a required field, a prefix, a fuzzy word and an exclusion."""
    rows, docs = _fields(spark, d)
    out = fields.field_search(cut(rows), docs.select("doc_id", "title", fields.shown("description").alias("description"), "chef"), '+title:soup "lemon juice"^2 cinn* lentl~1 -pork', boosts=BOOSTS)
    return out.withColumn("score", F.round("score", 6))


def result_text(spark: SparkSession, d: str) -> DataFrame:
    hits = search_classic(spark, d).join(recipes(spark, d).select(F.col("url").alias("doc_id"), "chef", "prep_time", "servings"), "doc_id")
    lines = result_lines(F.col("rank"), F.col("title"), F.col("score"), F.col("doc_id"), {"Chef": F.col("chef"), "Prep Time": F.col("prep_time")})
    return hits.select("rank", lines.alias("text"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.excerpt("text").alias("excerpt"))


def extract_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the saved pages, by way of Markdown."""
    pages = load(spark, d, "raw_pages").groupBy("url").agg(F.max("html").alias("html"), F.max("html_file").alias("html_file"))
    return extract.extract(pages).withColumn("ingredients", F.array_join("ingredients", "\n"))


def doc_mapping_rows(spark: SparkSession, d: str) -> DataFrame:
    """The documents' shown fields, one row each, nulls as blanks."""
    one = index.latest(load(spark, d, "doc_mapping"), "doc_id", [])
    return one.select("doc_id", "url", *[T.blank(c).alias(c) for c in ("title", "chef", "difficulty", "prep_time", "servings")], F.coalesce(F.size("ingredients"), F.lit(0)).alias("n_ingredients"))


def p2_quantities(spark: SparkSession, d: str) -> DataFrame:
    return units.convert_quantities(load(spark, d, "recipes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_quantities(spark, d)


HELPERS = {"recipes", "postings", "queries", "cut", "load", "spread", "result_lines", "parse_index", "token_count", "html_to_markdown", "md_title", "short_units", "valid_difficulty"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in HELPERS}
