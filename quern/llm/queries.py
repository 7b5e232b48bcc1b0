"""The registered queries of this subpackage: each over whole tables, with the operators' production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import boilerplate, leak, markup, match, mix, split, terms, topn
from quern.session import cut, load


def p1_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both fields that held markup, cleaned."""
    methods = markup.clean_markup(load(spark, sf_dir, "recipes"), "url", "method")
    pages = markup.clean_markup(load(spark, sf_dir, "wiki_recipes"), "page_id", "wiki_description")
    both = methods.withColumn("field", F.lit("method")).unionByName(pages.withColumn("field", F.lit("wiki_description")))
    return both.select("field", "row_key", "clean_text", F.concat_ws(",", "kinds").alias("kinds")).where(F.col("kinds") != "")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_markup(spark, sf_dir).select("field", "row_key")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.distinctive_terms(terms.postings(load(spark, sf_dir, "term_index")), 3).select("doc_id", "term")


def p3_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most distinctive terms of each recipe's method by graph-of-words degree."""
    rows = cut(terms.graph_degrees(load(spark, sf_dir, "recipes"), "url", "method"))
    return terms.distinctive_terms(terms.weighted(rows, "degree"), 3).withColumnRenamed("doc_id", "url")


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.mark_lines(load(spark, sf_dir, "raw_pages"), load(spark, sf_dir, "recipes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_lines(spark, sf_dir).where("boilerplate").select("field", "url", "line_no")


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(load(spark, sf_dir, "term_index"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_terms(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


def dishes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recipes, and pages with a row for each of their titles, whichever table names them."""
    recipes = load(spark, sf_dir, "recipes").where("url IS NOT NULL")
    left = recipes.groupBy("url").agg(F.max("title").alias("title"), F.max("ingredients").alias("foods"), F.max("description").alias("text")).withColumnRenamed("url", "id")
    dump = load(spark, sf_dir, "dump_index").select("page_id", "wiki_title", "wiki_ingredients", "wiki_origin")
    other = load(spark, sf_dir, "wiki_recipes").select("page_id", "wiki_title").distinct()
    pages = dump.unionByName(other, allowMissingColumns=True).where("page_id IS NOT NULL")
    spelled = F.trim(F.lower(F.translate("wiki_title", "_", " ")))
    right = pages.groupBy("page_id").agg(F.collect_set(spelled).alias("titles"), F.max("wiki_ingredients").alias("foods"), F.max(F.nullif(F.trim("wiki_origin"), F.lit(""))).alias("text"))
    right = right.select(F.col("page_id").cast("string").alias("id"), F.explode_outer("titles").alias("title"), "foods", "text")
    return cut(left), cut(right)


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes with their page."""
    found = match.match(*dishes(spark, sf_dir))
    return found.select(F.col("left_id").alias("url"), F.col("right_id").cast("long").alias("page_id"), F.round("confidence", 6).alias("confidence"))


def p6_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes and pages one to one, of the greatest confidence in all."""
    chosen = match.one_to_one(match.candidates(*dishes(spark, sf_dir)))
    return chosen.select(F.col("left_id").alias("url"), F.col("right_id").cast("long").alias("page_id"), F.round("score", 6).alias("score"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_matches(spark, sf_dir).select("url", "page_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_per_group(load(spark, sf_dir, "wiki_recipes"), ["recipe_url"], "page_id", "match_score", 3).select("recipe_url", "page_id")


def p7_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_per_group(load(spark, sf_dir, "wiki_recipes"), ["recipe_url"], "page_id", "match_score", 3)


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold leaked words, without them; null where most of a document leaked."""
    out = leak.remove_leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "eval_items"))
    return out.where("leaked_share > 0").select("doc_id", "clean_text", F.round("leaked_share", 6).alias("leaked_share"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_sources(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of which all texts are in the drawn mix as often as they may be, and that still fall short."""
    return p9_report(spark, sf_dir).where(F.col("used_up") & (F.col("drawn") < F.col("wanted"))).select("source")


def p9_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix asks of each source, sizes in words between blanks, which SQL can count too."""
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    texts = mix.sized_texts(load(spark, sf_dir, "documents"), size=words)
    return mix.budgets(cut(texts), load(spark, sf_dir, "mix_targets")).drop("mean_weight")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all texts over the limit."""
    return split.split_texts(load(spark, sf_dir, "documents"), long_only=True)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_pieces(spark, sf_dir).where("piece_no = 0").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}
