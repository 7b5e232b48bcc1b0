"""Linking titles to encyclopedia titles: token blocking, edit distance, best match; and descriptions for the links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quern.config import MIN_ABSTRACT, SIMILARITY
from quern.functions.text import clean_title, title_tokens
from quern.functions.wiki import wiki_abstract, wiki_section, wiki_url
from quern.operators.index import latest
from quern.operators.joins import grid, grid_join
from quern.operators.titles import similar
from quern.session import cut
from quern.sources.dump import block_pages, first_pages, read_offsets

AT_ONCE = 20_000_000  # candidates of a task, about; fewer where that leaves cores idle


def prepare_titles(df: DataFrame, title: str, order: str = "reference") -> DataFrame:
    """``df`` with ``cleaned_title`` and ``filtered_tokens``; all other columns stay, so nothing is joined back to them."""
    return df.withColumn("cleaned_title", clean_title(title, order)).withColumn("filtered_tokens", title_tokens("cleaned_title"))


def similarity(distance: Column, a: Column, b: Column) -> Column:
    return 1 - distance / F.greatest(F.length(a), F.length(b))


def exploded(df: DataFrame, key: str) -> DataFrame:
    """(_k, _c, _t, token) of a prepared frame: key, cleaned title, its tokens, and one of them; titles without tokens vanish."""
    return df.select(F.col(key).alias("_k"), F.col("cleaned_title").alias("_c"), F.col("filtered_tokens").alias("_t"), F.explode("filtered_tokens").alias("token")).where(F.col("token") != "")


def candidate_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_id, left_title, left_tokens, token, right_id, right_title, right_tokens): a row for each token that two titles share.

    An equi-join on the token; tokens that many titles have are split over tasks on both sides. No token can be left out: titles that share
    only a frequent one may be alike.
    """
    a = exploded(left, left_key).select(F.col("_k").alias("left_id"), F.col("_c").alias("left_title"), F.col("_t").alias("left_tokens"), "token")
    b = exploded(right, right_key).select(F.col("_k").alias("right_id"), F.col("_c").alias("right_title"), F.col("_t").alias("right_tokens"), "token")
    return grid_join(a, b, "token")


def scored_pairs(pairs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(left_id, right_id, similarity) of distinct pairs whose similarity is at least ``threshold``.

    A pair counts at the least of the tokens it shares, so candidates aren't shuffled to find repeated pairs. Lengths too
    different for the threshold are left out before the edit distance, whose bound stops it early; the comparison itself stays
    in doubles.
    """
    slack = 1 - threshold
    la, lb = F.length("left_title"), F.length("right_title")
    near = pairs.where(F.abs(la - lb) <= F.lit(slack) * F.greatest(la, lb) + 1e-9).where(F.col("token") == F.array_min(F.array_intersect("left_tokens", "right_tokens")))
    bound = F.floor(F.lit(slack) * F.greatest(la, lb) + 1e-9).cast("int")
    scored = near.withColumn("_d", F.call_function("levenshtein", F.col("left_title"), F.col("right_title"), bound)).where("_d >= 0")
    return scored.withColumn("similarity", similarity(F.col("_d"), F.col("left_title"), F.col("right_title"))).where(F.col("similarity") >= threshold).select("left_id", "right_id", "similarity")


def similar_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float = SIMILARITY, best: bool = False) -> DataFrame:
    """(left_id, right_id, similarity) of pairs that share a token and whose similarity is at least ``threshold``: what ``scored_pairs`` gives of ``candidate_pairs``.

    Candidates grow with the product of both sides, so they are never rows: the titles of a token meet in cells of a grid, where edit distances are
    worked out in arrays. With ``best`` each left title's most similar right ones are among what is given, of the others only some; a pair may come several times.
    """
    sides = []
    for df, key in ((left, left_key), (right, right_key)):
        rows = cut(df.where(F.size("filtered_tokens") > 0).select(F.col(key).alias("_k"), "cleaned_title", "filtered_tokens"))
        lesser = F.array().cast("array<string>") if best else F.filter("_t", lambda t: t < F.col("token"))
        sides.append(exploded(rows, "_k").select("token", F.col("_c").alias("title"), lesser.alias("lesser"), "_k"))
    counts = [df.groupBy("token").agg(F.count(F.lit(1)).cast("double").alias(c)) for df, c in zip(sides, "lr")]
    n = counts[0].join(counts[1], "token").agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0.0
    cores = left.sparkSession.sparkContext.defaultParallelism
    parts = max(1, int(n // AT_ONCE), min(3 * cores, int(n // (AT_ONCE / 20))))
    kinds = [df.schema["_k"].dataType for df in sides]
    a, b = grid(*sides, "token")
    names = ["token", "_lc", "_rc", "side", "title", "lesser", "left_id", "right_id"]
    a = a.select("*", F.lit(1).alias("side"), F.col("_k").alias("left_id"), F.lit(None).cast(kinds[1]).alias("right_id"))
    b = b.select("*", F.lit(0).alias("side"), F.lit(None).cast(kinds[0]).alias("left_id"), F.col("_k").alias("right_id"))
    rows = a.select(*names).unionByName(b.select(*names)).repartition(parts, "token", "_lc", "_rc").sortWithinPartitions(*names[:5])
    return rows.mapInArrow(similar(threshold, best), StructType([StructField("left_id", kinds[0]), StructField("right_id", kinds[1]), StructField("similarity", DoubleType())]))


def best_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float = SIMILARITY) -> DataFrame:
    """(left_id, right_id, similarity): the best right side of each left one that has any, as ``best_pairs``. Equal titles are compared once."""
    titles = left.groupBy("cleaned_title").agg(F.any_value("filtered_tokens").alias("filtered_tokens"))
    rights = right.groupBy("cleaned_title").agg(F.min(right_key).alias(right_key), F.any_value("filtered_tokens").alias("filtered_tokens"))
    best = best_pairs(similar_pairs(titles, rights, "cleaned_title", right_key, threshold, best=True)).withColumnRenamed("left_id", "cleaned_title")
    return best_pairs(left.select(F.col(left_key).alias("left_id"), "cleaned_title").join(best, "cleaned_title").select("left_id", "right_id", "similarity"))


def best_pairs(scored: DataFrame) -> DataFrame:
    """The best right side of each left one, ties to the lower id: an aggregate, combined map-side."""
    best = scored.groupBy("left_id").agg(F.min_by("right_id", F.struct(-F.col("similarity"), "right_id")).alias("right_id"), F.max("similarity").alias("similarity"))
    return best.select("left_id", "right_id", "similarity")


def link(recipes: DataFrame, pages: DataFrame, threshold: float = SIMILARITY, order: str = "reference", base: str = "https://en.wikipedia.org/wiki/", keep_all: bool = True) -> DataFrame:
    """Recipes with the page of the most similar title: ``recipe_url, recipe_title``, all other columns, then the page's.

    ``pages`` is (wiki_offset, page_id, wiki_title). One row per url; with ``keep_all`` unmatched ones stay with null page
    columns. Ranking runs on keys and similarities only; payload columns are joined once, at the end.
    """
    recipes = latest(recipes.where("url IS NOT NULL AND title IS NOT NULL"), "url", [c for c in ("crawled_at", "loaded_at") if c in recipes.columns])
    titles = pages.where("page_id IS NOT NULL AND wiki_title IS NOT NULL").groupBy("page_id").agg(F.min("wiki_title").alias("wiki_title"), F.min("wiki_offset").alias("wiki_offset"))
    left = prepare_titles(recipes.select("url", "title"), "title", order)
    right = prepare_titles(titles.select("page_id", "wiki_title"), "wiki_title", order)
    best = best_matches(left, right, "url", "page_id", threshold)
    found = best.join(titles, F.col("right_id") == F.col("page_id")).select(F.col("left_id").alias("url"), "page_id", "wiki_title", wiki_url("wiki_title", base).alias("wiki_url"), "wiki_offset", "similarity")
    out = recipes.join(found, "url", "left" if keep_all else "inner")
    rest = [c for c in recipes.columns if c not in ("url", "title")]
    return out.select(F.col("url").alias("recipe_url"), F.col("title").alias("recipe_title"), *rest, "page_id", "wiki_title", "wiki_url", "wiki_offset", "similarity", F.lit(None).cast("string").alias("wiki_description"))


def descriptions(offsets: DataFrame, dump: str, block_first_page: bool = False) -> DataFrame:
    """(wiki_offset, page_id, wiki_description) of the blocks at ``offsets``; with ``block_first_page`` each block's first page stands for all."""
    blocks = read_offsets(offsets, dump)
    if block_first_page:
        return first_pages(blocks).select("wiki_offset", F.lit(None).cast("bigint").alias("page_id"), wiki_section("xml").alias("wiki_description"))
    return block_pages(blocks).select("wiki_offset", "page_id", wiki_section("xml").alias("wiki_description"))


def enrich(links: DataFrame, dump: str | None, block_first_page: bool = False) -> DataFrame:
    """``links`` with ``wiki_description`` from the dump; without a dump they come back as they are."""
    if dump is None:
        return links
    found = descriptions(links.select("wiki_offset").where("wiki_offset IS NOT NULL"), dump, block_first_page).where("wiki_description IS NOT NULL")
    keys = ["wiki_offset"] if block_first_page else ["wiki_offset", "page_id"]
    found = found.groupBy(*keys).agg(F.min("wiki_description").alias("wiki_description"))
    return links.drop("wiki_description").join(found, keys, "left").select(*[c for c in links.columns if c != "wiki_description"], "wiki_description")


def abstracts(links: DataFrame, dump: str, limit: int | None = None, least: int = MIN_ABSTRACT) -> DataFrame:
    """``links`` with the abstracts of their pages as ``wiki_description``; with ``limit`` the first so many by url only.

    An abstract is the first line of an article's text, null where it begins with an infobox or is shorter than ``least``. Links
    without page stay with what description they have.
    """
    if limit is not None:
        links = links.orderBy("recipe_url").limit(limit)
    pages = block_pages(read_offsets(links.select("wiki_offset").where("wiki_offset IS NOT NULL"), dump))
    found = pages.select("wiki_offset", "page_id", wiki_abstract("xml", least).alias("_a")).groupBy("wiki_offset", "page_id").agg(F.min("_a").alias("_a"))
    out = links.join(found, ["wiki_offset", "page_id"], "left")
    return out.select(*[F.when(F.col("wiki_offset").isNotNull(), F.col("_a")).otherwise(F.col(c)).alias(c) if c == "wiki_description" else F.col(c) for c in links.columns])


def match_rate(links: DataFrame) -> DataFrame:
    """One row: links in all, with a page, with a description, pages used, and the share described in per cent (null for none)."""
    n = F.count(F.lit(1))
    described = F.count_if(F.col("wiki_description").isNotNull())
    return links.agg(n.alias("total"), F.count("page_id").alias("matched"), described.alias("described"), F.count_distinct("page_id").alias("pages"), F.try_divide(described * 100.0, n).alias("described_pct"))
