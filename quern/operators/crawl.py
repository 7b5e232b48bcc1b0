"""Following links: extraction and filtering of links, breadth-first crawling, reconciliation with a sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import file_to_url, hrefs, is_recipe_url, is_search_url, part, resolve, skipped_suffix
from quern.session import cut, stored
from quern.sinks.files import recovered, replace_table, save_pages
from quern.sources.pages import exists

STATE = "url string, depth int, visited boolean, downloaded boolean"


def page_links(pages: DataFrame) -> DataFrame:
    """(url, link): the distinct link targets of each page, as they stand."""
    return pages.select("url", F.explode(hrefs("html")).alias("link")).distinct()


def wanted(link: Column, base: Column, no_search: bool = True) -> Column:
    """Same authority as the page, no skipped suffix, no search."""
    ok = (part(link, "AUTHORITY") == part(base, "AUTHORITY")) & ~skipped_suffix(link)
    return ok & ~is_search_url(link) if no_search else ok


def page_edges(pages: DataFrame, no_search: bool = True) -> DataFrame:
    """(src_url, dst_url): links of the pages that are wanted, resolved, each once."""
    links = page_links(pages).select(F.col("url").alias("src_url"), resolve("url", "link").alias("dst_url"))
    return links.where(F.col("dst_url").isNotNull() & wanted(F.col("dst_url"), F.col("src_url"), no_search)).distinct()


def crawl(pages, seeds: DataFrame, max_depth: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """(url, depth, visited, downloaded): pages reached from the ``seeds`` (url), level by level, each url once at its least depth.

    ``pages`` is a frame (url, html) that stands for the web, or a function from a frame of urls to such a frame, like a
    fetcher. ``visited`` are pages whose links were followed, those at ``max_depth`` aren't; ``downloaded`` recipe pages that
    were got. A saved ``state`` is taken up: its unvisited urls are the frontier. Each level is written out, so lineage stays
    short and a lost executor costs a level at most; levels are added beside each other, none is written twice, and per level there is
    one anti-join with all seen urls. A state without depths is an error.
    """
    get = pages if callable(pages) else lambda urls: pages.join(urls.select("url"), "url", "left_semi")
    columns = "url", "depth", "visited", "downloaded"
    levels: list[str] = []
    if state is not None:
        if missing := set(columns) - set(state.columns):
            raise ValueError(f"a crawl's state needs {', '.join(sorted(missing))}")
        done = state.where("visited").select(*columns)
        spark, levels = state.sparkSession, [stored(done)]
        frontier = cut(state.where("NOT visited").select("url", "depth").unionByName(seeds.select("url", F.lit(0).alias("depth"))).groupBy("url").agg(F.min("depth").alias("depth")).join(done.select("url"), "url", "left_anti"))
    else:
        spark = seeds.sparkSession
        frontier = cut(seeds.select("url", F.lit(0).alias("depth")).where("url IS NOT NULL").distinct())
    while not frontier.isEmpty():
        if max_depth is not None:
            if frontier.where(F.col("depth") < max_depth).isEmpty():
                break
            later = frontier.where(F.col("depth") >= max_depth)
            frontier = frontier.where(F.col("depth") < max_depth)
        got = cut(get(frontier).select("url", "html").where("html IS NOT NULL"))
        level = frontier.join(got.select("url").distinct().withColumn("_got", F.lit(True)), "url", "left")
        level = level.select("url", "depth", F.lit(True).alias("visited"), (F.coalesce("_got", F.lit(False)) & is_recipe_url("url")).alias("downloaded"))
        levels.append(stored(level))
        done = spark.read.schema(STATE).parquet(*levels)
        edges = page_edges(got).join(frontier.withColumnRenamed("url", "src_url"), "src_url")
        found = edges.groupBy(F.col("dst_url").alias("url")).agg((F.min("depth") + 1).alias("depth"))
        if max_depth is not None:
            found = found.unionByName(later).groupBy("url").agg(F.min("depth").alias("depth"))
        frontier = cut(found.join(done.select("url"), "url", "left_anti"))
    rest = frontier.select("url", "depth", F.lit(False).alias("visited"), F.lit(False).alias("downloaded"))
    return rest if not levels else spark.read.schema(STATE).parquet(*levels).unionByName(rest)


def level_counts(state: DataFrame) -> DataFrame:
    """(depth, urls, recipes): pages reached per level, and recipe pages among them."""
    return state.groupBy("depth").agg(F.count(F.lit(1)).alias("urls"), F.count_if(is_recipe_url("url")).alias("recipes"))


def save_state(state: DataFrame, path: str) -> None:
    """Write the state of a crawl beside the old one, then take its place, so that a crash leaves one that can be read."""
    replace_table(state, path)


def load_state(spark, path: str) -> DataFrame | None:
    return spark.read.schema(STATE).parquet(path) if exists(spark, recovered(spark, path)) else None


def missing_urls(wanted_: DataFrame, have: DataFrame) -> DataFrame:
    """(url) in ``wanted_`` and not in ``have``, each once; sets, so null counts as a value."""
    return wanted_.select("url").subtract(have.select("url"))


def reconcile(sitemap: DataFrame, saved: DataFrame, name: str = "html_file") -> DataFrame:
    """(url, status): ``missing`` ones are in the sitemap and not saved, ``extra`` ones saved and not in the sitemap, else ``both``."""
    a = sitemap.select("url").distinct().withColumn("_a", F.lit(True))
    have = saved.select(file_to_url(name).alias("url")) if "url" not in saved.columns else saved.select("url")
    b = have.distinct().withColumn("_b", F.lit(True))
    both = a.join(b, "url", "full")
    return both.select("url", F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("both").alias("status"))


def apply_reconcile(spark, table: str, sitemap: DataFrame, fetched: DataFrame | None = None, drop_extra: bool = False) -> DataFrame:
    """The saved pages brought in line with the sitemap: missing ones that were ``fetched`` are appended; with ``drop_extra`` others go.

    Dropping puts a new table in the old one's place; it is off unless asked for.
    """
    if fetched is not None:
        save_pages(fetched.join(sitemap.select("url"), "url", "left_semi"), table)
    saved = spark.read.parquet(recovered(spark, table))
    if drop_extra:
        replace_table(saved.join(sitemap.select("url").distinct(), "url", "left_semi"), table)
        saved = spark.read.parquet(table)
    return reconcile(sitemap, saved)
