"""The stages chained: pages to records, records to index and links; a stage whose output is there is skipped."""

from __future__ import annotations

import argparse
import json
import urllib.request
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import session
from quern.config import FIELD_BOOSTS, FIELD_TOP_K, Config
from quern.functions.urls import is_recipe_url
from quern.operators.crawl import apply_reconcile, crawl, load_state, reconcile, save_state
from quern.operators.extract import extract
from quern.operators.fields import field_postings, field_stats, search_envelope, shown
from quern.operators.index import build_index, postings_maps
from quern.operators.link import abstracts, enrich, link, match_rate
from quern.operators.search import search
from quern.sinks.files import export_index, recipe_record, recovered, replace_table, result_lines, save_pages, write_fields, write_index, write_jsonl, write_single_jsonl, write_text
from quern.sources.dump import read_dump_index
from quern.sources.pages import RECIPE, MissingInput, exists, fetch, need, read_html_dir, read_jsonl, robots_sitemap, sitemap_recipes


@dataclass(frozen=True)
class Paths:
    html: str = "raw_html"
    recipes: str = "recipes"
    index: str = "index"
    links: str = "links"
    dump_index: str | None = None
    dump: str | None = None
    export: str | None = None
    fields: str = "fields"
    html_table: str = "pages"
    state: str = "crawl_state"
    seed: str = ""


def run_extract(spark: SparkSession, p: Paths) -> DataFrame:
    if not exists(spark, p.recipes):
        write_jsonl(recipe_record(extract(read_html_dir(spark, p.html))), p.recipes)
    return read_jsonl(spark, p.recipes, RECIPE)


def run_index(spark: SparkSession, p: Paths, config: Config = Config()) -> None:
    pages = read_html_dir(spark, p.html) if exists(spark, p.html) else None
    index = build_index(read_jsonl(spark, p.recipes), pages, config.tokenizer or None)
    write_index(*index, p.index)


def run_link(spark: SparkSession, p: Paths, config: Config = Config()) -> DataFrame:
    """Links are written without descriptions first, so they are there if the dump can't be read; then with them."""
    pages = read_dump_index(spark, need(spark, p.dump_index or "dump_index"))
    found = link(read_jsonl(spark, p.recipes), pages, config.similarity, config.title_order)
    replace_table(found, p.links)
    if p.dump:
        replace_table(enrich(spark.read.parquet(p.links), p.dump), p.links)
    out = spark.read.parquet(p.links)
    if p.export:
        write_single_jsonl(out.drop("similarity"), p.export)
    return out


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    need(spark, path)
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("postings", "docs", "stats"))


def run_search(spark: SparkSession, p: Paths, query: str, config: Config = Config(), method: str = "robertson") -> DataFrame:
    postings, docs, stats = load_index(spark, p.index)
    return search(postings, docs, stats.first()["total_documents"], query, config.top_k, method)


FIELDS = list(FIELD_BOOSTS)


def run_fields(spark: SparkSession, p: Paths) -> None:
    """The full-text index over the links, one document per recipe."""
    links = spark.read.parquet(recovered(spark, need(spark, p.links))).where("recipe_url IS NOT NULL").withColumn("doc_id", F.col("recipe_url"))
    rows = session.cut(field_postings(links, "doc_id", [f for f in FIELDS if f in links.columns]))
    stored = ["doc_id", "recipe_url", "recipe_title", "wiki_title", "description", "wiki_description", "ingredients", "chef", "difficulty", "prep_time", "servings", "wiki_url"]
    docs = links.select(*[c if c in links.columns else F.lit(None).cast("string").alias(c) for c in stored])
    write_fields(rows, field_stats(rows), docs, p.fields)


def run_field_search(spark: SparkSession, p: Paths, query: str, k: int = FIELD_TOP_K) -> dict:
    """The envelope of a full-text query on the index that ``run_fields`` wrote; long texts are shown as excerpts."""
    postings, stats, docs = (spark.read.parquet(f"{need(spark, p.fields)}/{t}") for t in ("postings", "stats", "docs"))
    short = docs.withColumns({c: shown(c) for c in ("description", "wiki_description")})
    return search_envelope(postings, short, query, k=k, stats=stats)


def run_export(spark: SparkSession, p: Paths) -> None:
    """The index as JSON lines in the folder ``export``."""
    postings, docs, stats = load_index(spark, p.index)
    export_index(postings_maps(postings), docs, stats, p.export or p.index)


def run_abstracts(spark: SparkSession, p: Paths, limit: int | None = None) -> DataFrame:
    """The links with abstracts from the dump, exported as JSON lines if ``export`` is given."""
    out = abstracts(spark.read.parquet(recovered(spark, need(spark, p.links))), need(spark, p.dump or "dump"), limit)
    if p.export:
        write_single_jsonl(out, p.export)
    return out


def fetch_url(url: str) -> str | None:
    """A page by HTTP, as text; errors are raised."""
    with urllib.request.urlopen(url, timeout=15) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", errors="replace")


def run_crawl(spark: SparkSession, p: Paths, get=fetch_url, max_depth: int | None = None, polite: float = 2.0) -> DataFrame:
    """Crawl from ``seed``, or on from the state that was saved; pages are added to the table ``html_table``, the state to ``state``."""
    state = load_state(spark, p.state)
    seeds = spark.createDataFrame([(p.seed,)] if p.seed else [], "url string")

    def pages(urls: DataFrame) -> DataFrame:
        got = spark.read.parquet(session.stored(fetch(urls, get, polite=polite)))
        save_pages(got.where(is_recipe_url("url")), p.html_table)
        return got

    done = crawl(pages, seeds, max_depth, state)
    save_state(done, p.state)
    return load_state(spark, p.state)


def run_sitemap(spark: SparkSession, p: Paths, get=fetch_url, drop_extra: bool = False, polite: float = 2.0) -> DataFrame:
    """The saved pages brought in line with the sitemap that the seed's robots.txt names: (url, status) as they were.

    robots.txt, then the sitemap or those of its index, then what is missing is fetched and, with ``drop_extra``, what isn't listed dropped.
    Each document is fetched by ``get`` and kept in the shared folder.
    """
    base, folder = p.seed.rstrip("/"), f"{session.shared_dir(spark).rstrip('/')}/sitemap-{uuid.uuid4().hex}"
    lines = spark.createDataFrame(list(enumerate((get(f"{base}/robots.txt") or "").splitlines())), "line_no int, value string")
    top = robots_sitemap(lines).first()
    if top is None:
        raise MissingInput(f"{base}/robots.txt names no sitemap")

    def keep(url: str) -> str:
        path = f"{folder}/{uuid.uuid4().hex}.xml"
        try:
            text = get(url) or ""
        except OSError as e:  # an entry that can't be got is left out
            print(f"sitemap {url}: {e}")
            return path
        write_text(spark, path, text)
        return path

    listed = session.cut(sitemap_recipes(spark, keep(top[0]), keep))
    have = spark.read.parquet(recovered(spark, p.html_table)) if exists(spark, p.html_table) else spark.createDataFrame([], "url string, html string")
    before = session.cut(reconcile(listed, have))
    got = fetch(before.where("status = 'missing'").select("url"), get, polite=polite)
    apply_reconcile(spark, p.html_table, listed, got, drop_extra)
    return before


METHODS = {"1": "robertson", "2": "classic"}


def run_repl(spark: SparkSession, p: Paths, config: Config = Config(), ask=input, say=print) -> None:
    """Queries asked for until an empty one or ``quit``; ``change`` asks for the idf again (1 Robertson, 2 classic, others Robertson)."""
    postings, docs, stats = load_index(spark, p.index)
    total = stats.first()["total_documents"]
    choose = lambda: METHODS.get(ask("IDF: 1 Robertson, 2 classic: ").strip(), "robertson")
    method = choose()
    while (query := ask("Search query: ").strip()) and query.lower() != "quit":
        if query.lower() == "change":
            method = choose()
            continue
        details = {"Chef": F.col("chef"), "Difficulty": F.col("difficulty"), "Prep Time": F.col("prep_time"), "Servings": F.col("servings")}
        hits = search(postings, docs, total, query, config.top_k, method)
        lines = hits.select("rank", result_lines(F.col("rank"), F.col("title"), F.col("score"), F.col("url"), details).alias("text")).orderBy("rank").collect()  # top_k rows
        say("\n\n".join(r["text"] for r in lines) or "No results.")


def run_all(spark: SparkSession, p: Paths, config: Config = Config()) -> DataFrame:
    run_extract(spark, p)
    run_index(spark, p, config)
    return run_link(spark, p, config)


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="quern")
    a.add_argument("stage", choices=("crawl", "extract", "index", "link", "abstracts", "fields", "export", "search", "all"))
    for f in Paths.__dataclass_fields__.values():
        a.add_argument(f"--{f.name.replace('_', '-')}", default=f.default)
    a.add_argument("--query", default="", help="without one, search asks for queries")
    a.add_argument("--idf", default="robertson", choices=("classic", "robertson"))
    a.add_argument("--full-text", action="store_true", help="search: the query language over all fields")
    a.add_argument("--xml", action="store_true", help="crawl: bring the saved pages in line with the sitemap")
    a.add_argument("--drop-extra", action="store_true", help="crawl --xml: drop saved pages that the sitemap doesn't list")
    a.add_argument("--limit", type=int, help="abstracts: only the first so many links")
    a.add_argument("--max-depth", type=int, help="crawl: levels of links to follow")
    x = vars(a.parse_args(argv))
    stage, query, method, full, xml, drop, limit, depth = (x.pop(k) for k in ("stage", "query", "idf", "full_text", "xml", "drop_extra", "limit", "max_depth"))
    spark, p = session.build(), Paths(**x)
    try:
        if stage == "search" and full:
            print(json.dumps(run_field_search(spark, p, query), ensure_ascii=False, indent=1))
        elif stage == "search" and query:
            run_search(spark, p, query, method=method).show(truncate=False)
        elif stage == "search":
            run_repl(spark, p)
        elif stage == "link":
            match_rate(run_link(spark, p)).show()
        elif stage == "abstracts":
            run_abstracts(spark, p, limit).select("recipe_url", "wiki_title", "wiki_description").show(5)
        elif stage == "all":
            match_rate(run_all(spark, p)).show()
        elif stage == "crawl":
            (run_sitemap(spark, p, drop_extra=drop).groupBy("status") if xml else run_crawl(spark, p, max_depth=depth).groupBy("depth")).count().show()
        else:
            {"extract": run_extract, "index": run_index, "fields": run_fields, "export": run_export}[stage](spark, p)
    finally:
        session.release(spark)


if __name__ == "__main__":
    main()
