"""Pages and records from files: saved HTML, JSON lines, robots and sitemaps, and a pluggable fetcher."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import MAX_RETRIES
from quern.functions.urls import file_to_url, is_sitemap_recipe, slashes

RECIPE = "url string, html_file string, title string, description string, ingredients array<string>, method string, chef string, difficulty string, prep_time string, servings string"


class MissingInput(FileNotFoundError):
    """An input that a stage needs isn't there."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def need(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise MissingInput(path)
    return path


def read_html_dir(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(url, html_file, html) of the ``*.html`` files of a folder; ``partitions`` spreads few large files, else Spark splits the list."""
    need(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    if partitions:
        files = files.repartition(partitions)
    name = F.element_at(F.split(slashes("path"), "/"), -1)
    return files.select(file_to_url(F.try_url_decode(name)).alias("url"), F.regexp_replace("path", "^file:/+", "/").alias("html_file"), F.decode("content", "UTF-8").alias("html"))


def read_jsonl(spark: SparkSession, path: str, schema: str = RECIPE) -> DataFrame:
    """JSON lines with a schema that is given, so no pass infers it; blank and broken lines are left out."""
    need(spark, path)
    row = _parsed(spark, path, schema)
    return row.where("_r._bad_line IS NULL").select("_r.*").drop("_bad_line")


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(value, _r): the lines that aren't blank, parsed; ``_r._bad_line`` is a line that doesn't parse."""
    parse = F.from_json("value", f"{schema}, _bad_line string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad_line"})
    return spark.read.text(path).where(F.trim("value") != "").select("value", parse.alias("_r"))


def broken_lines(spark: SparkSession, path: str, schema: str = RECIPE) -> DataFrame:
    """The lines that ``read_jsonl`` leaves out (``line``), without blank ones."""
    need(spark, path)
    return _parsed(spark, path, schema).where("_r._bad_line IS NOT NULL").select(F.col("value").alias("line"))


def infer_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an inferred schema; reads the input twice."""
    need(spark, path)
    return spark.read.json(path)


def robots_sitemap(lines: DataFrame) -> DataFrame:
    """(sitemap): the first sitemap that a robots.txt names; ``lines`` has (line_no, value)."""
    rows = lines.where(F.lower(F.trim("value")).startswith("sitemap:"))
    return rows.orderBy("line_no").limit(1).select(F.trim(F.get(F.split(F.trim("value"), ":", 2), F.lit(1))).alias("sitemap"))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc) of a sitemap's urls; of an index, see ``read_sitemap_index``."""
    need(spark, path)
    return _locs(spark, path, "url")


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    need(spark, path)
    return _locs(spark, path, "sitemap")


def _locs(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema("loc string").load(path).select(F.trim("loc").alias("loc")).where("loc IS NOT NULL")


def sitemap_recipes(spark: SparkSession, path: str, child: Callable[[str], str] = str) -> DataFrame:
    """(url): the distinct recipe pages of a sitemap, or of the sitemaps of an index that can be read.

    ``child`` maps an index's entries to paths. An index is one file, of 50,000 entries by its standard, so its entries come to the
    driver; those that are there are read in one load.
    """
    parts = [child(r[0]) for r in read_sitemap_index(spark, path).collect()]
    there = [p for p in parts if exists(spark, p)]
    for p in set(parts) - set(there):
        print(f"sitemap {p}: not there")
    found = _locs(spark, [need(spark, path), *there], "url")
    return found.where(is_sitemap_recipe("loc")).select(F.col("loc").alias("url")).distinct()


def fetch(urls: DataFrame, get: Callable[[str], str | None], retries: int = MAX_RETRIES, pause: float = 0.0, polite: float = 0.0) -> DataFrame:
    """(url, html, error) of a frame of urls, by a function that runs on the executors.

    A failing url is tried ``retries`` times in all with ``pause`` seconds between; ``polite`` seconds pass after each page. The
    last error is kept, the html is then null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u in b["url"]:
                page, error = None, None
                for attempt in range(max(1, retries)):
                    try:
                        page, error = get(u), None
                        break
                    except Exception as e:  # whatever the fetcher raises is the page's error
                        error = f"{type(e).__name__}: {e}"
                        if pause and attempt + 1 < retries:
                            time.sleep(pause)
                if polite:
                    time.sleep(polite)
                out.append((u, page, error))
            yield pd.DataFrame(out, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")
