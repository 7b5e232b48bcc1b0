"""Recipe records from saved pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import markdown as md

RECORD = ("url", "html_file", "title", "description", "ingredients", "method", "chef", "difficulty", "prep_time", "servings")


def records_from_markdown(df: DataFrame, text: str = "markdown", alt: str = md.ALT, credit: str = md.CREDIT) -> DataFrame:
    """``RECORD`` columns of a frame (url, html_file?, markdown); pages that are the list of recipes are left out."""
    c = F.col(text)
    fields = {
        "title": md.md_title(c), "description": md.md_description(c, alt), "ingredients": md.md_ingredients(c), "method": md.md_method(c, credit),
        "chef": md.md_author(c), "difficulty": md.md_difficulty(c, alt), "prep_time": md.md_prep_time(c, alt), "servings": md.md_servings(c, alt),
    }
    file = F.col("html_file") if "html_file" in df.columns else F.lit(None).cast("string")
    rows = df.where(c.isNotNull()).select("url", file.alias("html_file"), *[v.alias(k) for k, v in fields.items()])
    return rows.where(F.trim("title") != "Recipes").select(*RECORD)


def extract(pages: DataFrame, alt: str = md.ALT, credit: str = md.CREDIT) -> DataFrame:
    """Records of pages (url, html_file?, html). One Arrow step turns HTML to Markdown, the fields are expressions."""
    keep = [c for c in ("url", "html_file") if c in pages.columns]
    return records_from_markdown(pages.select(*keep, md.html_to_markdown("html").alias("markdown")), alt=alt, credit=credit)


def extraction_counts(pages: DataFrame, records: DataFrame) -> DataFrame:
    """One row: pages, records, skipped list pages and failed ones, each counted apart."""
    titles = pages.select(md.md_title(md.html_to_markdown("html")).alias("t"), "html")
    a = titles.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.trim("t") == "Recipes").alias("skipped"), F.count_if(F.col("html").isNull()).alias("failed")).withColumn("_one", F.lit(1))
    b = records.agg(F.count(F.lit(1)).alias("records")).withColumn("_one", F.lit(1))
    return a.join(b, "_one").select("pages", "records", "skipped", "failed")
