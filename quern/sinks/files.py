"""Writing records, pages and indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.urls import page_file
from quern.sources.pages import RECIPE, exists


def recipe_record(df: DataFrame) -> DataFrame:
    """The columns of a recipe record in their order, nulls and missing columns as empty strings and arrays."""
    names = [c.split()[0] for c in RECIPE.split(", ")]

    def one(c: str) -> Column:
        empty = F.array().cast("array<string>") if c == "ingredients" else F.lit("")
        return F.coalesce(F.col(c), empty).alias(c) if c in df.columns else empty.alias(c)

    order = ["url", "html_file", "title", "description", "method", "ingredients", "prep_time", "servings", "difficulty", "chef"]
    assert sorted(order) == sorted(names)
    return df.select(*[one(c) for c in order])


def _moved(spark: SparkSession, a: str, b: str) -> None:
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    source, target = path(a), path(b)
    fs = source.getFileSystem(conf)
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{a} can't be renamed to {b}")


def replace_table(df: DataFrame, path: str) -> None:
    """Put ``df`` in the place of the table at ``path``, which it may have been read from.

    It is written whole beside it (``.next``); then the old table steps aside (``.last``), the new one takes its name, and the old one goes. After
    a crash at any point ``recovered`` gives a whole table, the old or the new.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    recovered(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.next")
    if exists(spark, path):
        _moved(spark, path, f"{path}.last")
    _moved(spark, f"{path}.next", path)
    last = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.last")
    last.getFileSystem(spark._jsc.hadoopConfiguration()).delete(last, True)


def recovered(spark: SparkSession, path: str) -> str:
    """``path``, with its last table back in place where a crash left none."""
    path = path.rstrip("/")
    if not exists(spark, path) and exists(spark, f"{path}.last"):
        _moved(spark, f"{path}.last", path)
    return path


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of JSON lines, in parallel; null fields are left out of a line."""
    df.write.mode(mode).json(path)


def write_single_jsonl(df: DataFrame, path: str) -> None:
    """One file of JSON lines, for export: written in parallel beside it, then joined in order of the parts' names."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    parts = jvm.org.apache.hadoop.fs.Path(f"{path}.parts-{uuid.uuid4().hex}")
    try:
        df.write.json(parts.toString())
        out = fs.create(target, True)
        try:
            for p in sorted(s.getPath().toString() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")):
                source = fs.open(jvm.org.apache.hadoop.fs.Path(p))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
        finally:
            out.close()
    finally:
        fs.delete(parts, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, on any storage of the session."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save_pages(pages: DataFrame, path: str) -> DataFrame:
    """Append pages (url, html) that the table at ``path`` doesn't have yet, one per url; gives the rows that were new."""
    spark = pages.sparkSession
    one = pages.where("url IS NOT NULL AND html IS NOT NULL").groupBy("url").agg(F.min("html").alias("html")).withColumn("html_file", page_file("url"))
    if exists(spark, path):
        one = one.join(spark.read.parquet(path).select("url"), "url", "left_anti")
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    one.write.parquet(staged)  # the table is read above, so what is new is fixed before it is appended
    new = spark.read.schema(one.schema).parquet(staged)
    new.write.mode("append").parquet(path)
    return new


def write_index(postings: DataFrame, docs: DataFrame, stats: DataFrame, path: str) -> None:
    """An index as three tables: postings sorted by term, so a query's terms prune files; documents; statistics."""
    postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def write_fields(postings: DataFrame, stats: DataFrame, docs: DataFrame, path: str) -> None:
    """A full-text index as three tables: postings sorted by field and term, so a query's terms prune files and row groups; statistics; documents."""
    postings.repartitionByRange("field", "term").sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    docs.write.mode("overwrite").parquet(f"{path}/docs")


def export_index(maps: DataFrame, docs: DataFrame, stats: DataFrame, path: str) -> None:
    """The index as three files of JSON lines for other programs: ``index.jsonl`` (term, document_frequency, postings as a map), ``mapping.jsonl``, ``stats.jsonl``."""
    for df, name in ((maps, "index"), (docs, "mapping"), (stats, "stats")):
        write_single_jsonl(df, f"{path.rstrip('/')}/{name}.jsonl")


def result_lines(rank: Column, title: Column, score: Column, url: Column, details: dict[str, Column], digits: int = 4) -> Column:
    """A result as text: number and title, score, address, and the details that aren't empty, parted by bars."""
    shown = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in details.items()]
    tail = F.concat_ws(" | ", *shown) if shown else F.lit("")
    head = F.concat_ws("\n", F.concat(rank.cast("string"), F.lit(". "), title), F.concat(F.lit("   Score: "), F.format_string(f"%.{digits}f", score)), F.concat(F.lit("   URL: "), url))
    return F.when(tail != "", F.concat(head, F.lit("\n   "), tail)).otherwise(head)
