"""Keeping records and postings up to date as pages arrive: a folder as a stream, merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.extract import extract
from quern.operators.index import document_key, recipe_text, term_counts

PAGES = "url string, html_file string, html string, fetched_at timestamp_ntz"


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Pages (url, html_file, html, fetched_at) from a folder of Parquet files that grows."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_index(pages: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Records and postings of a page stream under ``out``, a folder per batch; a batch that runs again replaces its own folder.

    The tables are read by ``current``, which takes the last version of each page. Batches are independent, so nothing is merged
    while the stream runs, and the checkpoint gives each page to one batch.
    """

    def batch(df: DataFrame, n: int) -> None:
        last = df.where("url IS NOT NULL").groupBy("url").agg(F.max(F.struct("fetched_at", "html_file", "html")).alias("_p")).select("url", "_p.*")
        records = extract(last).join(last.select("url", "fetched_at"), "url").withColumn("doc_id", document_key("url"))
        records.write.mode("overwrite").parquet(f"{out}/records/batch={n}")
        kept = df.sparkSession.read.parquet(f"{out}/records/batch={n}")
        term_counts(kept, "doc_id", recipe_text(kept)).join(kept.select("doc_id", "fetched_at"), "doc_id").write.mode("overwrite").parquet(f"{out}/postings/batch={n}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(records, postings) with the latest batch of each page; postings of earlier versions fall out by their batch."""
    records = spark.read.option("basePath", f"{out}/records").parquet(f"{out}/records")
    newest = records.groupBy("doc_id").agg(F.max(F.struct("fetched_at", "batch")).alias("_v")).select("doc_id", F.col("_v.batch").alias("batch"))
    postings = spark.read.option("basePath", f"{out}/postings").parquet(f"{out}/postings")
    return records.join(newest, ["doc_id", "batch"]), postings.join(newest, ["doc_id", "batch"]).select("term", "doc_id", "tf")


def windowed_fetches(pages: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Pages fetched per host and window of time; windows close once ``late`` has passed."""
    rows = pages.withColumn("ts", F.col("fetched_at").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size).alias("w"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("pages")).select("w.start", "w.end", "host", "pages")
