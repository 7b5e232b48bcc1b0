"""Encyclopedia dumps: the index of a multistream dump, and a data source that reads its blocks by offset."""

from __future__ import annotations

import bz2
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.functions.text import col
from quern.sources.pages import need

CHUNK = 1 << 20


def index_fields(line: Column | str) -> list[Column]:
    parts = F.split(F.trim(col(line)), ":", 3)
    return [F.get(parts, F.lit(0)).try_cast("bigint").alias("wiki_offset"), F.get(parts, F.lit(1)).try_cast("bigint").alias("page_id"), F.get(parts, F.lit(2)).alias("wiki_title")]


def parse_index(lines: DataFrame, value: str = "value") -> DataFrame:
    """(wiki_offset, page_id, wiki_title) of lines ``offset:id:title``; titles may hold colons, broken lines are left out."""
    rows = lines.select(*index_fields(value))
    return rows.where("wiki_offset IS NOT NULL AND page_id IS NOT NULL AND wiki_title IS NOT NULL")


def read_dump_index(spark: SparkSession, path: str) -> DataFrame:
    """A dump's index, plain or compressed (Spark decompresses by the name's ending)."""
    return parse_index(spark.read.text(need(spark, path)))


class Blocks(InputPartition):
    def __init__(self, spans: list[tuple[int, int | None]]):
        self.spans = spans


class MultistreamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        offsets = sorted({int(x) for x in options.get("offsets", "0").split(",") if x.strip()})
        end = options.get("end")
        self.spans = list(zip(offsets, [*offsets[1:], int(end) if end else None]))
        self.per = int(options.get("blocksperpartition", "64"))

    def partitions(self) -> list[Blocks]:
        return [Blocks(self.spans[k : k + self.per]) for k in range(0, len(self.spans), self.per)]

    def read(self, partition: Blocks) -> Iterator[tuple[int, str | None, str | None]]:
        with opened(self.path) as f:
            for start, end in partition.spans:
                yield start, *try_block(f, start, end)


def opened(path: str):
    """A file that can be read from any place: of a file system by its address (``hdfs://``, ``s3://``, ``gs://``, ``file://``), or a local path."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        return system.open_input_file(inner)
    return open(path, "rb")


def try_block(f, start: int, end: int | None) -> tuple[str | None, str | None]:
    """(block, error): one of them is null."""
    try:
        return read_block(f, start, end), None
    except (OSError, EOFError, ValueError) as e:
        return None, f"{type(e).__name__}: {e}"


def read_block(f, start: int, end: int | None) -> str:
    """The text of the stream that begins at ``start``: to its own end, however its tags fall into chunks."""
    f.seek(start)
    d, out = bz2.BZ2Decompressor(), []
    left = None if end is None else end - start
    while not d.eof:
        chunk = f.read(CHUNK if left is None else min(CHUNK, left))
        if not chunk:
            break
        if left is not None:
            left -= len(chunk)
        out.append(d.decompress(chunk))
    return b"".join(out).decode("utf-8", errors="replace")


class Multistream(DataSource):
    """``spark.read.format("multistream")``: options path, offsets (comma-separated, ascending), end, blocksPerPartition.

    For offsets that fit an option; those of a whole dump are a frame, see ``read_offsets``. A block that can't be read has an ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "multistream"

    def schema(self) -> StructType:
        return StructType([StructField("wiki_offset", LongType()), StructField("block", StringType()), StructField("error", StringType())])

    def reader(self, schema: StructType) -> MultistreamReader:
        return MultistreamReader(dict(self.options))


def read_offsets(offsets: DataFrame, path: str) -> DataFrame:
    """(wiki_offset, block, error) of a dump for a frame of ``wiki_offset``: sorted ranges of offsets are read by one task each.

    The offsets never come to the driver; each task opens the dump once, on storage that all executors see, and reads its blocks in
    order of place. A block that can't be read is null and has its error.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(path) as f:
            for b in batches:
                out = [(int(o), *try_block(f, int(o), None)) for o in b["wiki_offset"]]
                yield pd.DataFrame(out, columns=["wiki_offset", "block", "error"]).astype({"wiki_offset": "int64"})

    spread = offsets.where("wiki_offset IS NOT NULL").select(F.col("wiki_offset").cast("long").alias("wiki_offset")).distinct()
    return spread.repartitionByRange("wiki_offset").sortWithinPartitions("wiki_offset").mapInPandas(run, "wiki_offset long, block string, error string")


def block_pages(blocks: DataFrame) -> DataFrame:
    """(wiki_offset, page_id, wiki_title, xml) of the pages in decompressed blocks."""
    pages = F.regexp_extract_all(F.col("block"), F.lit(r"(?s)<page>.*?</page>"), F.lit(0))
    rows = blocks.select("wiki_offset", F.explode(pages).alias("xml"))
    return rows.select("wiki_offset", F.regexp_extract("xml", r"<id>(\d+)</id>", 1).try_cast("bigint").alias("page_id"), F.regexp_extract("xml", r"<title>([^<]*)</title>", 1).alias("wiki_title"), "xml")


def first_pages(blocks: DataFrame) -> DataFrame:
    """(wiki_offset, xml): the block up to the end of its first page, whichever page was asked for."""
    return blocks.select("wiki_offset", F.regexp_extract("block", r"(?s)^(.*?</page>)", 1).alias("xml")).where("xml <> ''")
