"""Session building and cutting of lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "quern", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use ``__`` for the dot."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


class NoSharedFolder(RuntimeError):
    """A cluster's session names no folder that all executors see."""


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local master gets a folder of its own, removed at exit; on a cluster that is an error, since each
    executor would write to its own disk.
    """
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if given:
        return given
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


#: Tables that were cut and are still there.
CUT: list[str] = []


def stored(df: DataFrame) -> str:
    """Write ``df`` as a table in the shared folder; its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    CUT.append(path)
    df.write.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there, and it survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


def release(spark: SparkSession) -> None:
    """Delete the tables that were cut so far; to be called once nothing that was built on them is read any more."""
    conf = spark._jsc.hadoopConfiguration()
    while CUT:
        p = spark._jvm.org.apache.hadoop.fs.Path(CUT.pop())
        p.getFileSystem(conf).delete(p, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over as many tasks as the session has cores, by a hash of ``key``, where its input has fewer parts than that.

    For costly steps on few files. Inputs of a cluster's size have more parts than cores and are left as they are, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
