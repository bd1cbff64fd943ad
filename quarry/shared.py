"""The folder that all executors share, and frames written to it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, if that is unset and Spark runs in one process, a temporary folder that goes when the process ends."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir names no shared folder")
    folder = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    found = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: What this process has written, and how often that was cleared.
_WRITTEN: list[str] = []
_CLEARED: list[None] = []


def clear(spark: SparkSession) -> None:
    """Deletes all that was written so far. Frames that were returned read it lazily, so only a caller who is done with them all can say when."""
    _CLEARED.append(None)
    while _WRITTEN:
        at, files = _file(spark, _WRITTEN.pop())
        files.delete(at, True)


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor loses none of it, and no plan before it runs, or is analysed, twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of up to so many bytes are dealt to all cores if their files are fewer.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than cores in as many parts as there are cores. A file's row group is one task's work, and small files have one. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    """A path and its file system, as Spark's readers and writers see it, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, files = _file(spark, path)
    return files.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file."""
    at, files = _file(spark, path)
    out = files.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, whoever wrote it; None if it isn't there."""
    if not path_exists(spark, path):
        return None
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = jvm.org.apache.hadoop.fs.FileSystem.newInstance(at.toUri(), spark._jsc.hadoopConfiguration())
    files.setVerifyChecksum(False)  # a file that was edited has another one
    stream = files.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
        files.close()


def cleared() -> int:
    return len(_CLEARED)
