"""The folder that driver and executors share, and small tables held in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and all run on one machine, a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quernel-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: How tables are written: texts and postings take about half the disk that the default codec leaves them.
WRITTEN = {"compression": "zstd"}
#: Rows of a table of questions, or of their terms, that are passed on as literal rows at most.
FEW = 10_000


def literal(df: DataFrame) -> DataFrame:
    """The rows of df, of which there must be few, as literal rows: whatever is made of them later needs no job for them."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def stated(df: DataFrame, most: int | None = None) -> tuple[DataFrame, list | None]:
    """A table of questions as literal rows, and these, if they are `most` (FEW) at most, so that no plan computes them again; else the table itself, and None."""
    most = FEW if most is None else most
    found = (df if df.isLocal() else df.limit(most + 1)).toArrow()
    if found.num_rows > most:
        return df, None
    told = df.sparkSession.createDataFrame(found, df.schema)
    return told, told.collect()


def held(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """The rows of df, written and read again: whatever is made of them later doesn't make them again. most: a bound of their number, if one is known; few rows become literal ones."""
    if most is not None and most <= FEW:
        return literal(df)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**WRITTEN).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def holding(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """held(), up to the end of the block: what is kept of the rows must have been written by then."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.options(**WRITTEN).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder, system = _place(spark, path)
        system.delete(folder, True)


def _place(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, system = _place(spark, path)
    return system.exists(folder)


def file_state(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of change of the files at a path; nothing, if there are none."""
    folder, system = _place(spark, path)
    if not system.exists(folder):
        return ()
    found, files = [], system.listFiles(folder, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))
