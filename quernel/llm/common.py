"""What the operators of this subpackage share: written intermediate tables, word patterns, reading of tables."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


#: Bytes in an Arrow batch for Python functions, and the setting that bounds it with its default.
BATCH_BYTES = 8 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df. Texts can be long, so batches of its session hold BATCH_BYTES from now on, unless someone has chosen another bound."""
    conf = df.sparkSession.conf
    if str(conf.get(BATCH_SETTING, str(BATCH_DEFAULT))).lower() in (str(BATCH_DEFAULT), f"{BATCH_DEFAULT}b", "64m", "64mb"):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def trimmed(batches: Iterable) -> Iterator:
    """The batches; after each, memory that its handling has freed goes back to the system, as Python workers live on between tasks."""
    library = ctypes.CDLL(None)
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if hasattr(library, "malloc_trim"):
            library.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all run on one machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quernel-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders of the tables that each open scratch() is to delete.
_SCRATCH: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here, and a lost executor costs nothing before it.

    Within scratch() the table is deleted at the end, unless it is to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables written within; what is kept of them must have been written too."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for folder in _SCRATCH.pop():
            delete_folder(spark, folder)


#: Bytes of a table of numbers that is broadcast at most, and of bitmaps that tell decisions on rows.
BROADCAST_BYTES, MARK_BYTES = 16 << 20, 64 << 20


def small(side: DataFrame) -> DataFrame:
    """A written table of numbers as the side of a join that is broadcast up to a number of bytes; beyond it the join shuffles."""
    return F.broadcast(side) if 8 * len(side.columns) * side.count() <= BROADCAST_BYTES else side


#: Keys at most that join_skewed() broadcasts.
HUBS = 1 << 17


def join_skewed(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with side, which has one row for each key, and in n how many of the rows have that key; total: sum of n, about.

    Keys of more than 64 rows and more than a HUBS-th of all, of which there are at most HUBS, are broadcast; only the other rows are shuffled.
    """
    many = F.col("n") > max(64, total // HUBS)
    hubs = F.broadcast(side.where(many).drop("n"))
    return rows.join(hubs, key).unionByName(rows.join(hubs, key, "left_anti").join(side.where(~many).drop("n"), key))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str = "running") -> DataFrame:
    """rows with the number of rows and the sums of whole numbers (by name) over all rows before, in `order`: by range partitions, so no task holds all rows.

    What is written keeps its partition and place there, so that equal rows of `order` are counted once.
    """
    told = {"number": F.lit(1).cast("long"), **sums}
    rows = rows.withColumns({f"_{k}": v for k, v in told.items()})
    ordered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), name)
    # A row for each partition.
    parts = ordered.groupBy("_part").agg(*(F.sum(f"_{k}").alias(f"_all_{k}") for k in told))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.select("_part", *(F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_all_{k}") for k in told)), "parts")
    within = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    before = {k: (F.col(f"_all_{k}") + F.coalesce(F.sum(f"_{k}").over(within), F.lit(0))).cast("long") for k in told}
    return ordered.join(F.broadcast(parts), "_part").withColumns(before).drop("_part", "_place", *(f"_{k}" for k in told), *(f"_all_{k}" for k in told))


def _is_read_of_files(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def placed(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns, so that no name can clash), file, at: each row with its place in storage. What isn't a plain read of files is written first."""
    if _is_read_of_files(docs):
        try:
            place = docs.metadataColumn("_metadata")
            return docs.select(F.struct("*").alias("row"), place["file_path"].alias("file"), place["row_index"].alias("at"))
        except AnalysisException:  # files of a format without row numbers
            pass
    return placed(written(docs, "rows"))


#: Places in a bitmap.
MAP_BITS = 1 << 15


def marked(rows: DataFrame, marks: DataFrame, most: int = 1) -> DataFrame:
    """rows (of placed()) with mark, which marks (file, at, mark: 0 to `most`) has for their places, 0 for others. Rows are not shuffled.

    Marks become bitmaps, of MAP_BITS places of a file each. These are broadcast; if they exceed MARK_BYTES, files are read in several waves, each with its own part.
    """
    bits = max(1, most.bit_length())
    bucket, position = F.call_function("div", F.col("at"), F.lit(MAP_BITS).cast("long")), F.col("at") % MAP_BITS
    bit = lambda k: F.when(F.shiftright("mark", k).bitwiseAND(F.lit(1)) == 1, F.col("position"))
    told = marks.where("mark > 0").select("file", bucket.alias("bucket"), position.alias("position"), F.col("mark").cast("int").alias("mark"))
    maps = written(told.groupBy("file", "bucket").agg(*(F.bitmap_construct_agg(bit(k)).alias(f"map{k}") for k in range(bits))), "marks")
    waves = max(1, -(-maps.count() * bits * MAP_BITS // 8 // MARK_BYTES))
    byte = lambda k: F.conv(F.hex(F.substring(F.col(f"map{k}"), F.call_function("div", position, F.lit(8).cast("long")).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    value = lambda k: F.shiftleft(F.call_function("shiftright", byte(k), (position % 8).cast("int")).bitwiseAND(F.lit(1)), k)
    wave = F.pmod(F.xxhash64("file"), F.lit(waves))
    parts = []
    for w in range(waves):
        mine = lambda df: df.where(wave == w) if waves > 1 else df  # noqa: B023, E731
        joined = mine(rows).withColumn("bucket", bucket).join(F.broadcast(mine(maps)), ["file", "bucket"], "left")
        parts.append(joined.select("row", "file", "at", F.coalesce(sum((value(k) for k in range(1, bits)), value(0)), F.lit(0)).alias("mark")))
    return reduce(DataFrame.unionByName, parts)


def n_spaced_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Bytes of one text that are Python objects at once, about.
PIECE_BYTES = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, most: int | None = None) -> Iterator[bytes]:
    """A text cut before ASCII white space into pieces of about `most` bytes; a word is never cut."""
    most, at = most or PIECE_BYTES, 0
    while len(text) - at > most and (space := _SPACE.search(text, at + most)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum up to about `most`; a larger item gets a range of its own."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    return [*out, (start, len(sizes))] if sizes else out
