"""An index that grows by batches: each batch is a segment, old versions are hidden and their statistics taken off, small segments are merged.

A path holds segments, each as save_index() writes it, and manifest/version=<n>, which lists those that count. A batch writes its segment first and its manifest last, so what
fails half-way is never seen, and readers keep the segments that their manifest has listed. Documents whose ids a batch has again are hidden where they lie (hides: segment, doc_id),
and the batch's vocabulary and field statistics contain what their old versions had as negative counts. So sums over segments are those of an index built anew, and a batch costs
what its documents and their old versions cost, whatever the index holds.

Segments are merged when the newest ones together are not much smaller than the one before, so there are about as many as the logarithm of the batches.
"""

from __future__ import annotations

import uuid
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.encode import Encoder, embedded
from ..operators.index import Index, build_index, load_segments, of_versions, save_index, unpacked, with_documents, without_hidden, write_parts, write_statistics
from ..sources.records import latest
from ..sources.shared import exists, held, holding
from ..streaming.ingest import versions

#: A segment is merged with the newer ones if it has at most so many times their documents.
GROWTH = 2
#: Numbers of hidden documents up to which they are broadcast.
HIDDEN = 1_000_000


def manifest(spark: SparkSession, path: str) -> list:
    """Rows (segment, folder, documents, hidden, batch) of the newest version, oldest segment first; none if there is none."""
    found = versions(spark, f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest/version={found[-1]}").orderBy("segment").collect() if found else []


def _commit(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    number = max(versions(spark, f"{path}/manifest"), default=-1) + 1
    told = spark.createDataFrame(rows, "segment int, folder string, documents long, hidden long, batch long")
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")


def _hidden(spark: SparkSession, path: str, rows: list) -> DataFrame | None:
    folders = [f"{path}/{r.folder}/hides" for r in rows if r.hidden]
    if not folders:
        return None
    found = spark.read.parquet(*folders)
    return F.broadcast(found) if sum(r.hidden for r in rows) <= HIDDEN else found


def open_index(spark: SparkSession, path: str) -> Index:
    rows = manifest(spark, path)
    return load_segments(spark, {r.segment: f"{path}/{r.folder}" for r in rows}, _hidden(spark, path, rows))


def _read(spark: SparkSession, path: str, rows: list, name: str) -> DataFrame:
    """The rows of a table of each segment, with the segment's number. Each has folders of its own, so they are read one by one."""
    found = None
    for r in rows:
        part = spark.read.parquet(f"{path}/{r.folder}/{name}").withColumn("segment", F.lit(r.segment))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def upsert(documents: DataFrame, path: str, analyzer: str = "plain", deleted: DataFrame | None = None, batch: int = -1, written: bool = False) -> None:
    """Puts documents, of which the ids must differ (see records.latest()), into the index at the path, in place of those of equal ids, and takes out the deleted (doc_id).

    Rows without an id are left out. A batch without documents and deletions changes nothing. batch: the number of a stream's batch, kept in the manifest.
    written: whether documents are read from a table that stays as it is; others are held until the batch is in. Old versions are read where they lie: only their ids are written.
    """
    spark, rows = documents.sparkSession, manifest(documents.sparkSession, path)
    documents = documents.where("doc_id IS NOT NULL")
    with ExitStack() as stack:
        fresh = documents if written else stack.enter_context(holding(documents, "fresh"))
        ids = fresh.select("doc_id")
        if deleted is not None:
            ids = stack.enter_context(holding(ids.unionByName(deleted.select("doc_id").where("doc_id IS NOT NULL")).distinct(), "ids"))
        if ids.isEmpty():
            return
        number, folder = max((r.segment for r in rows), default=-1) + 1, f"segments/{uuid.uuid4().hex}"
        hidden, before = 0, None
        if rows:
            had = _read(spark, path, rows, "documents")
            live = without_hidden(had.select("segment", "doc_id"), _hidden(spark, path, rows))
            hides = with_documents(ids, live, "inner").select("segment", "doc_id")
            hides.write.mode("overwrite").parquet(f"{path}/{folder}/hides")
            hides = spark.read.schema(hides.schema).parquet(f"{path}/{folder}/hides")
            if hidden := hides.count():
                before = build_index(of_versions(hides, had).drop("segment").withColumn("vector", F.lit(None).cast("array<float>")), analyzer)
        save_index(build_index(fresh, analyzer), f"{path}/{folder}", retracted=before)
        _commit(spark, path, [*map(tuple, rows), (number, folder, fresh.count(), hidden, batch)])
    merge(spark, path)


def follow(stream: DataFrame, path: str, checkpoint: str, analyzer: str = "plain", encoder: Encoder | None = None, **trigger) -> StreamingQuery:
    """Puts each batch of a stream of documents (see ingest.documents_of()) into the index at the path, with vectors of their texts, so that it can be searched.

    Of one id the latest dated stays, of equal dates the last to come; undated ones count as oldest. A batch that the manifest has is not put in again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = manifest(spark, path)
        if any(r.batch >= number for r in rows):
            return
        new = held(latest(batch.withColumn("seq", F.monotonically_increasing_id()), "doc_id", F.struct("date", "seq")).drop("seq"), "new")
        if rows:
            dates = open_index(spark, path).documents.select("doc_id", F.struct("date").alias("had"))
            new = with_documents(new, dates).where(F.col("had").isNull() | (F.struct("date") >= F.col("had"))).drop("had")
        upsert(embedded(new, encoder), path, analyzer, batch=number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def due(sizes: list[int], growth: float = GROWTH) -> int:
    """From which segment on they are merged: each, from the newest backwards, that has at most `growth` times the documents of all newer ones."""
    start = len(sizes) - 1
    while start > 0 and sizes[start - 1] <= growth * sum(sizes[start:]):
        start -= 1
    return start


def merge(spark: SparkSession, path: str, growth: float = GROWTH, least: int = 4) -> None:
    """Puts the newest segments into one, if at least `least` are due (see due()). Hidden documents among them go; what they hide in older segments stays hidden."""
    rows = manifest(spark, path)
    chosen = rows[due([r.documents for r in rows], growth) :]
    if len(chosen) < least:
        return
    mine, folder = {r.segment for r in chosen}, f"segments/{uuid.uuid4().hex}"
    whole = load_segments(spark, {r.segment: f"{path}/{r.folder}" for r in chosen}, _hidden(spark, path, chosen))
    write_parts(f"{path}/{folder}", whole.documents, whole.vectors, posted=whole.live(unpacked(whole.blocks, "positions")).withColumn("head", F.lit(False)))
    read = lambda name, *columns: _read(spark, path, chosen, name).select(*columns)
    write_statistics(f"{path}/{folder}", read("vocabulary", "term", "field", "df"), read("stats", "field", "n_docs", "tokens"), whole.analyzer)
    for name, keys in (("values", ("facet", "value")), ("days", ("day", "label"))):
        rows_ = _read(spark, path, chosen, name).drop("segment")
        rows_.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows_.columns if c not in keys)).write.mode("overwrite").parquet(f"{path}/{folder}/{name}")
    hidden = 0
    if any(r.hidden for r in chosen):
        outside = held(spark.read.parquet(*(f"{path}/{r.folder}/hides" for r in chosen if r.hidden)).where(~F.col("segment").isin(*mine)), "outside")
        if hidden := outside.count():
            outside.write.mode("overwrite").parquet(f"{path}/{folder}/hides")
    documents = spark.read.parquet(f"{path}/{folder}/documents").count()
    left = [tuple(r) for r in rows if r.segment not in mine]
    _commit(spark, path, [*left, (max(mine), folder, documents, hidden, max(r.batch for r in chosen))])


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes versions but the newest `keep`, and segments that none of these lists; their folders. No batch may be running."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segments")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = versions(spark, f"{path}/manifest")
    for v in found[:-keep]:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/version={v}"), True)
    listed = {r.folder for v in found[-keep:] for r in spark.read.parquet(f"{path}/manifest/version={v}").collect()}
    gone = [s.getPath() for s in system.listStatus(folder) if f"segments/{s.getPath().getName()}" not in listed] if exists(spark, f"{path}/segments") else []
    for place in gone:
        system.delete(place, True)
    return [place.getName() for place in gone]
