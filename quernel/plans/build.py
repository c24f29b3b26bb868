"""From raw records to a saved index, with vectors and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import Encoder, embedded
from ..operators.index import build_index, save_index
from ..sources.records import latest, split_rejects, to_documents
from ..sources.shared import held


def index_records(records: DataFrame, path: str, encoder: Encoder | None = None, analyzer: str = "plain") -> DataFrame:
    """Indexes records (see read_records) at the path, with vectors of their texts. One row: indexed, without_vector, repeated, skipped.

    Of records with one id the latest dated stays. A text that the encoder fails on is indexed without a vector; records that lack a part, and malformed lines, are skipped.
    """
    whole, bad = split_rejects(records)
    documents = held(embedded(latest(to_documents(whole), "doc_id", F.coalesce(F.col("date"), F.lit("0001-01-01").cast("timestamp"))), encoder), "documents")
    save_index(build_index(documents, analyzer), path)
    counts = documents.agg(F.count("*").alias("indexed"), F.count_if(F.col("vector").isNull()).alias("without_vector"))
    all_, skipped = whole.agg(F.count("*").alias("valid")), bad.agg(F.count("*").alias("skipped"))
    told = counts.join(F.broadcast(all_), F.lit(True)).join(F.broadcast(skipped), F.lit(True))
    return told.select("indexed", "without_vector", (F.col("valid") - F.col("indexed")).alias("repeated"), "skipped")


def vector_lengths(vectors: DataFrame) -> DataFrame:
    """dimension, vectors: an index whose vectors can all be compared has one row. Vectors of unit length have product 1 with themselves: off_unit counts the others."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return vectors.groupBy(F.size("vector").alias("dimension")).agg(F.count("*").alias("vectors"), F.count_if(F.abs(square - 1) > 1e-3).alias("off_unit"))
