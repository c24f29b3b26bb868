"""Inverted index as tables: postings with positions, field statistics, vocabulary; saved in blocks by term bucket, so that a query reads its terms' parts only."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import Porter, english_terms, plain_tokens, stem_table
from ..sources.shared import WRITTEN, held, stated

if TYPE_CHECKING:
    from .cells import VectorCells

FIELDS = ("title", "text")
BUCKETS = 64
#: Documents of a block at most, which are neighbours in storage; a merge chooses blocks by hash of the id. Tokens that a task handles at once, and whose blocks it packs at once, about.
BLOCK, TOKENS, PACKED = 128, 1 << 19, 1 << 20


@dataclass
class Index:
    """documents; postings: term, field, doc_id, tf, dl, positions; stats: field, n_docs, avgdl; vocabulary: term, field, df; vectors: doc_id, vector. analyzer: a key of ANALYZERS.

    Of a saved index also blocks: segment, term, field, block, n, most_tf, least_dl, and the lists doc_ids, tfs, dls, positions; nearby: key, word, n (see words.parts_of());
    cells: the vectors by cell (see cells.VectorCells), if there are any; hidden: segment, doc_id of old versions that blocks still hold;
    values: facet, value, count and days: day, label, count, votes (see facts()), of which whole-corpus counts and trends are sums.
    Of one that isn't saved tokens: field, doc_id, tokens (see field_tokens()).
    """

    documents: DataFrame
    postings: DataFrame
    stats: DataFrame
    vocabulary: DataFrame
    vectors: DataFrame
    analyzer: str = "plain"
    blocks: DataFrame | None = None
    nearby: DataFrame | None = None
    cells: VectorCells | None = None
    hidden: DataFrame | None = None
    values: DataFrame | None = None
    days: DataFrame | None = None
    tokens: DataFrame | None = None

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (segment, doc_id, ...) without old versions."""
        return without_hidden(rows, self.hidden)


#: How texts become terms: lower-case words; or without stop words and possessive endings, and stemmed.
ANALYZERS = {"plain": plain_tokens, "english": english_terms}


def stemmed(rows: DataFrame, analyzer: str) -> DataFrame:
    """rows with term as the analyzer has it; stems are looked up for distinct terms only."""
    if analyzer != "english":
        return rows
    others = [c for c in rows.columns if c != "term"]
    return rows.join(stem_table(rows), "term").select(F.col("stem").alias("term"), *others)


def field_tokens(documents: DataFrame, tokens: Callable[[Column], Column] = plain_tokens, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """field, doc_id, tokens: a row for each document and field; the text is read once."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in fields)))
    return documents.select("doc_id", each.alias("x")).select("x.field", "doc_id", "x.tokens")


def _ranges(sizes: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many consecutive rows, and of about TOKENS tokens (sizes: of each row); a longer row has a range of its own."""
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        before = ends[start] - sizes[start]
        end = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + TOKENS, side="right"))))
        yield start, end
        start = end


class _Terms:
    """Terms of tokens as the analyzer has them: stems are looked up once for the distinct tokens of a batch, and the usual ones once in a task."""

    def __init__(self, analyzer: str):
        self.porter, self.known = Porter() if analyzer == "english" else None, {}

    def coded(self, tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Distinct terms, and which of them each token is."""
        found = tokens.dictionary_encode()
        code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if self.porter is None:
            return found.dictionary, code
        if len(self.known) > TOKENS:
            self.known.clear()
        words = found.dictionary.to_pylist()
        for w in words:
            if w not in self.known:
                self.known[w] = self.porter.stem(w)
        stems = pa.array([self.known[w] for w in words], pa.string()).dictionary_encode()
        return stems.dictionary, stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]


def _placed(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens of each row; of each token its row and its place there."""
    sizes = np.diff(tokens.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    return sizes, row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _posted(analyzer: str, only: list[str] | None = None):
    """Function for mapInArrow: of rows (field, doc_id, tokens) the postings; head: whether it is the first one of its row.

    only: terms whose postings are asked for. Then rows without a term tell, for each field, how many documents have a token there (tf) and how many tokens there are (dl).
    """
    columns = ["term", "field", "doc_id", "tf", "dl", "positions", "head"]

    def sums(field: pa.Array, doc_id: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        told = pa.table({"field": field, "n": pa.array(sizes > 0).cast(pa.int64()), "tokens": pa.array(sizes.astype(np.int64))}).group_by("field").aggregate([("n", "sum"), ("tokens", "sum")])
        none = lambda kind: pa.nulls(len(told), kind)
        field, n, tokens = (told[c].combine_chunks() for c in ("field", "n_sum", "tokens_sum"))
        return pa.RecordBatch.from_arrays([none(pa.string()), field, none(doc_id.type), n, tokens, none(pa.list_(pa.int32())), none(pa.bool_())], names=columns)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(analyzer)
        for whole in batches:
            for a, b in _ranges(np.diff(whole.column(2).offsets.to_numpy()), len(whole)):
                field, doc_id, tokens = whole.slice(a, b - a).columns
                sizes, row, place = _placed(tokens)
                names, code = terms.coded(tokens.flatten())
                if only is not None:
                    yield sums(field, doc_id, sizes)
                    asked = pc.is_in(names, value_set=pa.array(only, pa.string())).to_numpy(zero_copy_only=False)[code]
                    row, place, code = row[asked], place[asked], code[asked]
                order = np.argsort(row * max(1, len(names)) + code, kind="stable")
                row, code, place = row[order], code[order], place[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])[: len(row)])
                ends = np.append(new, len(row))
                head = np.concatenate([[True], row[new][1:] != row[new][:-1]])[: len(new)]
                positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
                taken = lambda x: x.take(pa.array(row[new]))  # noqa: E731, B023
                values = [names.take(pa.array(code[new])), taken(field), taken(doc_id), pa.array(np.diff(ends)), pa.array(sizes[row[new]].astype(np.int64)), positions, pa.array(head)]
                yield pa.RecordBatch.from_arrays(values, names=columns)

    return post


def postings(tokens: DataFrame, analyzer: str = "plain", only: list[str] | None = None) -> DataFrame:
    """term, field, doc_id, tf, dl, positions, head (see _posted()): a row of tokens holds all of a document's field, so nothing is shuffled."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("field", "doc_id", "tokens").mapInArrow(_posted(analyzer, only), f"term string, field string, doc_id {kind}, tf long, dl long, positions array<int>, head boolean")


def _blocked(analyzer: str, fields: tuple[str, ...]):
    """Function for mapInArrow: of rows (doc_id, and tokens of each field) blocks as in_blocks() has them, of neighbouring rows. A document's fields are in one block."""

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, number = _Terms(analyzer), TaskContext.get().partitionId() << 24
        for whole in batches:
            for a, b in _ranges(sum(np.diff(c.offsets.to_numpy()) for c in whole.columns[1:]), BLOCK):
                part = whole.slice(a, b - a)
                part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                for field, tokens in zip(fields, part.columns[1:], strict=True):
                    if len(tokens.flatten()):
                        yield block(terms, number, field, part.column(0), tokens)
                number += 1

    def block(terms: _Terms, number: int, field: str, doc_id: pa.Array, tokens: pa.ListArray) -> pa.RecordBatch:
        sizes, row, place = _placed(tokens)
        names, code = terms.coded(tokens.flatten())
        order = np.argsort(code * len(sizes) + row, kind="stable")
        row, code, place = row[order], code[order], place[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
        of, tf, dl = code[new], np.diff(np.append(new, len(row))), sizes[row[new]].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        edges = pa.array(np.append(first, len(of)), pa.int32())
        lists = lambda values: pa.ListArray.from_arrays(edges, values)
        positions = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(place, pa.int32()))
        # What a field has in the block is told by the first of its rows.
        once = lambda n: pa.array(np.where(np.arange(len(first)) == 0, n, 0).astype(np.int64))
        columns = [names.take(pa.array(of[first])), pa.array([field] * len(first)), pa.array(np.full(len(first), number)), pa.array(np.diff(np.append(first, len(of))), pa.int32()), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl, first))]
        columns += [once((sizes > 0).sum()), once(sizes.sum()), lists(doc_id.take(pa.array(row[new]))), lists(pa.array(tf)), lists(pa.array(dl)), lists(positions)]
        return pa.RecordBatch.from_arrays(columns, names=BLOCK_COLUMNS)

    return put


BLOCK_COLUMNS = ["term", "field", "block", "n", "most_tf", "least_dl", "heads", "tokens", "doc_ids", "tfs", "dls", "positions"]


def _packed(blocked: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], buckets: int):
    """Function for mapInArrow: what `blocked` makes as rows (bucket, packed), each a small Parquet file of one bucket's blocks out of about PACKED tokens."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had, size = [], 0
        for blocks in blocked(batches):
            had.append(blocks)
            size += pc.sum(blocks.column("tokens")).as_py()
            if size >= PACKED:
                yield packed(had)
                had, size = [], 0
        if had:
            yield packed(had)

    def packed(had: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(had).combine_chunks()
        found = whole["term"].combine_chunks().dictionary_encode()
        code = found.indices.to_numpy(zero_copy_only=False)
        of = np.array([zlib.crc32(t.encode()) % buckets for t in found.dictionary.to_pylist()])[code]
        order = np.lexsort((code, of))
        whole, of = whole.take(pa.array(order)), of[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        files = [file(whole.slice(a, b - a)) for a, b in zip(first, np.append(first[1:], len(of)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(of[first].astype(np.int32)), pa.array(files, pa.binary())], names=["bucket", "packed"])

    def file(rows: pa.Table) -> bytes:
        numbers = [f.name for f in rows.schema if pa.types.is_integer(f.type)]
        numbers += [f"{name}.list.element" for name in ("doc_ids", "tfs", "dls") if pa.types.is_integer(rows.schema.field(name).type.value_type)] + ["positions.list.element.list.element"]
        sink = pa.BufferOutputStream()
        pq.write_table(rows, sink, compression="zstd", use_dictionary=["term", "field"], column_encoding=dict.fromkeys(numbers, "DELTA_BINARY_PACKED"))
        return sink.getvalue().to_pybytes()

    return pack


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the blocks in rows of _packed(), with their bucket."""
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for rows in pq.ParquetFile(pa.BufferReader(packed.as_buffer())).iter_batches():
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(rows), bucket, np.int32))], names=[*BLOCK_COLUMNS, "bucket"])


def _analyzed(documents: DataFrame, analyzer: str) -> tuple[DataFrame, str]:
    """doc_id and the tokens of each field; the schema of their blocks."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"term string, field string, block long, n int, most_tf long, least_dl long, heads long, tokens long, doc_ids array<{kind}>, tfs array<long>, dls array<long>, positions array<array<int>>"
    return documents.select("doc_id", *(ANALYZERS[analyzer](F.col(f)).alias(f) for f in FIELDS)), schema


def blocks_of(documents: DataFrame, analyzer: str = "plain") -> DataFrame:
    """Blocks of documents as they lie in storage: neither texts nor postings are shuffled for them."""
    rows, schema = _analyzed(documents, analyzer)
    return rows.mapInArrow(_blocked(analyzer, FIELDS), schema)


def dealt_blocks(documents: DataFrame, analyzer: str = "plain") -> DataFrame:
    """blocks_of() with their buckets, dealt by these. As rows, blocks have several times the bytes of the texts, most of them of short lists; packed, they have about what files of them have."""
    rows, schema = _analyzed(documents, analyzer)
    packed = rows.mapInArrow(_packed(_blocked(analyzer, FIELDS), BUCKETS), "bucket int, packed binary")
    return packed.hint("rebalance", "bucket").mapInArrow(_unpacked, f"{schema}, bucket int")


def field_stats(tokens: DataFrame) -> DataFrame:
    """field, n_docs (documents with a token there), avgdl (their mean length)."""
    n = F.size("tokens")
    return tokens.where(n > 0).groupBy("field").agg(F.count("*").alias("n_docs"), (F.sum(n) / F.count("*")).alias("avgdl"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """term, field, df of tokens that are terms as they are."""
    return tokens.select("field", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term", "field").agg(F.count("*").alias("df"))


def build_index(documents: DataFrame, analyzer: str = "plain") -> Index:
    told = field_tokens(documents, ANALYZERS[analyzer])
    posted = postings(told, analyzer)
    words = vocabulary(told) if analyzer == "plain" else posted.groupBy("term", "field").agg(F.count("*").alias("df"))
    return Index(documents.drop("vector"), posted, field_stats(told), words, documents.where("vector IS NOT NULL").select("doc_id", "vector"), analyzer, tokens=told)


def of_asked(index: Index, terms: DataFrame) -> Index:
    """What an index that isn't saved has of a few asked terms (term): their postings and vocabulary, and the statistics, from one reading of the texts. Other indexes as they are."""
    if index.tokens is None:
        return index
    rows = stated(terms.select("term").distinct())[1]
    if rows is None:
        return index
    found = held(postings(index.tokens, index.analyzer, sorted(r.term for r in rows)), "asked")
    posted = found.where("term IS NOT NULL")
    sums = found.where("term IS NULL").groupBy("field").agg(F.sum("tf").alias("n_docs"), (F.sum("dl") / F.sum("tf")).alias("avgdl")).where("n_docs > 0")
    return replace(index, postings=posted, stats=sums, vocabulary=posted.groupBy("term", "field").agg(F.count("*").alias("df")), tokens=None)


def term_bucket(term: Column) -> Column:
    """A function that tasks in Python have too (see _packed())."""
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def block_of(doc_id: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n_blocks)).cast("int")


def in_blocks(posted: DataFrame, n_blocks: int) -> DataFrame:
    """Postings of a term, field and block as one row: n of them, lists in order of the ids, and what bounds their scores. A common term has many blocks, so no key is hot."""
    one = F.struct("doc_id", "tf", "dl", "positions")
    rows = posted.withColumn("block", block_of(F.col("doc_id"), n_blocks)).groupBy("term", "field", "block")
    told = rows.agg(
        F.count("*").cast("int").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.count_if("head").alias("heads"), F.sum(F.when(F.col("head"), F.col("dl"))).alias("tokens"), F.sort_array(F.collect_list(one)).alias("p")
    )
    lists = {"doc_ids": "doc_id", "tfs": "tf", "dls": "dl", "positions": "positions"}
    return told.select("term", "field", "block", "n", "most_tf", "least_dl", "heads", "tokens", *(F.col(f"p.{part}").alias(name) for name, part in lists.items()))


def without_hidden(rows: DataFrame, hidden: DataFrame | None) -> DataFrame:
    return rows if hidden is None else rows.join(hidden, ["segment", "doc_id"], "left_anti")


#: Bytes of a row group of blocks: small, as questions read few terms of a file.
GROUP_BYTES = 4 << 20


def save_index(index: Index, path: str, cells: bool = False, retracted: Index | None = None) -> None:
    """cells: whether the vectors are saved by cell too, for approximate search. retracted: old versions, of which the statistics are taken off (see plans.segments)."""
    from .cells import save_cells

    write_parts(path, index.documents, index.vectors, index.analyzer)
    # Documents may be a join of tables: what is made of them is made of those that are written.
    write_facts(path, facts(index.documents.sparkSession.read.parquet(f"{path}/documents")), None if retracted is None else facts(retracted.documents))
    blocks = index.documents.sparkSession.read.parquet(f"{path}/blocks")
    vocabulary_ = blocks.groupBy("term", "field").agg(F.sum("n").alias("df"))
    stats = blocks.groupBy("field").agg(F.sum("heads").alias("n_docs"), F.sum("tokens").alias("tokens"))
    if retracted is not None:
        vocabulary_ = vocabulary_.unionByName(retracted.vocabulary.withColumn("df", -F.col("df")))
        minus = retracted.tokens.where(F.size("tokens") > 0).groupBy("field").agg((-F.count("*")).alias("n_docs"), (-F.sum(F.size("tokens"))).alias("tokens"))
        stats = stats.unionByName(minus)
    if cells:
        save_cells(index.vectors, f"{path}/cells")
    write_statistics(path, vocabulary_, stats, index.analyzer, cells)


def write_parts(path: str, documents: DataFrame, vectors: DataFrame, analyzer: str = "plain", posted: DataFrame | None = None) -> None:
    """Blocks lie in folders by term bucket; a task writes to one bucket's folder only, large buckets by several tasks. Documents are sorted by id, so that those of given
    ids are in few row groups. Blocks are made of the documents written, or of postings, where these are at hand."""
    spark = documents.sparkSession
    documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").options(**WRITTEN).parquet(f"{path}/documents")
    vectors.write.mode("overwrite").options(**WRITTEN).parquet(f"{path}/vectors")
    put = spark.read.schema(documents.schema).parquet(f"{path}/documents")
    if posted is None:
        blocks = dealt_blocks(put, analyzer)
    else:
        blocks = in_blocks(posted, max(1, -(-put.count() // BLOCK))).withColumn("bucket", term_bucket(F.col("term"))).hint("rebalance", "bucket")
    rows = blocks.sortWithinPartitions("bucket", "term", "field", "block").write.mode("overwrite").options(**WRITTEN)
    rows.option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(f"{path}/blocks")


def facts(documents: DataFrame) -> dict[str, DataFrame]:
    """values: facet, value, count of tools, sentiment and subreddit, as far as documents have them, and the total; days: day (null: undated), label, count, votes."""
    from .facets import counted

    has = set(documents.columns)
    parts = [documents.agg(F.count("*").alias("count")).select(F.lit("total").alias("facet"), F.lit("documents").alias("value"), "count")]
    if "tools" in has:
        parts.append(counted(documents.select(F.explode("tools").alias("value")), "tools"))
    parts += [counted(documents.select(F.col(c).alias("value")), c) for c in ("sentiment", "subreddit") if c in has]
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    column = lambda name, kind, default: F.coalesce(F.col(name), default) if name in has else default.cast(kind)
    day = F.to_date("date") if "date" in has else F.lit(None).cast("date")
    days = documents.select(day.alias("day"), column("sentiment", "string", F.lit("not_applicable")).alias("label"), column("upvotes", "long", F.lit(0)).alias("votes"))
    return {"values": values, "days": days.groupBy("day", "label").agg(F.count("*").alias("count"), F.sum("votes").alias("votes"))}


def write_facts(path: str, fresh: dict[str, DataFrame], retracted: dict[str, DataFrame] | None) -> None:
    """Sums to be added up; what is retracted is negative."""
    for name, rows in fresh.items():
        if retracted is not None:
            rows = rows.unionByName(retracted[name].withColumns({c: -F.col(c) for c in ("count", "votes") if c in rows.columns}))
        keys = [c for c in rows.columns if c not in ("count", "votes")]
        rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows.columns if c not in keys)).write.mode("overwrite").parquet(f"{path}/{name}")


def write_statistics(path: str, vocabulary_: DataFrame, stats: DataFrame, analyzer: str, cells: bool = False) -> None:
    """vocabulary_: term, field, df; stats: field, n_docs, tokens. Rows are sums to be added up, and may be negative, where a segment takes old versions off."""
    from .words import keyed

    spark = stats.sparkSession
    words = vocabulary_.groupBy("term", "field").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("bucket", term_bucket(F.col("term")))
    words.hint("rebalance", "bucket").write.mode("overwrite").options(**WRITTEN).partitionBy("bucket").parquet(f"{path}/vocabulary")
    near = keyed(spark.read.parquet(f"{path}/vocabulary").select(F.col("term").alias("word"), "field", "df")).withColumn("bucket", term_bucket(F.col("key")))
    near.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").options(**WRITTEN).partitionBy("bucket").parquet(f"{path}/nearby")
    told = stats.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
    told.withColumns({"analyzer": F.lit(analyzer), "cells": F.lit(cells)}).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> Index:
    return load_segments(spark, {0: path})


def load_segments(spark: SparkSession, paths: dict[int, str], hidden: DataFrame | None = None) -> Index:
    """The index that saved segments (by their numbers) make up: their rows without hidden ones, and sums of their statistics."""
    from .cells import VectorCells

    def read(name: str, change: Callable[[int, DataFrame], DataFrame] = lambda i, rows: rows.withColumn("segment", F.lit(i))) -> DataFrame:
        found = None
        for i, path in paths.items():
            rows = change(i, spark.read.parquet(f"{path}/{name}"))
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        return found

    one = len(paths) == 1
    # Blocks of several segments are told apart by their numbers.
    blocks = read("blocks", lambda i, rows: rows.withColumns({"segment": F.lit(i), "block": F.col("block") + F.lit(i).cast("long") * (1 << 44)}))
    sums = read("stats").groupBy("field", "analyzer").agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
    stats = stated(sums.where("n_docs > 0").select("field", "n_docs", (F.col("tokens") / F.col("n_docs")).alias("avgdl"), "analyzer"))[0]
    told = read("stats").select("analyzer", "cells").first()
    words = read("vocabulary").drop("segment")
    if not one:
        words = words.groupBy("term", "field", "bucket").agg(F.sum("df").alias("df")).where("df > 0")
    near = read("nearby").groupBy("bucket", "key", "word", "field").agg(F.sum("df").alias("n")).where("n > 0").groupBy("bucket", "key", "word").agg(F.max("n").alias("n"))
    cells = VectorCells.open(spark, f"{paths[0]}/cells") if one and told and told.cells else None
    values = read("values").groupBy("facet", "value").agg(F.sum("count").alias("count")).where("count > 0 OR facet = 'total'")
    days = read("days").groupBy("day", "label").agg(F.sum("count").alias("count"), F.sum("votes").alias("votes")).where("count > 0")
    live = lambda name: without_hidden(read(name), hidden).drop("segment")
    analyzer = told.analyzer if told else "plain"
    return Index(live("documents"), without_hidden(unpacked(blocks, "positions"), hidden), stats.drop("analyzer"), words, live("vectors"), analyzer, blocks, near, cells, hidden, values, days)


def unpacked(blocks: DataFrame, *more: str) -> DataFrame:
    """A row for each posting: doc_id, tf, dl, and `more` of its lists; columns of the blocks other than lists stay. Lists that aren't asked for aren't read."""
    lists = {"doc_ids": "doc_id", "tfs": "tf", "dls": "dl", **{m: m for m in more}}
    others = [c for c in blocks.columns if c not in {*lists, "positions"}]
    rows = blocks.select(*others, F.explode(F.arrays_zip(*lists)).alias("p"))
    return rows.select(*others, *(F.col(f"p.{name}").alias(alias) for name, alias in lists.items()))


def in_buckets(saved: DataFrame, buckets: list[int]) -> DataFrame:
    return saved.where(F.col("bucket").isin(buckets)) if "bucket" in saved.columns else saved


def asked_buckets(rows: DataFrame, saved: DataFrame, column: str = "term") -> DataFrame:
    """Of a table saved by bucket only the folders of what a few rows ask for."""
    if "bucket" not in saved.columns:
        return saved
    return in_buckets(saved, rows.agg(F.collect_set(term_bucket(F.col(column)))).first()[0])  # BUCKETS numbers at most


def of_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of a saved table (postings or vocabulary) for a few given terms: other buckets' folders are not read."""
    given = rows.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    buckets = given.agg(F.collect_set(term_bucket(F.col("term")))).first()[0]
    return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


#: Documents that are looked up by a list of their ids at most; ids of one broadcast, and their bytes, about.
MANY_IDS, ID_BYTES = 10_000, 32 << 20


def with_documents(rows: DataFrame, documents: DataFrame, how: str = "left") -> DataFrame:
    """rows (a held table) joined with documents by doc_id.

    Ids reach the scan of documents: up to MANY_IDS as a list, by which it skips row groups; more of them as broadcast tables, in parts of bounded size. So only documents
    of the rows leave the scan, however many the questions are.
    """
    ids = rows.select("doc_id").where("doc_id IS NOT NULL")
    ids = ids if ids.isLocal() else ids.distinct()
    _, few = stated(ids, MANY_IDS)
    if few is not None:
        return rows.join(F.broadcast(documents.where(F.col("doc_id").isin(sorted({r.doc_id for r in few})))), "doc_id", how)
    return rows.join(_met(ids.distinct(), documents, ["doc_id"]), "doc_id", how)


def _met(ids: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Documents of ids (keys; distinct rows), which are broadcast in parts of bounded size."""
    size = F.length(F.col("doc_id").cast("string")).cast("long")
    n = max(1, -(-(ids.agg(F.sum(size + 16)).first()[0] or 0) // ID_BYTES))
    part = lambda df, i: df.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == i) if n > 1 else df
    met = None
    for i in range(n):
        found = part(documents, i).join(F.broadcast(part(ids, i)), keys, "left_semi")
        met = found if met is None else met.unionByName(found)
    return met


def of_versions(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """documents (segment, doc_id, ...) of versions (segment, doc_id; a held table of distinct rows). Nothing of the documents is shuffled or held."""
    _, few = stated(versions.select("doc_id"), MANY_IDS)
    near = documents if few is None else documents.where(F.col("doc_id").isin(sorted({r.doc_id for r in few})))
    return _met(versions, near, ["segment", "doc_id"])


def corpus_stats(documents: DataFrame, most: int = 100) -> DataFrame:
    """facet, value, count of tools, sentiment and subreddit over all documents, each facet's `most` most frequent, and the total."""
    from .facets import counted

    facets = [counted(documents.select(F.explode("tools").alias("value")), "tools", most), *(counted(documents.select(F.col(c).alias("value")), c, most) for c in ("sentiment", "subreddit"))]
    total = documents.agg(F.count("*").alias("count")).select(F.lit("total").alias("facet"), F.lit("documents").alias("value"), "count")
    for f in facets:
        total = total.unionByName(f)
    return total


def stored_stats(values: DataFrame, most: int = 100) -> DataFrame:
    """corpus_stats() of an index's values; no document is read."""
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("count").desc(), "value"))
    return values.withColumn("place", place).where(F.col("place") <= most).select("facet", "value", "count")


def health(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """component, rows, status: a component without rows is unhealthy."""
    told = None
    for name, table in (("documents", documents), ("vectors", vectors)):
        one = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("component"), "rows", F.when(F.col("rows") > 0, "healthy").otherwise("unhealthy").alias("status"))
        told = one if told is None else told.unionByName(one)
    return told


def lookup(documents: DataFrame, doc_id) -> DataFrame:
    """The document of this id, or no row; the id reaches the scan as a filter."""
    return documents.where(F.col("doc_id") == F.lit(doc_id)).limit(1)
