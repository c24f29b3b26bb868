"""Joining what is known of each distinct token to the tokens' frequencies in each document.

count_tokens() makes the table of distinct tokens. join_frequencies() sums a value per token over every document: the most frequent
tokens (a bounded number; long ones stand as digests) are broadcast and summed where the text is read; the other (document, token, frequency)
rows are joined by token, where no key can be hot any more, and added up per document. No list of a document's token ids is ever made.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, slices, trimmed

#: Broadcast tokens at most, and the length from which on a digest stands for a token; distinct tokens that a task holds before it passes their counts on.
HOT, HOT_LENGTH, HELD = 1 << 19, 64, 1 << 19
#: Bytes of text that are Python objects at once.
PART_BYTES = 1 << 20

Split = Callable[[], Callable[[bytes], list]]  # called once in each task; the function made gets pieces of texts, cut before white space


def key_of(token):
    """A token as the key of joins: itself, or, if long, a digest, which is longer than any token that stands for itself."""
    if len(token) <= HOT_LENGTH:
        return token
    text = isinstance(token, str)
    digest = hashlib.blake2b(token.encode("utf-8", "surrogatepass") if text else token, digest_size=HOT_LENGTH // 2 + 1).hexdigest()
    return digest if text else digest.encode()


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces with about PART_BYTES of a binary column each: Python objects are made for one piece at a time."""
    for a, b in slices(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), PART_BYTES):
        yield batch.slice(a, b - a)


def count_tokens(texts: DataFrame, split: Split, token_type: str, end: list = ()) -> DataFrame:
    """token, n over all rows of texts (one binary column); null texts have what the empty text has. end: tokens that each text has besides."""
    kind = pa.string() if token_type == "string" else pa.binary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = split(), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), kind), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

        for batch in trimmed(batches):
            for text in batch.column(0):
                seen.update(end)
                for piece in pieces(text.as_py() or b""):
                    seen.update(tokens(piece))
                    if len(seen) > HELD:
                        yield rows()
                        seen.clear()
        yield rows()

    return bounded_batches(texts).mapInArrow(count, f"token {token_type}, n long").groupBy("token").agg(F.sum("n").alias("n"))


def at_most(table: DataFrame, n: Column, most: int) -> Column:
    """Condition that the rows of the highest counts n meet, as many as can without being more than `most`; equal counts all or none."""
    total, least = 0, None
    for r in table.groupBy(n.alias("n")).agg(F.count("*").alias("rows")).orderBy(F.col("n").desc()).toLocalIterator():
        total += r.rows
        if total > most:
            break
        least = r.n
    return n >= F.lit(least) if least is not None else F.lit(False)


def join_frequencies(docs: DataFrame, keep: list[str], split: Split, table: DataFrame, token_type: str, default: float, hot: int = HOT, score: Callable[[list[bytes]], Sequence[float]] | None = None, *, end: list = ()) -> DataFrame:
    """The columns `keep`, n_tokens, n_known, total of each row of docs, which is a table read alike each time and has a binary column text.

    table: token (see key_of), n, value. n_known counts the tokens in the table, total sums their values and `default` for each other token.
    end: tokens that each text has besides. score: gives a number for each text, in a further column score; the texts are read once for both.
    """
    wanted = at_most(table, F.col("n"), hot)
    rows = table.where(wanted).select("token", "value").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    names = [*keep, *["score"] * bool(score)]
    info = ", ".join([f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double"] * bool(score))
    kind = pa.string() if token_type == "string" else pa.binary()
    schema = f"row long, token {token_type}, freq long, n_tokens long, known long, total double, {info}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = split(), dict(zip(*sent.value, strict=True))
        find = known.get
        for batch in (part for whole in trimmed(batches) for part in parts(whole, 1)):
            ids, texts, kept = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()], batch.columns[2:]
            if score:
                kept = [*kept, pa.array(np.asarray(score(texts), dtype=np.float64))]
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            row, token, freq, n_tokens, n_known, total, source = out
            for i, (at, text) in enumerate(zip(ids, texts, strict=True)):
                found, many = Counter(end), len(end)
                for piece in pieces(text):
                    new = tokens(piece)
                    found.update(new)
                    many += len(new)
                seen, sure, first = 0, 0.0, len(row)
                for t, f in found.items():
                    if len(t) > HOT_LENGTH:
                        t = key_of(t)
                    if (v := find(t)) is None:
                        token.append(t)
                        freq.append(f)
                    else:
                        seen += f
                        sure += f * v
                if len(token) == first:  # a row for the text itself, whose token no table has
                    mark = f"{at:>100}"
                    token.append(mark if token_type == "string" else mark.encode())
                    freq.append(0)
                more = len(token) - first
                row += [at] * more
                n_tokens += [many] + [None] * (more - 1)
                n_known += [seen] + [None] * (more - 1)
                total += [sure] + [None] * (more - 1)
                source += [i] + [None] * (more - 1)
            source = pa.array(source, pa.int32())
            columns = [pa.array(row, pa.int64()), pa.array(token, kind), *(pa.array(x, pa.int64()) for x in (freq, n_tokens, n_known)), pa.array(total, pa.float64()), *(c.take(source) for c in kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "token", "freq", "n_tokens", "known", "total", *names])

    spread = docs.select(F.monotonically_increasing_id().alias("row"), "text", *keep).mapInArrow(read, schema)
    joined = spread.join(table.select("token", "value"), "token", "left")
    return (
        joined.groupBy("row")
        .agg(
            *(F.first(c, ignorenulls=True).alias(c) for c in names),
            F.max("n_tokens").alias("n_tokens"),
            (F.max("known") + F.sum(F.when(F.col("value").isNotNull(), F.col("freq")).otherwise(0))).alias("n_known"),
            (F.max("total") + F.sum(F.col("freq") * F.coalesce("value", F.lit(float(default))))).alias("total"),
        )
        .drop("row")
    )
