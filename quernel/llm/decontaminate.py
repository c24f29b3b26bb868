"""Benchmark decontamination with suffix arrays over the training documents.

Every shard (a few MB of documents in one task) gets a word-level suffix array; every suffix of every benchmark item is binary-searched in
it, word by word, all suffixes at once. The range of the array that still matches after a window's length holds all its occurrences; the
depth at which the range runs empty is the suffix's longest verbatim match. Only runs of words that the benchmark knows can match, so the
array leaves out words outside them: this loses no match. A document's longest match, and where it begins, come from the same search:
places that leave a suffix's range at some depth match no longer. No rows are shuffled. The benchmark is the stated query set; it travels in
blocks of bounded size, each of which every shard searches.

A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: null or empty text has no words and is clean; a benchmark item without words matches nothing; equal items are searched once
per id; null item ids count as the empty string; repeated document rows repeat their result; an empty benchmark leaves all documents clean; a very
long text has a suffix array of its own, with some tens of bytes a word; other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, slices, trimmed

WIDTH = 10
#: Bytes of benchmark text in one broadcast block, and of document text in one suffix array.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 4 << 20
#: Lower-cases A-Z; keeps 0-9, a-z and all bytes of characters outside ASCII; the rest separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Stands between documents; no UTF-8 text holds it.
BETWEEN = b"\xff"


class TestSuffixes:
    """A block of benchmark items, ready to be searched."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.items = [item for item, _ in items]
        words = [text.translate(WORD_BYTES).split() for _, text in items]
        self.known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws), 1)}
        self.known[BETWEEN] = -1
        sizes = np.array([len(ws) for ws in words], dtype=np.int64)
        self.words = np.array([self.known[w] for ws in words for w in ws], dtype=np.int64)
        ends = np.cumsum(sizes)
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.left = np.repeat(ends, sizes) - np.arange(len(self.words))  # words from here to the item's end
        self.at = np.arange(len(self.words)) - np.repeat(ends - sizes, sizes)
        whole = np.repeat(sizes, sizes)
        #: Length of the window that begins here, 0 if none does.
        self.window = np.where(self.left >= width, width, np.where((self.at == 0) & (whole < width), whole, 0))
        self.shortest = int(min(self.window[self.window > 0], default=0))
        self.deepest = int(max(self.left, default=0))


class ShardSuffixes:
    """Suffix array of the words of a shard that stand in runs of at least `shortest` known words."""

    def __init__(self, texts: list[bytes], test: TestSuffixes):
        find, ids = test.known.get, [np.zeros(0, np.int64)]
        for piece in pieces(BETWEEN.join(b" " + t.replace(BETWEEN, b"\xfe").translate(WORD_BYTES) + b" " for t in texts)):
            words = piece.split()
            ids.append(np.fromiter((find(w, 0) for w in words), dtype=np.int64, count=len(words)))
        ids = np.concatenate(ids)
        bounds = np.flatnonzero(ids == -1)
        self.starts = np.concatenate([[0], bounds + 1])
        self.n_words = np.diff(np.concatenate([self.starts, [len(ids) + 1]])) - 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        keep = last - first >= max(1, test.shortest)
        first, last = first[keep], last[keep]
        length = last - first + 1  # with the word, boundary or end that stops the run, written as 0
        offset = np.cumsum(length) - length
        #: Where each kept word stands in the shard; the kept words, 0 after each run.
        self.place = np.arange(length.sum()) - np.repeat(offset - first, length)
        self.kept = np.where(np.repeat(last, length) == self.place, 0, np.append(ids, 0)[self.place])
        self.array = self._sorted(test.deepest)
        self.padded = np.concatenate([self.kept, np.zeros(test.deepest + 1, dtype=np.int64)])

    def _sorted(self, depth: int) -> np.ndarray:
        """Prefix doubling: ranks by 1, 2, 4 ... words, until all differ or `depth` words are compared."""
        rank, k = self.kept, 1
        n = len(rank)
        while n and k < depth:
            after = np.concatenate([rank[k:], np.zeros(min(k, n), dtype=np.int64)])[:n]
            _, rank = np.unique(rank * (int(rank.max()) + int(after.max()) + 2) + after, return_inverse=True)
            rank = rank + 1
            if rank.max() == n:
                break
            k *= 2
        return np.argsort(rank, kind="stable")

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        """First place in [lo, hi) whose suffix has a word >= (after: >) `word` at the depth."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            there = self.padded[self.array[np.where(open_, mid, 0)] + depth]
            less = open_ & ((there <= word) if after else (there < word))
            hi = np.where(open_ & ~less, mid, hi)
            lo = np.where(less, mid + 1, lo)
        return lo

    def search(self, test: TestSuffixes, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each test suffix: the array's range of its window's occurrences, its longest match's length, and a place in the array of that match.

        reach: words of the shard; each place is raised to the length of the longest match of a window or more that begins there.
        """
        n = len(test.words)
        from_, to = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        longest, where = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        live = np.arange(n) if len(self.array) else np.arange(0)
        spans = [np.zeros((3, 0), dtype=np.int64)]
        lo, hi, depth = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(self.array)), 0
        while len(live):
            word = test.words[live + depth]
            low, high = self._bound(lo, hi, depth, word, False), self._bound(lo, hi, depth, word, True)
            if reach is not None:
                left = (0 < test.window[live]) & (test.window[live] <= depth) & ((lo < low) | (high < hi))
                spans.append(distinct_spans(depth, lo[left], hi[left]))
            depth += 1
            more = low < high
            live, lo, hi = live[more], low[more], high[more]
            longest[live], where[live] = depth, lo
            full = test.window[live] == depth
            from_[live[full]], to[live[full]] = lo[full], hi[full]
            more = test.left[live] > depth
            if reach is not None:
                ended = ~more & (0 < test.window[live])
                spans.append(distinct_spans(depth, lo[ended], hi[ended]))
            live, lo, hi = live[more], lo[more], hi[more]
        if reach is not None:
            at = self.place[self.array]
            reach[at] = np.maximum(reach[at], deepest(len(at), np.concatenate(spans, axis=1)))
        return from_, to, longest, where


def distinct_spans(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows depth, lo, hi of the different ranges; equal suffixes have equal ones."""
    lo, hi = np.unique(np.stack([lo, hi]), axis=1)
    return np.stack([np.full(len(lo), depth), lo, hi])


def deepest(n: int, spans: np.ndarray) -> np.ndarray:
    """For each of n places the greatest depth of a span over it, else 0.

    A span is told to two spans of a power of two; these are halved, longest first, down to single places: time doesn't grow with the spans' overlap.
    """
    depth, lo, hi = spans
    level, cover = np.frexp((hi - lo).astype(float))[1] - 1, np.zeros(n, dtype=np.int64)
    for k in range(int(level.max(initial=-1)), -1, -1):
        mine = np.flatnonzero(level == k)
        np.maximum.at(cover, lo[mine], depth[mine])
        np.maximum.at(cover, hi[mine] - (1 << k), depth[mine])
        if k:
            half, upper = 1 << (k - 1), cover.copy()
            np.maximum(cover[half:], upper[:-half], out=cover[half:])
    return cover


def within(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, hi), one range after the other."""
    count = hi - lo
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)


def scan_shard(texts: list[bytes], blocks: list[TestSuffixes]) -> tuple[np.ndarray, np.ndarray, list[set[str]], np.ndarray, np.ndarray]:
    """Of each text: words, words inside a window's occurrence, the items with occurring windows, length and first place of its longest match. blocks: may build them one at a time."""
    n_hit, items, n_words, hit = np.zeros(len(texts), dtype=np.int64), [set() for _ in texts], None, None
    longest, first = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), -1)
    for test in blocks:
        shard = ShardSuffixes(texts, test)
        n_words, starts = shard.n_words, shard.starts
        if hit is None:
            hit = np.zeros(int(starts[-1] + n_words[-1]) + 2, dtype=np.int32)
            reach = np.zeros(len(hit), dtype=np.int32)
        from_, to, _, _ = shard.search(test, reach)
        found = np.flatnonzero(to > from_)
        if not len(found):
            continue
        # Equal windows have one range of the array: each occurrence is visited once, whatever the number of items with that window.
        ranges, same = np.unique(np.stack([from_[found], to[found], test.window[found]]), axis=1, return_inverse=True)
        which = np.repeat(np.arange(ranges.shape[1]), ranges[1] - ranges[0])
        rows = shard.place[shard.array[within(ranges[0], ranges[1])]]
        np.add.at(hit, rows, 1)
        np.add.at(hit, rows + ranges[2][which], -1)
        of = np.searchsorted(starts, rows, side="right") - 1
        having: dict[int, set[str]] = {}
        for k, suffix in zip(same.ravel(), found, strict=True):
            having.setdefault(int(k), set()).add(test.items[test.item[suffix]])
        for doc, k in np.unique(np.stack([of, which]), axis=1).T:
            items[doc] |= having[int(k)]
    if hit is not None:
        inside = np.concatenate([[0], np.cumsum(np.cumsum(hit) > 0)])
        n_hit = inside[starts + n_words] - inside[starts]
        rows = np.flatnonzero(reach)
        rows = rows[np.lexsort((rows, -reach[rows]))]
        of, at = np.unique(np.searchsorted(starts, rows, side="right") - 1, return_index=True)
        longest[of], first[of] = reach[rows[at]], rows[at] - starts[of]
    return n_words, n_hit, items, longest, first


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the items (item_id, text), each of about block_bytes at most."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    sc = benchmark.sparkSession.sparkContext
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [sc.broadcast([(r.item, bytes(r.text)) for r in items.where(block == k).orderBy("item", "text").toLocalIterator()]) for k in range(n)]


def contamination(text: Column, benchmark: DataFrame, width: int = WIDTH) -> Column:
    """Struct n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest verbatim match of a window or more, else 0), longest_at (its first word, from 0, smallest; else null) of a text column."""
    sent = benchmark_blocks(bounded_batches(benchmark))

    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at"]

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only = [TestSuffixes(sent[0].value, width)] if len(sent) == 1 else None

        def blocks():
            for part in sent:
                yield TestSuffixes(part.value, width)
                part.__dict__.pop("_value", None)  # one block in memory at a time

        for batch in trimmed(batches):
            texts = [t or b"" for t in batch]
            rows = []
            for a, b in slices([len(t) for t in texts], SHARD_BYTES):
                for n_words, n_hit, items, longest, first in zip(*scan_shard(texts[a:b], only or blocks()), strict=True):
                    rows.append((n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0, longest, first if longest else None))
            found = pd.DataFrame(rows, columns=names)
            yield found.astype({"longest_at": "Int64"})

    return scan(text.cast("binary"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and what contamination() says, one row for each row of docs."""
    return docs.select("doc_id", contamination(F.col("text"), benchmark, width).alias("found")).select("doc_id", "found.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WIDTH) -> DataFrame:
    """item_id, item_word, length, doc_id, doc_word: for each suffix of an item its longest verbatim match over all shards, if of `least` words at least; ties to the smallest doc_id and place."""
    sent = benchmark_blocks(benchmark)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            ids = batch.column(0)
            for a, b in slices([len(t) for t in texts], SHARD_BYTES):
                for part in sent:
                    test = TestSuffixes(part.value, 1)
                    shard = ShardSuffixes(texts[a:b], test)
                    _, _, longest, where = shard.search(test)
                    found = np.flatnonzero(longest >= least)
                    if len(found):
                        rows = shard.place[shard.array[where[found]]]
                        of = np.searchsorted(shard.starts, rows, side="right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([test.items[i] for i in test.item[found]], pa.string()), pa.array(test.at[found]), pa.array(longest[found]), ids.take(pa.array(of + a)), pa.array(rows - shard.starts[of])],
                            names=["item_id", "item_word", "length", "doc_id", "doc_word"],
                        )

    found = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(search, f"item_id string, item_word long, length long, doc_id {id_type}, doc_word long")
    best = F.min(F.struct((-F.col("length")).alias("length"), "doc_id", "doc_word"))
    return found.groupBy("item_id", "item_word").agg(best.alias("b")).select("item_id", "item_word", (-F.col("b.length")).alias("length"), "b.doc_id", "b.doc_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    return docs.where(~contamination(F.col("text"), benchmark, width)["contaminated"])


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item, r, i AS j, w[i:i + least(len(w), 10) - 1] AS win
  FROM (SELECT item, r, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
grams AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, i, n, item, r, j FROM grams JOIN windows USING (win)),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, r, i - j ORDER BY i) AS run FROM found),
matches AS (SELECT doc_id, min(i) - 1 AS pos, count(*) + max(n) - 1 AS words FROM runs GROUP BY doc_id, r, i - j, run),
longest AS (SELECT doc_id, max(words) AS longest, arg_min(pos, row(-words, pos)) AS longest_at FROM matches GROUP BY doc_id),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(longest_at AS BIGINT) AS longest_at
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
