"""Join of texts by the Jaccard similarity of their word n-grams, as a blocked sparse product of the (text, n-gram) incidence matrix with itself.

Equal sets are one row of the matrix (a node). Bounds from the sizes keep the product sparse: at similarity t, the first
n - ceil(t n) + 1 of a node's n n-grams, in one order for all nodes, hold the first n-gram it shares with any partner. Only these columns are
multiplied; n-grams that many nodes have there are put last in the order first, which empties most long columns. Two prefixes that share c
n-grams bound the overlap by c + max(n - prefix) of the two: pairs whose count c leaves this below what their sizes need are discarded.

Components need a spanning set of links, not all of them. So a long column first only pairs each node with the column's smallest one, and of these
pairs each node keeps the one with the highest count. Short columns pair all their nodes. Nodes that such pairs, or long columns
whose nodes are not in one component yet, connect are a cluster. A small cluster is multiplied whole; a large one is cut into blocks of
nodes by size, and each pair of blocks that can hold new links is multiplied in one task, which returns links that connect its nodes. All similarities are exact, in whole numbers.

Defined cases: null, empty and blank texts have no set, link with nothing and are their own component; texts of fewer than n words have
one n-gram of all their words; repeated rows and equal texts are one node; null ids take part, and a component's id is the smallest
that isn't null; other columns stay, whatever their names. A very long text is held whole by one task, with 24 bytes a word. N-grams and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_skewed, marked, pieces, placed, scratch, slices, small, trimmed, written
from .components import components
from .frequency import at_most

WIDTH, PERCENT = 4, 85
#: N-grams of more nodes are put last in the order, LAST of them at most; a column of more nodes than LONG is long.
DENSE, LAST, LONG = 64, 1 << 18, 256
#: Nodes and n-grams in a block, about; bytes of text handled at once.
BLOCK, BLOCK_GRAMS, SHARD_BYTES = 1024, 1 << 18, 2 << 20
#: Sets that share a member up to which it is counted pair by pair at least; columns of a dense product, and pairs that are counted, at once.
SHORT_COLUMN, COLUMNS, COUNTED = 8, 4096, 1 << 21
#: Prefix n-grams that a task counts at once.
HELD = 1 << 20
#: Bits at most of a bitmap of texts to read; pairs of one node that a task compares, about.
MOST_BITS, PARTNERS = 1 << 27, 256
#: Parts of a column of a dense n-gram.
PARTS = 64
BETWEEN = b"\xff"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> pa.BinaryArray:
    """The words of a text, between runs of ASCII white space."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = (data != 32) & (data - np.uint8(9) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    ends = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[inside[1:-1]])])


class WordHashes:
    """Hash of each word of a text. Only the distinct ones are Python objects; none is kept."""

    def __call__(self, text: bytes) -> np.ndarray:
        words = words_of(text).dictionary_encode()
        told = words.dictionary.to_numpy(zero_copy_only=False)
        return np.fromiter(map(xxhash.xxh3_64_intdigest, told), dtype=np.uint64, count=len(told))[words.indices.to_numpy()]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values of some."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    values = [np.zeros(0, np.uint64)]
    for piece in pieces(BETWEEN.join(b" " + t.replace(BETWEEN, b"\xfe").lower() + b" " for t in texts)):
        values.append(hashes(piece))
    values = np.concatenate(values)
    bounds = np.flatnonzero(values == hashes(BETWEEN)[0])
    grams = np.full(max(0, len(values) - width + 1), width, dtype=np.uint64)
    for j in range(width):
        grams = grams * _STEP + values[j : j + len(grams)]
    grams = mixed(grams)
    for start, end in zip([0, *(bounds + 1)], [*bounds, len(values)], strict=True):
        n = end - start
        if n >= width:
            yield distinct(grams[start : end - width + 1])
        elif n:
            short = np.full(1, n, dtype=np.uint64)
            for v in values[start:end]:
                short = short * _STEP + v
            yield mixed(short)
        else:
            yield grams[:0]


def node_of(grams: np.ndarray) -> int:
    """Number of a set: a hash of its members, as a signed 64-bit number."""
    h = xxhash.xxh3_64_intdigest(grams.tobytes())
    return h - (1 << 64) if h >> 63 else h


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Order:
    """One order of all n-grams for all nodes: by hash, but those of `last` after the others, by their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        place = np.argsort(grams)
        self.grams, self.rank = grams[place], np.argsort(np.argsort(counts[place], kind="stable"))

    def has(self, grams: np.ndarray) -> np.ndarray:
        """Whether each n-gram is one of `last`."""
        if not len(self.grams):
            return np.zeros(len(grams), dtype=bool)
        return self.grams[np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)] == grams

    def first(self, grams: np.ndarray, k: int) -> np.ndarray:
        """The first k of sorted distinct n-grams."""
        if not len(self.grams):
            return grams[:k]
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        last = self.grams[at] == grams
        early = grams[~last]
        if len(early) >= k:
            return early[:k]
        return np.concatenate([early, grams[last][np.argsort(self.rank[at[last]], kind="stable")[: k - len(early)]]])


def _shards(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in trimmed(batches):
        texts = [t or b"" for t in batch.column(column).to_pylist()]
        for a, b in slices([len(t) for t in texts], SHARD_BYTES):
            yield batch.slice(a, b - a), texts[a:b]


def node_table(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Two kinds of rows. doc_id, file, at, n_shingles, node (null if there is none) of each text; and gram, n: n-grams that several texts
    of a task have in their prefixes by hash order alone, and how many do."""
    id_type = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "file", "at", "n_shingles", "node", "gram", "n"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), []
        kind = None
        for batch, raw in _shards(batches, 0):
            sets = list(shingle_sets(raw, width, hashes))
            kind = batch.column(1).type
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), none, none], names=names)
            held.append(np.concatenate([s[: prefix_size(len(s), percent)] for s in sets if len(s)] or [np.zeros(0, np.uint64)]))
            if sum(map(len, held)) > HELD:
                yield several(held, kind)
        if held:
            yield several(held, kind)

    def several(held: list[np.ndarray], kind) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        grams, n = grams[n > 1], n[n > 1]
        none = pa.nulls(len(grams), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(len(grams), kind), pa.nulls(len(grams), pa.string()), none, none, none, pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=names)

    return texts.select("text", "doc_id", "file", "at").mapInArrow(find, f"doc_id {id_type}, file string, at long, n_shingles long, node long, gram long, n long")


def prefix_rows(texts: DataFrame, width: int, percent: int, order) -> DataFrame:
    """gram, node, n, dense (whether the n-gram is one of those put last): the entries of the matrix that are multiplied. order: broadcast."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, raw in _shards(batches, 0):
            seen: dict[int, tuple[int, np.ndarray]] = {}
            for s in shingle_sets(raw, width, hashes):
                if len(s) and (node := node_of(s)) not in seen:
                    seen[node] = (len(s), order.value.first(s, prefix_size(len(s), percent)))
            many = np.array([len(p) for _, p in seen.values()], dtype=np.int64)
            grams = np.concatenate([p for _, p in seen.values()]) if seen else np.zeros(0, np.uint64)
            n = np.repeat(np.array([n for n, _ in seen.values()], dtype=np.int32), many)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.repeat(np.array(list(seen), dtype=np.int64), many)), pa.array(n), pa.array(order.value.has(grams))], names=["gram", "node", "n", "dense"])

    return texts.select("text").mapInArrow(rows, "gram long, node long, n int, dense boolean")


def may_link(a_n, b_n, shared, percent: int):
    """Bounds from sizes: the smaller set is large enough, and `shared` n-grams of both prefixes and all outside one can reach the overlap needed."""
    a, b = a_n.cast("long"), b_n.cast("long")
    rest = F.greatest(*(F.call_function("div", percent * n + 99, F.lit(100).cast("long")) - 1 for n in (a, b)))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * (shared + rest) >= percent * (a + b))


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: the pairs (u, v) whose sets (node, grams) are similar enough."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([links(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x, y, strict=True)], dtype=bool)

    # A node that many pairs begin with is dealt to several tasks, with its set; such nodes, PARTNERS pairs and more each, are few.
    shares = written(pairs.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > PARTNERS).select("u", F.ceil(F.col("n") / PARTNERS).alias("shares")), "shares")
    share = F.coalesce("shares", F.lit(1))
    left = sets.join(small(shares), F.col("node") == F.col("u"), "left").select(F.col("node").alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), share - 1)).alias("share"), F.col("grams").alias("u_grams"))
    right = sets.select(F.col("node").alias("v"), F.col("grams").alias("v_grams"))
    dealt = pairs.join(small(shares), "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), share).alias("share"))
    return dealt.join(right, "v").join(left, ["u", "share"]).where(similar("u_grams", "v_grams")).select("u", "v")


def key_bitmap(keys: DataFrame) -> tuple[int, np.ndarray]:
    """Number of bits and bitmap of the keys (key: long) modulo that: 64 bits a key or more, MOST_BITS at most."""
    bits = 1 << 20
    n = keys.count()
    while bits < min(64 * n, MOST_BITS):
        bits *= 2
    at = F.pmod("key", F.lit(bits)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).toLocalIterator()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.m), dtype=np.uint8)
        out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(part)] = part
    return bits, out


def sets_of(nodes: DataFrame, texts: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """node, grams of the nodes (node) and perhaps a few others, computed again from one text of each. A bitmap of bounded size tells which
    texts to read; no text is shuffled. table: file, at, node of all texts."""
    key = F.xxhash64("file", "at")
    chosen = table.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min(key).alias("key"))
    bits, bitmap = key_bitmap(written(chosen.select("key"), "keys"))
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at = batch.column(1).to_numpy()
            asked = batch.filter(pa.array((sent.value[at >> 3] >> (at & 7)) & 1 == 1))
            for _, raw in _shards([asked], 0):
                sets = list(shingle_sets(raw, width, hashes))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    return texts.select("text", F.pmod(key, F.lit(bits)).alias("at")).mapInArrow(find, "node long, grams binary")


def packs(rows: DataFrame) -> DataFrame:
    """key, cluster, node, component of clusters within the bounds of a block (rows: cluster, node, n, component): whole clusters, many to a key."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    return rows.select(F.pmod(F.xxhash64("cluster"), F.lit(max(1, math.ceil(total / BLOCK_GRAMS)))).alias("key"), "cluster", "node", "component")


def block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """key, cluster, node, component of larger clusters: a key for each pair of blocks that can hold new links, and a row for each node of both.

    Blocks are of one size class each; sets of classes that aren't neighbours can't be similar enough. Large components get blocks of their
    own: these need not meet themselves or each other.
    """
    ratio = math.log(100 / percent)
    # A hair wide, so that rounding puts no pair at the very bound two classes apart.
    classed = rows.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio * (1 + 1e-9))).cast("int"))
    large = classed.groupBy("cluster", "size_class", "component").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    large = large.withColumn("own", F.when((F.col("m") > BLOCK // 2) | (F.col("grams") > BLOCK_GRAMS // 2), F.col("component")).otherwise(F.lit(0).cast("long")))
    key = ["cluster", "size_class", "own"]
    parts = large.groupBy(*key).agg(F.greatest(F.ceil(F.sum("m") / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("parts"))
    blocks = written(parts.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    ahead = F.struct("a.own", "a.part") <= F.struct("b.own", "b.part")
    near = (F.col("a.cluster") == F.col("b.cluster")) & ((F.col("a.size_class") == F.col("b.size_class")) & ahead | (F.col("a.size_class") + 1 == F.col("b.size_class")))
    useful = (F.col("a.own") == 0) | (F.col("a.own") != F.col("b.own"))
    sides = [F.struct(*(F.col(f"{x}.{c}").alias(c) for c in ("size_class", "own", "part"))) for x in "ab"]
    pair = F.xxhash64("a.cluster", *(F.col(f"{x}.{c}") for x in "ab" for c in ("size_class", "own", "part"))).alias("key")
    both = F.when(sides[0] == sides[1], F.array(sides[0])).otherwise(F.array(*sides))
    pairs = a.join(b, near & useful).select(F.col("a.cluster").alias("cluster"), pair, F.explode(both).alias("x")).select("cluster", "key", "x.size_class", "x.own", "x.part")
    placed = classed.join(large.select("cluster", "size_class", "component", "own"), ["cluster", "size_class", "component"]).join(parts, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return placed.join(pairs, [*key, "part"]).select("key", "cluster", "node", "component")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share. Members of one set only are left out; those of a few sets are counted pair by pair, only those of
    many sets (an eighth of all) are columns of a dense product. So the work goes by what is shared, not by how many members there are."""
    n = len(sets)
    members, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(members, kind="stable")
    members, row = members[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], members[1:] != members[:-1]])[: len(members)])
    many = np.diff(np.append(start, len(members)))
    shared = np.zeros((n, n), dtype=np.float32)
    full = max(SHORT_COLUMN, n // 8)
    wide = np.flatnonzero(many > full)
    for x in range(0, len(wide), COLUMNS):
        of = wide[x : x + COLUMNS]
        block = np.zeros((n, len(of)), dtype=np.float32)
        column = np.repeat(np.arange(len(of)), many[of])
        block[row[np.arange(len(column)) + np.repeat(start[of] - np.cumsum(many[of]) + many[of], many[of])], column] = 1
        shared += block @ block.T
    shared = shared.astype(np.int64)
    for c in np.unique(many[(many > 1) & (many <= full)]):
        # Rows of a column ascend, as the sort is stable.
        rows, (i, j) = row[start[many == c][:, None] + np.arange(c)], np.triu_indices(c, 1)
        step = max(1, COUNTED // len(i))
        for x in range(0, len(rows), step):
            pairs, times = np.unique((rows[x : x + step, i] * n + rows[x : x + step, j]).ravel(), return_counts=True)
            shared.ravel()[pairs] += times
    return np.maximum(shared, shared.T)


def connecting(nodes: np.ndarray, components: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the nodes (pairs) that connect all components that their links connect."""
    shared, size, parent, out = overlaps(sets), np.array([len(s) for s in sets]), {}, []

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    i, j = np.nonzero(np.triu(100 * shared >= percent * (size[:, None] + size - shared), 1))
    # One link of each two components will do.
    component = np.unique(components, return_inverse=True)[1]
    low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
    first = np.unique(low * len(nodes) + high, return_index=True)[1]
    for k in first[low[first] != high[first]]:
        x, y = root(low[k]), root(high[k])
        if x != y:
            parent[x] = y
            out.append((nodes[i[k]], nodes[j[k]]))
    return out


def multiplied(places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: of the nodes that share a key and a cluster (key, cluster, node, component), links that connect all components that their links connect."""

    def multiply(group: pd.DataFrame) -> list[tuple[int, int]]:
        return connecting(group["node"].to_numpy(), group["component"].to_numpy(), [np.frombuffer(g, np.uint64) for g in group["grams"]], percent)

    def each(group: pd.DataFrame) -> pd.DataFrame:
        out = [link for _, rows in group.drop_duplicates(["cluster", "node"]).groupby("cluster") if len(rows) > 1 for link in multiply(rows)]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return sets.join(small(places), "node").groupBy("key").applyInPandas(each, "u long, v long")


def link_components(rows: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, file, at, n_shingles, node, component of each of rows (see placed(); doc_id, text); node and component are null for rows without a set."""
    spark = rows.sparkSession
    texts = bounded_batches(rows).select("row.doc_id", F.col("row.text").cast("binary").alias("text"), "file", "at")
    both = written(node_table(texts, width, percent), "nodes")
    table = both.where("gram IS NULL").select("doc_id", "file", "at", "n_shingles", "node")
    counts = written(both.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > DENSE), "columns")
    last = counts.where(at_most(counts, F.col("n"), LAST)).toArrow()
    order = spark.sparkContext.broadcast(Order(last.column(0).to_numpy().view(np.uint64), last.column(1).to_numpy()))
    # Columns of dense n-grams may be long: they are cut into parts by node, so that no task has a whole one, and put together from these.
    part = F.when(F.col("dense"), F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    by = Window.partitionBy("gram", "part").orderBy("n", "node")
    whole = Window.partitionBy("gram", "part").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    star = F.first(F.struct("n", "node")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    columns = prefix_rows(texts, width, percent, order).withColumn("part", part).withColumns({"star": star, "place": F.dense_rank().over(by)})
    columns = written(columns.withColumn("nodes", F.max("place").over(whole)).where("dense OR nodes > 1").select("gram", "node", "n", "dense", "star", "nodes", "part").distinct(), "live")
    per = columns.where("dense").groupBy("gram", "part").agg(F.min("star").alias("star"), F.max("nodes").alias("nodes")).groupBy("gram").agg(F.min("star").alias("star"), F.sum("nodes").cast("int").alias("nodes"))
    live = columns.where("NOT dense").drop("dense", "part").unionByName(columns.where("dense").drop("dense", "part", "star", "nodes").join(F.broadcast(written(per.where("nodes > 1"), "dense")), "gram"))
    tried = live.where((F.col("nodes") > LONG) & (F.col("node") != F.col("star.node"))).groupBy("node", "n", "star").agg(F.count("*").alias("shared")).where(may_link(F.col("n"), F.col("star.n"), F.col("shared"), percent))
    tried = written(tried.groupBy("node").agg(F.max_by("star.node", F.struct("shared", "star.node")).alias("u")).select("u", F.col("node").alias("v")), "stars")
    first = written(verified(tried, written(sets_of(ends(tried), texts, table, width), "sets"), percent), "links")
    found = components(first)
    # Short columns: pairs by their number of shared n-grams. A pair that shares long columns too is undercounted here, but is compared there.
    short = live.where(F.col("nodes") <= LONG)
    a, b = short.select("gram", "node", "n").alias("a"), short.select("gram", "node", "n").alias("b")
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.node") < F.col("b.node")) & (100 * F.least("a.n", "b.n").cast("long") >= percent * F.greatest("a.n", "b.n").cast("long")))
    pairs = met.groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.n").alias("un"), F.col("b.n").alias("vn")).agg(F.count("*").alias("shared"))
    pairs = apart(pairs.where(may_link(F.col("un"), F.col("vn"), F.col("shared"), percent)).select("u", "v", "un", "vn"), found)
    # Long columns: those whose nodes the stars have not put in one component.
    wide = live.where(F.col("nodes") > LONG).select("gram", "node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    wide = written(wide, "wide")
    several = wide.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("hub"), F.count("*").alias("n")).where("low <> high")
    wide = written(join_skewed(wide.withColumnRenamed("n", "size"), several.select("gram", "hub", "n"), "gram", wide.count()).withColumnRenamed("size", "n"), "wide")
    # Nodes that pairs or long columns connect are a cluster. Small ones are compared whole; large ones in blocks, if long columns or many pairs ask for it.
    cluster = components(pairs.select("u", "v").unionByName(wide.select(F.col("node").alias("u"), F.col("hub").alias("v"))))
    ends_ = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("un").alias("n")), F.struct(F.col("v").alias("node"), F.col("vn").alias("n")))).alias("x")
    size = pairs.select(ends_).select("x.*").unionByName(wide.select("node", "n")).groupBy("node").agg(F.first("n").alias("n"))
    members = cluster.withColumnRenamed("component", "cluster").join(size, "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = written(members, "members")
    lists = pairs.join(members, pairs["u"] == members["node"]).groupBy("cluster").agg(F.count("*").alias("pairs"))
    spread = wide.select("node").join(members, "node").select("cluster", F.lit(True).alias("long")).distinct()
    whole = members.groupBy("cluster").agg(F.count("*").alias("nodes"), F.sum("n").alias("grams")).join(lists, "cluster", "left").join(spread, "cluster", "left")
    dense = F.coalesce("long", F.lit(False)) | (F.coalesce("pairs", F.lit(0)) > F.col("nodes") * F.ceil(F.col("nodes") / BLOCK))
    kind = F.when((F.col("nodes") <= BLOCK) & (F.col("grams") <= BLOCK_GRAMS), "pack").when(dense, "blocks").otherwise("pairs")
    kinds = written(whole.select("cluster", kind.alias("kind"), F.col("nodes").alias("n")), "kinds")
    members = written(join_skewed(members.withColumnRenamed("n", "size"), kinds, "cluster", members.count()).withColumnRenamed("size", "n"), "members")
    few = written(pairs.join(members.where("kind = 'pairs'").select(F.col("node").alias("u")), "u", "left_semi").select("u", "v"), "few")
    places = written(packs(members.where("kind = 'pack'")).unionByName(block_pairs(members.where("kind = 'blocks'"), percent)), "places")
    sets = written(sets_of(members.select("node"), texts, table, width), "sets")
    second = multiplied(places, sets, percent)
    if not few.isEmpty():
        second = second.unionByName(verified(few, sets.join(small(written(ends(few).distinct(), "ends")), "node", "left_semi"), percent))
    final = components(written(first.unionByName(second), "links"))
    return table.join(final, "node", "left").select("doc_id", "file", "at", "n_shingles", "node", F.coalesce("component", "node").alias("component"))


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (u, v, ...) whose ends are not in one component (node, component) yet."""
    for c in "uv":
        pairs = pairs.join(found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component")), c, "left")
    same = F.coalesce("u_component", "u") == F.coalesce("v_component", "v")
    return written(pairs.where(~same).drop("u_component", "v_component"), "pairs")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node"))


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    with scratch(docs.sparkSession):
        found = written(link_components(placed(docs), width, percent), "components", keep=True)
    linked = found.where("component IS NOT NULL")
    least = written(linked.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    named = join_skewed(linked, least, "component", found.count()).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return named.unionByName(found.where("component IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row for each component, of its smallest id (nulls last), and of that the first in storage; rows without a set all stay. No row is shuffled."""
    rows = placed(docs)
    with scratch(docs.sparkSession):
        found = written(link_components(rows, width, percent), "components", keep=True)
    found = found.where("component IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "at")
    kept = found.groupBy("component").agg(F.min(place).alias("kept"), F.count("*").alias("many")).where("many > 1")
    gone = join_rows(found, kept).where((F.col("file") != F.col("kept.file")) | (F.col("at") != F.col("kept.at")))
    return marked(rows, gone.select("file", "at", F.lit(1).alias("mark"))).where("mark = 0").select("row.*")


def join_rows(found: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of found with kept (component, kept, many) of their component; large components are not in one task."""
    kept = written(kept, "kept").withColumnRenamed("many", "n")
    return join_skewed(found, kept, "component", kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') || '/' || least(len(w), 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM overlap JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
