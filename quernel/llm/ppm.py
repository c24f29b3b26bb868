"""Language-model scoring: prediction by partial matching over bytes, beside a smoothed unigram baseline.

Counts of all byte contexts up to ORDER bytes are gathered from every training text, and all of them are kept, in written tables. A byte that a context
has not seen costs an escape (method C: as likely as the context's number of distinct bytes), and the next shorter context then excludes the bytes
that the longer one has seen. As a node's excluded bytes only depend on the node escaped from, both denominators are computed once per node. Each
distinct window (the last ORDER + 1 bytes) of all texts is scored once, beside those with a like end; the scores of the most frequent ones are broadcast and
summed where the text is read, the other ones are joined to the texts. Texts begin after ORDER marks and end with a mark, which is coded like a byte.

train() makes one trie of the most frequent nodes only; what it leaves out goes to escapes. op9 doesn't use it.

Defined cases: null text is the empty text, which costs its end mark; with no training text bytes are equally likely and the baseline is 0;
repeated rows repeat their result (rows are told apart by their place, so the input is to be a table); other columns play no part; a very long text is
read in pieces of SHARD_BYTES, its words in pieces of about PIECE_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, scratch, slices, trimmed, written
from .frequency import at_most, count_tokens, join_frequencies, key_of, parts

ORDER = 6
#: Nodes of a trie in memory at most; windows that a task sorts at once, and counts that it holds before it passes them on; bytes handled at once.
NODES, HELD, MERGED, SHARD_BYTES = 1 << 20, 1 << 23, 1 << 22, 1 << 20
#: Tokens whose baseline values are broadcast.
HOT = 1 << 18
#: Windows whose scores are broadcast; the other ones' are joined.
HOT_WINDOWS = 1 << 21
#: Bytes at a context's end by which windows meet to be scored; windows scored together.
SUFFIX, TOGETHER = 3, 1 << 18
#: Windows of one such end that meet in a task at most; ends of more windows are lengthened.
HEAVY = 1 << 21
MARK, ALPHABET = 0xFF, 256  # no UTF-8 text has this byte
#: Digits of scores: sums of floats depend on their order in the last ones.
DIGITS = 9
#: Ends each text's words in the baseline; no word holds white space.
END = b"\n"


def windows(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The last order + 1 bytes at each byte and end mark of all texts, as numbers, and how many each text has."""
    return windows_at([bytes([MARK]) * order + t.replace(b"\xff", b"\xfe") + bytes([MARK]) for t in texts], order)


def shards(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """windows() of a list of texts, about SHARD_BYTES at once, however long a text is: windows, how many each text has, numbers of the texts."""
    for a, b in slices([len(t) for t in texts], SHARD_BYTES):
        if b - a > 1 or len(texts[a]) <= SHARD_BYTES:
            yield *windows(texts[a:b], order), np.arange(a, b)
            continue
        whole = bytes([MARK]) * order + texts[a].replace(b"\xff", b"\xfe") + bytes([MARK])
        for i in range(order, len(whole), SHARD_BYTES):
            yield *windows_at([whole[i - order : i + SHARD_BYTES]], order), np.array([a])


def windows_at(coded: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of byte strings that begin with `order` bytes of context."""
    data = np.frombuffer(b"".join(coded), dtype=np.uint8)
    lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) - order
    keys = np.zeros(len(data) - order, dtype=np.uint64)
    for j in range(order + 1):
        keys = (keys << np.uint64(8)) | data[j : len(data) - order + j]
    starts = np.cumsum(lengths + order) - (lengths + order)
    inside = np.ones(len(keys), dtype=bool)  # all but windows that reach from one text into the marks before the next
    for j in range(order):
        inside[starts[1:] - order + j] = False
    return keys[inside], lengths


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_windows(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """key (window as a number), n (count in the texts learned from), seen (count in all) of texts (a binary column, and whether it is learned from).

    A task fills an array of HELD windows, sorts it and merges the counts with those before; it passes them on when they are of more than MERGED windows, or
    the last. So they are not summed again before the shuffle.
    """
    one = np.uint64(1)  # a window has 7 bytes at most, so it can be shifted: the last bit tells the texts not learned from

    def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys.sort()
        bare = keys >> one
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(bare)), dtype=bool), bare[1:] != bare[:-1]]))
        seen = np.diff(np.append(first, len(bare)))
        other = np.add.reduceat((keys & one).astype(np.int64), first) if len(first) else seen
        return bare[first], np.stack([seen - other, seen], axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full, known = np.empty(HELD, dtype=np.uint64), 0, []

        def rows() -> pa.RecordBatch:
            key, counts = known.pop()
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *(pa.array(np.ascontiguousarray(counts[:, i])) for i in (0, 1))], names=["key", "n", "seen"])

        def put() -> None:
            known.append(counted(held[:full]))
            if len(known) == 2:
                known[:] = [merged(*map(list, zip(*known, strict=True)))]

        for batch in (part for whole in trimmed(batches) for part in parts(whole, 0)):
            raw, learned = [t or b"" for t in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False)
            for keys, lengths, of in shards(raw, order):
                keys = keys << one | np.repeat((~learned[of].astype(bool)).astype(np.uint64), lengths)
                while len(keys):
                    new = keys[: len(held) - full]
                    held[full : full + len(new)] = new
                    keys, full = keys[len(new) :], full + len(new)
                    if full == len(held):
                        put()
                        full = 0
                        if len(known[0][0]) > MERGED:
                            yield rows()
        put()
        yield rows()

    return bounded_batches(texts).mapInArrow(count, "key long, n long, seen long").repartition("key").groupBy("key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def last_bytes(key: Column, n: Column | int) -> Column:
    """The last n (0 to 8) bytes of a number."""
    kept = F.array(*(F.lit((1 << 8 * k) - 1 if k < 8 else -1).cast("long") for k in range(9)))
    return key.bitwiseAND(F.element_at(kept, (n if isinstance(n, Column) else F.lit(n)).cast("int") + 1))


def context(key: Column) -> Column:
    return F.shiftrightunsigned(key, 8)


def all_contexts(whole: DataFrame, order: int = ORDER) -> DataFrame:
    """size (context's bytes), key (context and byte as a number), n: the sums of the longest windows (key, n) give the shorter ones."""
    size = F.explode(F.sequence(F.lit(0), F.lit(order - 1)))
    shorter = whole.select(size.alias("size"), "key", "n").groupBy("size", last_bytes(F.col("key"), F.col("size") + 1).alias("key")).agg(F.sum("n").alias("n"))
    return shorter.unionByName(whole.select(F.lit(order).alias("size"), "key", "n"))


def count_contexts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """size, key, n (see all_contexts) over all texts (one binary column). Only the longest windows are counted in the texts and shuffled."""
    return all_contexts(written(count_windows(texts.select(texts.columns[0], F.lit(True)), order), "windows"), order)


def heavy_suffixes(counted: DataFrame, low: int, order: int, most: int) -> dict[int, DataFrame]:
    """By their bytes, from `low` on, the ends of contexts (suffix) that more than `most` windows have; of the longer ones only those whose shorter one is heavy too."""
    found: dict[int, DataFrame] = {}
    rows = counted.select(context(F.col("key")).alias("context"))
    for k in range(low, order):
        heavy = written(rows.groupBy(last_bytes(F.col("context"), k).alias("suffix")).count().where(F.col("count") > most).select("suffix"), "heavy")
        if heavy.isEmpty():
            break
        found[k] = heavy
        rows = rows.join(F.broadcast(heavy), last_bytes(F.col("context"), k) == F.col("suffix"), "left_semi")
    return found


def score_windows(counted: DataFrame, order: int = ORDER, most: int = HEAVY) -> DataFrame:
    """key, seen, score (log10 probability of the last byte after the bytes before it) of each row of counted (see count_windows), a written table. No node is left out.

    Windows whose contexts end alike meet in a task: all longer nodes that they can escape to are there, and a trie of just these is made. The
    shorter nodes, of up to SUFFIX bytes, are broadcast; their number is bounded by that of strings of so many bytes. Ends that more than `most` windows
    have are dealt by a byte more, and so on up to the whole context, which 256 windows have at most; the nodes that these then lack, 256 at most for each such end, are broadcast too.
    """
    low = min(SUFFIX, order)
    size = F.explode(F.sequence(F.lit(0), F.lit(low - 1)))
    learned = counted.where("n > 0").select("key", "n")
    some = learned.select(last_bytes(F.col("key"), low).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    shorter = some.select(size.alias("size"), "key", "n").groupBy("size", last_bytes(F.col("key"), F.col("size") + 1).alias("key")).agg(F.sum("n").alias("n"))
    dealt = counted.withColumn("deal", F.lit(low))
    for k, heavy in heavy_suffixes(counted, low, order, most).items():
        ends = last_bytes(context(F.col("key")), k) == F.col("suffix")
        nodes = learned.join(F.broadcast(heavy), ends, "left_semi").groupBy(last_bytes(F.col("key"), k + 1).alias("key")).agg(F.sum("n").alias("n"))
        shorter = shorter.unionByName(nodes.select(F.lit(k).alias("size"), "key", "n"))
        dealt = dealt.join(F.broadcast(heavy), (F.col("deal") == k) & ends, "left").withColumn("deal", F.when(F.col("suffix").isNotNull(), k + 1).otherwise(F.col("deal"))).drop("suffix")
    sent = counted.sparkSession.sparkContext.broadcast([c.to_numpy() for c in shorter.toArrow().columns])
    masks = np.array([(1 << 8 * k) - 1 for k in range(order + 1)], dtype=np.int64)

    def scored(keys: np.ndarray, n: np.ndarray, deal: int) -> np.ndarray:
        k, c = keys[n > 0], n[n > 0]
        levels = {order: (k, c)}
        for i in range(order - 1, deal - 1, -1):
            levels[i] = merged([levels[i + 1][0] & np.uint64((1 << 8 * (i + 1)) - 1)], [levels[i + 1][1]])
        known = sent.value[0] < deal
        sizes = np.concatenate([sent.value[0][known], *(np.full(len(x[0]), i, dtype=np.int64) for i, x in levels.items())])
        every = [np.concatenate([sent.value[j + 1][known], *(x[j].astype(np.int64) for x in levels.values())]) for j in (0, 1)]
        return Trie(sizes, *every, order=order).score(keys)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def rows(columns):
            key, n, seen, deal = columns
            scores = np.zeros(len(key))
            for d in np.unique(deal):
                mine = np.flatnonzero(deal == d)
                scores[mine] = scored(key[mine].astype(np.uint64), n[mine], int(d))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(seen), pa.array(scores)], names=["key", "seen", "score"])

        for batch in trimmed(batches):
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(x[0]) for x in held) >= TOGETHER:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                ends, deal = columns[0] >> 8 & masks[columns[3]], columns[3]
                cut = int(np.argmax((ends == ends[-1]) & (deal == deal[-1])))  # the last suffix may go on in the next batch
                held[:] = [[c[cut:] for c in columns]]
                if cut:
                    yield rows([c[:cut] for c in columns])
        if held:
            yield rows([np.concatenate(x) for x in zip(*held, strict=True)])

    by_end = dealt.withColumn("suffix", last_bytes(context(F.col("key")), F.col("deal"))).repartition("deal", "suffix").sortWithinPartitions("deal", "suffix")
    return by_end.select("key", "n", "seen", "deal").mapInArrow(score, "key long, seen long, score double")


def sum_windows(texts: DataFrame, scores: DataFrame, order: int = ORDER, hot: int = HOT_WINDOWS) -> DataFrame:
    """place, score: the sum over its windows for each row of texts (place, text), by scores (key, seen, score), a written table."""
    wanted = at_most(scores, F.col("seen"), hot)
    rows = scores.where(wanted).select("key", "score").toArrow()
    sent = texts.sparkSession.sparkContext.broadcast((Lookup(rows.column(0).to_numpy().astype(np.uint64)), rows.column(1).to_numpy()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, value = sent.value
        for batch in (part for whole in trimmed(batches) for part in parts(whole, 1)):
            places, raw = batch.column(0).to_numpy(), [t or b"" for t in batch.column(1).to_pylist()]
            for keys, lengths, texts_ in shards(raw, order):
                at = find.find(keys)
                sure = np.add.reduceat(np.where(at >= 0, value[np.maximum(at, 0)] if len(value) else 0.0, 0.0), np.cumsum(lengths) - lengths)
                rest = np.flatnonzero(at < 0)
                key, of = keys[rest], np.repeat(texts_, lengths)[rest]
                edges = np.searchsorted(of, np.append(texts_, texts_[-1] + 1))
                for start, end in zip(edges[:-1], edges[1:], strict=True):
                    key[start:end].sort()
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])) if len(key) else np.zeros(0, dtype=np.int64)
                freq, own = np.diff(np.append(first, len(key))), places[texts_]
                # A row for the text itself, with a key of its own that no table has.
                columns = [np.concatenate([own, places[of[first]]]), np.concatenate([-1 - own, key[first].astype(np.int64)]), np.concatenate([np.zeros(len(own), dtype=np.int64), freq]), np.concatenate([sure, np.zeros(len(first))])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["place", "key", "freq", "sure"])

    spread = bounded_batches(texts).mapInArrow(read, "place long, key long, freq long, sure double")
    joined = spread.join(scores.where(~wanted).select("key", "score"), "key", "left")
    return joined.groupBy("place").agg(F.sum(F.col("sure") + F.col("freq") * F.coalesce("score", F.lit(0.0))).alias("score"))


class Lookup:
    """Positions of numbers in a fixed set: an open-addressing table that is probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        todo, at = np.arange(len(keys)), self._hash(keys)
        while len(todo):
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slots[at[put]], self.keys[at[put]] = todo[put], keys[todo[put]]
            rest = np.ones(len(todo), dtype=bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key in the set, -1 for those not in it."""
        at = self._hash(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(todo):
            at_ = (at[todo] + 1) & self.mask
            at[todo], out[todo] = at_, self.slots[at_]
            todo = todo[(out[todo] >= 0) & (self.keys[at_] != keys[todo])]
        return out


class Trie:
    """Nodes by context size: for each (context, byte) its count; for each context its denominators, alone and after an escape from it.

    n_bytes, n_texts: all training bytes with end marks, and all training texts. What of a context's count isn't in kept nodes goes to its escape. Without
    them every context that is here has all its nodes, so its count is theirs; the node that leads to it may be missing (it has another suffix).
    """

    def __init__(self, size: np.ndarray, key: np.ndarray, n: np.ndarray, n_bytes: int | None = None, n_texts: int | None = None, order: int = ORDER):
        self.order, self.grams, self.log_n, self.contexts = order, [], [], []
        self.start, self.after = [], []
        before: dict | None = None  # of the next smaller size
        for k in range(order + 1):
            rows = np.flatnonzero(size == k)
            rows = rows[np.argsort(key[rows], kind="stable")]
            grams, counts = key[rows].astype(np.uint64), n[rows].astype(np.float64)
            contexts, of = np.unique(grams >> np.uint64(8), return_inverse=True)
            kept, distinct = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(np.float64)
            if n_bytes is None:
                total = kept
            elif before is None:
                total = np.full(len(contexts), float(n_bytes))
            else:  # a context's count is that of the node that leads to it; that of marks alone, the number of texts
                place = np.minimum(np.searchsorted(before["grams"], contexts), len(before["grams"]) - 1)
                total = np.where(contexts == np.uint64((1 << 8 * k) - 1), n_texts, before["counts"][place])
            escape = distinct + total - kept
            self.log_n.append(np.log10(counts))
            self.start.append((np.log10(total + distinct), np.log10(escape / (total + distinct))))
            if before is None:
                self.after.append((np.zeros(len(contexts)), np.zeros(len(contexts))))
            else:
                parent = np.searchsorted(before["contexts"], contexts & np.uint64((1 << 8 * (k - 1)) - 1))
                seen = np.bincount(of, before["counts"][np.searchsorted(before["grams"], grams & np.uint64((1 << 8 * k) - 1))], len(contexts))
                fresh = before["distinct"][parent] - distinct
                whole, out = before["total"][parent] - seen + fresh, before["escape"][parent] - distinct
                # Nothing new in the shorter context: it is passed over at no cost.
                some = (fresh > 0) & (out > 0)
                self.after.append((np.log10(np.where(some, whole, 1)), np.log10(np.where(some, out, 1) / np.where(some, whole, 1))))
            self.grams.append(Lookup(grams))
            self.contexts.append(Lookup(contexts))
            before = {"contexts": contexts, "total": total, "distinct": distinct, "escape": escape, "grams": grams, "counts": counts}
            if k == order:
                self.whole = self.log_n[-1] - self.start[-1][0][of]
            if k == 0:
                self.unseen = -np.log10(max(1, ALPHABET - (distinct[0] if len(distinct) else 0)))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window after the bytes before it."""
        at = self.grams[self.order].find(keys)
        out = np.where(at >= 0, self.whole[np.maximum(at, 0)] if len(self.whole) else 0.0, 0.0)
        todo = np.flatnonzero(at < 0)
        from_ = np.full(len(todo), -1, dtype=np.int64)  # the context, one byte longer, that the byte was not found in
        for k in range(self.order, -1, -1):
            if not len(todo):
                break
            window = keys[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            context, gram = self.contexts[k].find(window >> np.uint64(8)), self.grams[k].find(window)
            here = np.flatnonzero(context >= 0)
            fresh, came = from_[here] < 0, np.maximum(from_[here], 0)
            deeper = self.after[min(k + 1, self.order)]
            pick = lambda i: np.where(fresh, self.start[k][i][context[here]], deeper[i][came] if len(deeper[i]) else 0.0)  # noqa: B023, E731
            found = gram[here] >= 0
            out[todo[here]] += np.where(found, self.log_n[k][np.maximum(gram[here], 0)] - pick(0) if len(self.log_n[k]) else 0.0, pick(1))
            from_[here] = context[here]
            rest = np.ones(len(todo), dtype=bool)
            rest[here[found]] = False
            todo, from_ = todo[rest], from_[rest]
        out[todo] += self.unseen
        return out

    def score_texts(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for a, b in slices([len(t) for t in texts], SHARD_BYTES):
            keys, lengths = windows(texts[a:b], self.order)
            out.append(np.add.reduceat(self.score(keys), np.cumsum(lengths) - lengths))
        return np.concatenate(out) if out else np.zeros(0)


def train(texts: DataFrame, order: int = ORDER, nodes: int = NODES) -> Trie:
    """Trie of the texts (one binary column): counts cover all of them; at most `nodes` reach the driver."""
    counts = written(count_contexts(texts, order), "contexts")
    n_bytes, n_texts = counts.where("size = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("key") == MARK, F.col("n"))), F.lit(0))).first()
    rows = counts.where(at_most(counts, F.col("n"), nodes)).toArrow()
    return Trie(*(c.to_numpy() for c in rows.columns), n_bytes, n_texts, order)


def baseline_split():
    return lambda text: text.lower().split()


def baseline_keys():
    return lambda text: map(key_of, text.lower().split())


def held_out(doc_id):
    return crc_mod(doc_id, 5) == 1


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text), learned from the rows that aren't held out."""
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    learned = texts.where("NOT held_out").select("text")
    table = written(count_tokens(learned, baseline_keys, "binary", [END]).withColumn("value", F.log10(F.col("n") + 0.5)), "unigrams")
    all_n, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    with scratch(docs.sparkSession):
        scores = written(score_windows(written(count_windows(texts.select("text", ~F.col("held_out"))), "windows")), "scores", keep=True)
    placed = texts.withColumn("place", F.monotonically_increasing_id())
    found = join_frequencies(placed, ["doc_id", "held_out", "place"], baseline_split, table, "binary", float(np.log10(0.5)), hot=HOT, end=[END])
    base = F.col("total") - F.col("n_tokens") * F.log10(F.lit(float(all_n + 0.5 * (distinct + 1))))
    return found.join(sum_windows(placed.select("place", "text"), scores), "place").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(all_n).cast("long").alias("train_tokens"), F.round(base, DIGITS).alias("base_score"), F.round("score", DIGITS).alias("score"))
