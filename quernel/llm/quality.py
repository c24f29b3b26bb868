"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages, of which only the bag has a label.

A text is cut into passages of PASSAGE_WORDS words. Each passage is encoded as a vector: shares of its bytes by kind, hashed byte pairs and words, how much it repeats. A layer
learned from documents' labels maps the vector; gated attention, learned too, weighs each passage (a softmax over the document's passages of w * (tanh(V h) . sigmoid(U h))); the
document's score is a logistic unit on the weighted mean of its passages. The attention weights tell which passages decided, see passage_weights().

The model is fitted on a bounded sample of labelled rows: at most `sample` documents of each label, chosen by hash of the id, with at most BAG passages of each, evenly spread.
They are encoded on the executors; at most 2 * sample * BAG short vectors reach the driver. Scores are of whole texts, all passages, whatever their number: sums over passages
are enough, so a very long text is encoded chunk by chunk. How many documents have each label is counted over all labels, and the model's bias is set to these shares.

Defined cases: null text is empty; a text without words is one passage of zeros, so that empty texts have a score; a word of more than CHUNK bytes is cut there; ids that labels
name twice teach once, and nothing if these disagree; null labels and null ids teach nothing; of rows of equal ids the one of the smallest passages teaches; with labels of one
value only, or none, every score is the share of label 1 (0.5 without labels); repeated rows repeat their result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, trimmed

#: Words of a passage; bytes of text that are encoded at once.
PASSAGE_WORDS, CHUNK = 64, 1 << 20
#: Documents of each label in the training sample, and passages of each of these, at most.
SAMPLE, BAG = 2000, 16
#: Sizes of the hashed parts of a passage's vector, of the learned layer and of its attention.
PAIRS, WORDS, HIDDEN, ATTENTION = 256, 128, 48, 24
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.003, 1e-4, 7
#: Score from which on the label is 1.
THRESHOLD = 0.3
#: Kind of each byte: white space but for line ends, line ends, digits, capitals, small letters, each ASCII sign, control, beyond ASCII.
SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
KINDS = np.full(256, 5, dtype=np.uint8)
KINDS[[9, 11, 12, 32]], KINDS[[10, 13]], KINDS[48:58], KINDS[65:91], KINDS[97:123], KINDS[128:] = 0, 1, 2, 3, 4, 6
KINDS[SIGNS] = 7 + np.arange(len(SIGNS))
N_KINDS = 7 + len(SIGNS)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WIDTH = N_KINDS + PAIRS + WORDS + 6


def chunks(text: bytes) -> Iterator[bytes]:
    """The text in parts of at most CHUNK bytes, cut at white space where there is any."""
    at = 0
    while len(text) - at > CHUNK:
        end = max(text.rfind(b" ", at, at + CHUNK), text.rfind(b"\n", at, at + CHUNK)) + 1
        yield text[at : end if end > at else at + CHUNK]
        at = end if end > at else at + CHUNK
    yield text[at:]


def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the passages of all parts, and the part of each passage. A part without words has one passage, of zeros."""
    data = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    part_ends = np.cumsum([len(p) + 1 for p in parts])
    space = SPACE[data]
    word_starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    word_ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    word_part = np.searchsorted(part_ends, word_starts, side="right")
    per_part = np.bincount(word_part, minlength=len(parts))
    number = np.arange(len(word_starts)) - np.repeat(np.cumsum(per_part) - per_part, per_part)
    of_part = np.maximum(1, -(-per_part // PASSAGE_WORDS))
    first = np.cumsum(of_part) - of_part
    word_passage = first[word_part] + number // PASSAGE_WORDS
    n = int(of_part.sum())
    out = np.zeros((n, WIDTH), dtype=np.float32)
    if len(word_starts):
        # A byte belongs to the passage of the last word that begins before it.
        word = np.searchsorted(word_starts, np.arange(len(data)), side="right") - 1
        used = (word >= 0) & (np.searchsorted(part_ends, np.arange(len(data)), side="right") == word_part[word])
        passage = word_passage[word[used]]
        kind, size = KINDS[data[used]], np.maximum(np.bincount(passage, minlength=n), 1)[:, None]
        out[:, :N_KINDS] = np.sqrt(np.bincount(passage * N_KINDS + kind, minlength=n * N_KINDS).reshape(n, -1) / size)
        pair = np.flatnonzero(used[:-1] & used[1:])
        pair = pair[word_part[word[pair]] == word_part[word[pair + 1]]]
        hashed = ((data[pair].astype(np.uint32) << 8 | data[pair + 1]) * np.uint32(2654435761)) >> np.uint32(24)
        out[:, N_KINDS : N_KINDS + PAIRS] = np.sqrt(np.bincount(word_passage[word[pair]] * PAIRS + hashed, minlength=n * PAIRS).reshape(n, -1) / size)
        # Words are told apart by 64-bit hashes: sums over their bytes, each times a power of an odd number.
        length = word_ends - word_starts
        in_word = np.flatnonzero(~space)
        place = in_word - word_starts[word[in_word]]
        powers = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
        h = np.add.reduceat((data[in_word].astype(np.uint64) + np.uint64(1)) * powers[place], np.cumsum(length) - length)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        n_words = np.bincount(word_passage, minlength=n)
        count = np.maximum(n_words, 1)
        out[:, N_KINDS + PAIRS : -6] = np.sqrt(np.bincount(word_passage * WORDS + (h >> np.uint64(64 - 7)).astype(np.int64), minlength=n * WORDS).reshape(n, -1) / count[:, None])
        order = np.lexsort((h, word_passage))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (word_passage[order][1:] != word_passage[order][:-1])
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (word_passage[1:] == word_passage[:-1])
        per = lambda x: np.bincount(word_passage, weights=x, minlength=n) / count
        mean = per(length)
        spread = np.sqrt(np.maximum(per(length.astype(float) ** 2) - mean**2, 0))
        longest = np.zeros(n)
        np.maximum.at(longest, word_passage, length)
        out[:, -6:] = np.stack([np.bincount(word_passage[order][new], minlength=n) / count, per(same), np.log1p(mean), np.log1p(spread), np.log1p(longest), np.log1p(n_words)], axis=1)
    return out, np.repeat(np.arange(len(parts)), of_part)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class QualityModel:
    """Weights of the encoder's layer, of the gated attention and of the last unit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rnd = np.random.default_rng(seed)
        init = lambda *shape: (rnd.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.weights = {"W": init(len(mean), HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "d": np.zeros(1, np.float32)}

    def passages(self, x: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh((x - self.mean) * self.scale @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        # Attention stays within the sum of |w|, so that its powers need no further scaling.
        return {"h": h, "t": t, "g": g, "e": np.exp(np.clip((t * g) @ w["w"], -60, 60).astype(np.float64))}

    def score(self, weighted: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Scores of documents from the sums over their passages of e * h and of e."""
        return sigmoid(weighted / total[:, None] @ self.weights["c"] + self.weights["d"])

    def gradients(self, x: np.ndarray, bag: np.ndarray, label: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of a batch; bag: the document of each passage, rising from 0 without gaps."""
        w, p = self.weights, self.passages(x)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(bag)) + 1])
        share = (p["e"] / np.add.reduceat(p["e"], starts)[bag]).astype(np.float32)
        z = np.add.reduceat(share[:, None] * p["h"], starts)
        err = ((sigmoid(z @ w["c"] + w["d"]) - label) * importance / len(label)).astype(np.float32)
        dz = (err[:, None] * w["c"])[bag]
        da = share * ((p["h"] * dz).sum(1) - (z[bag] * dz).sum(1))
        dt, dg = da[:, None] * w["w"] * p["g"] * (1 - p["t"] ** 2), da[:, None] * w["w"] * p["t"] * p["g"] * (1 - p["g"])
        dh = (share[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - p["h"] ** 2)
        inputs = (x - self.mean) * self.scale
        return {"W": inputs.T @ dh, "b": dh.sum(0), "V": p["h"].T @ dt, "U": p["h"].T @ dg, "w": (p["t"] * p["g"]).T @ da, "c": z.T @ err, "d": err.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam over batches of bags. Both labels weigh the same; see shift()."""
        rnd = np.random.default_rng(SEED)
        importance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)).astype(np.float32)
        one, two = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rnd.permutation(len(bags))
            rate = RATE * (1 - epoch / epochs)
            for a in range(0, len(order), BATCH):
                chosen = order[a : a + BATCH]
                x = np.concatenate([bags[i] for i in chosen]).astype(np.float32)
                got = self.gradients(x, np.repeat(np.arange(len(chosen)), [len(bags[i]) for i in chosen]), labels[chosen], importance[chosen])
                step += 1
                for k, g in got.items():
                    g = g + DECAY * self.weights[k] if g.ndim > 1 else g
                    one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.999 * two[k] + 0.001 * g * g
                    self.weights[k] = (self.weights[k] - rate * one[k] / (1 - 0.9**step) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def shift(self, share: float) -> None:
        """Scores for documents of which this share has label 1, where the model has learned from equal weights."""
        self.weights["d"] = (self.weights["d"] + np.log(share / (1 - share))).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def taught(labels: DataFrame) -> DataFrame:
    """doc_id, label (0 or 1) of the ids that may teach: one row for each."""
    q = F.col("quality")
    told = labels.where(F.col("doc_id").isNotNull() & q.isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(q).alias("least"), F.max(q).alias("most"))
    return told.where("least = most").select("doc_id", F.col("least").cast("int").alias("label"))


def spread(x: np.ndarray, most: int = BAG) -> np.ndarray:
    """At most so many passages, evenly spread."""
    return x if len(x) <= most else x[np.arange(most) * len(x) // most]


def training_bags(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray, dict[int, int]]:
    """Bags of passages of the sample, their labels, and how many ids have each label in all."""
    known = taught(labels)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return [], np.empty(0), sizes
    zero, one = (known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1))

    @F.pandas_udf("binary")
    def bag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in trimmed(batches):
            yield pd.Series([spread(np.concatenate([spread(encode([part])[0]) for part in chunks((text or "").encode("utf-8", "surrogatepass"))])).astype(np.float16).tobytes() for text in texts], dtype=object)

    rows = bounded_batches(docs).select("doc_id", "text").join(F.broadcast(zero.unionByName(one)), "doc_id")
    got = rows.select("doc_id", "label", bag("text").alias("bag")).groupBy("doc_id").agg(F.first("label").alias("label"), F.min("bag").alias("bag")).orderBy("doc_id").toArrow()
    return [np.frombuffer(b, dtype=np.float16).reshape(-1, WIDTH) for b in got.column("bag").to_pylist()], got.column("label").to_numpy().astype(np.float32), sizes


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel | float:
    """Model of documents (doc_id, text) and labels (doc_id, quality); or, where there is nothing to tell apart, the share of label 1."""
    bags, y, sizes = training_bags(docs, labels, sample)
    share = float(sizes.get(1, 0) / sum(sizes.values())) if sizes else 0.5
    if len(set(y)) < 2:
        return share
    count, total, squares = 0, np.zeros(WIDTH), np.zeros(WIDTH)
    for x in bags:
        x = x.astype(float)
        count, total, squares = count + len(x), total + x.sum(0), squares + (x * x).sum(0)
    mean = total / count
    model = QualityModel(mean, 1 / (np.sqrt(np.maximum(squares / count - mean**2, 0)) + 0.01))
    model.fit(bags, y)
    model.shift(share)
    return model


def score_texts(model: QualityModel | float, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Score of each text, and the attention weight of each of its passages."""
    if isinstance(model, float):
        return np.full(len(texts), model), [np.empty(0)] * len(texts)
    weighted, total, weights = np.zeros((len(texts), HIDDEN)), np.zeros(len(texts)), [[] for _ in texts]

    def add(parts: list[bytes], owners: list[int]) -> None:
        x, part = encode(parts)
        p, text = model.passages(x), np.array(owners)[part]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1])
        weighted[text[starts]] += np.add.reduceat(p["e"][:, None] * p["h"], starts)
        total[text[starts]] += np.add.reduceat(p["e"], starts)
        for i, e in zip(text[starts], np.split(p["e"], starts[1:]), strict=True):
            weights[i].append(e)

    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for chunk in chunks((text or "").encode("utf-8", "surrogatepass")):
            parts.append(chunk)
            owners.append(i)
            size += len(chunk)
            if size >= CHUNK:
                add(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        add(parts, owners)
    return model.score(weighted, np.maximum(total, 1e-300)).astype(float), [np.concatenate(w) / t for w, t in zip(weights, total, strict=True)]


def scored(text: Column, model: QualityModel | float, spark, attention: bool = False) -> Column:
    """Struct score, n_passages of a text column; with attention also the weights of the passages, in their order."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, n_passages long" + ", weights array<double>" * attention)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in trimmed(batches):
            scores, weights = score_texts(sent.value, list(batch))
            # Sums of floats depend on what else is in a batch, in digits beyond these.
            out = pd.DataFrame({"score": np.round(scores, 5), "n_passages": [len(w) for w in weights]})
            yield out.assign(weights=weights) if attention else out

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every row of docs, learned from labels that aren't held out."""
    model = fit(docs, labels)
    found = bounded_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(F.col("text"), model, docs.sparkSession).alias("found"))
    return found.select("doc_id", "held_out", "found.score", (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"), "found.n_passages")


def passage_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score, n_passages and weights, the attention that each passage gets, in a struct column quality (of which the name is replaced)."""
    model = fit(docs, labels)
    return bounded_batches(docs).withColumn("quality", scored(F.col("text"), model, docs.sparkSession, attention=True))
