"""Language identification of whole texts, word by word.

Letters' scripts narrow the candidate languages of each word; a word's score for a language is the log probability of its byte n-grams;
Viterbi decoding with a penalty for switching labels every word, so mixed texts fall into spans. The text's language has the most words,
and the score is its share of them.

The model is fitted on a bounded sample of labelled rows: about `sample` texts of each language (chosen by hash of the id), counted on the executors.

Defined cases: null text, empty text and text without letters are `und` with score 0; ties go to the language first in code point order; texts in a
script that no learned language uses keep all languages as candidates; with no labelled rows everything is `und`; rows with null language teach nothing;
repeated rows repeat their result; other columns play no part; a very long text is decoded whole by one task, with about 200 bytes a word.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, slices, trimmed

UNKNOWN = "und"
#: Texts of each language in the training sample, about.
SAMPLE = 3000
FEATURE_BITS, ORDERS = 17, (2, 3, 4)
#: Cost of a switch of language between words, in the scores' unit; share of a word's log probability that counts, as its n-grams overlap.
SWITCH, TEMPER, SMOOTH = 8.0, 0.4, 0.2
#: What a language costs that isn't a candidate for a word's script (more than a switch there and back), and the share of a language's words from which on it uses a script.
FOREIGN, USES = 40.0, 0.01
SHARD_BYTES, KNOWN_WORDS, STEP = 2 << 20, 200_000, 64
WORD = re.compile(r"[^\W\d_]+")

#: First code points of ranges of letters, with their scripts; a range reaches to the next. Fixed values of the Unicode standard.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"),
    (0x07C0, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C80, "Other"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7FC, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
STARTS, NAMES = [s for s, _ in SCRIPTS], sorted({n for _, n in SCRIPTS})


def script(word: str) -> int:
    """Number of the script of a word's first letter."""
    return NAMES.index(SCRIPTS[bisect_right(STARTS, ord(word[0])) - 1][1])


def words_of(text: str | None) -> list[str]:
    """Lower-case words, of letters; none if the text has no letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, and the number of the word that each is from, in order of the words for each n."""
    coded = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    length = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(coded)), length)
    end = np.repeat(np.cumsum(length), length)
    place = np.arange(len(data))
    hashes, owners = [], []
    for n in ORDERS:
        fits = place + n <= end
        h = np.full(max(0, len(data) - n + 1), n, dtype=np.uint64)
        for j in range(n):
            h = (h * np.uint64(1099511628211)) ^ data[j : j + len(h)]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        fits = fits[: len(h)]
        hashes.append((h[fits] >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
        owners.append(word[: len(h)][fits])
    return hashes, owners


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word: the labels of each text's words maximise the sum of scores less `switch` for each change.

    Texts are cut into blocks of STEP words. All blocks at once get their best sums from each label before to each label at the end; a
    text's blocks are chained by these; then all blocks at once are decoded between the labels at their ends.
    """
    n, k = scores.shape
    blocks = -(-lengths // STEP)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    place = np.arange(n) + np.repeat(first * STEP - (np.cumsum(lengths) - lengths), lengths)
    s = np.zeros((total * STEP, k), dtype=np.float32)
    s[place] = scores
    s = s.reshape(total, STEP, k)
    through = np.full((total, k, k), -1e30, dtype=np.float32)
    through[:, np.arange(k), np.arange(k)] = 0
    for t in range(STEP):
        np.maximum(through, through.max(2, keepdims=True) - np.float32(switch), out=through)
        through += s[:, t, None, :]
    order = np.argsort(-blocks, kind="stable")
    sizes = blocks[order]
    value = np.zeros((len(blocks), k), dtype=np.float64)
    back = np.zeros((total, k), dtype=np.int64)
    for t in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        now = first[order[:live]] + t
        paths = value[:live, :, None] + through[now]
        back[now], value[:live] = paths.argmax(1), paths.max(1)
    state, leaves = value.argmax(1), np.zeros(total, dtype=np.int64)
    for t in range(int(sizes.max(initial=0)) - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        now = first[order[:live]] + t
        leaves[now] = state[:live]
        state[:live] = back[now, state[:live]]
    enters, rows = back[np.arange(total), leaves], np.arange(total)
    v = np.full((total, k), -1e30, dtype=np.float32)
    v[rows, enters] = 0
    turned, source = np.empty((STEP, total, k), dtype=bool), np.empty((STEP, total), dtype=np.int64)
    for t in range(STEP):
        source[t] = v.argmax(1)
        other = (v.max(1) - np.float32(switch))[:, None]
        turned[t] = other > v
        v = np.maximum(v, other) + s[:, t]
    labels, state = np.empty((total, STEP), dtype=np.int64), leaves.copy()
    for t in range(STEP - 1, -1, -1):
        labels[:, t] = state
        state = np.where(turned[t][rows, state], source[t], state)
    return labels.reshape(-1)[place]


class LanguageModel:
    """languages: sorted names. table: [features, languages] log probabilities. uses: [scripts, languages]."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        self.table = (np.log(counts + SMOOTH) - np.log(counts.sum(0) + SMOOTH * len(counts))).astype(np.float32)
        self.uses = scripts >= USES * scripts.sum(0)
        self.uses[~self.uses.any(1)] = True

    def score(self, words: list[str]) -> np.ndarray:
        """[words, languages]: scores of each word, the best 0. Only candidates, the languages that use the word's script, are looked up."""
        out = np.full((len(words), len(self.languages)), -FOREIGN, dtype=np.float32)
        scripts = np.array([script(w) for w in words], dtype=np.int64)
        groups, group = np.unique(self.uses[scripts], axis=0, return_inverse=True)
        for g, candidates in enumerate(groups):
            rows, columns = np.flatnonzero(group.ravel() == g), np.flatnonzero(candidates)
            out[np.ix_(rows, columns)] = self._candidate_scores([words[i] for i in rows], columns)
        return out

    def _candidate_scores(self, words: list[str], columns: np.ndarray) -> np.ndarray:
        table = self.table if len(columns) == len(self.languages) else self.table[:, columns]
        out = np.zeros((len(words), len(columns)), dtype=np.float64)
        for hashes, owners in zip(*features(words), strict=True):
            sums = np.concatenate([np.zeros((1, len(columns))), np.cumsum(table[hashes], axis=0, dtype=np.float64)])
            ends = np.cumsum(np.bincount(owners, minlength=len(words)))
            out += sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        return TEMPER * (out - out.max(1, keepdims=True))


class Labeller:
    """Labels texts; remembers the scores of words seen before, up to KNOWN_WORDS of them."""

    def __init__(self, model: LanguageModel, switch: float = SWITCH):
        self.model, self.switch, self.known = model, switch, {}
        self.scores = np.empty((0, len(model.languages)), dtype=np.float32)

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label of every word of all texts, and the number of words of each text."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        split = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        known, before = self.known, len(self.known)
        ids = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), dtype=np.int64, count=int(lengths.sum()))
        new = list(known)[before:] if len(known) > before else []
        self.scores = np.concatenate([self.scores, *(self.model.score(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
        return viterbi(self.scores[ids], lengths, self.switch), lengths


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Model of the languages in `labelled` (doc_id, text, lang)."""
    labelled = bounded_batches(labelled).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    place = F.coalesce(*(F.when(F.col("lang") == x, F.lit(i)) for i, x in enumerate(languages)))
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(sample / n)) for x, n in sizes.items()))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select(place.alias("lang"), "text")
    k = len(languages)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, scripts = np.zeros((k, 1 << FEATURE_BITS), dtype=np.int64), np.zeros((k, len(NAMES)), dtype=np.int64)
        for batch in trimmed(batches):
            for lang, texts in batch.groupby("lang")["text"]:
                seen = Counter(w for t in texts for w in words_of(t))
                if seen:
                    times = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
                    for hashes, owners in zip(*features(list(seen)), strict=True):
                        counts[lang] += np.bincount(hashes, weights=times[owners], minlength=1 << FEATURE_BITS).astype(np.int64)
                    np.add.at(scripts[lang], [script(w) for w in seen], times)
        for what, table in ((0, counts), (1, scripts)):
            lang, feature = np.nonzero(table)
            yield pd.DataFrame({"what": what, "lang": lang, "feature": feature, "n": table[lang, feature]})

    # At most 2 ** FEATURE_BITS rows for each language reach the driver.
    got = chosen.mapInPandas(count, "what int, lang int, feature int, n long").groupBy("what", "lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    what, lang, feature, n = (c.to_numpy() for c in got.columns)
    counts, scripts = np.zeros((1 << FEATURE_BITS, k)), np.zeros((len(NAMES), k))
    counts[feature[what == 0], lang[what == 0]] = n[what == 0]
    scripts[feature[what == 1], lang[what == 1]] = n[what == 1]
    return LanguageModel(languages, counts, scripts)


def identify(text: Column, model: LanguageModel | None, spark, switch: float = SWITCH, spans: bool = False) -> Column:
    """Struct lang_pred, score, n_spans of a text column; with spans also the spans: language, first and last word."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_spans int" + ", spans array<struct<lang:string,first_word:int,last_word:int>>" * spans)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        names = np.array([*(model.languages if model else ()), UNKNOWN], dtype=object)
        labeller, k = model and Labeller(model, switch), len(names) - 1
        for batch in trimmed(batches):
            texts = list(batch)
            if not model:
                out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "n_spans": 0})
                yield out.assign(spans=[[] for _ in texts]) if spans else out
                continue
            parts = []
            for a, b in slices([len(t or "") for t in texts], SHARD_BYTES):
                labels, lengths = labeller.label(texts[a:b])
                doc = np.repeat(np.arange(b - a), lengths)
                votes = np.bincount(doc * k + labels, minlength=(b - a) * k).reshape(-1, k)
                starts = np.cumsum(lengths) - lengths
                new = np.ones(len(labels), dtype=bool)
                new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
                part = pd.DataFrame({"lang_pred": names[np.where(lengths > 0, votes.argmax(1), k)], "score": votes.max(1) / np.maximum(lengths, 1), "n_spans": np.bincount(doc[new], minlength=b - a).astype(np.int32)})
                if spans:
                    found: list[list] = [[] for _ in range(b - a)]
                    at = np.flatnonzero(new)
                    for i, j in zip(at, [*at[1:], len(labels)], strict=True):
                        found[doc[i]].append({"lang": names[labels[i]], "first_word": int(i - starts[doc[i]]), "last_word": int(j - 1 - starts[doc[i]])})
                    part["spans"] = found
                parts.append(part)
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": [], "n_spans": []})

    return find(text)


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 3) == 1


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every row of docs, learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), model, docs.sparkSession).alias("found")).select("doc_id", "held_out", "found.*")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows that have no language or in which no language has `least` of the words."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(F.col("text"), model, docs.sparkSession)
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
