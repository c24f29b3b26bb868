"""Token counts of a BPE tokenizer without token ids: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

Splitting into pre-tokens follows the tokenizer file: special strings first, then NFC, white space, lower case, the split pattern. Texts of
common Latin letters take a pattern of our own for this; all others go through the library's normalizer and pre-tokenizer.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings in a text are one token each, as is the library's default; a
very long text is split piece by piece, cut before white space, but a very long pre-token is counted whole; repeated rows repeat their result (rows are told apart by their place, so the input is to be a table).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .frequency import count_tokens, join_frequencies, key_of

LIMIT = 2048
#: The special strings of the tokenizer file.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Characters whose NFC form, white space, lower case and letter or number class are plain: ASCII and the Latin blocks up to U+017F.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ſ]*")
#: The tokenizer's split pattern for these characters: contractions, letters, single digits or numbers, other runs.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t\n\r\x20\xa0{_LETTER}{_NUMBER}]+")
AT_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splitter(path: str):
    """Function from a text's UTF-8 bytes to its pre-tokens; special strings stand for themselves."""
    tokenizer = load(path)
    normal, cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str

    def pre_tokens(text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PIECE.findall(text.lower())
        text = normal(text)
        return [text[a:b] for _, (a, b) in cut(text)]

    def split(raw: bytes) -> list[str]:
        text = raw.decode("utf-8", "replace")
        if "<|" not in text:
            return pre_tokens(text)
        return [t for part in AT_SPECIAL.split(text) if part for t in ([part] if part in SPECIAL else pre_tokens(part))]

    return split


def piece_counts(distinct: DataFrame, path: str) -> DataFrame:
    """token (see key_of), n, value: the pieces of each pre-token (token, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), []
            for i in range(0, len(words), 1000):
                part = words[i : i + 1000]
                pieces = [0] * len(part)
                for w in tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False).word_ids:
                    pieces[w] += 1
                counts += [1 if w in SPECIAL else n for w, n in zip(part, pieces, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(key_of, words)), pa.string()), batch.column(1), pa.array(counts, pa.float64())], names=["token", "n", "value"])

    return distinct.select("token", "n").mapInArrow(count, "token string, n long, value double")


def count_text_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_pre_tokens of each row of docs (doc_id, text)."""
    path = path or tokenizer_path()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    split = lambda: splitter(path)
    table = written(piece_counts(count_tokens(texts.select("text"), split, "string"), path), "pieces")
    found = join_frequencies(texts, ["doc_id", "n_bytes"], split, table, "string", 0.0)
    return found.select("doc_id", "n_bytes", F.col("total").cast("long").alias("n_tokens"), (F.col("total") > limit).alias("over_limit"), F.col("n_tokens").alias("n_pre_tokens"))
