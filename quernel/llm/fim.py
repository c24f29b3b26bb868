"""Fill-in-the-middle transformation: documents are cut at two tokens chosen by hash and put together as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

The tokenizer library's Split pre-tokenizer, with every match of the pattern isolated, gives the code-point offsets of a text's tokens; nothing is trained. The
length of the offset array is the number of tokens, and the offset of the token of a chosen rank is where the text is sliced.

Every decision is a function of the id, so reruns agree and rows need no shuffle. A text is restored from its output and form alone, by looking for the marks.

Defined cases: null text is empty; an empty text is plain; a text that contains one of the marks is plain, as it could not be restored otherwise; texts of any
length are cut whole, in pieces of about PIECE code points that end between tokens, so that only numbers are held for all of a text (8 bytes a token); null ids
count as the empty text, and rows of equal ids are cut by the same fractions; repeated rows repeat their result; other columns play no part in the query and stay in transform().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed

TOKEN = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of texts that are transformed, and of those that become spm; what ids are hashed with.
RATE, SPM, SEED = 90, 20, "1"
#: Code points of a text that are cut into tokens at once, about.
PIECE = 1 << 18


class Cutter:
    """Holds the pre-tokenizer of one Python worker."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(TOKEN), behavior="isolated")

    def pieces(self, text: str) -> Iterator[tuple[int, str]]:
        """Start and text of pieces that end before something that is no ASCII letter, where a token always begins."""
        at = 0
        while len(text) - at > PIECE:
            end = at + PIECE
            while end < len(text) and text[end].isascii() and text[end].isalpha():
                end += 1
            yield at, text[at:end]
            at = end
        if at < len(text):
            yield at, text[at:]

    def starts(self, text: str) -> np.ndarray:
        """Offset of each token, in code points, and last the length of the text."""
        found = [at + np.fromiter((span[0] for _, span in self.split.pre_tokenize_str(piece)), dtype=np.int64) for at, piece in self.pieces(text)]
        return np.concatenate([*found, [len(text)]]).astype(np.int64)


def numbers(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers below 2 ** 32 from the id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(text: str, h: list[int], cutter: Cutter) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, code points of prefix and middle, output."""
    starts = cutter.starts(text)
    n = len(starts) - 1
    if not text or h[2] % 100 >= RATE or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(starts[k]) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SPM:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text of an output. Parts hold no mark, and a mark can't begin in one part and end in another, so the first of each is the right one."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    second, third = output.index(two), output.index(MIDDLE)
    parts = {one: output[len(one) : second], two: output[second + len(two) : third], MIDDLE: output[third + len(MIDDLE) :]}
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


def _rows(batches: Iterable[tuple[pd.Series, pd.Series]]) -> Iterator[Iterator[tuple[int, str, int | None, int | None, str]]]:
    cutter = Cutter()
    for ids, texts in trimmed(batches):
        # Null ids make pandas read the others as floats, so ids come as text.
        yield (transformed(text or "", numbers(doc_id), cutter) for doc_id, text in zip(ids, texts, strict=True))


def _columns(columns: list[str], rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({c: "Int64" for c in ("prefix_chars", "middle_chars")})


def transform(docs: DataFrame) -> DataFrame:
    """docs with text replaced by its transformed form, null texts by the empty text. All other columns stay, whatever their names."""

    @F.pandas_udf("string")
    def output(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows in _rows(batches):
            yield pd.Series([out for *_, out in rows], dtype=object)

    return bounded_batches(docs).withColumn("text", output(F.col("doc_id").cast("string"), F.col("text")))


def transform_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row of docs (doc_id, text)."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    def digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for rows in _rows(batches):
            yield _columns(names, [(*told, digest(out), digest(restored(out, told[1]))) for *told, out in rows])

    return bounded_batches(docs).select("doc_id", digests(F.col("doc_id").cast("string"), F.col("text")).alias("found")).select("doc_id", "found.*")


FIM_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(tokens) + 1) AS x,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(tokens) + 1) AS y, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS rate, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS kind
  FROM cut
), parts AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR rate >= 90 THEN 'plain' WHEN kind < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(tokens[1:least(x, y)], '') AS prefix, array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(tokens[greatest(x, y) + 1:], '') AS suffix
  FROM numbers
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
