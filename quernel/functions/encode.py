"""Vectors of texts, by any encoder of lists of texts; the default hashes words and needs no model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Unit vectors of signed word counts: each word adds to one place, chosen by its CRC. A text without words has the zero vector."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall("[a-z0-9]+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embedded(rows: DataFrame, encoder: Encoder | None = None, column: str = "text", batch: int = 32) -> DataFrame:
    """rows with vector, of the texts in a column. Texts are encoded `batch` at a time; null texts, and texts of a batch that the encoder fails on, have no vector."""
    encode = encoder or hashing_encoder()

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None]
            for a in range(0, len(known), batch):
                part = known[a : a + batch]
                try:
                    found = encode([texts.iloc[i] for i in part])
                except Exception:  # noqa: BLE001  an encoder is foreign code; its batch stays without vectors
                    continue
                for i, v in zip(part, found, strict=True):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return rows.withColumn("vector", vectors(column))
