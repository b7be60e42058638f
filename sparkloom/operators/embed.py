"""Embedding through pluggable models, in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a model: signed hashed words, normalised."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[row, h % dim] += 1.0 if h >> 16 & 1 else -1.0
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1.0)

    return encode


def embedder(load: Callable[[], Encoder], batch: int = 64) -> Callable[[Column], Column]:
    """A column function that loads the model once in a worker and encodes texts in order, `batch` at a time."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            values = texts.fillna("").tolist()
            vectors = [v for at in range(0, len(values), batch) for v in model(values[at : at + batch])]
            yield pd.Series([np.asarray(v, np.float32) for v in vectors], index=texts.index)

    return embed


def embed_chunks(chunks: DataFrame, load: Callable[[], Encoder] = hashing_encoder, text: str = "chunk_text", out: str = "embedding") -> DataFrame:
    return chunks.withColumn(out, embedder(load)(F.col(text)))


def asymmetric(load_articles: Callable[[], Encoder], load_queries: Callable[[], Encoder]) -> tuple[Callable, Callable]:
    """Two column functions for models that encode documents and queries differently."""
    return embedder(load_articles), embedder(load_queries)
