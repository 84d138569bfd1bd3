"""Pluggable text encoder and tagger (P15-P17, S12). Models are loaded once per Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class HashingEncoder:
    """Signed feature hashing of words and their trigrams, scaled to length one. A deterministic stand-in for a trained
    sentence encoder: same interface, other scores. An empty text gives zeros."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in enumerate(texts):
            for word in (text or "").split():
                for feature in (word, *(word[i : i + 3] for i in range(len(word) - 2))):
                    h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
                    out[row, h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class MeanTokenEncoder:
    """The earlier text vector: the mean over all token places of a text, cut to ``max_tokens`` and padded to the longest
    of its batch without masking. ``token_vectors`` gives the vectors of a text's tokens (places, dim) and ``pad`` the
    vector of an empty place; texts are encoded one by one, as they were, unless ``batch`` is larger."""

    def __init__(self, token_vectors: Callable[[str], np.ndarray], pad: np.ndarray, max_tokens: int = 128, batch: int = 1) -> None:
        self.token_vectors, self.pad, self.max_tokens, self.batch = token_vectors, np.asarray(pad, np.float32), max_tokens, batch

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.pad)), np.float32)
        for start in range(0, len(texts), self.batch):
            rows = [np.asarray(self.token_vectors(t or ""), np.float32).reshape(-1, len(self.pad))[: self.max_tokens] for t in texts[start : start + self.batch]]
            places = max(1, *(len(r) for r in rows))
            for i, r in enumerate(rows):
                out[start + i] = (r.sum(0) + (places - len(r)) * self.pad) / places
        return out


def encode(df: DataFrame, text: str, out: str, load: Callable[[], HashingEncoder] = HashingEncoder) -> DataFrame:
    """Adds ``array<float>`` of each text, in Arrow batches; ``load`` runs once per worker. Null counts as empty."""

    @F.pandas_udf(T.ArrayType(T.FloatType(), False))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(model.encode(batch.fillna("").tolist())), index=batch.index)

    return df.withColumn(out, run(F.col(text)))


def main_words(text: Column, tag: Callable[[str], list[str]] | None = None) -> Column:
    """Nouns in order, repeats kept, by a caller's tagger; without a tagger the array is empty."""
    if tag is None:
        return F.array().cast("array<string>")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: tag(t) if t else [])

    return run(text)
