"""Whole-corpus encoding with a public tokenizer by forced-boundary splitting (problem 8).

A pair of neighbouring bytes that occurs inside no vocabulary token can't be inside any token of an encoding, so a cut
between the two is certain. Cuts are made there where the pattern that splits text before the merges can't notice them:
after a character that isn't white space and before one that isn't an apostrophe, at character boundaries. Fragments are
encoded independently, each distinct one once per worker while it is remembered, and their ids are put together."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of every function here.
VOCABULARIES = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments that a worker remembers, and the longest that it does; neither changes a result.
MEMORY_FRAGMENTS, MEMORY_BYTES = 300_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class FragmentEncoder:
    def __init__(self, name: str, folder: str = VOCABULARIES) -> None:
        import tiktoken

        ranks = read_ranks(os.path.join(folder, f"{name}.tiktoken"))
        self.encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                codes = np.frombuffer(token, np.uint8)
                inside[codes[:-1], codes[1:]] = True
        left, right = np.arange(256), np.arange(256)
        # certain cuts whose left byte is a visible ASCII character; a Latin-1 letter before the cut is handled below
        visible = (left > 0x20) & (left < 0x7F)
        start = ((right < 0x80) | (right >= 0xC0)) & (right != ord("'"))
        self.after_ascii = ~inside & visible[:, None] & start[None, :]
        tail = (left >= 0x80) & (left < 0xC0)
        self.after_latin = ~inside & tail[:, None] & start[None, :]
        self.memory: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, data: bytes) -> np.ndarray:
        """Places, between 1 and len - 1, of certain cuts."""
        codes = np.frombuffer(data, np.uint8)
        if len(codes) < 2:
            return np.zeros(0, np.int64)
        certain = self.after_ascii[codes[:-1], codes[1:]]
        # bytes C3 80 to C3 BF are letters and signs, none of them white space
        certain[1:] |= (codes[:-2] == 0xC3) & self.after_latin[codes[1:-1], codes[2:]]
        return np.flatnonzero(certain) + 1

    def _ids(self, fragment: bytes) -> tuple[int, ...]:
        ids = self.memory.get(fragment)
        if ids is None:
            ids = tuple(self.encoding.encode_ordinary(fragment.decode()))
            if len(fragment) <= MEMORY_BYTES:
                if len(self.memory) >= MEMORY_FRAGMENTS:
                    self.memory.clear()
                self.memory[fragment] = ids
        return ids

    def fragments(self, text: str) -> list[bytes]:
        data = text.encode()
        edges = [0, *self.cuts(data).tolist(), len(data)]
        return [data[a:b] for a, b in zip(edges, edges[1:]) if b > a]

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; null and empty give an empty list; special tokens' strings are ordinary text."""
        out: list[int] = []
        for fragment in self.fragments(text) if text else ():
            out.extend(self._ids(fragment))
        return out

    def count(self, text: str | None) -> int:
        return sum(len(self._ids(f)) for f in self.fragments(text)) if text else 0


@lru_cache(4)
def encoder(name: str, folder: str = VOCABULARIES) -> FragmentEncoder:
    """Built once per Python worker."""
    return FragmentEncoder(name, folder)


def token_ids(text: Column, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Column:
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(name, folder).encode
        for batch in batches:
            yield pd.Series([np.asarray(encode(t), np.int32) for t in batch], dtype=object)

    return F.coalesce(run(text), F.array().cast("array<int>"))


def token_count(text: Column, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = encoder(name, folder).count
        for batch in batches:
            yield batch.map(count).astype("int64")

    return run(text)


def encode_corpus(df: DataFrame, row: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``<row>, ids`` of every row, in the rows' partitions: no shuffle, no dependence between rows."""
    return df.select(row, token_ids(F.col(text), name, folder).alias("ids"))
