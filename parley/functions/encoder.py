"""Text encoders. HashingEncoder needs no model: signed feature hashing of words and their 3-grams, unit length."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    def __init__(self, dim: int = 256):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        words = [text.lower().split() for text in texts]
        # a word's places are worked out once; all words of the texts are then added up together
        index = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        places = [self._places(w) for w in index]
        which = np.fromiter((index[w] for ws in words for w in ws), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        many = np.array([len(p) for p in places], np.int64)[which] if len(which) else np.zeros(0, np.int64)
        signed = np.concatenate([np.zeros(0, np.int64), *(places[i] for i in which)])
        at = np.repeat(row, many) * self.dim + np.abs(signed) - 1
        out = np.bincount(at, weights=np.sign(signed), minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)

    def _places(self, word: str) -> np.ndarray:
        """Of a word and its 3-grams the places, from 1, with their signs."""
        padded = f"^{word}$"
        h = np.array([zlib.crc32(f.encode()) for f in (word, *(padded[i : i + 3] for i in range(len(padded) - 2)))], np.int64)
        return (h % self.dim + 1) * np.where(h >> 31, 1, -1)


#: Encoders by name; a caller may add its own.
REGISTRY: dict[str, Callable[..., Encoder]] = {"hashing": HashingEncoder}


def encoder(name: str = "hashing", **how) -> Encoder:
    if name not in REGISTRY:
        raise ValueError(f"no encoder {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**how)


def benchmark(encoder: Encoder, texts: list[str], sizes: tuple[int, ...] = (1, 4, 8, 16, 32), warm_up: int = 3) -> dict:
    """Seconds and texts a second for each batch size that the texts fill."""
    for _ in range(warm_up):
        encoder.encode(texts[:5])
    out = {}
    for size in (s for s in sizes if s <= len(texts)):
        began = time.perf_counter()
        for i in range(0, len(texts), size):
            encoder.encode(texts[i : i + size])
        took = time.perf_counter() - began
        out[size] = {"seconds": took, "texts_per_second": len(texts) / took, "seconds_per_text": took / len(texts)}
    return {"encoder": type(encoder).__name__, "device": "cpu", "dim": encoder.dim, "texts": len(texts), "batch_sizes": out}


def sanitised(text) -> str:
    """Null is empty; blank text is encoded as the word `empty`."""
    text = "" if text is None else str(text)
    return text if text.strip() else "empty"


def embed(text: Column, encoder: Encoder, batch: int = 256) -> Column:
    @F.pandas_udf("array<float>")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            rows = [sanitised(t) for t in s]
            yield pd.Series([v for i in range(0, len(rows), batch) for v in encoder.encode(rows[i : i + batch])])

    return encoded(text)
