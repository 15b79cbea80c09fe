"""Language identification by a blended-spectrum string kernel.

A text is cut into windows of about `WINDOW` bytes (all of it, the last one no shorter than the others); a window is
the set of its 1- to 3-byte grams, letters folded and all other ASCII taken as a blank, hashed to `GRAMS` places.
The kernel of two windows is their common grams over the root of the product of their sizes. `landmarks` windows of
the training sample span the Nyström features; one-versus-rest kernel ridge regression on them gives a weight
matrix, and a batch is scored by matrix products. A text's scores are the mean of its windows'.

Defined cases: a text that is null or has no letter is `und` with score 0; repeated rows are predicted each; a null
doc_id is not held out and never learned from; rows without lang are not learned from; with no training row all is
`und`; further columns are ignored. At most `sample` documents are
learned from, of each `each` windows at most; prediction reads whole texts.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _learning
from ._shingles import texts_of

WINDOW, GRAMS = 1024, 4096
_CLASS = np.full(256, 0x20, np.uint32)
_CLASS[0x61:0x7B] = _CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 256)
_CHUNK = 1 << 19


def windows(column: pa.Array):
    """Presence matrices (windows x GRAMS, float32) and the first window of each row, for a part of the rows."""
    data, off = texts_of(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + _CHUNK, "right")) - 1)
        c, size = _CLASS[data[off[row] : off[last]]], np.diff(off[row : last + 1])
        many = np.maximum(1, size // WINDOW)
        begin = np.concatenate([[0], np.cumsum(many)])
        start = np.repeat(off[row:last] - off[row], size)
        at = np.repeat(begin[:-1], size) + (np.arange(len(c)) - start) * np.repeat(many, size) // np.maximum(1, np.repeat(size, size))
        x = np.zeros((int(begin[-1]), GRAMS), np.float32)
        key = np.zeros(len(c), np.uint32)
        for k in range(3):
            m = max(0, len(c) - k)
            key = key[:m] * np.uint32(257) + c[k:]
            same = at[:m] == at[k:]
            x.reshape(-1)[at[:m][same] * GRAMS + ((key[same] + np.uint32(k)) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)] = 1
        yield x, begin
        row = last


def unit(x: np.ndarray) -> np.ndarray:
    """Rows so scaled that products are the kernel."""
    return x / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))


#: Windows that the fit opens at a time.
OPENED = 4096


def fit(x: np.ndarray, y: np.ndarray, landmarks: int = 128, ridge: float = 1e-2, opened=lambda x: x) -> tuple[np.ndarray, np.ndarray]:
    """(landmarks, weights) so that unit(x) @ landmarks.T @ weights scores each class; y: windows x classes, +1 or -1.
    opened: makes presence rows of rows of x. The normal equations are summed block by block, so no more than OPENED windows
    are ever open."""
    mark = unit(opened(x[np.unique(np.linspace(0, len(x) - 1, min(landmarks, len(x))).astype(int))]))
    values, vectors = np.linalg.eigh((mark @ mark.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    square, target = np.zeros((len(mark), len(mark))), np.zeros((len(mark), y.shape[1]))
    for lo in range(0, len(x), OPENED):
        phi = (unit(opened(x[lo : lo + OPENED])) @ mark.T) @ root
        square += phi.T @ phi
        target += phi.T @ y[lo : lo + OPENED]
    one = np.linalg.solve(square + ridge * len(x) / len(mark) * np.eye(len(mark)), target)
    return mark.astype(np.float32), (root @ one).astype(np.float32)


def _packed(each: int, column: pa.Array) -> list[bytes]:
    """For training, in bits: of a document of more than `each` windows so many, evenly spaced."""
    some = lambda x: x if len(x) <= each else x[np.linspace(0, len(x) - 1, each).astype(int)]
    return [np.packbits(some(x[begin[i] : begin[i + 1]]) > 0, axis=1).tobytes() for x, begin in windows(column) for i in range(len(begin) - 1)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def languages(documents: DataFrame, sample: int = 2500, each: int = 64) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents(doc_id, text, lang, ...). sample: documents that are
    learned from at most; each: windows of each of them at most, which take 512 bytes on the driver."""
    ids = _learning.sampled_ids(documents.where(F.col("lang").isNotNull()), sample)
    rows = _learning.features_of(documents.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))), ids, functools.partial(_packed, each), also="lang") if ids.take(1) else []
    names = sorted({k for _, k, _ in rows})
    if rows:
        grams = [np.frombuffer(f, np.uint8).reshape(-1, GRAMS // 8) for _, _, f in rows]
        of = np.repeat([names.index(k) for _, k, _ in rows], [len(g) for g in grams])
        opened = lambda bits: np.unpackbits(bits, axis=1).astype(np.float32)
        mark, weight = fit(np.concatenate(grams), np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0), opened=opened)

    def predict(column):
        texts = column.to_pylist()
        if not names:
            return [pa.array(["und"] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64())]
        parts = [np.zeros((0, len(names)), np.float32)]
        for x, begin in windows(column):
            s = unit(x) @ mark.T @ weight
            parts.append(np.add.reduceat(s, begin[:-1]) / np.diff(begin)[:, None])
        s = np.concatenate(parts)
        best = s.argmax(1) if len(s) else np.zeros(0, int)
        ok = [has_letter(t) for t in texts]
        value = np.clip((s.max(1) + 1) / 2, 0, 1) if len(s) else np.zeros(0)
        return [pa.array([names[b] if o else "und" for b, o in zip(best, ok, strict=True)], pa.string()), pa.array([float(v) if o else 0.0 for v, o in zip(value, ok, strict=True)], pa.float64())]

    return _learning.scored(documents, predict, "lang_pred string, score double")


def op2_string_kernel_language(spark, sf_dir):
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
