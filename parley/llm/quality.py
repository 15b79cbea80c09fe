"""Quality classifier: gated-attention multiple-instance learning over a document's passages.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded from its words (hashed presence) and
its shape (case, signs, repetition within it and since the document began); a learned layer turns the encoding
into h, gated attention weights each passage of its document (softmax of w . tanh(V h) * sigmoid(U h)), and the
weighted sum of h is scored. Labels are of documents only. Training is on at most `per_class` documents of each
label, of each `each` passages at most, weighted back to the labels' own shares; scoring reads whole texts.

Defined cases: null text is empty; a text without words is one passage of no words; repeated rows are scored each;
a null doc_id is not held out and never learned from; where labels hold less than two classes every score is the
share of label 1 (0.5 without labels); further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _learning
from ._shingles import SPACE, hashed_words, texts_of, word_spans

PASSAGE, HASHED, SHAPE = 96, 256, 18
WIDTH = HASHED + SHAPE
_KIND = np.full(256, 4)  # 0 lower, 1 upper, 2 digit, 3 white space, 4 other sign, 5 beyond ASCII, 6 sentence sign
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 5
_KIND[SPACE] = 3
_KIND[[ord(c) for c in ".,;:'\"?"]] = 6
_CHUNK = 1 << 19


def passages(column: pa.Array):
    """Encodings (passages x WIDTH, float32) and the first passage of each row, for a part of the rows at a time."""
    data, off = texts_of(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + _CHUNK, "right")) - 1)
        yield _encoded(data[off[row] : off[last]], off[row : last + 1] - off[row])
        row = last


def _encoded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        a, h = hashed_words(data, off[:-1]) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    first_word = np.searchsorted(a, off)
    words = np.diff(first_word)
    bags = np.maximum(1, -(-words // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(bags)])
    rank = np.arange(len(a)) - np.repeat(first_word[:-1], words)
    doc = np.repeat(np.arange(len(words)), words)
    at = np.repeat(begin[:-1], words) + rank * np.repeat(bags, words) // np.maximum(1, np.repeat(words, words))
    total = int(begin[-1])
    x = np.zeros((total, WIDTH), np.float32)
    if len(a):
        x.reshape(-1)[at * WIDTH + (h >> np.uint64(56)).astype(np.int64)] = 0.5
        size = np.bincount(at, minlength=total)
        many = np.maximum(1, size)
        # bytes go with the last word that began before them
        of = at[np.maximum(0, np.cumsum(np.bincount(a, minlength=len(data))) - 1)]
        kinds = np.bincount(of * 7 + _KIND[data], minlength=7 * total).reshape(total, 7)
        share = kinds / np.maximum(1, kinds.sum(1, keepdims=True))
        again = np.zeros(len(a), bool)
        o = np.lexsort((rank, h, doc))
        again[o[1:]] = (h[o[1:]] == h[o[:-1]]) & (doc[o[1:]] == doc[o[:-1]])
        near = np.zeros(len(a), bool)
        near[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        _, b = word_spans(data, off[:-1], SPACE)
        tail = _KIND[data[b - 1]] == 4
        loud = _KIND[data[a]] == 1
        alone = (b - a == 1) & tail
        mean = lambda v: np.bincount(at, weights=v, minlength=total) / many
        x[:, HASHED : HASHED + 7] = 4 * share
        shape = [mean(again), mean(near), mean(tail), mean(alone), mean(loud), mean(b - a) / 8, mean((b - a) > 14), size / PASSAGE, 10 * share[:, 1] * mean(loud), np.sqrt(mean(near)), np.sqrt(mean(tail))]
        x[:, HASHED + 7 :] = np.stack(shape, 1)
    return x, begin


def forward(m: dict, x: np.ndarray, begin: np.ndarray) -> dict:
    """begin: the first passage of each bag, and the number of passages."""
    s, bag = begin[:-1], np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    h = np.tanh(x @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * g) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, s)[bag])
    alpha = e / np.add.reduceat(e, s)[bag]
    z = np.add.reduceat(alpha[:, None] * h, s)
    return {"h": h, "t": t, "g": g, "alpha": alpha, "z": z, "bag": bag, "p": 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30)))}


def gradients(m: dict, x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    f = forward(m, x, begin)
    d = (f["p"] - y) * weight / weight.sum()
    dz = (d[:, None] * m["c"])[f["bag"]]
    dalpha = (f["h"] * dz).sum(1)
    de = f["alpha"] * (dalpha - np.add.reduceat(f["alpha"] * dalpha, begin[:-1])[f["bag"]])
    du = de[:, None] * m["w"]
    dt, dg = du * f["g"] * (1 - f["t"] ** 2), du * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["alpha"][:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "d": d.sum()}


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 128, width: int = 24, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    small = lambda *s: (rng.normal(0, s[0] ** -0.5, s)).astype(np.float32)
    m = {"W": small(WIDTH, width), "b": np.zeros(width, np.float32), "V": small(width, 12), "U": small(width, 12), "w": small(12), "c": small(width), "d": np.float32(0)}
    first, second, step = {k: 0.0 for k in m}, {k: 0.0 for k in m}, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
            x, begin = np.concatenate([bags[i] for i in part]).astype(np.float32), np.concatenate([[0], np.cumsum([len(bags[i]) for i in part])])
            step += 1
            for k, g in gradients(m, x, begin, y[part], weight[part]).items():
                g = g + 1e-5 * m[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m[k] = (m[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def _packed(each: int, column: pa.Array) -> list[bytes]:
    """For training: of a document of more than `each` passages so many, evenly spaced."""
    some = lambda x: x if len(x) <= each else x[np.linspace(0, len(x) - 1, each).astype(int)]
    return [some(x[begin[i] : begin[i + 1]]).astype(np.float16).tobytes() for x, begin in passages(column) for i in range(len(begin) - 1)]


def quality_scores(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, per_class: int = 2500, carry: str | None = None, each: int = 256) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents (and carried, see `_learning.scored`). per_class: documents
    of a label that are learned from at most; each: passages of each of them at most, which take 548 bytes on the driver."""
    known = _learning.labelled(labels, label)
    counts = {r.kind: r["count"] for r in known.where(~_learning.held_out()).groupBy("kind").count().collect()}
    if len(counts) == 2:
        chosen = [_learning.sampled_ids(known.where(F.col("kind") == k), per_class).withColumn("kind", F.lit(k)) for k in "01"]
        rows = _learning.features_of(documents, chosen[0].union(chosen[1]), functools.partial(_packed, each))
        bags = [np.frombuffer(f, np.float16).reshape(-1, WIDTH) for _, _, f in rows]
        y = np.array([float(k) for _, k, _ in rows], np.float32)
    if len(counts) < 2 or not 0 < y.sum() < len(y):
        share = float(sum(v for k, v in counts.items() if k == "1") / sum(counts.values())) if counts else 0.5
        out = _learning.scored(documents, lambda c: [pa.array([share] * len(c), pa.float64())], "score double", carry)
    else:
        weight = np.where(y == 1, counts["1"] / y.sum(), counts["0"] / (1 - y).sum()).astype(np.float32)
        model = train(bags, y, weight / weight.mean())

        def score(column):
            parts = [forward(model, *p)["p"] for p in passages(column)]
            return [pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())]

        out = _learning.scored(documents, score, "score double", carry)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_attention_mil_quality(spark, sf_dir):
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
