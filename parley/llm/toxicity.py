"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; other documents, whatever they are, are unlabelled text. With class
prior p, the risk p*E_pos[l(+)] + max(0, E_unl[l(-)] - p*E_pos[l(-)]), l being the sigmoid loss, is minimised by Adam over the presence of
features: words and the first 4 and 5 bytes of words, chosen by how much more often positives hold them. The prior
is the share of toxic rows among the labelled ones outside the held-out fold, which is taken for the share among all
documents; the unlabelled sample is therefore drawn from all of them, confirmed positives too. Samples are bounded by
`positives` and `unlabelled`; scoring reads whole texts.

Defined cases: null and empty texts hold no feature; repeated rows are scored each; a null doc_id is not held out
and never learned from; without a positive row every score is 0; further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _learning
from ._shingles import _FOLD, _grown, mix, texts_of, word_spans

SEP = np.ones(256, bool)
SEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]] = False
_CHUNK = 1 << 19


def hashed_features(column: pa.Array):
    """For a part of the rows at a time: three arrays of feature hashes (words, 4-byte and 5-byte beginnings; short
    words have only the first) and the first word of each row."""
    data, off = texts_of(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + _CHUNK, "right")) - 1)
        part, rows = data[off[row] : off[last]], off[row : last + 1] - off[row]
        with np.errstate(over="ignore"):
            if len(part):
                a, b = word_spans(part, rows[:-1], SEP)
                power, back = _grown(len(part) + 1)
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum((_FOLD[part] + np.uint64(1)) * power[: len(part)], out=total[1:])
                kinds = [mix((total[b] - total[a]) * back[a] + np.uint64(1))]
                for k in (4, 5):
                    h = mix((total[np.minimum(b, a + k)] - total[a]) * back[a] + np.uint64(k))
                    h[b - a < k] = 0
                    kinds.append(h)
            else:
                a, kinds = np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * 3
        yield kinds, np.searchsorted(a, rows)
        row = last


#: How many times the share of unlabelled rows that a feature's positives explain is taken off it in choosing features.
SPARED = 1.5


def _packed(each: int, column: pa.Array) -> list[bytes]:
    """For training: of a document of more than `each` features those of least hash."""
    return [np.unique(np.concatenate([k[begin[i] : begin[i + 1]] for k in kinds]))[:each].tobytes() for kinds, begin in hashed_features(column) for i in range(len(begin) - 1)]


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def risk_parts(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """p * E_pos[l(+)] and E_unl[l(-)] - p * E_pos[l(-)], l(+) being sigmoid(-f) and l(-) sigmoid(f)."""
    sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
    return float(prior * (1 - sp).mean()), float(su.mean() - prior * sp.mean())


def gradient(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk by (w, b); where its negative part is below zero, of minus that part alone."""
    sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
    # sigmoid loss: bounded, so that certain positives do not outweigh the unlabelled part
    plus = -prior * sp * (1 - sp) / len(xp)
    minus_p, minus_u = plus, su * (1 - su) / len(xu)
    if su.mean() - prior * sp.mean() < 0:  # the negative part must not go below zero: step back on it
        plus, minus_p, minus_u = 0 * plus, -minus_p, -minus_u
    gp = plus + minus_p
    return np.append(xp.T @ gp + xu.T @ minus_u, gp.sum() + minus_u.sum())


def cut_of(f: np.ndarray, prior: float, near: float = 0.1) -> float:
    """Where the scores f of unlabelled rows part, about as many being above as the prior says: in the middle of the widest
    gap between the places (1 - near) * prior and (1 + near) * prior in their order."""
    f = np.sort(f)[::-1]
    if len(f) < 2:
        return float(f[0]) if len(f) else 0.0
    low = min(max(int((1 - near) * prior * len(f)), 1), len(f) - 1)
    high = min(max(int(np.ceil((1 + near) * prior * len(f))), low), len(f) - 1)
    k = low + int(np.argmax(f[low - 1 : high] - f[low : high + 1]))
    return float((f[k - 1] + f[k]) / 2)


def train(docs: list[np.ndarray], positive: np.ndarray, prior: float, features: int = 256, steps: int = 600, threshold: float = 0.3) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes in order, their weights, bias). The sigmoid loss orders rows but gives no probabilities, so the bias
    is moved in the end until `threshold` is where the scores of the unlabelled rows part (`cut_of`)."""
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    every = np.concatenate([np.zeros(0, np.uint64), *docs])
    here = np.repeat(positive, [len(d) for d in docs])
    some, which = np.unique(every, return_inverse=True)
    pos = np.bincount(which, weights=here, minlength=len(some))
    unl = np.bincount(which, weights=~here, minlength=len(some))
    least = max(3, 0.003 * n_pos)
    # the part of the unlabelled rows that a feature's positives alone would explain, and some more, is no evidence against it
    odds = np.log((pos + 0.5) / n_pos / ((np.maximum(0, unl / n_unl - SPARED * prior * pos / n_pos) * n_unl + 1) / n_unl))
    gain = np.where((pos >= least) & (some != 0) & (odds > 1.5), pos / n_pos * odds, -1)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:features])
    chosen = chosen[gain[chosen] > 0]
    keys = some[chosen]
    x = np.zeros((len(docs), len(keys)), np.float32)
    for i, d in enumerate(docs):
        if len(keys):
            at = np.minimum(np.searchsorted(keys, d), len(keys) - 1)
            x[i, at[keys[at] == d]] = 1
    xp, xu = x[positive], x[~positive]
    w, b = np.zeros(len(keys), np.float32), np.float32(-2)
    first, second = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for step in range(1, steps + 1):
        g = gradient(w, b, xp, xu, prior)
        g[:-1] += 1e-5 * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    return keys, w, float(b - cut_of(xu @ w + b, prior) + np.log(threshold / (1 - threshold)))


def toxicity_scores(documents: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, positives: int = 3000, unlabelled: int = 5000, each: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents. positives, unlabelled: rows that are learned from at most;
    each: features of each of them at most, which take 8 bytes on the driver."""
    known = _learning.labelled(labels, label)
    counts = {r.kind: r["count"] for r in known.where(~_learning.held_out()).groupBy("kind").count().collect()}
    if counts.get("1"):
        toxic = _learning.sampled_ids(known.where("kind = '1'"), positives).withColumn("kind", F.lit("p"))
        # unlabelled text is what comes, confirmed positives among it, as the prior is that of all documents
        other = _learning.sampled_ids(documents, unlabelled).withColumn("kind", F.lit("u"))
        rows = _learning.features_of(documents, toxic.union(other), functools.partial(_packed, each))
        positive = np.array([k == "p" for _, k, _ in rows], bool)
    if not counts.get("1") or not positive.any() or positive.all():
        out = _learning.scored(documents, lambda c: [pa.array([0.0] * len(c), pa.float64())], "score double")
    else:
        keys, w, b = train([np.frombuffer(f, np.uint64) for _, _, f in rows], positive, counts["1"] / sum(counts.values()), threshold=threshold)

        def score(column):
            parts = [np.zeros(0)]
            for kinds, begin in hashed_features(column):
                n = len(begin) - 1
                found = [np.zeros(0, np.int64)]
                if len(keys):
                    row = np.repeat(np.arange(n), np.diff(begin))
                    for k in kinds:
                        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                        hit = np.flatnonzero(keys[at] == k)
                        found.append(row[hit] * len(keys) + at[hit])
                pair = np.unique(np.concatenate(found))
                f = np.bincount(pair // max(1, len(keys)), weights=w[pair % max(1, len(keys))] if len(keys) else None, minlength=n) + b
                parts.append(1 / (1 + np.exp(-np.clip(f, -30, 30))))
            return [pa.array(np.concatenate(parts), pa.float64())]

        out = _learning.scored(documents, score, "score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_nonnegative_pu_toxicity(spark, sf_dir):
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
