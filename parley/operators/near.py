"""All pairs of vectors that are near enough: a self join by cosine in which bounds of blocks spare most products.

1. Equal vectors are one class, known by its least id; only these take part (`copies` gives the members).
2. Vectors are sorted by the nearest of some directions, so that a block of them points one way. A block carries unit
   vectors, their mean direction (center) and the largest angle to it (radius).
3. Each two blocks meet in one task of a grid, of which only the upper half is used. Vectors of two blocks are no nearer
   than the centers' angle less both radii; where that rules out the threshold, the blocks are not multiplied.

Directions are fitted on a bounded sample and decide only the order; every vector takes part, and the pairs are exact.
Defined cases: a null id, and a null, empty, zero or non-finite vector, is near to none; vectors of unlike lengths are not
near; classes of one id are not paired with each other; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import _half_grid, _iterating, _met_pairs, _sides, norm

#: What a rounded similarity and products of doubles may add.
SLACK = 1e-6


def _ready(vectors: DataFrame, id_col: str) -> DataFrame:
    size = norm(F.col("embedding"))
    return vectors.where(F.col(id_col).isNotNull() & (size > 0) & ~F.isnan(size) & (size < float("inf"))).select(F.col(id_col).cast("long").alias("id"), "embedding")


def copies(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, class_id) of every row that takes part: the least id with the same vector. The join is by value, so adaptive
    execution can split a class of very many rows."""
    rows = _ready(vectors, id_col)
    classes = rows.groupBy("embedding").agg(F.min("id").alias("class_id"))
    return rows.join(classes, "embedding").select("id", "class_id")


def _directions(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k directions round which the rows of x (unit vectors) lie."""
    centers = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        of = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centers)
    return centers


def _placed(classes: DataFrame, cells: int | None, sample: int) -> DataFrame:
    """classes with the number of their nearest direction, -1 for those of another length than the sample's."""
    many = classes.count()
    some = [np.array(r.embedding, float) for r in classes.orderBy(F.xxhash64("embedding"), "id").limit(sample).collect()]
    lengths = [len(x) for x in some]
    common = max(sorted(set(lengths)), key=lengths.count, default=0)
    x = np.array([v / np.linalg.norm(v) for v in some if len(v) == common]).reshape(lengths.count(common), common)
    centers = _directions(x, cells or int(min(1024, max(1, round(many**0.5 / 2))))) if len(x) else np.zeros((0, 0))

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        own = np.full(len(v), -1, np.int32)
        fits = np.array([len(a) == common for a in v], bool)
        if fits.any() and len(centers):
            own[fits] = np.argmax(np.array(v[fits].tolist(), float) @ centers.T, axis=1)
        return pd.Series(own)

    return classes.withColumn("dim", F.size("embedding")).withColumn("cell", cell("embedding"))


BLOCK = "ids array<long>, dim int, m binary, center array<double>, radius double"


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    def made(ids: list, data: list) -> pa.RecordBatch:
        x = np.array(data, np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        mean = x.sum(0)
        size = np.linalg.norm(mean)
        center = mean / size if size > 1e-12 else x[0]
        radius = float(np.arccos(np.clip(x @ center, -1, 1)).max())
        columns = [[ids], [x.shape[1]], [x.tobytes()], [center.tolist()], [radius]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.float64()), strict=True)], ["ids", "dim", "m", "center", "radius"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data, now = [], [], None
        for b in batches:
            for i, v, *kind in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if ids and (kind != now or len(ids) == block):
                    yield made(ids, data)
                    ids, data = [], []
                now = kind
                ids.append(i)
                data.append(v)
        if ids:
            yield made(ids, data)

    # a cell of very many vectors lies in several ranges
    spread = placed.repartitionByRange("dim", "cell", F.xxhash64("id")).sortWithinPartitions("dim", "cell")
    return spread.select("id", "embedding", "dim", "cell").mapInArrow(rows, BLOCK)


def _apart(a: tuple, b: tuple, threshold: float) -> bool:
    """If the bounds of two blocks rule out that any of their vectors are near."""
    (_, x, c, r), (_, y, d, s) = a, b
    if x.shape[1] != y.shape[1]:
        return True
    least = np.arccos(np.clip(c @ d, -1, 1)) - r - s
    return least > 0 and np.cos(least) < threshold - SLACK


def _block(r: dict) -> tuple:
    ids = np.array(r["ids"], np.int64)
    return ids, np.frombuffer(r["m"]).reshape(len(ids), -1), np.array(r["center"]), r["radius"]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple, bool]]:
    return _met_pairs(batches, _block)


def _grid(vectors: DataFrame, id_col: str, block: int, cells: int | None, sample: int):
    classes = _ready(vectors, id_col).groupBy("embedding").agg(F.min("id").alias("id"))
    blocks = _blocks(_placed(classes, cells, sample), block).withColumn("own", F.xxhash64("ids")).drop("dim")
    return _half_grid(blocks, _sides(classes, classes))


def near_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", block: int = 512, cells: int | None = None, sample: int = 4096) -> DataFrame:
    """(a, b, sim), a < b: all classes of equal vectors whose cosine, rounded to six places, is at least threshold. cells:
    directions, half the root of the number of classes unless given; sample: vectors on which they are fitted."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, itself in _pairs(batches):
            if _apart(a, b, threshold):
                continue
            sim = np.round(a[1] @ b[1].T, 6)
            near = (sim >= threshold) & (a[0][:, None] != b[0][None])
            i, j = np.nonzero(np.triu(near, 1) if itself else near)
            x, y = a[0][i], b[0][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sim[i, j])], ["a", "b", "sim"])

    return _grid(vectors, id_col, block, cells, sample).applyInArrow(_iterating(found), "a long, b long, sim double")


def pruning(vectors: DataFrame, threshold: float, id_col: str = "vec_id", block: int = 512, cells: int | None = None, sample: int = 4096) -> DataFrame:
    """(block_pairs, multiplied): how many pairs of blocks near_pairs meets, and how many of them it can't rule out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = [not _apart(a, b, threshold) for a, b, _ in _pairs(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([len(open_)], pa.int64()), pa.array([sum(open_)], pa.int64())], ["block_pairs", "multiplied"])

    counts = _grid(vectors, id_col, block, cells, sample).applyInArrow(_iterating(counted), "block_pairs long, multiplied long")
    return counts.agg(F.coalesce(F.sum("block_pairs"), F.lit(0)).alias("block_pairs"), F.coalesce(F.sum("multiplied"), F.lit(0)).alias("multiplied"))
