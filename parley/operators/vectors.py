"""Vectors: similarity expressions, filtered search, nearest-neighbour joins, validation, approximate modes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from parley.schema import Search

from .filters import matching

EPSILON = 1e-8
METRICS = ("cosine", "l2")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    n = norm(a) + EPSILON
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Null where one vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def ranked(vectors: DataFrame, query: list[float], metric: str = "cosine", id_col: str = "id") -> tuple[DataFrame, list[Column]]:
    """vectors with `similarity` (cosine, or squared distance for l2) and the order from best to worst."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    q = F.lit(np.asarray(query, float).tolist()) if len(query) else F.array().cast("array<double>")
    score = cosine(F.col("embedding"), q) if metric == "cosine" else squared_l2(F.col("embedding"), q)
    best = F.col("similarity").desc_nulls_last() if metric == "cosine" else F.col("similarity").asc_nulls_last()
    return vectors.withColumn("similarity", F.round(score, 6)), [best, F.col(id_col)]


def search(chunks: DataFrame, query: list[float], filters: dict | None = None, config: Search = Search(), id_col: str = "id") -> DataFrame:
    """The top_k chunks. mode "pre" filters first and is exact; "post" filters the max_candidates nearest."""
    scored, order = ranked(chunks if config.mode == "post" else matching(chunks, filters), query, config.metric, id_col)
    near = F.col("similarity") >= config.threshold if config.metric == "cosine" else F.lit(True)
    if config.mode == "post":
        scored = matching(scored.orderBy(*order).limit(config.max_candidates), filters)
    found = scored.where(near).orderBy(*order).limit(config.top_k).drop("embedding")
    if not config.text:
        found = found.drop("text")
    return found if config.metadata else found.select(id_col, "similarity", *(["text"] if config.text else []))


def _blocks(df: DataFrame, id_col: str, block: int) -> DataFrame:
    """df's rows with an id as (ids, dims, m, item, own): blocks of vectors, padded to a common length; dims is -1 for a null
    one, item the bytes of a component, and own a number by which blocks are dealt evenly."""
    item = 4 if df.schema["embedding"].dataType.elementType == FloatType() else 8

    def blob(ids, data, own):
        dims = [-1 if x is None else len(x) for x in data]
        m = np.zeros((len(ids), max(1, *dims)), f"<f{item}")
        for i, x in enumerate(data):
            if x:
                m[i, : len(x)] = np.array(x, m.dtype)
        return pa.RecordBatch.from_pydict({"ids": pa.array([ids], pa.list_(pa.int64())), "dims": pa.array([dims], pa.list_(pa.int64())), "m": pa.array([m.tobytes()], pa.binary()), "item": pa.array([item], pa.int32()), "own": pa.array([own], pa.int32())})

    def rows(batches):
        ids, data, own = [], [], TaskContext.get().partitionId()
        for b in batches:
            ids += b.column(0).to_pylist()
            data += b.column(1).to_pylist()
            while len(ids) >= block:
                yield blob(ids[:block], data[:block], own)
                del ids[:block], data[:block]
                own += 1
        if ids:
            yield blob(ids, data, own)

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), "embedding").mapInArrow(rows, "ids array<long>, dims array<long>, m binary, item int, own int")


def _matrix(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array(r["ids"], np.int64)
    return ids, np.array(r["dims"], np.int64), np.frombuffer(r["m"], f"<f{r['item']}").reshape(len(ids), -1).astype(np.float64)


def _matrices(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [_matrix(r) for r in t.to_pylist()]


#: Bytes of one side of a cell of the grid, as doubles.
CELL_BYTES = 128 << 20
#: Rows of one side of a cell: what a task multiplies is bounded, and a larger table has more cells.
CELL_ROWS = 1 << 15


def _least_sides(t: DataFrame, rows: int) -> tuple[int, int]:
    r = t.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()
    return r.n, max(1, -(-r.n // rows), -(-r.n * r.d * 8 // CELL_BYTES))


def _sides(df: DataFrame, *tables: DataFrame, rows: int = CELL_ROWS) -> int:
    """Rows and columns of the grid of tasks on which two tables meet: no cell has more than about `rows` of either, or
    CELL_BYTES of their vectors."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    return max(int(np.ceil(tasks**0.5)), *(_least_sides(t, rows)[1] for t in {id(t): t for t in tables}.values()))


def _oblong(queries: DataFrame, vectors: DataFrame, rows: int = CELL_ROWS, least: int = 1024) -> tuple[int, int]:
    """(rows, columns) of the grid for tables of unlike sizes: the longer side is cut first, so that few queries are sent
    to where the vectors are, and those once."""
    tasks = 2 * max(vectors.sparkSession.sparkContext.defaultParallelism, 1)
    q, i = _least_sides(queries, rows)
    v, j = (q, i) if queries is vectors else _least_sides(vectors, rows)
    while i * j < tasks and max(q / i, v / j) > least:
        i, j = (i + 1, j) if q / i > v / j else (i, j + 1)
    return i, j


def _meeting(a: DataFrame, b: DataFrame, sides: tuple[int, int]):
    """Every block of a with every block of b: a block of a is sent along its row of the grid, one of b along its
    column. A cell is a partition of its own, as far as hashes allow: sizes in bytes say little of its work."""
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = a.select("*", F.pmod("own", F.lit(sides[0])).alias("i"), across(sides[1]).alias("j")).repartition(sides[0] * sides[1], "i", "j")
    y = b.select("*", F.pmod("own", F.lit(sides[1])).alias("j"), across(sides[0]).alias("i")).repartition(sides[0] * sides[1], "i", "j")
    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j"))


def _half_grid(blocks: DataFrame, sides: int):
    """Each two blocks (with `own`) in one cell (i <= j) of the grid, grouped by i and j; first: of the cell's row and not its
    column. On the diagonal a block is there once."""
    own = blocks.withColumn("own", F.pmod("own", F.lit(sides)).cast("int"))
    cell = lambda i, j, first: F.struct(i.alias("i"), j.alias("j"), F.lit(first).alias("first"))
    along = F.transform(F.sequence("own", F.lit(sides - 1)), lambda j: cell(F.col("own"), j, True))
    down = F.transform(F.filter(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: i < F.col("own")), lambda i: cell(i, F.col("own"), False))
    return own.select("*", F.explode(F.concat(along, down)).alias("at")).drop("own").select("*", "at.*").drop("at").repartition(sides * (sides + 1) // 2, "i", "j").groupBy("i", "j")


def _met_pairs(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[tuple, tuple, bool]]:
    """The pairs of blocks of a cell of the half grid, each as `read` has it, and if a pair is a block with itself."""
    left, right, diagonal = [], [], False
    for b in batches:
        for r in b.to_pylist():
            (left if r["first"] else right).append(read(r))
            diagonal = diagonal or r["i"] == r["j"]
    for k, a in enumerate(left):
        for n, b in enumerate(left[k:] if diagonal else right):
            yield a, b, diagonal and n == 0


def _iterating(f):
    """f with the types by which Spark knows that it takes and gives iterators."""

    def batches(b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(b)

    batches.__annotations__ = {"b": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return batches


def _together(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of blocks, without null ones; shorter vectors are filled with zeros."""
    wide, many = max((m.shape[1] for _, _, m in blocks), default=1), sum(int((d >= 0).sum()) for _, d, _ in blocks)
    ids, out, n = np.zeros(many, np.int64), np.zeros((many, wide)), 0
    for i, d, m in blocks:
        ok = d >= 0
        ids[n : n + ok.sum()], out[n : n + ok.sum(), : m.shape[1]] = i[ok], m[ok]
        n += ok.sum()
    return ids, out


def _folded(ids: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Which rows can be among anyone's k nearest, by id: of equal vectors those of the k + 1 least ids."""
    of = np.unique(np.ascontiguousarray(m).view(f"V{m.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel() if len(m) else np.zeros(0, int)
    order = np.lexsort((ids, of))
    begins = np.r_[True, np.diff(of[order]) != 0] if len(order) else np.zeros(0, bool)
    steps = np.cumsum(np.r_[True, (np.diff(of[order]) != 0) | (np.diff(ids[order]) != 0)]) if len(order) else np.zeros(0, int)
    first = np.maximum.accumulate(np.where(begins, steps, 0)) if len(order) else steps
    kept = order[steps - first <= k]
    return kept[np.argsort(ids[kept], kind="stable")]


def _units(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(size[:, None] > 0, m / np.where(size > 0, size, 1)[:, None], 0).astype(np.float32)


def _nearest(q: pa.Table, v: pa.Table, k: int, wide: int = 4096) -> pa.Table:
    """Each query's k nearest other vectors of a cell."""
    return _nearest_of(_matrices(q), *_together(_matrices(v)), k, wide)


def _nearest_of(queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, m: np.ndarray, k: int, wide: int = 4096) -> pa.Table:
    """Products of single precision leave out what can't be among the k nearest, by more than they may err; the rest is
    computed in double precision."""
    kept = _folded(ids, m, k)
    ids, m = ids[kept], m[kept]
    size = np.linalg.norm(m, axis=1)
    units, out = _units(m, size), []
    for qi, qm in (_together([b]) for b in queries):
        d = min(qm.shape[1], m.shape[1])
        err = 1e-6 + 1.2e-7 * (d + 8)
        q_size = np.linalg.norm(qm, axis=1)
        q_units = _units(qm, q_size)
        # norms of such vectors may underflow, and those of single precision say nothing
        odd, q_odd = size < 1e-140, q_size < 1e-140
        best, best_id = np.full((len(qi), k), -np.inf), np.full((len(qi), k), np.iinfo(np.int64).max)
        for at in range(0, len(ids), wide):
            part = slice(at, at + wide)
            with np.errstate(all="ignore"):
                near = q_units[:, :d] @ units[part, :d].T
            if not at and near.shape[1] > k:
                others = np.where(np.isfinite(near) & (qi[:, None] != ids[None, part]), near, -np.inf)
                floor = np.partition(others, -k, axis=1)[:, -k] - 2 * err
            else:
                floor = best[:, -1] - err
            found = near >= np.maximum(floor, -2)[:, None].astype(np.float32)
            if odd[part].any():
                found[:, odd[part]] = True
            if q_odd.any():
                found[q_odd] = True
            row, col = np.divmod(np.flatnonzero(found), near.shape[1])
            col += at
            sim = np.empty(len(row))
            for lo in range(0, len(row), 1 << 16):
                r, c = row[lo : lo + (1 << 16)], col[lo : lo + (1 << 16)]
                with np.errstate(all="ignore"):
                    sim[lo : lo + len(r)] = np.round(np.einsum("ij,ij->i", qm[r, :d], m[c, :d]) / np.maximum(q_size[r] * size[c], 1e-300), 6)
            last, last_id = best[row, -1], best_id[row, -1]
            ok = np.isfinite(sim) & (qi[row] != ids[col]) & ((sim > last) | ((sim == last) & (ids[col] < last_id)))
            row, col, sim = row[ok], col[ok], sim[ok]
            if not len(row):
                continue
            some = np.unique(row)
            r = np.concatenate([np.repeat(some, k), row])
            s, i = np.concatenate([best[some].ravel(), sim]), np.concatenate([best_id[some].ravel(), ids[col]])
            order = np.lexsort((i, -s, r))
            r, s, i = r[order], s[order], i[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            top = rank < k
            best[r[top], rank[top]], best_id[r[top], rank[top]] = s[top], i[top]
        ok = np.isfinite(best)
        out.append((np.repeat(qi, ok.sum(1)), best_id[ok], best[ok]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "sim": pa.array(cols[2], pa.float64())})


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", block: int = 1024) -> DataFrame:
    """(query_id, id, sim, rank): each query's k nearest other vectors by cosine, exact.

    Blocks of both tables meet on a grid of tasks (matrix products); of each task only k rows a query leave it. The work
    is the product of both tables' rows, that of a task is bounded."""
    meeting = _meeting(_blocks(queries, id_col, block), _blocks(vectors, id_col, block), _oblong(queries, vectors))
    return _top(meeting.applyInArrow(lambda q, v: _nearest(q, v, k), "query_id long, id long, sim double"), k)


def similarity_matrix(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(a, b, sim) of all pairs a <= b of a table that is small by nature (a result page)."""
    a = vectors.select(F.col(id_col).alias("a"), F.col("embedding").alias("x"))
    b = vectors.select(F.col(id_col).alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("a") <= F.col("b")).select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("sim"))


#: Rows of a block of the matrix at most: a pair of blocks is 16.8 million rows of the result.
MATRIX_ROWS = 1 << 12


def similarity_blocks(vectors: DataFrame, id_col: str = "vec_id", block: int | None = None, saved: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
    """similarity_matrix of a table of any size. saved: writes a table of blocks and reads it again; without it `vectors` has
    to read the same each time.

    Tasks take pairs of blocks from a Cartesian product, so a vector is stored and shuffled once, and what is sent grows with
    the table. The result alone grows with its square: a pair's rows leave in the order of their similarities, of which equal
    ones take little room in Parquet when a pair has millions of rows; in the order of ids each takes eight bytes."""
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, 1)
    many = vectors.count()
    block = block or int(min(MATRIX_ROWS, max(MATRIX_ROWS // 2, many / (2 * tasks) ** 0.5 / 2)))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                (r,) = batch.slice(n, 1).to_pylist()
                yield from _by_similarity(_matrix(r["x"]), _matrix(r["y"]), r["same"])

    # not from more partitions than there are full blocks, so that few blocks are small
    whole = saved(_blocks(vectors.coalesce(max(1, -(-many // block))), id_col, block).withColumn("no", F.monotonically_increasing_id()))
    # two blocks or so in a partition, dealt round
    side = lambda name: whole.repartition(max(1, -(-many // (2 * block)))).select(F.col("no").alias(f"{name}_no"), F.struct("ids", "dims", "m", "item").alias(name))
    # of two blocks one order, which is first by turns
    once = (F.col("x_no") == F.col("y_no")) | ((F.col("x_no") < F.col("y_no")) == ((F.col("x_no") + F.col("y_no")) % 2 == 0))
    pairs = side("x").join(side("y").hint("shuffle_replicate_nl"), once)
    return pairs.select("x", "y", (F.col("x_no") == F.col("y_no")).alias("same")).mapInArrow(paired, "a long, b long, sim double")


def _by_similarity(first: tuple[np.ndarray, np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray, np.ndarray], itself: bool, strip: int = 512, parts: int = 8, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The rows (a, b, sim) of two blocks, or of one with itself, by similarity, nulls last."""
    (ai, ad, x), (bi, bd, y) = first, other
    wide, y_size = min(x.shape[1], y.shape[1]), np.linalg.norm(y, axis=1)
    null, left_out = np.iinfo(np.int32).max, np.iinfo(np.int32).min
    odd = None  # similarities that aren't finite
    keys = np.empty((len(ai), len(bi)), np.int32)  # millionths, those with a minus sign less by one, as there is a -0
    for at in range(0, len(ai), strip):
        part = slice(at, at + strip)
        with np.errstate(all="ignore"):
            size = np.linalg.norm(x[part], axis=1)[:, None] * y_size[None]
            # null where a vector is null or zero, or the two differ in length
            no = (ad[part, None] != bd[None]) | (ad[part, None] < 0) | (size == 0)
            sim = np.rint((x[part, :wide] @ y[:, :wide].T / np.where(no, 1, size)) * 1e6)
            far = ~no & ~(np.abs(sim) < 1 << 30)
        if far.any():
            odd = np.full(keys.shape, np.nan) if odd is None else odd
            odd[part] = np.where(far, sim / 1e6, odd[part])
        keys[part] = np.where(no, null, np.where(far, null - 1, np.where(no | far, 0, sim) - np.signbit(sim)))
    if itself:
        keys[np.tril_indices(len(ai), -1)] = left_out
    keys = keys.ravel()
    some = keys[:: max(1, len(keys) // 4096)]
    some = some[some > left_out]
    cuts = np.unique(np.quantile(some, np.arange(1, parts) / parts).astype(np.int64)) if len(some) else []
    for low, high in zip([left_out + 1, *cuts], [*cuts, null + 1], strict=True):
        found = np.flatnonzero((keys >= low) & (keys < high))
        found = found[np.argsort(keys[found], kind="stable")]
        for at in range(0, len(found), rows):
            k = found[at : at + rows]
            i, j = np.divmod(k, len(bi))
            # rows that share an id are a pair in both orders
            twice = (ai[i] == bi[j]) & ((i != j) | (not itself))
            if twice.any():
                k, i, j = (np.repeat(v, 1 + twice) for v in (k, i, j))
            a, b, key = ai[i], bi[j], keys[k].astype(np.int64)
            sim = np.where(key < 0, -((-key - 1) / 1e6), key / 1e6)
            if odd is not None:
                sim = np.where(key == null - 1, odd.ravel()[k], sim)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim, pa.float64(), mask=key == null)], ["a", "b", "sim"])


def dimension_stats(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg(*[F.round(f(F.col("v").cast("double")), 6).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("low", F.min), ("high", F.max))])


def validation(vectors: DataFrame) -> DataFrame:
    """One row: how many vectors there are, are missing, or differ in size from the commonest, and their norms."""
    common = vectors.where("embedding IS NOT NULL").agg(F.mode(F.size("embedding"), True).alias("dim"))
    n = norm(F.col("embedding"))
    return vectors.join(F.broadcast(common)).agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.size("embedding") != F.col("dim")).alias("odd_size"), F.max("dim").cast("bigint").alias("dim"), F.round(F.avg(n), 6).alias("norm_mean"), F.round(F.stddev_pop(n), 6).alias("norm_std"))


def issues(vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, issue): the rows whose vector is missing or not of the commonest size."""
    common = vectors.where("embedding IS NOT NULL").agg(F.mode(F.size("embedding"), True).alias("dim"))
    issue = F.when(F.col("embedding").isNull(), "missing embedding").when(F.size("embedding") != F.col("dim"), "inconsistent embedding dimension")
    return vectors.join(F.broadcast(common)).select(F.col(id_col).alias("id"), issue.alias("issue")).where("issue IS NOT NULL")


def text_stats(chunks: DataFrame, words: Column) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.sum(words).alias("total_tokens"), F.round(F.avg(F.length("text")), 6).alias("average_length"))


class CellIndex:
    """A stored approximate index: k-means cells, of which a search reads the nearest `probes`.

    The folder holds `rows`, partitioned by cell so that a search lists and reads its cells only, and `cells` (cell, center,
    probes). Cells are fitted on about `sample` vectors at most, every vector is indexed, and as many probes are noted as give
    `recall` of the ten nearest to at most `asked` vectors, measured against all of them."""

    def __init__(self, spark: SparkSession, folder: str):
        found = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # a row a cell, 4096 at most
        self.spark, self.folder = spark, folder
        self.centers, self.probes = np.array([r.center for r in found]), found[0].probes

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, id_col: str = "vec_id", cells: int | None = None, sample: int = 100_000, asked: int = 200, recall: float = 0.97, seed: int = 7) -> "CellIndex":
        """cells: half the root of the number of vectors, 4096 at most."""
        spark, ready = vectors.sparkSession, vectors.where(F.col("embedding").isNotNull() & F.col(id_col).isNotNull())
        many = ready.count()
        cells = cells or int(min(4096, max(1, round(many**0.5 / 2))))
        # by a bound of hashes, so that the sample stays where it is and no task orders it
        some = ready if many <= sample else ready.where(F.pmod(F.xxhash64("embedding", id_col), F.lit(1 << 40)) < F.lit((sample << 40) // many))
        model = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell").fit(some.select(array_to_vector("embedding").alias("_v")))
        centers = np.array(model.clusterCenters())
        near = _cells(centers, 1)
        cls._placed(ready, near).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
        queries = ready.orderBy(F.xxhash64(F.col(id_col), F.lit(1))).limit(asked).select(id_col, "embedding")
        truth = knn_join(queries, ready, 10, id_col).select("query_id", F.col("id").alias(id_col)).join(spark.read.parquet(f"{folder}/rows").select(id_col, "cell"), id_col)
        ranks = _cells(centers, len(centers))
        order = {r[0]: r.order for r in queries.select(id_col, ranks("embedding").alias("order")).collect()}  # at most `asked` rows
        places = sorted(order[r.query_id].index(r.cell) for r in truth.collect())  # at most ten a query
        probes = places[min(len(places) - 1, int(np.ceil(recall * len(places))))] + 1 if places else 1
        spark.createDataFrame([(i, [float(x) for x in c], probes) for i, c in enumerate(centers)], "cell int, center array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
        return cls(spark, folder)

    @staticmethod
    def _placed(ready: DataFrame, near) -> DataFrame:
        # rows of one cell are written by as many tasks as they come from when it is large
        return ready.withColumn("cell", F.get(near("embedding"), 0)).hint("rebalance", "cell")

    def search(self, query: list[float], probes: int | None = None, filters: dict | None = None, config: Search = Search(), id_col: str = "id") -> DataFrame:
        near = _order(np.asarray([query], float), self.centers)[0][: probes or self.probes]
        rows = self.spark.read.parquet(f"{self.folder}/rows").where(F.col("cell").isin([int(c) for c in near]))
        return search(rows.drop("cell"), query, filters, config, id_col)

    def search_all(self, queries: DataFrame, k: int = 10, id_col: str = "vec_id", probes: int | None = None, block: int = 2048) -> DataFrame:
        """(query_id, id, sim, rank) for many queries: each is sent to its cells, and a cell's blocks are multiplied."""
        asked = queries.withColumn("cell", F.explode(_cells(self.centers, probes or self.probes)("embedding")))
        rows = self.spark.read.parquet(f"{self.folder}/rows").select(F.col(id_col).cast("long").alias("id"), "embedding", "cell")
        # a large cell is dealt to several tasks, each of which gets its queries
        counts = [(r.cell, -(-r["count"] // (1 << 16))) for r in rows.groupBy("cell").count().collect()]  # a row a cell
        parts = lambda: F.broadcast(self.spark.createDataFrame(counts, "cell int, parts long"))
        rows = rows.join(parts(), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        asked = asked.select(F.col(id_col).cast("long").alias("id"), "embedding", "cell").join(parts(), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - F.lit(1).cast("long"))))

        def best(q: pa.Table, v: pa.Table) -> pa.Table:
            def rows(t):
                data = t["embedding"].to_pylist()
                m = np.zeros((len(data), max([1, *map(len, data)])))
                for i, x in enumerate(data):
                    m[i, : len(x)] = x
                return np.array(t["id"].to_pylist(), np.int64), np.zeros(len(data), np.int64), m

            (qi, qd, qm), (vi, _, vm) = rows(q), rows(v)
            return _nearest_of([(qi[n : n + block], qd[n : n + block], qm[n : n + block]) for n in range(0, len(qi), block)], vi, vm, k)

        return _top(asked.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(best, "query_id long, id long, sim double"), k)


def _order(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The centers from near to far, for each row of x."""
    return np.argsort((centers**2).sum(1)[None] - 2 * x @ centers.T, axis=1, kind="stable")


def _cells(centers: np.ndarray, n: int):
    """The n nearest cells of a vector, as a column function."""

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        return pd.Series([o.tolist() for o in _order(np.array(v.tolist(), float).reshape(len(v), -1), centers)[:, :n].astype(np.int32)])

    return near


def lsh_neighbours(vectors: DataFrame, query: list[float], k: int = 10, tables: int = 8, length: float = 0.8) -> DataFrame:
    """Approximate nearest neighbours by random projections."""
    from pyspark.ml.linalg import Vectors

    ready = vectors.where("embedding IS NOT NULL").withColumn("_v", array_to_vector("embedding"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", numHashTables=tables, bucketLength=length, seed=7).fit(ready)
    return model.approxNearestNeighbors(ready, Vectors.dense(query), k).drop("_v", "_h")
