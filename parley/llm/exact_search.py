"""Exact top-k search by exhaustive term-at-a-time accumulation over blocks of vectors.

1. A vector's components become integers. A task cuts the rows that it reads into blocks of at most `BLOCK` candidates,
   sorted by id; a block holds for each dimension (term) its postings: the rows where it is not zero, with their
   weights. Queries are kept as sparse rows, `QUERIES` of them together. Both are stored once; no row is shuffled
   for this.
2. Cells of a grid take a group of queries and a group of candidate blocks. Their numbers follow the counts: a cell has
   at most `CELL_QUERIES` queries, which bounds what its task holds; candidate blocks stream through it.
3. In a task a tile of queries has a dense array of scores over a block. Term by term, the queries' weights times the
   postings are scattered into it; the postings of a term that most rows have are a dense column, added without
   places. Numbers are float32, float64 or Python's integers, the first that holds all scores exactly.
4. Of each tile and block a partition selection takes the k best (one number of score and place, so ties go to the
   smaller id), which are merged into the k best that the cell has so far. A window merges the cells' best.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; an empty vector has score 0
with all; a component that one of two vectors lacks counts as zero; rows that repeat an id are rows of their own, and a
query leaves out only its own row; a null id is no query, and as a candidate comes after all others among ties; a score
beyond a long counts as the nearest long; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared

BLOCK, QUERIES, TILE, CELL_QUERIES = 4096, 512, 32, 1 << 16
SCHEMA = "kind int, block long, n int, ids binary, nulls binary, rows binary, starts binary, at binary, weights binary, wide boolean"

_LONG = np.iinfo(np.int64)


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: which rows take part, and of these the lengths and floor(scale * x) of the components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = column.is_valid().to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * x)
    bad = np.bincount(row[~np.isfinite(x)], minlength=len(size)) > 0
    ok = there & ~bad
    return ok, size[ok], x[ok[row]]


def sparse(lines: np.ndarray, of: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of many lines starts if entries are sorted by line, and that order. of: breaks ties."""
    o = np.lexsort((of, lines))
    return np.concatenate([[0], np.cumsum(np.bincount(lines, minlength=many))]).astype("<i4"), o


def packed(weights: np.ndarray) -> tuple[bytes, bool]:
    """Weights as bytes, and if they are wide."""
    wide = bool(len(weights)) and float(np.abs(weights).max()) >= 1 << 15
    return weights.astype("<f8" if wide else "<i2").tobytes(), wide


def unpacked(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<f8" if wide else "<i2").astype(np.float64)


def blocks(vectors: DataFrame, is_query: Column, scale: float) -> DataFrame:
    """SCHEMA: kind 1 are blocks of candidates by term, kind 0 groups of queries by row. vectors(id, embedding)."""

    def record(kind, block, ids, nulls, rows, starts, at, weights):
        raw, wide = packed(weights)
        one = [kind, block, len(ids), ids.astype("<i8").tobytes(), nulls.tobytes(), rows.astype("<i8").tobytes(), starts.tobytes(), at.astype("<i4").tobytes(), raw, wide]
        return {f.split()[0]: [v] for f, v in zip(SCHEMA.split(", "), one, strict=True)}

    def cut(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33  # of the rows' numbers, and of the blocks'
        schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "nulls", "rows", "starts", "at", "weights")), ("wide", pa.bool_())])
        held, waiting = [], 0

        def emit():
            nonlocal base
            t = pa.concat_tables(held).combine_chunks()
            held.clear()
            ids = t.column(0).fill_null(0).to_numpy()
            nulls = t.column(0).is_null().to_numpy(zero_copy_only=False)
            query = t.column(1).to_numpy(zero_copy_only=False)
            size = t.column(2).to_numpy()
            x = t.column(3).combine_chunks().flatten().to_numpy() if len(t) else np.zeros(0)
            place = np.empty(len(ids), np.int64)
            place[np.lexsort((ids, nulls))] = np.arange(len(ids))  # a row's place in the block
            own = np.repeat(np.arange(len(ids)), size)
            term = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
            there = x != 0
            term, own, x = term[there], own[there], x[there]
            back = np.argsort(place)
            starts, o = sparse(term, place[own], int(size.max(initial=0)))
            yield record(1, base, ids[back], nulls[back], base + np.arange(len(ids)), starts, place[own][o], x[o])
            asked = np.flatnonzero(query)
            if len(asked):
                number = np.full(len(ids), -1)
                number[asked] = np.arange(len(asked))
                mine = number[own] >= 0
                starts, o = sparse(number[own[mine]], term[mine], len(asked))
                yield record(0, base, ids[asked], nulls[asked], base + place[asked], starts, term[mine][o], x[mine][o])
            base += len(ids)

        for b in batches:
            ok, size, x = integers(b.column(1), scale)
            off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            t = pa.table({"id": b.column(0).filter(pa.array(ok)), "query": b.column(2).filter(pa.array(ok)), "size": pa.array(size), "x": pa.LargeListArray.from_arrays(pa.array(off), pa.array(x))})
            while waiting + len(t) >= BLOCK:
                held.append(t.slice(0, BLOCK - waiting))
                t, waiting = t.slice(BLOCK - waiting), 0
                for r in emit():
                    yield pa.RecordBatch.from_pydict(r, schema)
            if len(t):
                held.append(t)
                waiting += len(t)
        if held:
            for r in emit():
                yield pa.RecordBatch.from_pydict(r, schema)

    asks = F.coalesce(is_query, F.lit(False)) & F.col("id").isNotNull()
    return vectors.select("id", "embedding", asks.alias("asks")).mapInArrow(cut, SCHEMA)


class Queries:
    """The queries of a cell as sparse rows, and the k best candidates of each so far."""

    def __init__(self, k: int):
        self.k, self.groups = k, []

    def add(self, r: dict) -> None:
        self.groups.append(r)

    def ready(self) -> None:
        if not isinstance(self.groups, list):
            return
        g, self.groups = self.groups, None
        self.ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in g])
        self.rows = np.concatenate([np.frombuffer(r["rows"], "<i8") for r in g])
        sizes = np.concatenate([np.diff(np.frombuffer(r["starts"], "<i4")) for r in g])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = np.concatenate([np.frombuffer(r["at"], "<i4") for r in g])
        self.weights = np.concatenate([unpacked(r["weights"], r["wide"]) for r in g])
        self.heaviest = float(np.abs(self.weights).max(initial=0))
        self.longest = int(sizes.max(initial=0))
        n = len(self.ids)
        self.score = np.full((n, self.k), -np.inf)
        self.best = np.zeros((n, self.k), np.int64)
        self.null = np.ones((n, self.k), bool)
        self.exact = None  # scores that float64 can't hold, as Python's integers

    def scored(self, lo: int, hi: int, block: Block, kind: type) -> np.ndarray:
        """The dense scores of a tile of queries over a block, term by term."""
        out = np.zeros((hi - lo, block.n), kind)
        a, b = self.starts[lo], self.starts[hi]
        own = np.repeat(np.arange(hi - lo), np.diff(self.starts[lo : hi + 1]))
        starts, o = sparse(self.terms[a:b], own, block.terms)
        own, weights = own[o], self.weights[a:b][o]
        weights = np.array([int(w) for w in weights], object) if kind is object else weights.astype(kind)
        product = np.empty((hi - lo, block.n), kind)
        for t in range(block.terms):
            q, w = own[starts[t] : starts[t + 1]], weights[starts[t] : starts[t + 1]]
            if not len(q):
                continue
            at, posted = block.postings(t, kind)
            if at is not None:
                out[np.ix_(q, at)] += np.multiply.outer(w, posted)
            elif len(q) == len(out):
                out += np.multiply.outer(w, posted, out=product)
            else:
                out[q] += np.multiply.outer(w, posted, out=product[: len(q)])
        return out

    def take(self, block: Block) -> None:
        """Scores a block and merges its best into those so far."""
        most = self.heaviest * block.heaviest * min(max(1, self.longest), max(1, block.terms))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 40 else object
        for lo in range(0, len(self.ids), TILE):
            hi = min(len(self.ids), lo + TILE)
            score = self.scored(lo, hi, block, kind)
            if kind is object:
                # past float64, exactly: a long's worth of each score, by a sort of the whole block
                score = np.clip(score, _LONG.min, _LONG.max).astype(np.int64)
                self.exact = self.exact if self.exact is not None else np.where(np.isfinite(self.score), self.score, _LONG.min).astype(np.int64)
                order = np.lexsort((np.broadcast_to(np.arange(block.n), score.shape), ~score), axis=1)
            else:
                key = score.astype(np.float64) * BLOCK + block.back
                key[self.own(lo, hi, block)] = -np.inf
                few = min(self.k, block.n)
                order = np.argpartition(key, block.n - few, axis=1)[:, block.n - few :] if few < block.n else np.broadcast_to(np.arange(block.n), key.shape)
            order = order[:, : self.k + 1] if kind is object else order
            new = np.take_along_axis(score, order, 1)
            there = np.ones(new.shape, bool)
            q, own = np.nonzero(order == self.column_of(lo, hi, block)[:, None])
            there[q, own] = False
            self.merge(lo, hi, new, block.ids[order], block.nulls[order], there)

    def column_of(self, lo: int, hi: int, block: Block) -> np.ndarray:
        """Each query's own place in the block, -1 if it is in another."""
        at = self.rows[lo:hi] - block.base
        return np.where((at >= 0) & (at < block.n), at, -1)

    def own(self, lo: int, hi: int, block: Block):
        at = self.column_of(lo, hi, block)
        q = np.flatnonzero(at >= 0)
        return q, at[q]

    def merge(self, lo, hi, score, ids, nulls, there) -> None:
        old = self.exact[lo:hi] if self.exact is not None else self.score[lo:hi]
        held = np.isfinite(self.score[lo:hi])
        score = np.concatenate([old, score.astype(old.dtype)], 1)
        ids, nulls, there = np.concatenate([self.best[lo:hi], ids], 1), np.concatenate([self.null[lo:hi], nulls], 1), np.concatenate([held, there], 1)
        # ~ turns the order of longs around without running over
        order = np.lexsort((ids, nulls, ~score if score.dtype == np.int64 else -score, ~there), axis=1)[:, : self.k]
        pick = lambda x: np.take_along_axis(x, order, 1)
        self.best[lo:hi], self.null[lo:hi] = pick(ids), pick(nulls)
        if self.exact is not None:
            self.exact[lo:hi] = pick(score)
        self.score[lo:hi] = np.where(pick(there), pick(score).astype(np.float64), -np.inf)

    def found(self):
        """Batches of the best: row of the query, query_id, vec_id, score."""
        for lo in range(0, len(self.ids), 4096):
            part = slice(lo, lo + 4096)
            q, at = np.nonzero(np.isfinite(self.score[part]))
            score = (self.exact if self.exact is not None else self.score)[part][q, at].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(self.rows[part][q]), pa.array(self.ids[part][q]), pa.array(self.best[part][q, at], mask=self.null[part][q, at]), pa.array(score)], names=["row", "query_id", "vec_id", "score"])


class Block:
    """A block of candidates: the postings of each term."""

    def __init__(self, r: dict):
        self.n, self.base = r["n"], int(np.frombuffer(r["rows"], "<i8")[0])
        self.ids, self.nulls = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nulls"], bool)
        self.starts, self.at = np.frombuffer(r["starts"], "<i4"), np.frombuffer(r["at"], "<i4")
        self.weights = unpacked(r["weights"], r["wide"])
        self.terms = len(self.starts) - 1
        self.heaviest = float(np.abs(self.weights).max(initial=0))
        self.back = np.float64(self.n - 1) - np.arange(self.n)
        self._kept: dict = {}

    def postings(self, t: int, kind: type):
        """(places, weights) of a term; places is None where most rows have it, and then all have a weight."""
        if (t, kind) not in self._kept:
            a, b = self.starts[t], self.starts[t + 1]
            at, w = self.at[a:b], self.weights[a:b]
            w = np.array([int(x) for x in w], object) if kind is object else w.astype(kind)
            if 2 * len(at) > self.n:
                full = np.zeros(self.n, kind)
                full[at] = w
                at, w = None, full
            self._kept[t, kind] = at, w
        return self._kept[t, kind]


def grid(queries: int, blocks: int, tasks: int) -> tuple[int, int]:
    """Numbers of groups of queries and of candidate blocks: as few query groups as their bound allows, as each of
    them reads all candidates, and enough cells for the tasks."""
    rows = max(1, -(-queries // CELL_QUERIES))
    return rows, max(1, min(blocks, -(-tasks // rows)))


def exact_top_k(vectors: DataFrame, k: int, is_query: Column, scale: float = 64.0, tasks: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) of every query among vectors
    (id, embedding). is_query is a condition on vectors. tasks: cells at least, if there are as many blocks."""
    spark = vectors.sparkSession
    tasks = tasks or 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = _shared.stored(blocks(vectors, is_query, scale), "vectors", hashes=True)
    many = {r.kind: (r.rows, r.blocks) for r in table.groupBy("kind").agg(F.sum("n").alias("rows"), F.count("*").alias("blocks")).collect()}
    rows, columns = grid(many.get(0, (0, 0))[0], many.get(1, (0, 0))[1], tasks)
    asks = F.col("kind") == 0
    line = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    others = F.sequence(F.lit(0), F.when(asks, F.lit(columns - 1)).otherwise(F.lit(rows - 1)))
    dealt = table.select("*", F.explode(others).alias("other"))
    cell = F.when(asks, line(rows) * columns + F.col("other")).otherwise(F.col("other") * columns + line(columns))
    dealt = dealt.withColumn("cell", cell.cast("long")).drop("other").repartition(rows * columns, "cell").sortWithinPartitions("cell", "kind", "block")
    best = dealt.mapInArrow(functools.partial(_searched, k), "row long, query_id long, vec_id long, score long")
    order = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(k: int, batches):
    cell, queries = None, None
    for b in batches:
        for r in b.to_pylist():
            if r["cell"] != cell:
                if queries is not None and queries.groups is None:
                    yield from queries.found()
                cell, queries = r["cell"], Queries(k)
            if r["kind"] == 0:
                queries.add(r)
            elif queries.groups != []:  # a cell without queries has nothing to do
                queries.ready()
                queries.take(Block(r))
    if queries is not None and queries.groups is None:
        yield from queries.found()


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.r, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""


def op12_term_at_a_time_search(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return exact_top_k(vectors, 20, F.col("id") % 20 == 0)
