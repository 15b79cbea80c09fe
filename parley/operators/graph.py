"""A neighbour graph over vectors, built by neighbour-descent rounds and searched best-first.

Build: each vector begins with neighbours by chance. In a round every node introduces its neighbours, and a bounded choice of
the nodes that name it, to each other: their vectors meet in one row of at most twice the degree, whose products are
taken at once, and a pair leaves it only if it is better than the worst neighbour that one of the two has. A node keeps its
`degree` nearest. It ends when fewer than `still` of all edges are new.

Stored: `nodes` (node, v, near, part): each vector with its neighbours and the nearest of those that name it; and `entries`,
a bounded sample from which searches begin.

Search: all queries go at once. A query's state is its beam: the nearest nodes that it has seen, each expanded or not. In a
round the `expand` nearest unexpanded ones are looked up, their neighbours are scored, and the beam keeps the nearest. It ends
when no query has an unexpanded node left. No vector but the entries goes to the driver.

The measure is cosine. Defined cases: null vectors and ids are not indexed; zero vectors have similarity 0 to all; of rows
that share an id the least vector counts; of vectors of unlike length the shorter is filled with zeros; few vectors are
all neighbours of each other; in an empty index nothing is found.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vectors import dot, norm

#: At most so many nodes from which searches begin.
ENTRIES = 512


def _unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)).cast("float"))


def _padded(lists: pa.Array) -> np.ndarray:
    """A list column as a matrix, short rows filled with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=1))), np.float32)
    out[np.arange(out.shape[1])[None] < size[:, None]] = lists.flatten().to_numpy()
    return out


def _introduced(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(a, b, sim): of the nodes that share a center in rows(center, node), the pairs that are better for a than its worst in
    state(node, v, worst). A center has a bounded number of nodes."""

    def pairs(batches):
        for t in batches:
            lists = t.column(0)
            flat = lists.flatten()
            node, worst, v = flat.field("node").to_numpy(), flat.field("worst").to_numpy(), _padded(flat.field("v"))
            off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for lo, hi in zip(off[:-1], off[1:], strict=True):
                sim = np.round((v[lo:hi] @ v[lo:hi].T).astype(np.float64), 6)
                i, j = np.nonzero((sim > worst[lo:hi, None]) & ~np.eye(hi - lo, dtype=bool))
                out.append((node[lo:hi][i], node[lo:hi][j], sim[i, j]))
            a, b, sim = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim)], names=["a", "b", "sim"])

    met = rows.join(state, "node").groupBy("center").agg(F.collect_list(F.struct("node", "v", "worst")).alias("met"))
    return met.select("met").mapInArrow(pairs, "a long, b long, sim double")


def _nearest(found: DataFrame, n: int, twice: int = 1) -> DataFrame:
    """(a, near): the n nearest of each node, by a ranking that leaves out most rows before they are sent; a pair may be there
    `twice` times."""
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), F.desc("b")))
    some = found.withColumn("rank", rank).where(F.col("rank") <= n * twice)
    best = F.sort_array(F.collect_set(F.struct("sim", F.col("b").alias("node"))), asc=False)
    return some.groupBy("a").agg(F.slice(best, 1, n).alias("near"))


class NeighbourGraph:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.about = json.loads(spark.read.text(f"{folder}/about").first().value)

    # ---- build

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, id_col: str = "vec_id", degree: int = 16, rounds: int = 12, still: float = 0.01, parts: int = 64, entries: int = ENTRIES) -> "NeighbourGraph":
        """vectors(id_col, embedding, ...). rounds: at most; still: the share of new edges with which it ends."""
        spark = vectors.sparkSession
        saved = _Saved(spark, folder)
        ready = vectors.where(F.col(id_col).isNotNull() & F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("node"), "embedding")
        units = saved(ready.groupBy("node").agg(F.min("embedding").alias("v")).select("node", _unit(F.col("v")).alias("v")))
        total = units.count()
        nothing = units.select("node", "v", F.lit(float("-inf")).alias("worst"))
        groups = max(1, total // (degree + 1))
        # twice dealt to small groups by hashes: the size of a group is what chance makes of `degree` nodes
        dealt = [units.select(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(groups)).alias("center"), "node") for k in (1, 2)]
        first = _introduced(dealt[0], nothing).union(_introduced(dealt[1], nothing))
        edges, done = saved(_nearest(first, degree, 2)), 0
        for done in range(1, rounds + 1):
            before, edges = edges, saved(cls._round(units, edges, degree, done))
            pair = lambda t: t.select("a", F.explode("near.node").alias("b"))
            if pair(edges).join(pair(before), ["a", "b"], "left_anti").count() <= still * total * degree:
                break
        # an edge is gone along from both its ends: a node also has the nearest of those that name it
        back = edges.select(F.explode("near").alias("x"), F.col("a").alias("b")).select(F.col("x.node").alias("a"), "b", F.col("x.sim").alias("sim"))
        back = _nearest(back, degree).select(F.col("a").alias("node"), F.col("near.node").alias("named"))
        graph = units.join(edges.select(F.col("a").alias("node"), F.col("near.node").alias("own")), "node", "left").join(back, "node", "left")
        none = F.array().cast("array<bigint>")
        near = F.array_distinct(F.concat(F.coalesce("own", none), F.coalesce("named", none)))
        graph = graph.select("node", "v", near.alias("near"), F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"))
        graph.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/nodes")
        units.orderBy(F.xxhash64("node", F.lit(3))).limit(entries).write.mode("overwrite").parquet(f"{folder}/entries")
        about = {"degree": degree, "rounds": done, "nodes": total, "parts": parts}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")
        saved.drop()
        return cls(spark, folder)

    @staticmethod
    def _round(units: DataFrame, edges: DataFrame, degree: int, seed: int) -> DataFrame:
        own = edges.select(F.col("a").alias("center"), F.explode("near").alias("x")).select("center", F.col("x.node").alias("node"), F.col("x.sim").alias("sim"))
        # of those that name a node a choice of `degree`, another in each round
        chance = F.row_number().over(W.partitionBy("center").orderBy(F.xxhash64("center", "node", F.lit(seed))))
        back = own.select(F.col("node").alias("center"), F.col("center").alias("node")).withColumn("rank", chance).where(F.col("rank") <= degree)
        hood = own.select("center", "node").union(back.select("center", "node")).distinct()
        worst = edges.select(F.col("a").alias("node"), F.when(F.size("near") >= degree, F.element_at("near", -1)["sim"]).otherwise(float("-inf")).alias("worst"))
        state = units.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
        found = _introduced(hood, state).distinct()
        return _nearest(found.union(own.select(F.col("center").alias("a"), F.col("node").alias("b"), "sim")), degree, 2)

    # ---- search

    def nodes(self) -> DataFrame:
        return self.spark.read.schema("node bigint, v array<float>, near array<bigint>, part int").parquet(f"{self.folder}/nodes")

    def search_all(self, queries: DataFrame, k: int = 10, id_col: str = "vec_id", beam: int = 64, expand: int = 8, starts: int = 8, rounds: int = 64) -> DataFrame:
        """(query_id, id, sim, rank): of each query(id_col, embedding) its k nearest indexed vectors but its own id, by best-first
        search with a beam. rounds: at most; each expands `expand` nodes a query."""
        saved = _Saved(self.spark, self.folder)
        asked = saved(queries.where(F.col(id_col).isNotNull() & F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("q"), _unit(F.col("embedding")).alias("x")).dropDuplicates(["q"]))
        entries = self.spark.read.parquet(f"{self.folder}/entries").collect()  # ENTRIES at most
        ids, m = [r.node for r in entries], _matrix([r.v for r in entries])

        @F.pandas_udf("array<struct<sim:double,node:bigint>>")
        def nearest(x: pd.Series) -> pd.Series:
            out = []
            for v in x:
                d = min(len(v), m.shape[1])
                sim = np.round((m[:, :d] @ np.asarray(v[:d], np.float32)).astype(np.float64), 6)
                out.append([{"sim": float(sim[i]), "node": ids[i]} for i in np.argsort(-sim, kind="stable")[:starts]])
            return pd.Series(out)

        begun = asked.select("q", nearest("x").alias("beam"))
        state = saved(begun.select("q", F.transform("beam", lambda b: F.struct(b["sim"].alias("sim"), b["node"].alias("node"), F.lit(False).alias("done"))).alias("beam")))
        graph = self.nodes()
        for _ in range(rounds):
            todo = F.slice(F.filter("beam", lambda b: ~b["done"]), 1, expand)
            front = state.select("q", F.explode(todo.getField("node")).alias("at"), F.col("beam.node").alias("seen"))
            if not front.limit(1).count():
                break
            near = front.join(graph.select(F.col("node").alias("at"), "near"), "at").select("q", F.explode(F.array_except("near", "seen")).alias("node")).distinct()
            scored = near.join(asked, "q").join(graph.select("node", "v"), "node").select("q", "node", F.round(dot(F.col("x"), F.col("v")), 6).alias("sim"))
            new = scored.groupBy("q").agg(F.collect_list(F.struct("sim", "node", F.lit(False).alias("done"))).alias("new"))
            expanded = F.transform("beam", lambda b: F.struct(b["sim"].alias("sim"), b["node"].alias("node"), (b["done"] | F.array_contains(todo.getField("node"), b["node"])).alias("done")))
            merged = F.concat(expanded, F.coalesce("new", F.array().cast("array<struct<sim:double,node:bigint,done:boolean>>")))
            state = saved(state.join(new, "q", "left").select("q", F.slice(F.sort_array(merged, asc=False), 1, beam).alias("beam")), state)
        kept = F.slice(F.array_sort(F.filter("beam", lambda b: b["node"] != F.col("q")), lambda a, b: F.when(a["sim"] > b["sim"], -1).when(a["sim"] < b["sim"], 1).when(a["node"] < b["node"], -1).when(a["node"] > b["node"], 1).otherwise(0)), 1, k)
        return state.select(F.col("q").alias("query_id"), F.posexplode(kept).alias("at", "b")).select("query_id", F.col("b.node").alias("id"), F.col("b.sim").alias("sim"), (F.col("at") + 1).alias("rank"))


def _matrix(vectors: list) -> np.ndarray:
    out = np.zeros((len(vectors), max([1, *map(len, vectors)])), np.float32)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class _Saved:
    """Tables of one computation, written below the index's folder and read again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/work/{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, over: DataFrame | None = None) -> DataFrame:
        """over: a table that is not read after this one."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        if over is not None:
            for old in {f.rpartition("/")[0] for f in over.inputFiles()}:
                self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
