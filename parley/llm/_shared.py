"""Scratch tables in the cluster's shared folder, checked broadcasts, connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of (at most 64 bytes) that may be broadcast after they were counted.
BROADCAST_ROWS = 200_000
#: The same for rows that are one long.
BROADCAST_LONGS = 2_000_000
#: Edges that one task joins by itself at a time.
EDGES = 1 << 18


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without it gets
    a folder of its own, as all its tasks run on this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own:
        own = tempfile.mkdtemp(prefix="parley-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own[context.applicationId] = f"file://{own}"
    return _own[context.applicationId]


def stored(df: DataFrame, name: str, hashes: bool | str = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again; the files go when the driver's JVM ends, or as soon
    as a `Scratch` drops them. hashes: nearly all values (of that column) are different, so no dictionary is tried."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/parley-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    # the shuffle files of this write serve nothing else: they go with its end
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        writer = df.write.option("parquet.dictionary.page.size", str(16 << 20))
        writer = writer.option(f"parquet.enable.dictionary#{hashes}", "false") if isinstance(hashes, str) else writer.option("parquet.enable.dictionary", str(not hashes).lower())
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def scrapped(table: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The stored tables of one computation. A table goes by `drop` after its last reader; the end of the block drops
    all others but those given to `keep`, which the result still reads."""

    def __init__(self):
        self._tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self._tables)

    def stored(self, df: DataFrame, name: str, hashes: bool | str = False) -> DataFrame:
        self._tables.append(stored(df, name, hashes))
        return self._tables[-1]

    def keep(self, table: DataFrame) -> DataFrame:
        self._tables = [t for t in self._tables if t is not table]
        return table

    def drop(self, *tables: DataFrame) -> None:
        for t in list(tables):
            self.keep(t)
            scrapped(t)


@contextlib.contextmanager
def smaller_batches(spark: SparkSession, rows: int):
    """What runs in this block sends Python workers so many rows at a time, which bounds what both sides hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is (the join then shuffles).
    df should be a stored table or small to count; rows wider than 64 bytes need a lower bound."""
    return F.broadcast(df) if is_small(df, rows) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) from every node but the roots to the smallest node that edges (a, b) connect it with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        # roots hook on smaller ones, then all nodes go up to their root
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    low = up != np.arange(len(nodes))
    return nodes[low], nodes[up[low]]


def _forests(batches):
    """The forests of at most EDGES edges at a time."""
    held, n = [], 0

    def joined():
        a, b = forest(*(np.concatenate([r.column(k).to_numpy() for r in held]) for k in (0, 1)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for r in batches:
        if held and n + len(r) > EDGES:
            yield joined()
            n = 0
        held.append(r)
        n += len(r)
    if held:
        yield joined()


def _with_roots(batches):
    """(node, root) of one forest's edges, roots too."""
    roots = np.zeros(0, np.int64)
    for r in batches:
        roots = np.union1d(roots, r.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays(r.columns, names=["node", "root"])
    yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int64())] * 2, names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): rows (node, root), root being the smallest node reachable.

    Tasks first put stars in place of the components of their own at most EDGES edges, and again as long as this halves
    the table; a table of at most EDGES edges is done then. Larger ones go on with large-star and small-star steps on the
    edge table, in turn, until it no longer changes; the number of steps grows
    with the square of the logarithm of the nodes at most, so no limit is set. Each step sends a node's edges to the smallest neighbour by a partial
    aggregate and a join, which adaptive execution can split when one node has very many edges; every step's table is
    written to the shared folder, and the one before it goes."""
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    left, tasks = links.count(), 0
    while tasks != 1:
        n, tasks = left, max(1, -(-left // EDGES))
        last, links = links, stored(links.coalesce(tasks).mapInArrow(_forests, "a long, b long"), "edges")
        scrapped(last)
        left = links.count()
        if 2 * left > n:
            break
    if tasks == 1:
        return links.coalesce(1).mapInArrow(_with_roots, "node long, root long")
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        last, links = links, stored(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        scrapped(last)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return links.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
