"""One object with all operations of an index."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.encoder import Encoder, HashingEncoder
from parley.operators import lookups, vectors
from parley.operators.filters import matching, search_filters
from parley.operators.graph import NeighbourGraph
from parley.schema import Chunking, Search
from parley.shipping import ship
from parley.sources.store import Store
from parley.streaming import watch


#: The node of a graph that stands for a query.
NO_NODE = -(2**63)
#: How a search finds the nearest: of all chunks, in k-means cells, or along a neighbour graph.
INDEX_TYPES = ("flat", "cells", "graph")


class Engine:
    def __init__(self, spark: SparkSession, folder: str, encoder: Encoder | None = None, chunking: Chunking = Chunking(), signs: list[str] = (), index_type: str = "flat"):
        """signs: what marks a message as a hook's, besides the fixed values (names of a product, for instance). index_type:
        of INDEX_TYPES; all but flat are approximate and search what `build_index` found last."""
        if index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type: {index_type}; there are {', '.join(INDEX_TYPES)}")
        ship(spark)
        self.index_type = index_type
        self.spark, self.store, self.encoder, self.chunking, self.signs = spark, Store(spark, folder), encoder or HashingEncoder(), chunking, list(signs)

    def index(self, path: str, force: bool = False) -> watch.Run:
        return watch.index(self.spark, path, self.store, self.encoder, self.chunking, force=force, signs=self.signs)

    def watch(self, path: str, quiet: float = 5):
        return watch.watch(self.spark, path, self.store, quiet, encoder=self.encoder, config=self.chunking, signs=self.signs)

    def semantic_search(self, query: str, top_k: int = 10, mode: str = "pre", **filters) -> DataFrame:
        """filters: project, has_code, session, after, before."""
        vector = self.encoder.encode([query])[0].tolist()
        wanted = search_filters(**filters)
        if self.index_type != "flat":
            return lookups.display(self._near(vector, wanted, Search(top_k=top_k, mode=mode)))
        # after the ranking a filter mustn't leave out files before it
        chunks = self.store.chunks(wanted if mode == "pre" else None)
        return lookups.display(vectors.search(chunks, vector, wanted, Search(top_k=top_k, mode=mode)))

    def build_index(self) -> None:
        """Builds the vector index of the store's chunks as they are; searches take it when it is whole."""
        version, chunks = self.store.version(), self.store.chunks().where("embedding IS NOT NULL")
        folder = f"{self.store.folder}/vectors/{self.index_type}-{version:012d}"
        if self.index_type == "cells":
            vectors.CellIndex.build(chunks.withColumn("node", _node()), folder, "node")
        elif self.index_type == "graph":
            NeighbourGraph.build(chunks.select(_node().alias("vec_id"), "embedding"), folder)

    def _index_folder(self) -> str:
        fs, p = self.store._path(f"{self.store.folder}/vectors")
        whole = {"cells": "cells", "graph": "about"}[self.index_type]  # what a build writes last
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        built = [n for n in names if n.startswith(f"{self.index_type}-") and fs.exists(self.store._path(f"{self.store.folder}/vectors/{n}/{whole}/_SUCCESS")[1])]
        if not built:
            raise ValueError(f"no index of type {self.index_type} has been built")
        return f"{self.store.folder}/vectors/{built[-1]}"

    def _near(self, vector: list[float], wanted: dict, config: Search) -> DataFrame:
        """The nearest that the index finds, of the chunks that the store still has. In cells, filters come before the ranking;
        a graph gives candidates, which are filtered."""
        folder, chunks = self._index_folder(), self.store.chunks()
        if self.index_type == "cells":
            found = vectors.CellIndex(self.spark, folder).search(vector, filters=wanted, config=replace(config, top_k=config.max_candidates))
            return found.join(chunks.select("id"), "id", "left_semi").drop("node").orderBy(F.desc("similarity"), "id").limit(config.top_k)
        asked = self.spark.createDataFrame([(None, [float(x) for x in vector])], "vec_id long, embedding array<float>").select(F.lit(NO_NODE).alias("vec_id"), "embedding")
        near = NeighbourGraph(self.spark, folder).search_all(asked, config.max_candidates, beam=2 * config.max_candidates)
        found = matching(chunks, wanted).join(F.broadcast(near.select(F.col("id").alias("node"), F.col("sim").alias("similarity"))), _node() == F.col("node"))
        return found.where(F.col("similarity") >= config.threshold).drop("node", "embedding").orderBy(F.desc("similarity"), "id").limit(config.top_k)

    def related(self, key: str, top_k: int = 10, same_session: bool = True) -> DataFrame:
        chunks = self.store.chunks()
        row = chunks.where(F.col("id") == key).select("session_id", "embedding").first()
        if row is None:
            raise KeyError(f"no chunk {key}")
        if same_session:
            if row.session_id is None:
                raise ValueError(f"chunk {key} has no session")
            return lookups.related_in_session(chunks, key, top_k)
        return vectors.search(chunks, list(row.embedding), {"session_id": row.session_id} if row.session_id else None, Search(top_k=top_k))

    def chunk(self, key: str) -> DataFrame:
        return lookups.by_id(self.store.chunks(), key)

    def projects(self) -> list[str]:
        return [r.project_name for r in lookups.projects(self.store.chunks()).collect()]

    def stats(self, exact: bool = True) -> dict:
        """exact=False: numbers of sessions and projects from the sketches in the manifest, without reading all chunks."""
        if not exact:
            out = self.store.statistics().first().asDict()
            return out | {"index_type": "flat", "bytes": {n: self.store.size_bytes(n) for n in ("chunks", "files")}}
        out = lookups.index_stats(self.store.chunks()).first().asDict()
        out["chunk_types"] = {r.chunk_type: r.n for r in lookups.type_counts(self.store.chunks()).collect()}
        out["bytes"] = {n: self.store.size_bytes(n) for n in ("chunks", "files")}
        return out

    def status(self) -> dict:
        return {**self.stats(), "last_indexed": self.store.files().agg(F.max("last_indexed")).first()[0]}


def _node() -> Column:
    """The number by which a graph knows a chunk."""
    return F.xxhash64("id")
