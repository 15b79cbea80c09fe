"""What the trained operators share: the held-out fold, bounded training samples, scoring by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2 (a null id is not); nothing is learned from them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sampled_ids(rows: DataFrame, limit: int) -> DataFrame:
    """The ids of at most `limit` rows outside the held-out fold, the same ones for the same rows."""
    ids = rows.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    return ids.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(limit)


def features_of(documents: DataFrame, chosen: DataFrame, features: Callable[[pa.Array], list[bytes]], also: str = "kind") -> list[tuple]:
    """(kind, features) of the chosen documents, in order; chosen (doc_id, kind) is bounded by its caller's limits,
    so it is broadcast and its features are collected."""
    rows = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", also, "text")

    def extracted(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(features(b.column(2)), pa.binary())], names=["doc_id", "kind", "found"])

    return sorted((r.doc_id, r.kind, bytes(r.found)) for r in rows.mapInArrow(extracted, "doc_id long, kind string, found binary").toLocalIterator())


def scored(documents: DataFrame, score: Callable[[pa.Array], list[pa.Array]], columns: str, carry: str | None = None) -> DataFrame:
    """documents' doc_id and held_out with the columns that score gives for a batch's texts, and if wanted the long
    that the SQL expression `carry` gives for a row, as `carried`."""
    extra = ["carried"] if carry else []
    names = ["doc_id", "held_out", *(c.split()[0] for c in columns.split(", ")), *extra]

    def batched(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *score(b.column(2)), *([b.column(3)] if carry else [])], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", *([F.expr(carry).alias("carried")] if carry else [])).mapInArrow(batched, f"doc_id long, held_out boolean, {columns}" + (", carried long" if carry else ""))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, kind) of labels 0 and 1; of rows that repeat an id the largest label counts."""
    return labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("string").alias("kind"))
