"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

1. The keys (64-bit hashes of texts) are counted by their leading bits (bounded: 2**max_bits counts). That gives the
   directory: it starts with one bucket and doubles as long as a bucket holds more than `capacity` keys, splitting the
   overfull buckets by one more bit. Buckets overfull at the last bit keep longer chains.
2. A task leaves one row of the copies that it reads, so a group of copies, however large, is sent as a row a task.
3. An owner has the buckets of a range of keys. It sorts a bucket's rows by key and text: those whose bytes are equal
   are one entry, those of one key with other bytes follow as the next entry of the key's chain. The entry's largest id
   and number of rows are taken there; the result is the index.
4. Each document finds its bucket by the directory and its entry in the chain of its key by the SHA-256 of its text;
   the join is one that adaptive execution can split where one key holds very many documents.

Defined cases: null text counts as empty, and empty texts are equal to each other; texts of any length are compared whole;
of rows that repeat one doc_id each is a row of its own, all are counted, and those that carry the largest id (a tie) are
all kept; a null doc_id is less than any other (a group with only null ids has a null keep_id and all its rows are kept);
an empty table gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared


def directory(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """Buckets (first prefix, prefixes, local depth) over a histogram of 2**bits hash prefixes, by doubling."""
    bits = len(counts).bit_length() - 1
    buckets, depth = [(0, len(counts), 0)], 0
    total = np.concatenate([[0], np.cumsum(counts)])
    while depth < bits and any(total[a + n] - total[a] > capacity for a, n, _ in buckets):
        depth += 1
        buckets = [x for a, n, d in buckets for x in (((a, n // 2, depth), (a + n // 2, n // 2, depth)) if total[a + n] - total[a] > capacity else ((a, n, d),))]
    return buckets


class ExtendibleHashIndex:
    """The index of one table's texts: `entries(owner, bucket, h, chain, text_sha256, keep_id, group_size)`, `buckets`."""

    def __init__(self, documents: DataFrame, capacity: int = 1 << 16, max_bits: int = 14, key: Callable[[Column], Column] = F.xxhash64):
        """key: the hash of a text, of which the leading max_bits choose the bucket."""
        spark = documents.sparkSession
        self.key, self.bits = key, max_bits
        rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        keys = rows.select(key(F.col("text")).alias("h")).groupBy("h").agg(F.lit(1).alias("one"))
        counts = np.zeros(1 << max_bits, np.int64)
        for r in keys.groupBy(self._prefix().alias("p")).count().toLocalIterator():
            counts[r.p] = r["count"]
        self.buckets = directory(counts, capacity)
        # an owner's buckets follow each other, and hold about `capacity` keys in all
        sizes = np.add.reduceat(counts, [a for a, _, _ in self.buckets])
        owners = (np.cumsum(sizes) - sizes) // capacity
        many = [n for _, n, _ in self.buckets]
        of = zip(range(len(counts)), np.repeat(np.arange(len(many)), many).tolist(), np.repeat(owners, many).tolist(), strict=True)
        self.directory = F.broadcast(spark.createDataFrame(list(of), "p long, bucket long, owner long"))
        near = rows.select("doc_id", "text", key(F.col("text")).alias("h"), F.spark_partition_id().alias("task"))
        near = near.groupBy("task", "h", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        owned = self._placed(near).repartition(max(int(owners.max()) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "owner")
        entries = owned.groupBy("owner", "bucket", "h", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        chain = F.row_number().over(W.partitionBy("owner", "bucket", "h").orderBy("text")).alias("chain")
        self.entries = _shared.stored(entries.select("owner", "bucket", "h", chain, F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "index")

    def _prefix(self) -> Column:
        return F.shiftrightunsigned("h", 64 - self.bits) if self.bits else F.lit(0).cast("long")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("p", self._prefix()).join(self.directory, "p").drop("p")

    def look_up(self, documents: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        docs = self._placed(documents.select("doc_id", self.key(text).alias("h"), F.sha2(text, 256).alias("text_sha256")))
        found = docs.join(self.entries.drop("owner", "chain"), ["bucket", "h", "text_sha256"])
        return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(documents: DataFrame, capacity: int = 1 << 16, max_bits: int = 14) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of documents(doc_id, text, ...)."""
    return ExtendibleHashIndex(documents, capacity, max_bits).look_up(documents)


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op7_extendible_hash_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
