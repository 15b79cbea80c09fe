"""A training-corpus pipeline: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Rows that repeat a doc_id are judged by their own texts; a null doc_id is an id like others; texts of any length are
read whole; an empty table gives no rows; further columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import _shared, decontamination, line_dedup, packing, quality, similarity_join
from parley.shipping import ship


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one column, so that no column of its own can clash with those of a stage."""
    return docs.select(F.struct("*").alias("row"))


def _is_of(key: DataFrame):
    """That a row is one of key(d, h): doc_id and hash of the text."""
    return F.col("row.doc_id").eqNullSafe(key["d"]) & (F.xxhash64("row.text") == key["h"])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts are scored like others, and go if they are rejected; equal rows have equal scores."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = quality.quality_scores(docs.select("doc_id", "text"), labels, carry="xxhash64(text)")
    rejected = _shared.stored(scores.where("predicted = 0").select(F.col("doc_id").alias("d"), F.col("carried").alias("h")).distinct(), "rejected")
    rejected = _shared.broadcast_if_small(rejected)
    return _rows(docs).join(rejected, _is_of(rejected), "left_anti").select("row.*")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier line resembles; a document of which nothing is left goes.

    Documents without a removed line are left as they are, null and empty texts too; n_chars follows the text."""
    return _with_lengths(line_dedup.without_repeated_lines(docs), docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies (five-word shingles, similarity 0.8).

    The first is the row of least doc_id (a null one is least), then of least text hash; of equal rows one stays. Texts
    without words are in no group and stay, but for equal rows."""
    ship(spark)
    found = _shared.stored(similarity_join.similar_documents(docs.select("doc_id", "text")), "groups")
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("x")).select("x.*")
    kept = first.union(found.where("n_shingles = 0").select("doc_id", "th")).distinct().select(F.col("doc_id").alias("d"), F.col("th").alias("h"))
    one = _rows(docs).join(kept, _is_of(kept), "left_semi").withColumn("h", F.xxhash64("row.text"))
    return one.withColumn("d", F.col("row.doc_id")).dropDuplicates(["d", "h"]).select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of ten words of a benchmark item.

    Texts without words stay; rows of one doc_id are judged by their own texts."""
    hits = decontamination.occurrences(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = _shared.stored(hits.select(F.col("doc_id").alias("d"), F.col("th").alias("h")).distinct(), "leaks")
    leaks = _shared.broadcast_if_small(leaks)
    return _rows(docs).join(leaks, _is_of(leaks), "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; null text is empty, equal rows are documents of their own."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _with_lengths(out: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, follows the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL has no form for the classifier or the tokenizer; tests hold the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _shared.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
