"""Rows by key, related chunks, index statistics, result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_id(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.where(F.col("id") == key).drop("embedding").limit(1)


def by_session(chunks: DataFrame, session: str) -> DataFrame:
    return chunks.where(F.col("session_id") == session).drop("embedding").orderBy("ts", "id")


def by_project(chunks: DataFrame, project: str) -> DataFrame:
    """The project's name in full, unlike in searches."""
    return chunks.where(F.col("project_name") == project).drop("embedding").orderBy("ts", "id")


def related_in_session(chunks: DataFrame, key: str, top_k: int = 10) -> DataFrame:
    """The first other chunks of a chunk's session, all with similarity 1; none if it has no session."""
    ref = chunks.where(F.col("id") == key).select("session_id").limit(1)
    others = chunks.where(F.col("id") != key).join(F.broadcast(ref), "session_id")
    return others.drop("embedding").withColumn("similarity", F.lit(1.0)).orderBy("ts", "id").limit(top_k)


def projects(chunks: DataFrame) -> DataFrame:
    return chunks.where("project_name IS NOT NULL AND project_name <> ''").select("project_name").distinct().orderBy("project_name")


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct("session_id").alias("total_sessions"), F.count_distinct("project_name").alias("total_projects"), F.max(F.size("embedding")).cast("bigint").alias("dimension"), F.lit("flat").alias("index_type"))


def type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"))


def conversations(messages: DataFrame) -> DataFrame:
    return messages.groupBy("file_path").agg(F.min_by("session_id", F.when(F.col("session_id").isNotNull(), F.col("line_no"))).alias("session_id"), F.first("project_name").alias("project_name"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("total_messages"), F.bool_or("has_tools").alias("has_tool_usage"), F.bool_or("has_code").alias("has_code_blocks"))


def display(results: DataFrame) -> DataFrame:
    """Results with what is shown for missing values."""
    or_unknown = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    return results.select("id", "similarity", "text", or_unknown("project_name"), or_unknown("session_id"), "ts", F.coalesce("has_code", F.lit(False)).alias("has_code"))


def cut(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def json_items(results: DataFrame) -> DataFrame:
    """uid, title (100 characters), subtitle, and the whole item as JSON."""
    subtitle = F.format_string("Project: %s | Similarity: %.3f", F.coalesce("project_name", F.lit("unknown")), "similarity")
    out = results.select(F.col("id").alias("uid"), cut(F.col("text"), 100).alias("title"), subtitle.alias("subtitle"), "text", "similarity", "project_name", "session_id", "ts")
    variables = F.struct(F.format_string("%.3f", "similarity").alias("similarity"), F.col("project_name").alias("project"), F.col("session_id").alias("session"), F.col("ts").cast("string").alias("timestamp"))
    item = F.struct("uid", "title", "subtitle", F.col("uid").alias("arg"), "text", F.lit("").alias("quicklookurl"), variables.alias("variables"))
    return out.withColumn("item", F.to_json(item)).select("uid", "title", "subtitle", "item")


def json_document(results: DataFrame) -> DataFrame:
    """One row with all items of a result page."""
    return json_items(results).agg(F.concat(F.lit('{"items":['), F.array_join(F.collect_list("item"), ","), F.lit("]}")).alias("json"))


def text_lines(results: DataFrame, full: bool = False) -> DataFrame:
    body = F.col("text") if full else F.concat(F.substring("text", 1, 200), F.lit("..."))
    return results.select("id", F.format_string("%.3f", "similarity").alias("similarity"), body.alias("body"))


def markdown(results: DataFrame, full: bool = False) -> DataFrame:
    head = F.concat(F.lit("**Project:** "), F.coalesce("project_name", F.lit("unknown")), F.lit("\n**Similarity:** "), F.format_string("%.3f", "similarity"))
    return results.select("id", head.alias("head"), (F.col("text") if full else cut(F.col("text"), 500)).alias("body"))


def index_memory_gb(rows: Column, dim: Column) -> Column:
    """Gigabytes recommended for a dense index: vectors and half a gigabyte, a tenth more, a fifth to spare."""
    return (rows * dim * 4 / F.lit(2**30) + F.lit(0.5)) * 1.1 * 1.2


def batch_size(memory_gb: Column, dim: Column, cap: int = 256) -> Column:
    """What fits in memory besides one gigabyte at 16 bytes a dimension, from 8 to cap."""
    fits = F.floor((memory_gb - 1) / (dim * 16 / F.lit(2**30)))
    return F.when(memory_gb <= 1, 8).otherwise(F.greatest(F.lit(8), F.least(F.lit(cap), fits))).cast("bigint")
