"""Conversations to chunks: question-answer pairs, time segments, code blocks, tool usage.

All window functions share one specification (partition by file, order by time and line). `chunked` is a union of five
branches, each of which reads its messages: give it a stored table, not a parse.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.schema import Chunking

from .filters import chunkable

# Words by which a long question opens a new topic.
TOPIC_WORDS = ["now", "next", "different", "instead", "change", "new topic"]
LONG_QUESTION, CONTEXT_SIZE, MIN_SEGMENT = 100, 200, 3

def by_file():
    """The one window of this module (made when a session is there)."""
    return W.partitionBy("file_path").orderBy("ts", "line_no")


def _line(role: str = "role", content: str = "content", ts: str = "ts") -> Column:
    return F.concat(T.stamp(F.col(ts)), F.lit(" "), T.title(F.col(role)), F.lit(": "), F.col(content))


def qa_pairs(messages: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Each question with the answer right after it, and up to context_window messages before, as text; all sizes."""
    after = lambda c: F.lead(c).over(by_file())
    short = F.when(F.length("content") > CONTEXT_SIZE, F.concat(F.substring("content", 1, CONTEXT_SIZE), F.lit("..."))).otherwise(F.col("content"))
    note = F.concat(F.lit("[Context] "), T.title(F.col("role")), F.lit(": "), short)
    window = config.context_window if config.context else 0
    before = F.collect_list(note).over(by_file().rowsBetween(-window, -1)) if window else F.array().cast("array<string>")
    rows = messages.withColumn("answer", after("content")).withColumn("next_role", after("role")).withColumn("answer_code", after("has_code")).withColumn("answer_tools", after("has_tools")).withColumn("answer_uuid", after("uuid")).withColumn("before", before)
    pairs = rows.where("role = 'user' AND next_role = 'assistant'")
    pair = F.concat(T.stamp(F.col("ts")), F.lit(" User: "), F.col("content"), F.lit("\n\nAssistant: "), F.col("answer"))
    body = F.when(F.size("before") > 0, F.concat(F.array_join("before", "\n"), F.lit("\n\n"), pair)).otherwise(pair)
    return pairs.select("file_path", "session_id", "project_name", "ts", "line_no", body.alias("text"), (F.col("has_code") | F.col("answer_code")).alias("has_code"), (F.col("has_tools") | F.col("answer_tools")).alias("has_tools"), F.lit(2).cast("bigint").alias("message_count"), F.array("uuid", "answer_uuid").alias("message_uuids"), F.array("role", "next_role").alias("roles"))


def segments(messages: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """messages with seg, the number of their segment in the file (gaps and islands)."""
    gap = F.col("ts") - F.lag("ts").over(by_file()) > F.expr(f"INTERVAL {config.gap_minutes} MINUTES")
    topic = functools.reduce(operator.or_, [F.lower("content").contains(w) for w in TOPIC_WORDS])
    turn = (F.col("role") == "user") & (F.length("content") > LONG_QUESTION) & topic
    opens = F.coalesce(gap, F.lit(True)) | turn
    return messages.withColumn("opens", opens.cast("int")).withColumn("seg", F.sum("opens").over(by_file())).drop("opens")


def context_segments(messages: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Segments of at least three messages as text; all sizes."""
    parts = F.array_sort(F.collect_list(F.struct("ts", "line_no", _line().alias("line"), "uuid", "role")))
    grouped = segments(messages, config).groupBy("file_path", "session_id", "project_name", "seg").agg(F.min("ts").alias("ts"), F.min("line_no").alias("line_no"), F.count("*").alias("message_count"), F.bool_or("has_code").alias("has_code"), F.bool_or("has_tools").alias("has_tools"), parts.alias("parts"))
    return grouped.where(F.col("message_count") >= MIN_SEGMENT).withColumn("text", F.array_join(F.transform("parts", lambda p: p["line"]), "\n\n")).select("*", F.transform("parts", lambda p: p["uuid"]).alias("message_uuids"), F.transform("parts", lambda p: p["role"]).alias("roles")).drop("parts")


def code_blocks(messages: DataFrame) -> DataFrame:
    """A row for each fenced block and each inline block of more than 20 characters."""
    blocks = F.concat(T.fenced(F.col("content")), T.inline(F.col("content")))
    return messages.where(F.col("content").contains("`")).select("*", F.posexplode(blocks).alias("block_no", "block")).select("*", "block.*").drop("block")


def code_chunks(messages: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Blocks of at least code_lines lines with the rest of their message."""
    lines = F.size(F.split("code", "\n"))
    before, after = T.strip(F.expr("substring(content, 1, instr(content, raw) - 1)")), T.strip(F.expr("substring(content, instr(content, raw) + length(raw))"))
    body = F.concat(T.stamp(F.col("ts")), F.lit(" "), T.title(F.col("role")), F.lit(":\n"), F.when(before != "", F.concat(before, F.lit("\n\n"))).otherwise(""), F.lit("```"), F.col("language"), F.lit("\n"), F.col("code"), F.lit("\n```"), F.when(after != "", F.concat(F.lit("\n\n"), after)).otherwise(""))
    return code_blocks(messages).where(lines >= config.code_lines).select("file_path", "session_id", "project_name", "ts", "line_no", "block_no", "language", lines.cast("bigint").alias("code_lines"), body.alias("text"), F.lit(1).cast("bigint").alias("message_count"), "has_code", "has_tools", F.array("uuid").alias("message_uuids"), F.array("role").alias("roles"))


def tool_chunks(messages: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Messages with tool calls or results, these numbered; all sizes."""
    number = lambda i: F.concat((i + 1).cast("string"), F.lit(". "))
    calls = F.array_join(F.transform("tool_calls", lambda t, i: F.concat(number(i), F.coalesce(t["name"], F.lit("unknown")), F.lit("\n"), F.coalesce(F.concat(F.lit("   Input: "), t["input"], F.lit("\n")), F.lit("")))), "")
    results = F.array_join(F.transform("tool_results", lambda t, i: F.concat(number(i), F.coalesce(t["output"], F.lit("No output")), F.lit("\n"))), "")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    body = F.concat(_line(), F.lit("\n\n"), F.when(some("tool_calls"), F.concat(F.lit("Tool Calls:\n"), calls)).otherwise(""), F.when(some("tool_results") & F.lit(config.tool_results), F.concat(F.lit("\nTool Results:\n"), results)).otherwise(""))
    return messages.where(some("tool_calls") | some("tool_results")).select("file_path", "session_id", "project_name", "ts", "line_no", body.alias("text"), F.transform("tool_calls", lambda t: F.coalesce(t["name"], F.lit("unknown"))).alias("tools_used"), some("tool_results").alias("has_results"), F.lit(1).cast("bigint").alias("message_count"), "has_code", "has_tools", F.array("uuid").alias("message_uuids"), F.array("role").alias("roles"))


def split_large(chunks: DataFrame, limit: int) -> DataFrame:
    """Chunks over the limit as their pieces; the pieces keep session, project and file."""
    return chunks.where(F.length("text") > limit).select("*", F.posexplode(T.split_greedy(F.col("text"), limit)).alias("piece", "part")).drop("text").withColumnRenamed("part", "text")


def dedup(chunks: DataFrame, scope: str = "file_path") -> DataFrame:
    """The first chunk (by strategy, then ordinal) of each text of a conversation. A task sends one of the chunks that it has
    of a text, and sorts by hashes, so texts are compared only where these are equal."""
    by = W.partitionBy(F.xxhash64(scope, "text"), scope, "text").orderBy("strategy_rank", "ordinal")
    return chunks.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def described(chunks: DataFrame) -> DataFrame:
    """With an id from the content and sizes; blank texts are no chunks."""
    key = F.concat_ws("\u0001", "file_path", "chunk_type", F.col("ordinal").cast("string"), "text")
    return chunks.where(T.strip(F.col("text")) != "").withColumn("id", F.concat(F.lit("chunk_"), F.substring(F.sha2(key, 256), 1, 16))).withColumn("char_count", F.length("text").cast("bigint")).withColumn("word_count", T.word_count(F.col("text")))


def chunked(messages: DataFrame, config: Chunking = Chunking(), signs: list[str] = ()) -> DataFrame:
    """All chunks of all conversations. messages: see MESSAGES, with has_tools."""
    kept = chunkable(messages, signs)
    size = F.length("text")
    pairs = qa_pairs(kept, config)
    base = ["file_path", "session_id", "project_name", "ts", "text", "message_count", "has_code", "has_tools", "message_uuids", "roles"]
    extra = {"language": "string", "code_lines": "bigint", "tools_used": "array<string>", "has_results": "boolean"}

    def shaped(df: DataFrame, kind: str, rank: int, order: Column) -> DataFrame:
        more = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()]
        return df.select(*base, *more, F.lit(kind).alias("chunk_type"), F.lit(rank).alias("strategy_rank"), order.cast("bigint").alias("ordinal"))

    line = F.col("line_no") * 1000
    parts = [
        shaped(pairs.where((size >= config.min_size) & (size <= config.max_size)), "qa_pair", 1, line),
        shaped(split_large(pairs, config.max_size), "qa_pair_split", 1, line + F.col("piece")),
        shaped(context_segments(kept, config).where((size >= config.min_size) & (size <= config.max_size)), "context_segment", 2, line),
        shaped(code_chunks(kept, config), "code_block", 3, line + F.col("block_no")),
        shaped(tool_chunks(kept, config).where(size >= config.min_size), "tool_usage", 4, line),
    ]
    return described(dedup(functools.reduce(DataFrame.unionByName, parts)))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Counts and sizes of each type and of all (chunk_type null, is_total 1), in one pass."""
    return chunks.rollup("chunk_type").agg(F.grouping("chunk_type").cast("bigint").alias("is_total"), F.count("*").alias("n_chunks"), F.sum("char_count").alias("total_chars"), F.sum("word_count").alias("total_words"), F.round(F.avg("char_count"), 6).alias("avg_chars"), F.round(F.avg("word_count"), 6).alias("avg_words"))
