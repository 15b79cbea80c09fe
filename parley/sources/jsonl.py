"""Chat logs: JSON lines of varying shape to typed messages.

Each logical field is the first present of several keys, whatever its type, so lines are parsed to VARIANT and read by
path; no schema is inferred. Lines that are blank or no JSON object are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import has_code

# The keys of each field, in the order in which they are tried.
CONTENT_KEYS = ["content", "text", "body"]
TIME_KEYS = ["timestamp", "created_at", "createdAt", "time"]
SESSION_KEYS = ["sessionId", "session_id", "conversation_id", "thread_id"]
MILLISECONDS_ABOVE = 10_000_000_000


def _files(spark: SparkSession, kind: str, paths: str | list[str], pattern: str, recursive: bool) -> DataFrame:
    reader = spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    # a file that goes between listing and reading is no error of the others
    return reader.option("ignoreMissingFiles", "true").load(paths)


def _name() -> Column:
    """The file's path as it is written, not as a URL; local ones in one spelling, file:///, whichever Spark gives."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")


def scan(spark: SparkSession, paths: str | list[str], pattern: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(line, file_path, modified, block, at): the lines of all matching files. Files are split among tasks; block and at
    order the lines of a file. Blank lines are left out; a line that is not UTF-8 is null."""
    lines = _files(spark, "text", paths, pattern, recursive)
    line = F.when(F.is_valid_utf8("value"), F.col("value")).alias("line")
    out = lines.select(line, _name().alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return out.where("line IS NULL OR trim(line) <> ''")


def numbered(lines: DataFrame) -> DataFrame:
    """lines of `scan` with line_no, from 0 in each file."""
    by = W.partitionBy("file_path").orderBy("block", "at")
    return lines.withColumn("line_no", F.row_number().over(by) - 1).drop("block", "at")


def listing(spark: SparkSession, path: str, pattern: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(path, modified) of all matching files, without reading them."""
    return _files(spark, "binaryFile", path, pattern, recursive).select(_name().alias("path"), F.col("_metadata.file_modification_time").alias("modified"))


def library(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all logs of a folder, whichever of the two endings they have."""
    return scan(spark, path, "*.{jsonl,json}")


def project_name(path: Column) -> Column:
    """The folder's name, or without one the file's without its ending."""
    parts = F.split(path, "/")
    folder, name = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    return F.when(folder.isNotNull() & (folder != "") & ~folder.endswith(":"), folder).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, F.lit(f"$.{key}"), kind)


def _kind(v: Column) -> Column:
    return F.split(F.schema_of_variant(v), "<")[0]


def _block(b: Column) -> Column:
    text, more = _get(b, "text", "string"), _get(b, "content", "string")
    code = F.concat(F.lit("```"), F.coalesce(_get(b, "language", "string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n```"))
    return F.when(_kind(b) == "STRING", b.cast("string")).when(_get(b, "type", "string") == "code", code).otherwise(F.coalesce(text, more))


def _text(v: Column) -> Column:
    """A string as it is, a list by its blocks, an object by its text or message; any other kind is null."""
    blocks = F.array_join(F.filter(F.transform(v.try_cast("array<variant>"), _block), lambda x: x.isNotNull()), "\n")
    body = F.coalesce(_get(v, "text", "string"), _get(v, "message", "string"), F.to_json(v))
    kind = _kind(v)
    return F.when(kind == "STRING", v.cast("string")).when(kind == "ARRAY", blocks).when(kind == "OBJECT", body)


def _time(v: Column) -> Column:
    """ISO text, else milliseconds as text; numbers are milliseconds when large, else seconds."""
    s, n = F.when(_kind(v) == "STRING", v.cast("string")), F.when(~_kind(v).isin("STRING", "ARRAY", "OBJECT", "BOOLEAN", "VOID"), v.try_cast("double"))
    number = F.timestamp_micros(F.when(n > MILLISECONDS_ABOVE, n * 1000).otherwise(n * 1_000_000).cast("bigint"))
    return F.coalesce(s.try_cast("timestamp"), F.timestamp_millis(s.try_cast("bigint")), number).cast("timestamp_ntz")


def _first(v: Column, keys: list[str], read) -> Column:
    return F.coalesce(*[read(_get(v, k)) for k in keys])


def _calls(v: Column, many: list[str], one: list[str], name: str, shape: str) -> Column:
    lists = F.coalesce(*[_get(v, k, f"array<{shape}>") for k in many], F.array().cast(f"array<{shape}>"))
    single = F.coalesce(*[_get(v, k, shape) for k in one])
    return F.concat(lists, F.when(single.isNotNull(), F.array(single)).otherwise(F.array().cast(f"array<{shape}>")))


def messages(lines: DataFrame, run_time: Column | None = None, keep_bad: bool = False) -> DataFrame:
    """Messages of lines(line, file_path, line_no, ...). A message without a time takes run_time, one for all.
    keep_bad: lines that are no JSON object are there too, with `bad` set and only their file and number."""
    now = F.current_timestamp().cast("timestamp_ntz") if run_time is None else run_time
    v = F.col("v")
    # parsed inside a generator, which the optimizer keeps apart from what reads v: one parse a line
    rows = lines.select("*", F.explode_outer(F.array(F.try_parse_json("line"))).alias("v"))
    rows = rows.withColumn("bad", F.coalesce(_kind(v) != "OBJECT", F.lit(True)))
    if not keep_bad:
        rows = rows.where("NOT bad")
    nested = _text(_get(_get(v, "message"), "content"))
    content = F.coalesce(nested, _first(v, CONTENT_KEYS, _text), F.lit(""))
    role = F.when(_kind(_get(v, "message")) == "OBJECT", F.coalesce(_get(_get(v, "message"), "role", "string"), F.lit("unknown"))).otherwise(F.coalesce(_get(v, "role", "string"), F.lit("unknown")))
    session = F.coalesce(*[_get(v, k, "string") for k in SESSION_KEYS])
    out = rows.select(
        "file_path", "line_no", session.alias("session_id"), project_name(F.col("file_path")).alias("project_name"), _get(v, "uuid", "string").alias("uuid"), _get(v, "parentUuid", "string").alias("parent_uuid"),
        role.alias("role"), content.alias("content"), F.when(~F.col("bad"), F.coalesce(_first(v, TIME_KEYS, _time), now)).alias("ts"),
        _calls(v, ["tool_calls", "toolCalls"], ["function_call", "functionCall"], "name", "struct<name:string,input:string>").alias("tool_calls"),
        _calls(v, ["tool_results"], ["function_result"], "output", "struct<output:string>").alias("tool_results"),
        F.col("line").alias("record"), *(["bad"] if keep_bad else []),
    )
    return out.withColumn("has_code", has_code(F.col("content"))).withColumn("has_tools", (F.size("tool_calls") > 0) | (F.size("tool_results") > 0))


def with_file_sessions(rows: DataFrame) -> DataFrame:
    """Messages with their file's session: the first that a line names, else one from the file's first time."""
    every = W.partitionBy("file_path")
    named = F.min(F.when(F.col("session_id").isNotNull(), F.struct("line_no", "session_id"))).over(every)["session_id"]
    made = F.concat(F.lit("session_"), F.date_format(F.min("ts").over(every), "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.withColumn("session_id", F.coalesce(named, made))
