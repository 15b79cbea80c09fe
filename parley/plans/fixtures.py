"""Views that give the driver's tables the shape of parsed messages and indexed chunks, in both SQL dialects.

CHUNKS has every row of documents and of embeddings, and whole texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MESSAGES = r"""
SELECT '/corpus/project_'||CAST(conv_id % 7 AS STRING)||'/session_'||CAST(conv_id AS STRING)||'.jsonl' AS file_path,
 turn AS line_no, 'session_'||CAST(conv_id AS STRING) AS session_id, 'project_'||CAST(conv_id % 7 AS STRING) AS project_name,
 'm'||CAST(conv_id AS STRING)||'-'||CAST(turn AS STRING) AS uuid,
 CASE WHEN role='system' THEN 'unknown' ELSE role END AS role,
 CASE WHEN role='assistant' AND turn % 4 = 1 THEN text||chr(10)||chr(10)||'```python'||chr(10)||'def f'||CAST(conv_id AS STRING)||'(x):'||chr(10)||'    y = x + '||CAST(turn AS STRING)||chr(10)||'    z = y * 2'||chr(10)||'    return z'||chr(10)||'```'
      WHEN role='assistant' AND turn % 4 = 3 THEN text||' Use `compute_value_of_item_'||CAST(conv_id AS STRING)||'` here.'
      WHEN role='user' AND conv_id % 17 = 3 AND turn = 2 THEN 'PreToolUse: '||text
      WHEN role='user' AND conv_id % 5 = 0 AND turn > 0 THEN text||' Now a different question.'
      ELSE text END AS content,
 CAST('2024-01-01 09:00:00' AS {TS}) + INTERVAL '1' DAY * CAST(conv_id AS INT) + INTERVAL '1' MINUTE * CAST(turn*2 + CASE WHEN turn>=4 THEN 45 ELSE 0 END AS INT) AS ts,
 CASE WHEN role='assistant' AND turn % 4 = 3 THEN 'search' END AS tool_name,
 CASE WHEN role='assistant' AND turn % 4 = 3 THEN 'q='||CAST(conv_id AS STRING) END AS tool_input,
 CASE WHEN role='assistant' AND turn % 8 = 3 THEN 'ok '||CAST(turn AS STRING) END AS tool_output
FROM conversations
"""
# every document meets an embedding and every embedding a document, the smaller table's rows serving more than once
CHUNKS = r"""
SELECT 'chunk_'||CASE WHEN n < 1000000 THEN lpad(CAST(n AS STRING),6,'0') ELSE CAST(n AS STRING) END AS id, n AS vec_id, text,
 CASE n % 5 WHEN 0 THEN 'qa_pair' WHEN 1 THEN 'qa_pair_split' WHEN 2 THEN 'context_segment' WHEN 3 THEN 'code_block' ELSE 'tool_usage' END AS chunk_type,
 CASE WHEN n % 50 <> 49 THEN 'session_'||CAST(n % 25 AS STRING) END AS session_id,
 CASE WHEN n % 40 = 39 THEN NULL WHEN n % 40 = 38 THEN '' ELSE CASE label % 4 WHEN 0 THEN 'team-Alpha-Engine' WHEN 1 THEN 'team-alpha-engine-v2' WHEN 2 THEN 'beta_100%' ELSE 'Gamma' END END AS project_name,
 '/corpus/f'||CAST(n % 30 AS STRING)||'.jsonl' AS file_path,
 CAST('2024-01-01 00:00:00' AS {TS}) + INTERVAL '1' HOUR * CAST(n AS INT) AS ts,
 n % 3 = 0 AS has_code, n % 4 = 0 AS has_tools, CAST(n % 3 + 1 AS BIGINT) AS message_count,
 CAST(length(text) AS BIGINT) AS char_count,
 CAST(length(text) - length(replace(text,' ','')) + 1 AS BIGINT) AS word_count,
 embedding
FROM (SELECT greatest(d.doc_id, e.vec_id) AS n, d.text, e.label, e.embedding
 FROM (SELECT *, vec_id % (SELECT greatest(1, least((SELECT count(*) FROM documents), (SELECT count(*) FROM embeddings)))) AS j FROM embeddings) e
 FULL JOIN (SELECT *, doc_id % (SELECT greatest(1, least((SELECT count(*) FROM documents), (SELECT count(*) FROM embeddings)))) AS j FROM documents) d ON e.j = d.j)
"""


def _view(spark: SparkSession, sf_dir: str, sql: str, tables: list[str]) -> DataFrame:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    sql = sql.replace("{TS}", "TIMESTAMP_NTZ")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _view(spark, sf_dir, MESSAGES, ["conversations"])
    return df.selectExpr("*", "contains(content, '`') AS has_code", "tool_name IS NOT NULL AS has_tools", "CASE WHEN tool_name IS NOT NULL THEN array(named_struct('name', tool_name, 'input', tool_input)) END AS tool_calls", "CASE WHEN tool_output IS NOT NULL THEN array(named_struct('output', tool_output)) END AS tool_results")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; it goes when the driver's JVM ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/parley-{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


_stored: dict[tuple[str, str], str] = {}


def chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CHUNKS, ["embeddings", "documents"])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as an index has it: written once for a session and its folder, then read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = scratch(spark, "chunks")
        chunk_view(spark, sf_dir).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


M = "m0 AS (" + MESSAGES.replace("{TS}", "TIMESTAMP") + "), m AS (SELECT *, contains(content, '`') AS has_code, tool_name IS NOT NULL AS has_tools FROM m0)"
K = "k AS (" + CHUNKS.replace("{TS}", "TIMESTAMP") + ")"
