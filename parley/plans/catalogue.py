"""The registered queries and, for each, what DuckDB computes from the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import chunking as C
from parley.operators import filters as FL
from parley.operators import lookups as L
from parley.operators import near as N
from parley.operators import vectors as V
from parley.operators.graph import NeighbourGraph
from parley.operators.threads import reply_threads as threads
from parley.schema import Chunking, Search
from parley.sources import jsonl, store

from . import fixtures as X

QUERIES, SQL = {}, {}


def query(sql: str | None = None, needs: str = ""):
    """Registers a query under its function's name; needs: the views (M, K) that its SQL reads."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            views = ", ".join(v for v in [X.M if "M" in needs else "", X.K if "K" in needs else ""] if v)
            SQL[f.__name__] = (f"WITH RECURSIVE {views}, " + sql[5:] if sql.startswith("WITH ") else f"WITH {views} {sql}") if views else sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_of(df: DataFrame, where) -> list[float]:
    """One row's vector, as a query vector."""
    row = df.where(where).select("embedding").first()
    return [float(x) for x in row.embedding] if row else []


def first_vector(spark, sf_dir):
    return vector_of(table(spark, sf_dir, "embeddings"), "vec_id = 0")


Q0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
SIM = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q0}), 6)"


@query(f"SELECT vec_id, {SIM} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10")
def vector_topk_cosine(spark, sf_dir):
    return V.search(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), config=Search(threshold=-1), id_col="vec_id").select("vec_id", "similarity")


@query(f"SELECT vec_id, round(pow(list_distance(CAST(embedding AS DOUBLE[]), {Q0}), 2), 6) AS similarity FROM embeddings ORDER BY similarity, vec_id LIMIT 10")
def vector_topk_l2(spark, sf_dir):
    return V.search(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), config=Search(metric="l2"), id_col="vec_id").select("vec_id", "similarity")


SEARCH = {"project_name": "alpha-engine", "has_code": True}
WHERE = "contains(lower(project_name), 'alpha-engine') AND has_code"


@query(f"SELECT id, similarity FROM (SELECT *, {SIM} AS similarity FROM k ORDER BY similarity DESC, id LIMIT 100) WHERE {WHERE} AND similarity >= 0 ORDER BY similarity DESC, id LIMIT 10", "K")
def vector_search_postfilter(spark, sf_dir):
    return V.search(X.chunks(spark, sf_dir), first_vector(spark, sf_dir), SEARCH, Search(mode="post")).select("id", "similarity")


@query(f"SELECT id, similarity FROM (SELECT *, {SIM} AS similarity FROM k WHERE {WHERE}) WHERE similarity >= 0 ORDER BY similarity DESC, id LIMIT 10", "K")
def vector_search_prefilter(spark, sf_dir):
    return V.search(X.chunks(spark, sf_dir), first_vector(spark, sf_dir), SEARCH).select("id", "similarity")


@query(f"SELECT id, similarity FROM (SELECT *, {SIM} AS similarity FROM k) WHERE similarity >= 0.2", "K")
def vector_threshold(spark, sf_dir):
    return V.ranked(X.chunks(spark, sf_dir), first_vector(spark, sf_dir))[0].where("similarity >= 0.2").select("id", "similarity")


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM p) SELECT * FROM r WHERE rank <= 5")
def knn_join_k5(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.knn_join(e, e)


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <= b.vec_id")
def similarity_matrix(spark, sf_dir):
    return V.similarity_blocks(table(spark, sf_dir, "embeddings"), saved=saved_in(spark, X.scratch(spark, "matrix")))


NEAR = "WITH r AS (SELECT min(vec_id) AS id, embedding FROM embeddings GROUP BY embedding), e AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM r)"


@query(f"{NEAR}, p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.id < b.id) SELECT * FROM p WHERE sim >= 0.4")
def vector_near_pairs(spark, sf_dir):
    """All vectors that are near to each other; equal ones are one."""
    return N.near_pairs(table(spark, sf_dir, "embeddings"), 0.4)


@query("SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY embedding) AS class_id FROM embeddings")
def vector_copies(spark, sf_dir):
    return N.copies(table(spark, sf_dir, "embeddings"))


@query()
def cell_index_search(spark, sf_dir):
    """The ten nearest to each vector whose id is divisible by 100, by a stored index (no SQL: approximate)."""
    e = table(spark, sf_dir, "embeddings")
    return V.CellIndex.build(e, X.scratch(spark, "cells")).search_all(e.where("vec_id % 100 = 0"))


@query()
def graph_index_search(spark, sf_dir):
    """The ten nearest to each vector whose id is divisible by 100, by a stored neighbour graph (no SQL: approximate)."""
    e = table(spark, sf_dir, "embeddings")
    return NeighbourGraph.build(e, X.scratch(spark, "graph")).search_all(e.where("vec_id % 100 = 0"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 'missing embedding' ELSE 'inconsistent embedding dimension' END AS issue FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 10 = 1")
def embedding_issues(spark, sf_dir):
    """Of vectors of which some are taken away and some shortened."""
    changed = F.when(F.col("vec_id") % 10 == 0, F.lit(None)).when(F.col("vec_id") % 10 == 1, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    return V.issues(table(spark, sf_dir, "embeddings").withColumn("embedding", changed), "vec_id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-8)) ** 2))), 6) AS norm FROM embeddings")
def normalize_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(V.normalised(F.col("embedding"))), 6).alias("norm"))


@query("SELECT CAST(pos - 1 AS INT) AS pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings) GROUP BY pos")
def embedding_dim_stats(spark, sf_dir):
    return V.dimension_stats(table(spark, sf_dir, "embeddings"))


@query("SELECT count(*) AS n, CAST(count(*) - count(embedding) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS odd_size, CAST(max(len(embedding)) AS BIGINT) AS dim, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std FROM (SELECT embedding, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)")
def embedding_validation(spark, sf_dir):
    return V.validation(table(spark, sf_dir, "embeddings"))


@query(r"SELECT count(*) AS total_chunks, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS total_tokens, round(avg(length(text)), 6) AS average_length FROM documents")
def embedding_text_stats(spark, sf_dir):
    return V.text_stats(table(spark, sf_dir, "documents"), T.word_count(F.col("text")))


def _filter(name, filters, where):
    def f(spark, sf_dir):
        return FL.matching(X.chunks(spark, sf_dir), filters() if callable(filters) else filters).select("id")

    f.__name__ = name
    query(f"SELECT id FROM k WHERE {where}", "K")(f)


_filter("filter_project_contains", {"project_name": "ALPHA-engine"}, "contains(lower(project_name), 'alpha-engine')")
_filter("filter_project_literal", {"project_name": "_100%"}, "contains(lower(project_name), '_100%')")
_filter("filter_in", {"chunk_type": ["qa_pair", "code_block"]}, "chunk_type IN ('qa_pair', 'code_block')")
_filter("filter_range", {"word_count": {"gte": 40, "lt": 60}, "message_count": {"gt": 1, "lte": 3}}, "word_count >= 40 AND word_count < 60 AND message_count > 1 AND message_count <= 3")
_filter("filter_date", lambda: FL.search_filters(after="2024-01-03", before="2024-01-10"), "ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00'")
_filter("filter_combined", lambda: {**FL.search_filters(project="gamma", has_code=True, session="session_3"), "no_such_column": 1}, "contains(lower(project_name), 'gamma') AND has_code AND session_id = 'session_3'")

LOW = "lower(content)"
MARKS = [*FL.HOOK_EVENTS, *FL.HOOK_SIGNS, *FL.SYSTEM_SIGNS]
KEPT = "f AS (SELECT * FROM m WHERE role <> 'unknown' AND NOT (" + " OR ".join(f"contains({LOW}, '{s}')" for s in MARKS) + "))"
TITLE = "concat(upper(role[1]), lower(role[2:]))"
STAMP = "'[' || strftime(ts, '%Y-%m-%d %H:%M') || ']'"
QA = (
    KEPT
    + f""", n AS (SELECT *, lead(content) OVER w AS answer, lead(role) OVER w AS next_role, lead(has_code) OVER w AS ac, lead(has_tools) OVER w AS answer_tools, lead(uuid) OVER w AS next_uuid,
 array_to_string(list('[Context] ' || {TITLE} || ': ' || CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END) OVER (PARTITION BY file_path ORDER BY ts, line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)) AS before
 FROM f WINDOW w AS (PARTITION BY file_path ORDER BY ts, line_no)),
qa AS (SELECT file_path, ts, line_no, uuid || ',' || next_uuid AS uuids, has_code OR ac AS has_code, has_tools OR answer_tools AS has_tools, CASE WHEN coalesce(before, '') <> '' THEN before || chr(10) || chr(10) ELSE '' END || {STAMP} || ' User: ' || content || chr(10) || chr(10) || 'Assistant: ' || answer AS text, {STAMP} || ' User: ' || content || chr(10) || chr(10) || 'Assistant: ' || answer AS plain FROM n WHERE role = 'user' AND next_role = 'assistant')"""
)
SEGS = (
    KEPT
    + """, b AS (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER w > INTERVAL '30' MINUTE, TRUE) OR (role = 'user' AND length(content) > 100 AND ("""
    + " OR ".join(f"contains(lower(content), '{s}')" for s in C.TOPIC_WORDS)
    + f""")) THEN 1 ELSE 0 END AS o FROM f WINDOW w AS (PARTITION BY file_path ORDER BY ts, line_no)),
s AS (SELECT *, sum(o) OVER (PARTITION BY file_path ORDER BY ts, line_no) AS seg FROM b),
g AS (SELECT file_path, seg, min(ts) AS ts, min(line_no) AS line_no, count(*) AS message_count, bool_or(has_code) AS has_code, bool_or(has_tools) AS has_tools, string_agg({STAMP} || ' ' || {TITLE} || ': ' || content, chr(10) || chr(10) ORDER BY ts, line_no) AS text, string_agg(uuid, ',' ORDER BY ts, line_no) AS uuids, string_agg(role, ',' ORDER BY ts, line_no) AS roles FROM s GROUP BY file_path, seg)"""
)
STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
BLOCKS = r"""fen AS (SELECT m.*, CAST(unnest(generate_series(1, len(regexp_extract_all(content, '(?s)```([A-Za-z0-9_]+)?\n(.*?)```', 0)))) AS INT) AS i FROM m),
fb AS (SELECT file_path, line_no, role, ts, content, has_code, has_tools, i - 1 AS block_no, regexp_extract_all(content, '(?s)```([A-Za-z0-9_]+)?\n(.*?)```', 1)[i] AS l, regexp_extract_all(content, '(?s)```([A-Za-z0-9_]+)?\n(.*?)```', 2)[i] AS code, regexp_extract_all(content, '(?s)```([A-Za-z0-9_]+)?\n(.*?)```', 0)[i] AS raw FROM fen),
fenced AS (SELECT file_path, line_no, role, ts, content, has_code, has_tools, block_no, CASE WHEN coalesce(l, '') = '' THEN 'text' ELSE l END AS language, code, raw FROM fb),
ix AS (SELECT *, regexp_extract_all(content, '`([^`]+)`', 1) AS cs, regexp_extract_all(content, '`([^`]+)`', 0) AS rs, len(regexp_extract_all(content, '(?s)```([A-Za-z0-9_]+)?\n(.*?)```', 0)) AS nf FROM m),
iy AS (SELECT *, unnest(generate_series(1, len(cs))) AS i FROM ix),
blocks AS (SELECT * FROM fenced UNION ALL SELECT file_path, line_no, role, ts, content, has_code, has_tools, CAST(nf + row_number() OVER (PARTITION BY file_path, line_no ORDER BY i) - 1 AS INT), 'text', cs[i], rs[i] FROM iy WHERE length(cs[i]) > 20)"""
CODE = BLOCKS + f""", cc AS (SELECT file_path, ts, line_no, block_no, language, CAST(len(string_split(code, chr(10))) AS BIGINT) AS code_lines, has_code, has_tools,
 {STAMP} || ' ' || {TITLE} || ':' || chr(10) || CASE WHEN {STRIP("substr(content, 1, instr(content, raw) - 1)")} <> '' THEN {STRIP("substr(content, 1, instr(content, raw) - 1)")} || chr(10) || chr(10) ELSE '' END || '```' || language || chr(10) || code || chr(10) || '```' || CASE WHEN {STRIP("substr(content, instr(content, raw) + length(raw))")} <> '' THEN chr(10) || chr(10) || {STRIP("substr(content, instr(content, raw) + length(raw))")} ELSE '' END AS text
 FROM blocks WHERE len(string_split(code, chr(10))) >= 5)"""
TOOLS = f"""tc AS (SELECT file_path, ts, line_no, has_code, has_tools, {STAMP} || ' ' || {TITLE} || ': ' || content || chr(10) || chr(10) || 'Tool Calls:' || chr(10) || '1. ' || tool_name || chr(10) || '   Input: ' || tool_input || chr(10) || CASE WHEN tool_output IS NOT NULL THEN chr(10) || 'Tool Results:' || chr(10) || '1. ' || tool_output || chr(10) ELSE '' END AS text FROM f WHERE tool_name IS NOT NULL)"""


def pieces(rows: str, limit: int) -> str:
    """SQL for the pieces of the texts of rows(..., text) over the limit: views cut and pieces(..., t, i), i from 1."""
    packed = lambda parts, glue, n: f"list_reduce({parts}, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + {n} + length(x) + {n} <= {limit} THEN a || {glue} || x ELSE a || chr(1) || x END)"
    return f"""cut AS (SELECT *, len(p) = 1 OR len(list_filter(p, lambda x: length(x) > {limit})) > 0 AS by_words
 FROM (SELECT *, string_split(text, chr(10) || chr(10)) AS p, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM {rows} WHERE length(text) > {limit})),
packed AS (SELECT *, CASE WHEN by_words THEN {packed("w", "' '", 1)} ELSE {packed("p", "chr(10) || chr(10)", 2)} END AS r FROM cut),
trimmed AS (SELECT *, list_filter(list_transform(string_split(r, chr(1)), lambda x: {STRIP("x")}), lambda x: x <> '') AS ts_ FROM packed),
pieces AS (SELECT * EXCLUDE (p, w, r, ts_, by_words), unnest(ts_) AS t, unnest(generate_series(1, len(ts_))) AS i FROM trimmed)"""


@query(f"WITH {KEPT} SELECT uuid FROM f", "M")
def message_filter(spark, sf_dir):
    return FL.chunkable(X.messages(spark, sf_dir)).select("uuid")


def kept(spark, sf_dir):
    return FL.chunkable(X.messages(spark, sf_dir))


@query(f"WITH {QA} SELECT file_path, line_no, plain AS text, has_code FROM qa", "M")
def qa_pairs(spark, sf_dir):
    return C.qa_pairs(kept(spark, sf_dir), Chunking(context=False)).select("file_path", "line_no", "text", "has_code")


@query(f"WITH {QA} SELECT file_path, line_no, text, has_tools FROM qa WHERE length(text) BETWEEN 100 AND 2000", "M")
def qa_pairs_context(spark, sf_dir):
    return C.qa_pairs(kept(spark, sf_dir)).where(F.length("text").between(100, 2000)).select("file_path", "line_no", "text", "has_tools")


@query(f"WITH {SEGS} SELECT file_path, CAST(seg AS BIGINT) AS seg, count(*) AS n FROM s GROUP BY file_path, seg", "M")
def context_segments(spark, sf_dir):
    return C.segments(kept(spark, sf_dir)).groupBy("file_path", "seg").agg(F.count("*").alias("n"))


@query(f"WITH {SEGS} SELECT file_path, line_no, message_count, text FROM g WHERE message_count >= 3 AND length(text) BETWEEN 100 AND 2000", "M")
def context_chunks(spark, sf_dir):
    return C.context_segments(kept(spark, sf_dir)).where(F.length("text").between(100, 2000)).select("file_path", "line_no", "message_count", "text")


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    by = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    return table(spark, sf_dir, "events").groupBy("user_id", by).agg(F.min("ts").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")


@query(f"WITH {BLOCKS} SELECT file_path, line_no, CAST(block_no AS INT) AS block_no, language, code FROM fenced", "M")
def code_blocks_fenced(spark, sf_dir):
    return X.messages(spark, sf_dir).select("file_path", "line_no", F.posexplode(T.fenced(F.col("content"))).alias("block_no", "b")).select("file_path", "line_no", "block_no", "b.language", "b.code")


@query("WITH i AS (SELECT file_path, line_no, unnest(regexp_extract_all(content, '`([^`]+)`', 1)) AS code FROM m) SELECT file_path, line_no, code FROM i WHERE length(code) > 20", "M")
def code_blocks_inline(spark, sf_dir):
    return X.messages(spark, sf_dir).select("file_path", "line_no", F.explode(T.inline(F.col("content"))).alias("b")).select("file_path", "line_no", "b.code")


@query(f"WITH {CODE} SELECT file_path, line_no, language, code_lines, text FROM cc", "M")
def code_chunks(spark, sf_dir):
    return C.code_chunks(X.messages(spark, sf_dir)).select("file_path", "line_no", "language", "code_lines", "text")


@query(f"WITH {KEPT}, {TOOLS} SELECT file_path, line_no, text, 'search' AS tools FROM tc WHERE length(text) >= 100", "M")
def tool_chunks(spark, sf_dir):
    return C.tool_chunks(kept(spark, sf_dir)).where(F.length("text") >= 100).select("file_path", "line_no", "text", F.array_join("tools_used", ",").alias("tools"))


@query(f"WITH {pieces('documents', 2000)} SELECT doc_id, CAST(i - 1 AS INT) AS piece, t AS text FROM pieces")
def split_words(spark, sf_dir):
    return C.split_large(table(spark, sf_dir, "documents").select("doc_id", "text"), 2000).select("doc_id", "piece", "text")


@query(f"WITH {QA}, {pieces('qa', 400)} SELECT file_path, line_no, CAST(i - 1 AS INT) AS piece, t AS text FROM pieces", "M")
def split_paragraphs(spark, sf_dir):
    """By paragraphs where each fits, else by words."""
    return C.split_large(C.qa_pairs(kept(spark, sf_dir)), 400).select("file_path", "line_no", "piece", "text")


@query("SELECT min(doc_id) AS doc_id, CAST(length(text) AS BIGINT) AS size FROM documents GROUP BY text")
def chunk_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("all").alias("file_path"), F.lit(1).alias("strategy_rank"), F.col("doc_id").alias("ordinal"))
    return C.dedup(docs).select("doc_id", F.length("text").cast("bigint").alias("size"))


PIPE = f"""{QA}, {SEGS[len(KEPT) + 2:]}, {CODE.replace("FROM m)", "FROM f AS m)")}, {TOOLS}, {pieces("qa", 2000)},
u AS (SELECT file_path, text, 'qa_pair' AS chunk_type, 1 AS r, line_no * 1000 AS o, uuids, 'user,assistant' AS roles, CAST(NULL AS VARCHAR) AS language, CAST(NULL AS BIGINT) AS code_lines, CAST(NULL AS VARCHAR) AS tools FROM qa WHERE length(text) BETWEEN 100 AND 2000
UNION ALL SELECT file_path, t, 'qa_pair_split', 1, line_no * 1000 + i - 1, uuids, 'user,assistant', NULL, NULL, NULL FROM pieces
UNION ALL SELECT file_path, text, 'context_segment', 2, line_no * 1000, uuids, roles, NULL, NULL, NULL FROM g WHERE message_count >= 3 AND length(text) BETWEEN 100 AND 2000
UNION ALL SELECT file_path, text, 'code_block', 3, line_no * 1000 + block_no, f.uuid, f.role, language, code_lines, NULL FROM cc JOIN f USING (file_path, line_no)
UNION ALL SELECT file_path, text, 'tool_usage', 4, line_no * 1000, f.uuid, f.role, NULL, NULL, f.tool_name FROM tc JOIN f USING (file_path, line_no) WHERE length(text) >= 100),
d AS (SELECT *, row_number() OVER (PARTITION BY file_path, text ORDER BY r, o) AS k FROM u)"""


@query(rf"WITH {PIPE} SELECT file_path, chunk_type, CAST(length(text) AS BIGINT) AS char_count, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS word_count, uuids, roles, language, CAST(code_lines AS BIGINT) AS code_lines, tools, 'chunk_' || substr(sha256(file_path || chr(1) || chunk_type || chr(1) || CAST(o AS VARCHAR) || chr(1) || text), 1, 16) AS id FROM d WHERE k = 1", "M")
def chunk_pipeline(spark, sf_dir):
    listed = [F.array_join(c, ",").alias(name) for c, name in (("message_uuids", "uuids"), ("roles", "roles"), ("tools_used", "tools"))]
    return C.chunked(X.messages(spark, sf_dir)).select("file_path", "chunk_type", "char_count", "word_count", "id", "language", "code_lines", *listed)


@query("SELECT chunk_type, grouping(chunk_type) AS is_total, count(*) AS n_chunks, CAST(sum(char_count) AS BIGINT) AS total_chars, CAST(sum(word_count) AS BIGINT) AS total_words, round(avg(char_count), 6) AS avg_chars, round(avg(word_count), 6) AS avg_words FROM k GROUP BY ROLLUP (chunk_type)", "K")
def chunk_stats(spark, sf_dir):
    return C.chunk_stats(X.chunks(spark, sf_dir))


@query("SELECT chunk_type, count(*) AS n FROM k GROUP BY chunk_type", "K")
def chunk_type_histogram(spark, sf_dir):
    return L.type_counts(X.chunks(spark, sf_dir))


@query("SELECT count(*) AS total_chunks, count(DISTINCT session_id) AS total_sessions, count(DISTINCT project_name) AS total_projects, CAST(max(len(embedding)) AS BIGINT) AS dimension, 'flat' AS index_type FROM k", "K")
def index_stats(spark, sf_dir):
    return L.index_stats(X.chunks(spark, sf_dir))


@query("SELECT DISTINCT project_name FROM k WHERE project_name IS NOT NULL AND project_name <> ''", "K")
def project_list(spark, sf_dir):
    return L.projects(X.chunks(spark, sf_dir))


@query("SELECT file_path, min(session_id) AS session_id, min(project_name) AS project_name, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS total_messages, bool_or(has_tools) AS has_tool_usage, bool_or(has_code) AS has_code_blocks FROM m GROUP BY file_path", "M")
def conversation_summary(spark, sf_dir):
    return L.conversations(X.messages(spark, sf_dir))


@query("SELECT id, text, chunk_type FROM k WHERE id = 'chunk_000007'", "K")
def chunk_by_id(spark, sf_dir):
    return L.by_id(X.chunks(spark, sf_dir), "chunk_000007").select("id", "text", "chunk_type")


@query("SELECT id, ts FROM k WHERE session_id = 'session_3'", "K")
def chunks_by_session(spark, sf_dir):
    return L.by_session(X.chunks(spark, sf_dir), "session_3").select("id", "ts")


@query("SELECT id, ts FROM k WHERE project_name = 'Gamma'", "K")
def chunks_by_project(spark, sf_dir):
    return L.by_project(X.chunks(spark, sf_dir), "Gamma").select("id", "ts")


@query("SELECT id, ts, 1.0::DOUBLE AS similarity FROM k WHERE id <> 'chunk_000003' AND session_id = (SELECT session_id FROM k WHERE id = 'chunk_000003') ORDER BY ts, id LIMIT 10", "K")
def related_same_session(spark, sf_dir):
    return L.related_in_session(X.chunks(spark, sf_dir), "chunk_000003").select("id", "ts", "similarity")


SIM3 = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM k WHERE id = 'chunk_000003')), 6)"


@query(f"SELECT id, {SIM3} AS similarity FROM k WHERE session_id = 'session_3' AND {SIM3} >= 0 ORDER BY similarity DESC, id LIMIT 10", "K")
def related_semantic(spark, sf_dir):
    k = X.chunks(spark, sf_dir)
    return V.search(k, vector_of(k, "id = 'chunk_000003'"), {"session_id": "session_3"}).select("id", "similarity")


def results(spark, sf_dir):
    return V.search(X.chunks(spark, sf_dir), first_vector(spark, sf_dir))


PAGE = f"page AS (SELECT *, {SIM} AS similarity FROM k ORDER BY similarity DESC, id LIMIT 10)"


@query(f"WITH {PAGE} SELECT id, similarity, coalesce(project_name, 'unknown') AS project_name, coalesce(session_id, 'unknown') AS session_id, has_code FROM page", "K")
def result_rows(spark, sf_dir):
    return L.display(results(spark, sf_dir)).select("id", "similarity", "project_name", "session_id", "has_code")


@query(f"WITH {PAGE} SELECT id AS uid, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS title, 'Project: ' || coalesce(project_name, 'unknown') || ' | Similarity: ' || printf('%.3f', similarity) AS subtitle FROM page", "K")
def json_results(spark, sf_dir):
    return L.json_items(results(spark, sf_dir)).select("uid", "title", "subtitle")


@query(f"WITH {PAGE} SELECT id, printf('%.3f', similarity) AS similarity, substr(text, 1, 200) || '...' AS body FROM page", "K")
def text_results(spark, sf_dir):
    return L.text_lines(results(spark, sf_dir))


@query(f"WITH {PAGE} SELECT id, '**Project:** ' || coalesce(project_name, 'unknown') || chr(10) || '**Similarity:** ' || printf('%.3f', similarity) AS head, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS body FROM page", "K")
def markdown_results(spark, sf_dir):
    return L.markdown(results(spark, sf_dir))


NEW = "n AS (SELECT id, 'new ' || chunk_type AS chunk_type, message_count + 10 AS message_count FROM k WHERE vec_id % 3 = 0 UNION ALL SELECT 'extra_' || id, chunk_type, message_count FROM k WHERE vec_id % 10 = 0)"


@query(f"WITH {NEW} SELECT id, chunk_type, message_count FROM n UNION ALL SELECT id, chunk_type, message_count FROM k WHERE id NOT IN (SELECT id FROM n)", "K")
def upsert(spark, sf_dir):
    k = X.chunks(spark, sf_dir).select("id", "vec_id", "chunk_type", "message_count")
    new = k.where("vec_id % 3 = 0").selectExpr("id", "'new ' || chunk_type AS chunk_type", "message_count + 10 AS message_count").union(k.where("vec_id % 10 = 0").selectExpr("'extra_' || id", "chunk_type", "message_count"))
    return store.upserted(k.drop("vec_id"), new, "id")


@query("SELECT id FROM k WHERE session_id IS DISTINCT FROM 'session_3'", "K")
def delete_by_session(spark, sf_dir):
    return store.without(X.chunks(spark, sf_dir), F.col("session_id") == "session_3").select("id")


@query("SELECT id FROM k WHERE file_path <> '/corpus/f7.jsonl'", "K")
def delete_by_file(spark, sf_dir):
    return store.without(X.chunks(spark, sf_dir), F.col("file_path") == "/corpus/f7.jsonl").select("id")


@query("WITH l AS (SELECT file_path AS path, max(ts) AS t FROM k GROUP BY 1), f AS (SELECT path, t - CASE WHEN length(path) % 2 = 0 THEN INTERVAL '1' HOUR ELSE INTERVAL '0' HOUR END AS t FROM l WHERE path <> '/corpus/f5.jsonl') SELECT l.path FROM l LEFT JOIN f USING (path) WHERE f.t IS NULL OR l.t > f.t", "K")
def incremental_changed_files(spark, sf_dir):
    listed = X.chunks(spark, sf_dir).groupBy(F.col("file_path").alias("path")).agg(F.max("ts").alias("modified"))
    known = listed.where("path <> '/corpus/f5.jsonl'").selectExpr("path", "modified - CASE WHEN length(path) % 2 = 0 THEN INTERVAL '1' HOUR ELSE INTERVAL '0' HOUR END AS last_modified")
    return store.changed(listed, known).select("path")


@query("SELECT label, n, d, round((n * d * 4 / 1073741824.0 + 0.5) * 1.1 * 1.2, 6) AS gb FROM (SELECT label, count(*) * 10000 AS n, max(len(embedding)) AS d FROM embeddings GROUP BY label)")
def index_memory(spark, sf_dir):
    """What an index of ten thousand times the vectors of each label would take."""
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg((F.count("*") * 10_000).alias("n"), F.max(F.size("embedding")).cast("long").alias("d"))
    return sizes.select("label", "n", "d", F.round(L.index_memory_gb(F.col("n"), F.col("d")), 6).alias("gb"))


@query("SELECT p_partkey, gb, CASE WHEN gb <= 1 THEN 8 ELSE CAST(greatest(8, least(256, floor((gb - 1) / (768 * 16 / 1073741824.0)))) AS BIGINT) END AS batch FROM (SELECT p_partkey, 0.9995 + CAST(p_size AS DOUBLE) / 16384 AS gb FROM part)")
def optimal_batch_size(spark, sf_dir):
    """The batch for as much memory as a part's size makes."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "0.9995D + CAST(p_size AS DOUBLE) / 16384 AS gb").select("p_partkey", "gb", L.batch_size(F.col("gb"), F.lit(768)).alias("batch"))


RECORDS = "SELECT '{\"uuid\":\"u' || CAST(event_id AS VARCHAR(20)) || '\",\"sessionId\":\"s' || CAST(user_id AS VARCHAR(20)) || '\",' || CASE WHEN event_id % 4 = 0 THEN '\"message\":{\"role\":\"user\",\"content\":[{\"type\":\"text\",\"text\":\"' || event_type || '\"},\"plain\",{\"type\":\"code\",\"language\":\"sql\",\"text\":\"select 1\"}]}' WHEN event_id % 4 = 1 THEN '\"role\":\"assistant\",\"content\":\"' || event_type || '\"' WHEN event_id % 4 = 2 THEN '\"text\":{\"text\":\"' || event_type || '\"}' ELSE '\"content\":5,\"body\":\"' || event_type || '\"' END || ',\"timestamp\":' || CAST(1705312800 + event_id AS VARCHAR(20)) || CASE WHEN event_id % 3 = 0 THEN '000' ELSE '' END || '}' AS line, event_id FROM events"


@query(f"WITH r AS ({RECORDS}) SELECT 'u' || event_id AS uuid, CASE event_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'unknown' END AS role, CASE WHEN event_id % 4 = 0 THEN event_type || chr(10) || 'plain' || chr(10) || '```sql' || chr(10) || 'select 1' || chr(10) || '```' ELSE event_type END AS content, make_timestamp((1705312800 + event_id) * 1000000) AS ts, event_id % 4 = 0 AS has_code FROM r JOIN events USING (event_id)")
def parse_jsonl(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    lines = spark.sql(RECORDS.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}").replace("VARCHAR(20)", "STRING"), events=events).selectExpr("line", "'/corpus/p/a.jsonl' AS file_path", "CAST(event_id AS INT) AS line_no")
    return jsonl.messages(lines).select("uuid", "role", "content", "ts", "has_code")


# answers to the turn before or the one before that, some to a turn that isn't there, and in some talks two to each other
ANSWERS = "SELECT conv_id, turn, 'm' || CAST(turn AS VARCHAR(20)) AS uuid, CASE WHEN turn = 0 THEN NULL WHEN conv_id % 11 = 5 AND turn = 1 THEN 'm2' WHEN conv_id % 11 = 5 AND turn = 2 THEN 'm1' WHEN turn % 7 = 6 THEN 'gone' WHEN turn % 3 = 2 THEN 'm' || CAST(turn - 2 AS VARCHAR(20)) ELSE 'm' || CAST(turn - 1 AS VARCHAR(20)) END AS parent_uuid FROM conversations"


@query(f"WITH a AS ({ANSWERS}), t AS (SELECT a.*, uuid AS root, CAST(0 AS BIGINT) AS depth, [uuid] AS path, parent_uuid IS NOT NULL AS missing_parent FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.conv_id = a.conv_id AND b.uuid = a.parent_uuid) UNION ALL SELECT a.*, t.root, t.depth + 1, list_append(t.path, a.uuid), false FROM t JOIN a ON a.conv_id = t.conv_id AND a.parent_uuid = t.uuid) SELECT a.conv_id, a.turn, t.root, t.depth, array_to_string(t.path, '/') AS path, coalesce(t.missing_parent, false) AS missing_parent, t.root IS NULL AS cyclic FROM a LEFT JOIN t USING (conv_id, turn)".replace("WITH a", "WITH RECURSIVE a"))
def reply_threads(spark, sf_dir):
    """Root, depth and path of every message of conversations whose answers cross, miss their parent or go around."""
    rows = spark.sql(ANSWERS.replace("VARCHAR(20)", "STRING").replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, sf_dir, "conversations"))
    folder = X.scratch(spark, "threads")
    found = threads(rows, saved_in(spark, folder), "conv_id", order="turn")
    return found.select("conv_id", "turn", "root", "depth", F.array_join("path", "/").alias("path"), "missing_parent", "cyclic")


def saved_in(spark: SparkSession, folder: str):
    """A function that writes tables below the folder and reads them again."""

    def saved(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return saved


CHANGED = "(SELECT id, chunk_type, has_code FROM k WHERE embedding IS NOT NULL AND file_path <> '/corpus/f7.jsonl' AND session_id IS DISTINCT FROM 'session_3' AND vec_id % 3 <> 0 UNION ALL SELECT id, 'new ' || chunk_type, has_code FROM k WHERE embedding IS NOT NULL AND vec_id % 3 = 0 AND file_path <> '/corpus/f7.jsonl' UNION ALL SELECT 'again_' || id, chunk_type, NOT has_code FROM k WHERE file_path = '/corpus/f7.jsonl')"


@query(f"SELECT * FROM {CHANGED}", "K")
def store_changes(spark, sf_dir):
    """What a store holds after chunks came, a session was deleted, a third was upserted anew, a rewrite, and a file was read
    again: readers merge data and keys."""
    k = X.chunks(spark, sf_dir).drop("vec_id")
    held = store.Store(spark, X.scratch(spark, "store"))
    held.add(k)
    held.delete(F.col("session_id") == "session_3")
    held.add(X.chunks(spark, sf_dir).where("vec_id % 3 = 0").drop("vec_id").withColumn("chunk_type", F.concat(F.lit("new "), "chunk_type")))
    held.optimize()
    again = k.where("file_path = '/corpus/f7.jsonl'").withColumn("id", F.concat(F.lit("again_"), "id")).withColumn("has_code", ~F.col("has_code"))
    states = again.select(F.col("file_path").alias("path")).distinct().selectExpr("path", "current_timestamp() AS last_modified", "current_timestamp() AS last_indexed", "1L AS chunk_count")
    held.replace_files(again, states)
    return held.chunks().select("id", "chunk_type", "has_code")


@query("SELECT id, ts FROM k WHERE embedding IS NOT NULL AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'", "K")
def store_date_window(spark, sf_dir):
    """A date window of a store in Z-order, whose files with other times are not opened."""
    held = store.Store(spark, X.scratch(spark, "window"))
    held.add(X.chunks(spark, sf_dir).drop("vec_id"))
    held.optimize(rows_per_file=5000)
    wanted = FL.date_window("2024-01-10", "2024-01-12")
    return FL.matching(held.chunks(wanted), wanted).select("id", "ts")


@query("SELECT count(*) AS total_chunks, count(DISTINCT session_id) AS total_sessions, count(DISTINCT project_name) AS total_projects, CAST(max(len(embedding)) AS BIGINT) AS dimension, count(*) FILTER (chunk_type = 'code_block') AS code_blocks FROM k WHERE embedding IS NOT NULL AND session_id IS DISTINCT FROM 'session_3'", "K")
def store_statistics(spark, sf_dir):
    """Statistics of a store of two fragments: one is read for what a delete has taken, of the other only the manifest. Distinct
    counts are of sketches, which are exact for as few sessions and projects as these."""
    k = X.chunks(spark, sf_dir).drop("vec_id")
    held = store.Store(spark, X.scratch(spark, "statistics"))
    held.add(k.where("session_id IN ('session_3', 'session_4')"))
    held.delete(F.col("session_id") == "session_3")
    held.add(k.where("session_id IS NULL OR session_id NOT IN ('session_3', 'session_4')"))
    return held.statistics().select("*", F.col("chunk_types")["code_block"].alias("code_blocks")).drop("chunk_types")


# the time of each event in one of the seven forms in which logs have it
SECOND = "date_trunc('second', ts)"
STAMPED = """SELECT '{"uuid":"u' || event_id || '","content":"x","createdAt":' || CASE event_id % 7
  WHEN 0 THEN '"' || date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") || 'Z"' WHEN 1 THEN '"' || date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") || '+02:00"' WHEN 2 THEN '"' || date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") || '"'
  WHEN 3 THEN '"' || date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") || '.500Z"' WHEN 4 THEN CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS STRING) || '000' WHEN 5 THEN CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS STRING)
  ELSE '"' || unix_seconds(CAST(ts AS TIMESTAMP)) || '000"' END || '}' AS line, '/corpus/p/a.jsonl' AS file_path, CAST(event_id AS INT) AS line_no FROM {events}"""


@query(f"SELECT 'u' || event_id AS uuid, CASE event_id % 7 WHEN 1 THEN {SECOND} - INTERVAL '2' HOUR WHEN 3 THEN {SECOND} + INTERVAL '500' MILLISECOND ELSE {SECOND} END AS ts FROM events")
def timestamp_coalesce(spark, sf_dir):
    lines = spark.sql(STAMPED.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}"), events=table(spark, sf_dir, "events"))
    return jsonl.messages(lines).select("uuid", "ts")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered search over chunks."""
    return V.search(X.chunks(spark, sf_dir), first_vector(spark, sf_dir), {"project_name": "alpha"}).select("id", "similarity", "text")
