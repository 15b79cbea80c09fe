"""Row types and settings."""

from __future__ import annotations

from dataclasses import dataclass

MESSAGES = "file_path string, line_no int, session_id string, project_name string, uuid string, parent_uuid string, role string, content string, ts timestamp_ntz, tool_calls array<struct<name:string,input:string>>, tool_results array<struct<output:string>>, has_code boolean"
CHUNKS = "id string, text string, chunk_type string, strategy_rank int, ordinal bigint, session_id string, project_name string, file_path string, ts timestamp_ntz, message_count bigint, has_code boolean, has_tools boolean, char_count bigint, word_count bigint, message_uuids array<string>, roles array<string>, language string, code_lines bigint, tools_used array<string>, has_results boolean, embedding array<float>"
FILES = "path string, last_modified timestamp, last_indexed timestamp, chunk_count bigint"


@dataclass(frozen=True)
class Chunking:
    max_size: int = 2000
    context_window: int = 2
    min_size: int = 100
    code_lines: int = 5
    tool_results: bool = True
    context: bool = True
    gap_minutes: int = 30


@dataclass(frozen=True)
class Search:
    top_k: int = 10
    threshold: float = 0.0
    max_candidates: int = 100
    metric: str = "cosine"  # or "l2"
    mode: str = "pre"  # filter before ranking; "post": filter the nearest max_candidates
    text: bool = True
    metadata: bool = True
