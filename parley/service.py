"""The operations of an index as named calls with plain arguments and text answers, for whatever protocol carries them."""

from __future__ import annotations

import functools
import os

from pyspark.sql import SparkSession

from parley.engine import Engine
from parley.operators import lookups

# The codes of an unknown call, of arguments that name nothing, and of any other failure.
UNKNOWN_CALL, BAD_ARGUMENT, FAILED = -32601, -32602, -32603
TOP_K = 20


class CallError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@functools.lru_cache(maxsize=8)
def engine(spark: SparkSession, folder: str) -> Engine:
    """One for each session and folder."""
    return Engine(spark, folder)


def search(e: Engine, query: str = "", top_k: int = TOP_K, chunk_id: str | None = None, project: str | None = None, has_code: bool = False, session: str | None = None, after: str | None = None, before: str | None = None, related_to: str | None = None, same_session: bool = False, full_content: bool = False) -> str:
    """Results as markdown; with chunk_id that chunk, with related_to what is like it."""
    if chunk_id:
        return chunk(e, chunk_id)
    try:
        found = e.related(related_to, top_k, same_session) if related_to else e.semantic_search(query, top_k, project=project, has_code=has_code, session=session, after=after, before=before)
    except (KeyError, ValueError) as x:
        raise CallError(BAD_ARGUMENT, str(x.args[0])) from x
    rows = lookups.markdown(found, full_content).collect()
    return f"{len(rows)} results for: {related_to or query}\n\n" + "\n---\n".join(f"### {i}: {r.id}\n{r.head}\n\n{r.body}" for i, r in enumerate(rows, 1))


def chunk(e: Engine, chunk_id: str) -> str:
    row = e.chunk(chunk_id).first()
    if row is None:
        raise CallError(BAD_ARGUMENT, f"no chunk {chunk_id}")
    return f"**Chunk:** {row.id}\n**Project:** {row.project_name or 'unknown'}\n**Time:** {row.ts}\n\n{row.text}"


def projects(e: Engine) -> str:
    names = e.projects()
    return f"{len(names)} projects\n" + "\n".join(f"- {n}" for n in names)


def _listed(values: dict) -> str:
    return "\n".join(f"- {k}: {v}" for k, v in values.items())


CALLS = {"search": search, "chunk": chunk, "projects": projects, "stats": lambda e: _listed(e.stats()), "status": lambda e: _listed(e.status())}


def call(e: Engine, name: str, arguments: dict | None = None) -> str:
    """The answer of a call, or a CallError with one of the codes."""
    if name not in CALLS:
        raise CallError(UNKNOWN_CALL, f"no call {name}")
    try:
        return CALLS[name](e, **(arguments or {}))
    except CallError:
        raise
    except TypeError as x:
        raise CallError(BAD_ARGUMENT, str(x)) from x
    except Exception as x:
        raise CallError(FAILED, str(x)) from x


def capabilities(spark: SparkSession | None = None) -> dict:
    """What there is to compute with; no device but the CPU is used."""
    context = spark.sparkContext if spark else None
    return {"gpu": False, "device": "cpu", "cores": context.defaultParallelism if context else os.cpu_count(), "master": context.master if context else None}
