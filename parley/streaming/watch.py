"""Incremental indexing and streams."""

from __future__ import annotations

import contextlib
import hashlib
import re
import time
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions.encoder import Encoder, HashingEncoder, embed
from parley.operators.chunking import chunked
from parley.schema import Chunking
from parley.sources import jsonl
from parley.sources.store import Staging, Store, changed
from parley.sources.stream import register
from parley.streaming.debounce import bursts, prepared


@dataclass
class Run:
    """Counters of an indexing run, taken while its tables are written. Files without a chunk are skipped; an error names a file that could not be read."""

    files_listed: int = 0
    files_processed: int = 0
    files_unchanged: int = 0
    files_skipped: int = 0
    chunks: int = 0
    chunks_removed: int = 0
    bad_lines: int = 0
    errors: list[str] = field(default_factory=list)
    seconds: float = 0.0

    def first_errors(self, n: int = 3) -> list[str]:
        """What a report shows: the first errors, and how many more there are."""
        more = len(self.errors) - n
        return self.errors[:n] + ([f"... and {more} more"] if more > 0 else [])


def index(spark: SparkSession, path: str, store: Store, encoder: Encoder | None = None, config: Chunking = Chunking(), pattern: str = "*.jsonl", recursive: bool = True, force: bool = False, signs: list[str] = (), listed: DataFrame | None = None) -> Run:
    """Reads files that are new or changed since the store noted them, and replaces their chunks. listed: the files
    (path, modified) to look at, in place of all below path. Files without chunks
    are noted too, so they are not read again. Lines that are no JSON are left out and counted; when a file cannot be
    read, the others are indexed without it, and it is tried once more before it is an error. signs: more of what marks
    a message as a hook's."""
    began, run = time.time(), Run()
    if force:
        store.clear()
    with store.staging() as staging:
        some = listed is not None
        n = F.count(F.lit(1))
        listed, all_files = staging.measured(listed if some else jsonl.listing(spark, path, pattern, recursive), n=n)
        todo, new_files = staging.measured(changed(listed, store.files()), n=n)
        run.files_listed, many = all_files["n"], new_files["n"]
        run.files_unchanged = run.files_listed - many
        if many:
            # all files: the folder is read; else the changed ones by name (the driver lists them in any case)
            every = many == run.files_listed and not some
            _read(spark, store, staging, run, todo, path if every else None, pattern, recursive, encoder or HashingEncoder(), config, signs)
    run.seconds = time.time() - began
    return run


def _read(spark: SparkSession, store: Store, staging: Staging, run: Run, todo: DataFrame, path: str | None, pattern: str, recursive: bool, encoder: Encoder, config: Chunking, signs: list[str]) -> None:
    """Indexes the files of todo(path, modified); if that fails, each half of them, down to single files."""
    try:
        paths = path or [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in todo.select("path").collect()]
        lines = jsonl.numbered(jsonl.scan(spark, paths, pattern, recursive))
        staged, of_lines = staging.measured(jsonl.with_file_sessions(jsonl.messages(lines, keep_bad=True)), bad=F.count_if("bad"))
        rows = chunked(staged.where("NOT bad"), config, signs)
        rows = staging.table(rows.withColumn("embedding", embed(F.col("text"), encoder)))
        counts = rows.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("chunk_count"))
        states = todo.join(counts, "path", "left").select("path", F.col("modified").alias("last_modified"), F.current_timestamp().alias("last_indexed"), F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"))
        states, of_files = staging.measured(states, chunks=F.sum("chunk_count"), files=F.count(F.lit(1)), empty=F.count_if(F.col("chunk_count") == 0))
        removed = store.replace_files(rows, states)
    except Exception as e:
        names = sorted(todo.collect())
        if len(names) == 1 and path is None:
            run.errors.append(f"{names[0].path}: {str(e).splitlines()[0]}")
            return
        half = (len(names) + 1) // 2  # of one file all is tried again
        for part in (names[:half], names[half:]):
            if part:
                _read(spark, store, staging, run, spark.createDataFrame(part, todo.schema), None, pattern, recursive, encoder, config, signs)
        return
    run.chunks += of_files["chunks"] or 0
    run.files_processed += of_files["files"]
    run.files_skipped += of_files["empty"]
    run.chunks_removed += removed
    run.bad_lines += of_lines["bad"]


def watch(spark: SparkSession, path: str, store: Store, quiet: float = 5, every: str = "1 second", encoder: Encoder | None = None, config: Chunking = Chunking(), signs: list[str] = ()) -> StreamingQuery:
    """Indexes the changed files of a folder when none of them has changed for `quiet` seconds. The stream goes on from the
    store's own folder after a restart. If an index run fails, the next batch compares all files."""
    fs, p = store._path(path)
    home = path if "://" in path else (f"file://{fs.makeQualified(p).toUri().getPath()}" if fs.getScheme() == "file" else fs.makeQualified(p).toString())
    events = register(spark).readStream.format("parley_logs").option("path", home).load()
    last: dict[str, str] = {}

    def batch(df: DataFrame, number: int) -> None:
        found = df.select(F.explode(F.arrays_zip("paths", "times")).alias("x")).select(F.col("x.paths").alias("path"), F.col("x.times").alias("modified")).persist()
        try:
            if found.count() or last:  # the count runs the whole batch, whose state must be kept
                index(df.sparkSession, path, store, encoder, config, signs=signs, listed=None if last else found)
            last.pop("error", None)
        except Exception as e:
            last["error"] = str(e)
        finally:
            found.unpersist()

    place = f"{store.folder}/watch/{hashlib.md5(home.encode()).hexdigest()}"
    with prepared(spark):  # the query keeps the settings that it starts with
        query = bursts(events, quiet).writeStream.foreachBatch(batch).option("checkpointLocation", place).trigger(processingTime=every).start()
    query.watch_errors = last
    return query


def stop(query: StreamingQuery, seconds: float = 10) -> bool:
    """Ends a watch; false if it still runs after so many seconds."""
    query.stop()
    with contextlib.suppress(StreamingQueryException):  # a batch that is broken off is no failure, the next start repeats it
        query.awaitTermination(int(seconds))
    return not query.isActive


def status(query: StreamingQuery) -> dict:
    return {"running": query.isActive, "status": query.status, "last": query.lastProgress, "errors": dict(getattr(query, "watch_errors", {}))}


def session_stream(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by time gap on a stream or a table; a session closes when the watermark passes its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
