"""The index on disk: fragments of Parquet for chunks and file states, keys of what went, and manifests.

A change writes new fragments and then one manifest for chunks and files together, which names all fragments. Nothing is
overwritten. A fragment has the number of the version that it came by. A delete, or an upsert of what may be there, writes
no data anew but the keys that go, with the last version to which this applies; readers leave those rows out, and
`optimize` folds the keys in.

Writers need no lock. A version's manifest is created only if it isn't there; who comes second reads the newer one and
puts the same change on top of it, so both changes are kept, in one order. A change that read rows (a delete by a
condition) applies to the version that it read. Two rewrites of one table can't be ordered: the second raises Conflict.
Readers follow one manifest; what it names stays until `vacuum` finds it out of use for long enough. The folder may be
on any file system that Spark reaches.
"""

from __future__ import annotations

import base64
import datetime
import json
import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from parley.schema import CHUNKS, FILES

SCHEMAS = {"chunks": CHUNKS, "files": FILES}
#: The number of the commit that a row came by, where a rewrite has brought rows of several together.
SEQ = "_seq"
#: Kinds of chunks, each counted for itself in a fragment's statistics.
KINDS = ("qa_pair", "qa_pair_split", "context_segment", "code_block", "tool_usage")
#: Logarithm of a sketch's counters: distinct counts have a relative standard error of 1.04 / 2**6, 1.6 %.
SKETCH = 12
STATISTICS = "total_chunks bigint, sessions binary, projects binary, dimension int, kinds array<bigint>"
#: Columns by which a row is looked up, and which get Bloom filters.
BLOOMS = ("id", "session_id", "path")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(df: DataFrame, gone: Column) -> DataFrame:
    """df without the rows for which gone holds; null is no."""
    return df.where(~F.coalesce(gone, F.lit(False)))


def changed(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Files of listed(path, modified) that known(path, last_modified) lacks or has from an earlier time."""
    return listed.join(known.select("path", "last_modified"), "path", "left").where("last_modified IS NULL OR modified > last_modified").select("path", "modified")


def write_archive(chunks: DataFrame, folder: str) -> None:
    """chunk_id, embedding, text and metadata (all other columns as JSON) of the chunks that have a vector."""
    rest = [c for c in chunks.columns if c not in ("id", "embedding", "text")]
    kept = chunks.where("embedding IS NOT NULL AND size(embedding) > 0")
    kept.select(F.col("id").alias("chunk_id"), "embedding", "text", F.to_json(F.struct(*rest)).alias("metadata")).write.parquet(folder)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of an archive."""
    names = {f.name: f for f in spark.createDataFrame([], CHUNKS).schema}
    rest = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in names.items() if n not in ("id", "embedding", "text"))
    rows = spark.read.parquet(folder).select(F.col("chunk_id").alias("id"), "embedding", "text", F.from_json("metadata", rest).alias("m"))
    return rows.select("id", "embedding", "text", "m.*").select(*names)


class Conflict(RuntimeError):
    """Another writer has changed what this one has read, and the two can't be put in one order."""


class Staging:
    """Tables of one run, in a folder of its own under the store's, which goes at the end of the block."""

    def __init__(self, store: "Store"):
        self.store, self.path = store, f"{store.folder}/staging/{uuid.uuid4().hex}"

    def __enter__(self) -> "Staging":
        return self

    def __exit__(self, *exc) -> None:
        fs, p = self.store._path(self.path)
        fs.delete(p, True)

    def table(self, df: DataFrame) -> DataFrame:
        """df written and read again, so that it is made once."""
        return self.measured(df, n=F.count(F.lit(1)))[0]

    def measured(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """table(df), and aggregates of its rows that are taken while they are written."""
        path, seen = f"{self.path}/{uuid.uuid4().hex}", Observation()
        df.observe(seen, *[c.alias(n) for n, c in measures.items()]).write.parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path), seen.get


class Store:
    #: Rows of keys that went which may be broadcast after they were counted.
    BROADCAST_KEYS = 500_000

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __enter__(self) -> "Store":
        return self

    def __exit__(self, *exc) -> None:
        pass

    # ---- manifests

    def _path(self, path: str):
        """(file system, path) of the cluster's file API."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> dict[int, int]:
        """The versions whose manifests are there, with the milliseconds of their files."""
        fs, p = self._path(f"{self.folder}/manifest")
        found = fs.listStatus(p) if fs.exists(p) else []
        return {int(n[:-5]): s.getModificationTime() for s in found if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()}

    def version(self) -> int:
        """The current version, 0 if there is none."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """For chunks and files: data and deletes, each a list of fragments in the order of their commits."""
        v = self.version() if version is None else version
        if not v:
            return {name: {"data": [], "deletes": []} for name in SCHEMAS}
        fs, p = self._path(f"{self.folder}/manifest/{v}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, version: int, manifest: dict) -> bool:
        """Makes the manifest the given version; false if that is there already. It appears whole or not at all."""
        fs, new = self._path(f"{self.folder}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, place = self._path(f"{self.folder}/manifest/{version}.json")
        try:
            if fs.getScheme() == "file":  # whose renames write over files; a link doesn't
                os.link(new.toUri().getPath(), place.toUri().getPath())
                return True
            context = self.spark.sparkContext
            jvm, none = context._jvm, context._gateway.new_array(context._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), context._jsc.hadoopConfiguration()).rename(new, place, none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(new, False)

    def _commit(self, change: Callable[[dict, int], dict]) -> int:
        """Publishes change(manifest, version) of the newest manifest, again on top of what others publish meanwhile."""
        while True:
            v = self.version()
            if self._put(v + 1, change(self.manifest(v), v + 1)):
                return v + 1

    # ---- fragments

    def _written(self, rows: DataFrame, measures: dict[str, Column] | None = None, **options: str) -> dict:
        """rows as a new fragment: its folder, number of rows and bytes, and `seen`, the measures taken on the way."""
        folder, seen = f"data/{uuid.uuid4().hex}", Observation()
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in BLOOMS if c in rows.columns} | {"parquet.bloom.filter.adaptive.enabled": "true"}
        rows.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in (measures or {}).items()]).write.options(**blooms | options).parquet(f"{self.folder}/{folder}")
        fs, p = self._path(f"{self.folder}/{folder}")
        got = {n: v if not isinstance(v, (bytes, bytearray)) else base64.b64encode(v).decode() for n, v in seen.get.items()}
        return {"folder": folder, "rows": got["n"], "bytes": fs.getContentSummary(p).getLength()} | ({"seen": got} if measures else {})

    def _data(self, name: str, rows: DataFrame, **options: str) -> dict:
        """A fragment of a table's rows; of chunks with the range of times of each file, and statistics."""
        cols = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema if f.name in rows.columns]
        measures = {n: c for n, c in _measures().items() if n != "total_chunks"} if name == "chunks" and set(cols) >= {"session_id", "project_name", "chunk_type", "embedding"} else None
        out = self._written(rows.select(*cols, *[c for c in (SEQ,) if c in rows.columns]), measures, **options)
        if name == "chunks" and out["rows"]:
            written = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{out['folder']}")
            ranges = written.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
            shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
            out["files"] = {r.f: [r.a, r.b] for r in ranges.select("f", shown("a").alias("a"), shown("b").alias("b")).collect()}  # a row a file
        return out

    def _of_fragments(self, fragments: list[dict], schema: str, value: str, column: str, filters: dict | None = None) -> DataFrame:
        """Rows of fragments, with the number that each of them has under `value`; rows with one of their own keep it."""
        paths, number = [], {}
        for f in fragments:
            kept = [n for n, span in f["files"].items() if _overlaps(span, filters)] if filters and "files" in f else None
            paths += [f"{self.folder}/{f['folder']}"] if kept is None else [f"{self.folder}/{f['folder']}/{n}" for n in kept]
            number[f["folder"].rpartition("/")[2]] = f[value]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, {column} bigint")
        df = self.spark.read.schema(f"{schema}, {column} bigint").parquet(*paths)
        own = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
        numbers = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])
        return df.withColumn(column, F.coalesce(column, F.element_at(numbers, own)))

    def _read(self, name: str, manifest: dict | None = None, filters: dict | None = None, numbered: bool = False) -> DataFrame:
        """The rows of a table. numbered: with the commit that each came by."""
        found = (manifest or self.manifest())[name]
        data, deletes = [f for f in found["data"] if f["rows"]], [d for d in found["deletes"] if d["rows"]]
        last = max((d["upto"] for d in deletes), default=-1)
        # what came after all deletes needs none of them
        old, new = ([f for f in data if (f["seq"] <= last) == x] for x in (True, False))
        rows = self._of_fragments(old, SCHEMAS[name], "seq", SEQ, filters)
        for key in sorted({tuple(d["key"]) for d in deletes}):
            mine = [d for d in deletes if tuple(d["key"]) == key]
            gone = self._of_fragments(mine, ", ".join(f"{c} string" for c in key), "upto", "upto").groupBy(*key).agg(F.max("upto").alias("upto"))
            gone = gone.select(F.col("upto").alias("_upto"), *[F.col(c).alias(f"_{c}") for c in key])
            on = F.col(SEQ) <= F.col("_upto")
            for c in key:
                on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
            rows = rows.join(F.broadcast(gone) if sum(d["rows"] for d in mine) <= self.BROADCAST_KEYS else gone, on, "left_anti")
        rows = rows.unionByName(self._of_fragments(new, SCHEMAS[name], "seq", SEQ, filters)) if new else rows
        return rows if numbered else rows.drop(SEQ)

    def _keys(self, rows: DataFrame, key: list[str]) -> dict:
        return self._written(rows.select(*key).distinct()) | {"key": key}

    # ---- reading

    def chunks(self, filters: dict | None = None) -> DataFrame:
        """All chunks. filters, as a search takes them, only leave out files that hold no row of their range of times:
        they are still to be applied."""
        return self._read("chunks", filters=(filters or {}).get("ts"))

    def files(self) -> DataFrame:
        return self._read("files")

    def statistics(self) -> DataFrame:
        """One row: total_chunks, total_sessions, total_projects, dimension, chunk_types (a map). Distinct counts are merged from
        the sketches of fragments (within the error of SKETCH, and not always alike after a rewrite), all others are exact. Chunks are read only of fragments of which a later change may have
        taken rows, so after `optimize` none; a sketch can't be reduced."""
        found = self.manifest()["chunks"]
        last = max((d["upto"] for d in found["deletes"] if d["rows"]), default=-1)
        whole = [f for f in found["data"] if f["rows"] and f["seq"] > last and "seen" in f]
        parts = [self._noted(f) for f in whole]
        rows = self.spark.createDataFrame(parts, STATISTICS)
        rest = [f for f in found["data"] if f["rows"] and f not in whole]
        if rest:
            columns = self._read("chunks", {"chunks": found | {"data": rest}})
            measured = columns.agg(*[c.alias(n) for n, c in _measures().items()])
            rows = rows.unionByName(measured.select("total_chunks", "sessions", "projects", "dimension", F.array(*[f"kind_{k}" for k in KINDS]).alias("kinds")))
        distinct = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("bigint")
        total = F.coalesce(F.sum("total_chunks"), F.lit(0))
        kinds = [F.coalesce(F.sum(F.get("kinds", F.lit(i))), F.lit(0)) for i in range(len(KINDS))]
        types = F.map_from_arrays(F.array(*map(F.lit, [*KINDS, "other"])), F.array(*kinds, total - sum(kinds, F.lit(0))))
        return rows.agg(total.alias("total_chunks"), distinct("sessions").alias("total_sessions"), distinct("projects").alias("total_projects"), F.max("dimension").cast("bigint").alias("dimension"), F.map_filter(types, lambda _, n: n > 0).alias("chunk_types"))

    def _noted(self, fragment: dict) -> Row:
        seen = fragment["seen"]
        return Row(fragment["rows"], *[bytearray(base64.b64decode(seen[c])) for c in ("sessions", "projects")], seen["dimension"], [seen[f"kind_{k}"] for k in KINDS])

    def staging(self) -> Staging:
        return Staging(self)

    # ---- changes

    def add(self, chunks: DataFrame) -> None:
        """Upserts chunks by id; those without a vector are left out."""
        new = self._data("chunks", chunks.where("embedding IS NOT NULL"))
        gone = self._keys(self._of_fragments([new | {"seq": 0}], SCHEMAS["chunks"], "seq", SEQ), ["id"])
        self._commit(lambda m, v: _with(m, v, "chunks", new, gone))

    def delete(self, gone: Column) -> int:
        """Deletes chunks; gives their number. Their keys are noted, and no file of chunks is written anew. Chunks that come
        while it runs stay."""
        base = self.version()
        keys = self._keys(self._read("chunks", self.manifest(base)).where(gone), ["file_path", "id"])
        if keys["rows"]:
            self._commit(lambda m, v: _with(m, v, "chunks", None, keys, base))
        return keys["rows"]

    def replace_files(self, chunks: DataFrame, states: DataFrame) -> int:
        """Puts the chunks of re-read files in place of what the store has of them, and notes the files' states with
        them; gives the number of chunks that went."""
        new, noted = self._data("chunks", chunks), self._data("files", states)
        gone = self._keys(states.select(F.col("path").alias("file_path")), ["file_path"])
        known = self._keys(states, ["path"])
        removed = self.chunks().join(states.select(F.col("path").alias("file_path")), "file_path", "left_semi").count()
        self._commit(lambda m, v: _with(_with(m, v, "chunks", new, gone), v, "files", noted, known))
        return removed

    def clear(self) -> None:
        self._commit(lambda m, v: m | {name: {"data": [], "deletes": []} for name in SCHEMAS})

    def optimize(self, rows_per_file: int = 500_000, bytes_per_file: int = 64 << 20, **options: str) -> None:
        """Rewrites both tables without what was deleted; chunks in files that are near in project and time (a Z-order),
        so that a search of either reads few of them. A file has about rows_per_file rows or bytes_per_file, as fragments
        have them now, whichever is less. Rows keep the number of their commit, so changes made
        meanwhile still apply. Raises Conflict if another writer has rewritten the table too."""
        base = self.version()
        seen = self.manifest(base)
        for name in SCHEMAS:
            rows = self._read(name, seen, numbered=True)
            if name == "chunks":
                size = lambda k: sum(f[k] for f in seen[name]["data"])
                many = max(1, -(-size("rows") // rows_per_file), -(-size("bytes") // bytes_per_file))
                rows = z_ordered(rows, many)
            new, old = self._data(name, rows, **options), seen[name]

            def change(m: dict, v: int, name=name, new=new, old=old) -> dict:
                now, names = m[name], lambda part: {f["folder"] for f in part}
                if not names(old["data"]) <= names(now["data"]):
                    raise Conflict(f"another writer has rewritten {name}")
                later = {k: [f for f in now[k] if f["folder"] not in names(old[k])] for k in ("data", "deletes")}
                return m | {name: later | {"data": [new | {"seq": base}, *later["data"]]}}

            self._commit(change)

    def vacuum(self, seconds: float = 86_400) -> int:
        """Deletes what no reader or writer can need who took no longer than so many seconds: versions that were followed by
        another before that, and folders as old which no version left names. Gives the number of folders."""
        edge = (time.time() - seconds) * 1000
        versions = self._versions()
        for v in sorted(versions)[:-1]:
            if versions[v + 1] < edge:
                fs, p = self._path(f"{self.folder}/manifest/{v}.json")
                fs.delete(p, False)
        used = {f["folder"] for v in self._versions() for m in [self.manifest(v)] for name in SCHEMAS for part in m[name].values() for f in part}
        fs, data = self._path(f"{self.folder}/data")
        old = [s.getPath() for s in (fs.listStatus(data) if fs.exists(data) else []) if s.getModificationTime() < edge and f"data/{s.getPath().getName()}" not in used]
        for p in old:
            fs.delete(p, True)
        return len(old)

    def backup(self, folder: str) -> None:
        now = self.manifest()
        for name in SCHEMAS:
            self._read(name, now).write.mode("overwrite").parquet(f"{folder}/{name}")

    def restore(self, folder: str) -> None:
        """Puts back what the backup has; either part may be missing."""
        back = {}
        for name, schema in SCHEMAS.items():
            fs, p = self._path(f"{folder}/{name}")
            if fs.exists(p):
                back[name] = self._data(name, self.spark.read.schema(schema).parquet(f"{folder}/{name}"))
        self._commit(lambda m, v: m | {name: {"data": [new | {"seq": v}], "deletes": []} for name, new in back.items()})

    def size_bytes(self, name: str) -> int:
        return sum(f["bytes"] for part in self.manifest()[name].values() for f in part)


def _measures() -> dict[str, Column]:
    """What the statistics of chunks are put together from."""
    kinds = {f"kind_{k}": F.count_if(F.col("chunk_type") == k) for k in KINDS}
    values = lambda c: F.hll_sketch_agg(F.concat(F.lit("="), F.col(c)), SKETCH)  # noqa: E731  (a sketch leaves out empty text)
    return {"total_chunks": F.count(F.lit(1)), "sessions": values("session_id"), "projects": values("project_name"), "dimension": F.max(F.size("embedding"))} | kinds


def _with(m: dict, version: int, name: str, new: dict | None, gone: dict, upto: int | None = None) -> dict:
    """A manifest with a fragment and keys that go from all that came before it (or until the version upto)."""
    now = m[name]
    data = [*now["data"], *([new | {"seq": version}] if new else [])]
    return m | {name: {"data": data, "deletes": [*now["deletes"], gone | {"upto": version - 1 if upto is None else upto}]}}


def _overlaps(span: list, wanted: dict) -> bool:
    """If a file with times from span[0] to span[1] may hold a time that is asked for, as far as this is text or a time."""
    low, high = span
    if low is None:
        return False
    text = lambda k: str(wanted[k]).replace("T", " ") if isinstance(wanted.get(k), (str, datetime.date)) else None
    above, below = ([t for k in keys if (t := text(k))] for keys in (("gte", "gt"), ("lte", "lt")))
    return all(high >= t for t in above) and all(low <= f"{t}~" for t in below)  # ~ is after all digits and signs


def z_ordered(chunks: DataFrame, files: int, bits: int = 5, names: int = 4096) -> DataFrame:
    """chunks in so many ranges of a Z-order over project and time, each sorted; rows of one time can lie in several. Both
    are cut at quantiles, of projects by the `names` commonest."""
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    when = F.unix_micros(F.col("ts").cast("timestamp"))
    times = chunks.agg(F.percentile_approx(when, steps, 1000)).first()[0] or []
    counts = chunks.where("project_name IS NOT NULL").groupBy("project_name").count().orderBy(F.desc("count"), "project_name").limit(names).collect()
    counts.sort(key=lambda r: r.project_name)
    total, below, projects = sum(r["count"] for r in counts), 0, []
    for r in counts:
        if len(projects) < len(steps) and below >= total * steps[len(projects)]:
            projects.append(r.project_name)
        below += r["count"]
    place = lambda c, cuts: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= c)) if cuts else F.lit(0)
    x, y = F.coalesce(place(F.col("project_name"), projects), F.lit(0)), F.coalesce(place(when, times), F.lit(0))
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1))
    z = F.lit(0)
    for i in range(bits):
        z = z + F.shiftleft(bit(x, i), 2 * i + 1) + F.shiftleft(bit(y, i), 2 * i)
    return chunks.withColumn("_z", z).repartitionByRange(files, "_z", "ts", F.xxhash64("id")).sortWithinPartitions("_z", "project_name", "ts").drop("_z")
