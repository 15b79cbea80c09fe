"""The store: merge-on-read changes, writers without locks, access paths, clean-up."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from parley.sources import store as S
from parley.sources.store import Conflict, Store


def chunk_rows(spark, ids, file="f", text="t", session="s", day=1, project="p"):
    rows = [(i, f"{text} {i}", file, session, project, f"2024-01-{day:02d} 10:00:00", [1.0, 2.0]) for i in ids]
    return spark.createDataFrame(rows, "id string, text string, file_path string, session_id string, project_name string, ts string, embedding array<float>").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def states(spark, *paths):
    return spark.createDataFrame([(p, 1) for p in paths], "path string, chunk_count long").withColumn("last_modified", F.current_timestamp()).withColumn("last_indexed", F.current_timestamp())


def texts(store):
    return {r.id: r.text for r in store.chunks().collect()}


@pytest.fixture
def two(spark, tmp_path):
    folder = f"file://{tmp_path}/st"
    a, b = Store(spark, folder), Store(spark, folder)
    a.add(chunk_rows(spark, ["1", "2", "3"]))
    return a, b


def meanwhile(store, other):
    """Lets the other writer publish after this one has written its data and read the newest manifest."""
    put, done = store._put, []

    def late(version, manifest):
        if not done:
            done.append(1)
            other()
        return put(version, manifest)

    store._put = late


def test_two_interleaved_writers_keep_both_changes(spark, two):
    a, b = two
    meanwhile(a, lambda: b.replace_files(chunk_rows(spark, ["9"], "g"), states(spark, "g")))
    a.replace_files(chunk_rows(spark, ["4"], "f"), states(spark, "f"))
    assert a.version() == 3 and texts(a) == texts(b) == {"4": "t 4", "9": "t 9"}
    assert sorted(r.path for r in b.files().collect()) == ["f", "g"]


def test_the_later_of_two_upserts_of_one_id_stays(spark, two):
    a, b = two
    meanwhile(a, lambda: b.add(chunk_rows(spark, ["1", "5"], text="b")))
    a.add(chunk_rows(spark, ["1", "6"], text="a"))
    assert texts(a) == {"1": "a 1", "2": "t 2", "3": "t 3", "5": "b 5", "6": "a 6"}


def test_a_delete_applies_to_what_it_read(spark, two):
    a, b = two
    meanwhile(a, lambda: b.add(chunk_rows(spark, ["1", "7"], text="new")))
    assert a.delete(F.col("id").isin("1", "2", "7")) == 2  # 7 was not there, and 1 is another row since
    assert texts(b) == {"1": "new 1", "3": "t 3", "7": "new 7"}


def test_a_rewrite_keeps_what_comes_meanwhile(spark, two):
    a, b = two
    a.delete(F.col("id") == "3")

    def changes():
        b.delete(F.col("id") == "2")
        b.add(chunk_rows(spark, ["1", "8"], text="new"))

    meanwhile(a, changes)
    a.optimize()
    assert texts(a) == {"1": "new 1", "8": "new 8"}
    b.optimize()
    now = a.manifest()["chunks"]
    assert texts(a) == {"1": "new 1", "8": "new 8"} and len(now["data"]) == 1 and now["deletes"] == [] and now["data"][0]["rows"] == 2


def test_a_delete_computed_before_a_rewrite_still_applies(spark, two):
    a, b = two
    meanwhile(a, lambda: b.optimize())
    assert a.delete(F.col("id") == "1") == 1 and texts(a) == {"2": "t 2", "3": "t 3"}
    a.optimize()
    assert texts(a) == {"2": "t 2", "3": "t 3"}


def test_of_two_rewrites_the_second_is_an_error(spark, two):
    a, b = two
    meanwhile(a, b.optimize)
    with pytest.raises(Conflict):
        a.optimize()
    assert texts(a) == texts(b) == {"1": "t 1", "2": "t 2", "3": "t 3"}


def test_clear_and_restore_against_an_upsert(spark, two, tmp_path):
    a, b = two
    a.backup(f"file://{tmp_path}/backup")
    meanwhile(a, lambda: b.add(chunk_rows(spark, ["5"])))
    a.clear()
    assert texts(a) == {}
    b.add(chunk_rows(spark, ["6"]))
    a.restore(f"file://{tmp_path}/backup")
    assert texts(b) == {"1": "t 1", "2": "t 2", "3": "t 3"} and b.delete(F.col("id") == "1") == 1


def test_many_threads_write_at_once(spark, two):
    a, b = two
    failed = []

    def work(n):
        try:
            s = Store(spark, a.folder)
            s.add(chunk_rows(spark, [f"{n}a", f"{n}b"], f"file{n}"))
            s.delete(F.col("id") == f"{n}b")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and sorted(texts(a)) == ["0a", "1", "1a", "2", "2a", "3", "3a"] and b.version() == 9


def test_a_version_is_made_once_whatever_the_file_system(spark, two):
    a, _ = two
    assert not a._put(1, {}) and a._put(2, a.manifest()) and not a._put(2, {}) and texts(a)
    fs, p = a._path(a.folder)
    path = a._path

    class Other:  # what hasn't links is asked to rename without writing over
        def __init__(self, fs):
            self.fs = fs

        def getScheme(self):
            return "other"

        def __getattr__(self, name):
            return getattr(self.fs, name)

    a._path = lambda x: (Other(path(x)[0]), path(x)[1])
    assert a._put(3, {"x": 1}) and not a._put(3, {})
    names = os.listdir(p.toUri().getPath() + "/manifest")
    assert not [n for n in names if n.startswith(".") and not n.endswith(".crc")]


def data_files(store):
    top = store.folder.removeprefix("file://") + "/data"
    return {(d, n, os.stat(f"{top}/{d}/{n}").st_mtime_ns) for d in os.listdir(top) for n in os.listdir(f"{top}/{d}")}


def test_deleting_one_chunk_writes_only_its_key(spark, two):
    a, _ = two
    before, folders = data_files(a), {f["folder"] for f in a.manifest()["chunks"]["data"]}
    assert a.delete(F.col("id") == "2") == 1
    now = a.manifest()["chunks"]
    assert before <= data_files(a) and {f["folder"] for f in now["data"]} == folders
    assert now["deletes"][-1]["rows"] == 1 and now["deletes"][-1]["key"] == ["file_path", "id"]
    assert a.delete(F.col("id") == "none") == 0 and len(a.manifest()["chunks"]["deletes"]) == len(now["deletes"])
    assert a.delete(F.col("session_id").isNull()) == 0 and sorted(texts(a)) == ["1", "3"]


def test_readers_keep_their_files_until_they_are_out_of_use(spark, two):
    a, _ = two
    reader = a.chunks()
    a.delete(F.col("id") == "2")
    unfinished = a._written(chunk_rows(spark, ["50"]))  # of a writer that hasn't published
    a.optimize()
    a.optimize()
    assert a.vacuum() == 0 and len(reader.collect()) == 3
    time.sleep(1.1)
    assert a.vacuum(seconds=1) >= 3 and len(a._versions()) == 1
    fs, p = a._path(f"{a.folder}/{unfinished['folder']}")
    assert not fs.exists(p) and sorted(texts(a)) == ["1", "3"]


def test_staging_of_two_runs_is_apart(spark, two):
    a, b = two
    with a.staging() as one:
        kept = one.table(spark.range(3).toDF("x"))
        with b.staging() as other:
            other.table(spark.range(4).toDF("x"))
        assert kept.count() == 3
    fs, p = a._path(one.path)
    assert not fs.exists(p)


def scanned(df):
    """(files, rows) that scans of the executed query gave."""
    df.collect()
    out, waiting = [0, 0], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        plan = waiting.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.executedPlan()
        metrics = {kv._1(): kv._2().value() for kv in [it for it in _items(plan.metrics())]}
        if "numFiles" in metrics:
            out[0], out[1] = out[0] + metrics["numFiles"], out[1] + metrics["numOutputRows"]
        children = plan.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return tuple(out)


def _items(scala_map):
    it = scala_map.iterator()
    while it.hasNext():
        yield it.next()


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """40,000 chunks of 40 days and 20 projects, in any order."""
    folder = f"file://{tmp_path_factory.mktemp('large')}/st"
    rows = spark.range(40_000).selectExpr("concat('id', xxhash64(id)) AS id", "concat('text ', id) AS text", "concat('f', id % 50) AS file_path", "concat('session', xxhash64(id % 4000)) AS session_id", "concat('project', id % 20) AS project_name", "timestampadd(MINUTE, cast(pmod(xxhash64(id), 57600) as int), timestamp_ntz'2024-01-01') AS ts", "array(1.0f) AS embedding")
    store = Store(spark, folder)
    store.add(rows.repartition(8))
    before = store.chunks().count(), store.chunks(), store.manifest()
    store.optimize(rows_per_file=1000, **{"parquet.block.size": "65536", "parquet.page.row.count.limit": "500"})
    return store, before, rows


def test_a_date_window_opens_few_files(spark, large):
    store, (n, _, _), rows = large
    window = {"gte": "2024-01-10", "lt": "2024-01-12"}
    wanted = (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-12")
    all_files, all_rows = scanned(store.chunks().select("id", "ts"))
    files, read = scanned(store.chunks({"ts": window}).where(wanted).select("id", "ts"))
    assert n == all_rows == 40_000 and all_files >= 32 and files <= all_files / 2 and read <= all_rows / 2
    want = sorted(r.id for r in rows.where(wanted).collect())
    assert sorted(r.id for r in store.chunks({"ts": window}).where(wanted).collect()) == want
    assert store.chunks({"ts": {"gte": "2030-01-01"}}).count() == 0


def test_a_project_in_full_reads_few_rows(spark, large):
    store, _, rows = large
    files, read = scanned(store.chunks().where("project_name = 'project7'").select("id"))
    assert 2000 <= read <= 20_000


def test_point_lookups_skip_row_groups_by_bloom_filters(spark, large):
    store, _, rows = large
    key, session = rows.where("text = 'text 777'").select("id", "session_id").first()  # neither is the least of a file
    for column, value, n in (("id", key, 1), ("session_id", session, 10)):
        found = lambda: store.chunks().where(F.col(column) == value).select("id", "text")  # noqa: B023, E731
        assert found().count() == n
        read = {}
        try:
            # repeated values are ruled out by a row group's dictionary, others by its Bloom filter
            for on in (True, False):
                spark.conf.set("parquet.filter.dictionary.enabled", str(on and column == "session_id").lower())
                spark.conf.set("parquet.filter.bloom.enabled", str(on).lower())
                read[on] = scanned(found())[1]
        finally:
            spark.conf.unset("parquet.filter.dictionary.enabled")
            spark.conf.unset("parquet.filter.bloom.enabled")
        assert read[True] <= 8000 and read[True] < read[False] / 2, (column, read)


def test_z_order_has_quantiles_of_both(spark):
    df = spark.range(2000).selectExpr("concat('p', id % 7) AS project_name", "timestampadd(HOUR, cast(id as int), timestamp_ntz'2024-01-01') AS ts", "id")
    out = S.z_ordered(df.union(spark.sql("SELECT NULL, NULL, -1L")), 8)
    spans = out.groupBy(F.spark_partition_id()).agg(F.count_distinct("project_name").alias("p"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in spans) == 2001 and max(r.p for r in spans) < 7
    assert S.z_ordered(df.limit(0), 3).count() == 0


def test_statistics_are_merged_from_the_manifest(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/st")
    assert st.statistics().first().asDict() == {"total_chunks": 0, "total_sessions": 0, "total_projects": 0, "dimension": None, "chunk_types": {}}
    many = spark.range(20_000).selectExpr("'i' || id AS id", "'t' AS text", "'f' || id % 9 AS file_path", "CASE WHEN id % 10 > 0 THEN 's' || id % 7000 END AS session_id", "'p' || id % 13 AS project_name", "CASE id % 4 WHEN 0 THEN 'qa_pair' WHEN 1 THEN 'code_block' WHEN 2 THEN 'more' END AS chunk_type", "array(1f, 2f, 3f) AS embedding")
    st.add(many)
    opened = []
    read, st._read = st._read, lambda *a, **k: opened.append(a) or read(*a, **k)
    one = st.statistics().first()
    assert not opened and one.total_chunks == 20_000 and one.total_projects == 13 and one.dimension == 3
    assert one.chunk_types == {"qa_pair": 5000, "code_block": 5000, "other": 10_000}
    exact = many.selectExpr("count(DISTINCT session_id)").first()[0]
    assert abs(one.total_sessions - exact) <= 3 * 1.04 / 2**6 * exact
    st._read = read
    st.delete(F.col("project_name") == "p3")
    st.add(many.where("id IN ('i1', 'i2')").withColumn("session_id", F.lit("new")).withColumn("chunk_type", F.lit("tool_usage")))
    left = many.where("project_name <> 'p3' AND id NOT IN ('i1', 'i2')").count() + 2
    left_sessions = st.chunks().select("session_id").distinct().where("session_id IS NOT NULL").count()
    before = st.statistics().first()
    assert before.total_chunks == left == st.chunks().count() and before.total_projects == st.chunks().select("project_name").distinct().count() == 12 and before.chunk_types["tool_usage"] == 2
    st.optimize()
    st._read = lambda *a, **k: opened.append(a) or read(*a, **k)
    after, exact = st.statistics().first().asDict(), left_sessions
    assert not opened and all(abs(n - exact) <= 3 * 1.04 / 2**6 * exact for n in (before.total_sessions, after["total_sessions"]))
    assert after | {"total_sessions": before.total_sessions} == before.asDict()


def test_optimize_bounds_a_files_bytes_even_of_one_time(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/st")
    st.add(chunk_rows(spark, [f"{i:05d}" for i in range(400)]).withColumn("text", F.concat(*[F.sha2(F.concat("id", F.lit(f"{k}")), 512) for k in range(20)])))
    had = {r.id: r.text for r in st.chunks().collect()}
    st.optimize(bytes_per_file=100_000)
    sizes = st.chunks().groupBy(F.input_file_name()).count().collect()
    assert len(sizes) >= 5 and max(r["count"] for r in sizes) <= 160  # one file before, as all are few rows and of one time
    assert {r.id: r.text for r in st.chunks().collect()} == had
