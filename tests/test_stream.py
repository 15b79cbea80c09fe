"""The stream of changed files and its quiet period."""

import os
import time


from parley.sources import stream as S
from parley.streaming import debounce


def put(path, text, seconds=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    if seconds is not None:
        os.utime(path, (seconds, seconds))


def run(spark, tmp_path, what="lines", **options):
    """One start of the stream to its end, from its checkpoint; gives the rows that came."""
    S.register(spark)
    out, before = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    df = spark.readStream.format("parley_logs").option("path", f"{tmp_path}/logs").option("what", what).options(**options).load()
    n = spark.read.schema(df.schema).parquet(out).count() if os.path.exists(out) else 0
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", before).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.parquet(out)
    return sorted((tuple(r) for r in rows.collect()), key=str), rows.count() - n


def test_a_grown_file_is_read_again_once_and_restarts_lose_nothing(spark, tmp_path):
    logs = tmp_path / "logs"
    put(logs / "p" / "a.jsonl", "1\n2\n", 1000)
    put(logs / "q" / "b.jsonl", b"x\r\n\xff\xfe\n\nlast", 1000)
    put(logs / "c.txt", "no log", 1000)
    rows, new = run(spark, tmp_path)
    found = lambda rows, name: [(r[2], r[3]) for r in sorted(rows, key=lambda r: (r[1], r[2])) if r[0].endswith(name)]
    assert new == 6 and found(rows, "a.jsonl") == [(0, "1"), (1, "2")] and found(rows, "b.jsonl") == [(0, "x"), (1, None), (2, ""), (3, "last")]
    assert {r[1].timestamp() for r in rows} == {1000.0}
    assert run(spark, tmp_path)[1] == 0  # nothing is read again after a restart
    put(logs / "p" / "a.jsonl", "1\n2\n3\n", 2000)
    put(logs / "p" / "d.jsonl", "same time as the last offset", 1000)
    rows, new = run(spark, tmp_path)
    assert new == 3 + 1 and found(rows, "a.jsonl")[-3:] == [(0, "1"), (1, "2"), (2, "3")]
    assert run(spark, tmp_path)[1] == 0


def test_offsets_of_one_time_tell_paths_apart():
    f = lambda p, t: S.LogFile(p, t, 1)
    start, end = {"time": 5, "paths": ["a"]}, {"time": 9, "paths": ["c"]}
    files = [f("a", 5), f("b", 5), f("c", 9), f("d", 9), f("e", 10), f("f", 4), f("g", 7)]
    assert [x.path for x in S.between(files, start, end)] == ["b", "g", "c"]
    assert S.between(files, end, end) == []
    batches = [S.between(files, {"time": -1, "paths": []}, start), S.between(files, start, end), S.between(files, end, {"time": 10, "paths": ["e"]})]
    assert [[x.path for x in b] for b in batches] == [["f", "a"], ["b", "g", "c"], ["d", "e"]]


def test_files_are_dealt_by_bytes_and_read_in_pieces(tmp_path):
    f = lambda p, n: S.LogFile(p, 1, n)
    assert [[x.path for x in g.files] for g in S.dealt([f("a", 3), f("b", 3), f("c", 50), f("d", 1), f("e", 6)], 7)] == [["a", "b"], ["c"], ["d", "e"]]
    assert S.dealt([], 7) == []
    put(tmp_path / "x", "ab\ncdef\n\nlast")
    assert list(S.lines_of(f"{tmp_path}/x", chunk=3)) == [b"ab", b"cdef", b"", b"last"] and list(S.lines_of(f"file://{tmp_path}/x")) == [b"ab", b"cdef", b"", b"last"]
    assert [x.path for x in S.listed(f"file://{tmp_path}", "*", True)] == [f"file://{tmp_path}/x"] and S.listed(f"{tmp_path}/none", "*", True) == []


def test_a_batch_that_runs_again_leaves_a_file_that_has_changed_since(tmp_path):
    logs = tmp_path / "logs"
    put(logs / "a.jsonl", "1\n", 1000)
    put(logs / "b.jsonl", "2\n", 2000)
    r = S.Reader({"path": f"{logs}", "what": "lines"})
    start, end = r.initialOffset(), r.latestOffset()
    put(logs / "a.jsonl", "1\n3\n", 3000)
    later = r.latestOffset()
    names = lambda a, b: [f.path.rsplit("/", 1)[1] for p in r.partitions(a, b) for f in p.files]
    assert names(start, end) == ["b.jsonl"] and names(end, later) == ["a.jsonl"] and names(later, later) == []
    (logs / "a.jsonl").unlink()
    assert list(r.read(S.Files([S.LogFile(f"{logs}/a.jsonl", 1, 1)]))) == []


def test_a_burst_fires_once_after_the_pause(spark, tmp_path):
    logs, got, quiet = tmp_path / "logs", [], 3.0
    S.register(spark)
    put(logs / "p" / "a.jsonl", "1")
    events = spark.readStream.format("parley_logs").option("path", f"{logs}").load()

    def batch(df, number):
        got.extend((time.time(), r.folder.rsplit("/", 1)[1], [p.rsplit("/", 1)[1] for p in r.paths], r.events) for r in df.collect())

    with debounce.prepared(spark):
        query = debounce.bursts(events, quiet).writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="500 milliseconds").start()
    try:
        for k in range(8):  # a change a second and more often than the pause is long
            put(logs / "p" / f"{'ab'[k % 2]}.jsonl", "1" * (k + 1))
            time.sleep(1)
        last = time.time()
        while time.time() - last < 60 and not got:
            time.sleep(0.2)
        first = list(got)
        put(logs / "q" / "c.jsonl", "other folder")
        put(logs / "p" / "a.jsonl", "again")
        while time.time() - last < 120 and len(got) < len(first) + 2:
            time.sleep(0.2)
    finally:
        query.stop()
    assert query.exception() is None
    assert [x[1:3] for x in first] == [("p", ["a.jsonl", "b.jsonl"])] and first[0][3] >= 2 and first[0][0] >= last - 1 + quiet
    assert sorted(x[1:] for x in got[1:]) == [("p", ["a.jsonl"], 1), ("q", ["c.jsonl"], 1)]
