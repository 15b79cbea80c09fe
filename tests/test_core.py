import collections
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import __main__ as cli
from parley import service
from parley.engine import Engine
from parley.functions import encoder
from parley.functions import text as T
from parley.operators import chunking as C
from parley.operators import filters as FL
from parley.operators import lookups as L
from parley.operators import vectors as V
from parley.plans import catalogue
from parley.schema import Chunking, Search
from parley.sources import jsonl, store
from parley.sources.store import Store
from parley.streaming import watch


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(name, same):
    same(catalogue.QUERIES[name], catalogue.SQL[name])


def lines(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r), "/data/my_project/conv.jsonl", i) for i, r in enumerate(records)], "line string, file_path string, line_no int")


def test_parser_shapes(spark):
    rows = jsonl.messages(lines(spark, "invalid json line", "[1]", {"uuid": "a", "content": [{"text": "x"}, "y", {"type": "code", "language": "py", "text": "z"}], "timestamp": 1705312800}, {"uuid": "b", "message": {"role": "user", "content": "hi"}, "tool_calls": [{"name": "t", "input": "q"}], "function_call": {"name": "u"}}, {"uuid": "c", "content": None, "text": {"message": "m"}, "timestamp": "bad", "time": "2024-01-15T10:00:00Z", "thread_id": "s"})).orderBy("line_no").collect()
    assert [r.uuid for r in rows] == ["a", "b", "c"]
    assert rows[0].content == "x\ny\n```py\nz\n```" and rows[0].has_code and str(rows[0].ts) == "2024-01-15 10:00:00"
    assert rows[1].content == "hi" and rows[1].role == "user" and [t.name for t in rows[1].tool_calls] == ["t", "u"] and rows[1].has_tools
    assert rows[2].content == "m" and str(rows[2].ts) == "2024-01-15 10:00:00" and rows[2].session_id == "s" and rows[2].project_name == "my_project"


def greedy(text, limit):
    paragraphs = text.split("\n\n")
    words = len(paragraphs) == 1 or any(len(p) > limit for p in paragraphs)
    out, cur = [], ""
    for part in text.split() if words else paragraphs:
        glue = " " if words else "\n\n"
        if len(cur) + len(part) + len(glue) > limit:
            out += [cur.strip()] if cur.strip() else []
            cur = ""
        cur += part + glue
    return out + ([cur.strip()] if cur.strip() else [])


def test_split_equals_python(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(["a", "bc ", "\n\n", " ", "dddd"], 60)) for _ in range(200)] + ["", "x" * 90]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.split_greedy(F.col("t"), 30).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [greedy(t, 30) for t in texts]


def test_filters(spark):
    df = spark.createDataFrame([("Team-Alpha", 5, None), ("beta", 9, True), (None, 7, False)], "project_name string, word_count int, has_code boolean")
    assert FL.matching(df, {"project_name": "ALPHA"}).count() == 1
    assert FL.matching(df, {"word_count": {"gte": 6}, "no_column": 3}).count() == 2
    assert FL.matching(df, {"has_code": True}).count() == 1


def test_post_filter_can_return_less(spark):
    df = spark.createDataFrame([(str(i), [1.0, i / 1000.0], i >= 150) for i in range(200)], "id string, embedding array<float>, has_code boolean")
    assert V.search(df, [1.0, 0.0], {"has_code": True}, Search(mode="post")).count() == 0
    assert V.search(df, [1.0, 0.0], {"has_code": True}).count() == 10
    with pytest.raises(ValueError):
        V.search(df, [1.0, 0.0], config=Search(metric="dot"))


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {(r.a, r.b): r.sim for r in V.similarity_matrix(df).collect()}
    assert got[0, 1] == 0 and got[0, 0] == 1 and got[0, 3] is None
    assert [r.id for r in V.knn_join(df, df, 1).where("query_id = 0").collect()] == [2]


def test_approximate_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = catalogue.first_vector(spark, "/root/testdata/sf0.001")
    exact = {r.vec_id for r in V.search(e, q, config=Search(threshold=-1), id_col="vec_id").collect()}
    assert len(exact & {r.vec_id for r in V.lsh_neighbours(e, q, 10).collect()}) >= 9


def test_cell_index_recall_at_its_own_probes(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    built = V.CellIndex.build(e, f"file://{tmp_path}/index")
    index = V.CellIndex(spark, f"file://{tmp_path}/index")
    assert index.probes == built.probes <= len(index.centers) and len(index.centers) == 22
    queries = e.where("vec_id % 20 = 3")
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact, found = pairs(V.knn_join(queries, e, 10)), pairs(index.search_all(queries, 10))
    assert len(exact) == 1000 and len(exact & found) >= 900
    assert pairs(index.search_all(queries, 10, probes=22)) == exact
    one = [float(x) for x in queries.where("vec_id = 3").first().embedding]
    near = {r.vec_id for r in index.search(one, config=Search(threshold=-1, top_k=11), id_col="vec_id").collect()} - {3}
    assert len(near & {i for q, i in exact if q == 3}) >= 8
    plan = index.search(one, 1, id_col="vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "[cell") or "cell#" in plan.split("PartitionFilters")[1][:80]


def test_knn_join_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(40)] + [(50, None), (None, [1.0] * 5), (51, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(list)
    for r in sorted(V.knn_join(df, df, 3, block=7).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.id)
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None}
    cos = lambda a, b: round(float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300)), 6)
    want = {q: sorted((i for i in x if i != q), key=lambda i: (-cos(x[q], x[i]), i))[:3] for q in x}
    assert dict(got) == want
    assert V.knn_join(df.limit(0), df).count() == 0 and V.knn_join(df, df.limit(0)).count() == 0


def test_issues_archive_and_benchmark(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0], "x", 3), ("b", None, "y", 4), ("c", [1.0], "z", 5), ("d", [0.0, 1.0], None, None)], "id string, embedding array<float>, text string, word_count long")
    assert {(r.id, r.issue) for r in V.issues(df).collect()} == {("b", "missing embedding"), ("c", "inconsistent embedding dimension")}
    store.write_archive(df, f"{tmp_path}/archive")
    back = {r.id: r for r in store.read_archive(spark, f"{tmp_path}/archive").collect()}
    assert sorted(back) == ["a", "c", "d"] and back["a"].word_count == 3 and back["a"].embedding == [1.0, 2.0] and back["d"].text is None
    e = encoder.encoder("hashing", dim=32)
    out = encoder.benchmark(e, ["some text"] * 9)
    assert list(out["batch_sizes"]) == [1, 4, 8] and out["dim"] == 32
    with pytest.raises(ValueError):
        encoder.encoder("none")
    one = np.zeros(32)
    for f in ("ab", "^ab", "ab$"):
        h = zlib.crc32(f.encode())
        one[h % 32] += 1 if h >> 31 else -1
    assert np.allclose(e.encode(["AB", "", "AB ab"])[0], one / np.linalg.norm(one)) and not e.encode([""]).any() and e.encode([]).shape == (0, 32)


def test_service_calls_and_commands(spark, tmp_path, capsys):
    long = "word " * 30
    write(tmp_path / "logs" / "proj", "a.jsonl", ["how do I sort a list " + long, "call sorted " + long])
    data = f"{tmp_path}/store"
    e = service.engine(spark, data)
    assert e is service.engine(spark, data) and e.index(str(tmp_path / "logs")).chunks == 1
    key = e.store.chunks().first().id
    assert service.call(e, "search", {"query": "sort"}).startswith("1 results") and key in service.call(e, "chunk", {"chunk_id": key})
    assert "- proj" in service.call(e, "projects") and "total_chunks: 1" in service.call(e, "stats") and "last_indexed" in service.call(e, "status")
    for name, arguments, code in (("none", {}, service.UNKNOWN_CALL), ("chunk", {"chunk_id": "x"}, service.BAD_ARGUMENT), ("search", {"after": "x"}, service.BAD_ARGUMENT), ("search", {"no": 1}, service.BAD_ARGUMENT)):
        with pytest.raises(service.CallError) as x:
            service.call(e, name, arguments)
        assert x.value.code == code
    assert service.capabilities(spark)["cores"] == 4
    assert cli.main([data, "search", "sort", "--after", "2024-13-01"]) == 1 and cli.main([data, "stop"]) == 0 and cli.main([data, "status"]) == 0
    assert cli.main([data, "search", "sort", "--json"]) == 0
    assert capsys.readouterr().out.count("not watching") == 2


def write(path, name, texts, session="s1"):
    path.mkdir(parents=True, exist_ok=True)
    rows = [{"uuid": f"u{i}", "role": "user" if i % 2 == 0 else "assistant", "content": t, "timestamp": f"2024-01-15T10:0{i}:00Z", "sessionId": session} for i, t in enumerate(texts)]
    (path / name).write_text("\n".join(map(json.dumps, rows)) + "\n\n")


def test_topic_word_opens_a_segment(spark):
    long = "word " * 30

    def chunk_types(question):
        talk = ["how do I sort a list " + long, "call sorted " + long, question + long, "reversed " + long]
        rows = [{"uuid": f"u{i}", "role": "user" if i % 2 == 0 else "assistant", "content": t, "timestamp": f"2024-01-15T10:0{i}:00Z", "sessionId": "s"} for i, t in enumerate(talk)]
        return sorted(r.chunk_type for r in C.chunked(jsonl.messages(lines(spark, *rows)), Chunking()).select("chunk_type").collect())

    assert chunk_types("and then ") == ["context_segment", "qa_pair", "qa_pair"]
    assert chunk_types("and now ") == ["qa_pair", "qa_pair"]


def test_index_search_change_delete(spark, tmp_path):
    logs, long = tmp_path / "logs" / "proj", "word " * 30
    write(logs, "a.jsonl", ["how do I sort a list " + long, "call sorted " + long])
    write(logs, "b.jsonl", ["hi", "hello"], "s2")
    engine = Engine(spark, f"file://{tmp_path}/store")
    run = engine.index(str(tmp_path / "logs"))
    assert (run.files_listed, run.files_processed, run.chunks) == (2, 2, 1)
    assert engine.index(str(tmp_path / "logs")).files_processed == 0  # the file without chunks is noted too
    found = engine.semantic_search("sort a list", project="PROJ").collect()
    assert len(found) == 1 and found[0].session_id == "s1"
    assert engine.projects() == ["proj"] and engine.stats()["total_chunks"] == 1
    with pytest.raises(KeyError):
        engine.related("none")
    assert engine.related(found[0].id).count() == 0
    write(logs, "a.jsonl", ["how do I sort a list " + long, "call sorted " + long, "and now " + long, "reversed " + long])
    import os

    os.utime(logs / "a.jsonl", (2_000_000_000, 2_000_000_000))
    assert engine.index(str(tmp_path / "logs")).files_processed == 1
    n = engine.store.chunks().count()
    assert n == 2  # two pairs; the long question with "now" opens a segment, so neither has three messages
    engine.store.backup(f"file://{tmp_path}/backup")
    assert engine.store.delete(F.col("session_id") == "s1") == n and engine.store.chunks().count() == 0
    engine.store.restore(f"file://{tmp_path}/backup")
    engine.store.optimize()
    assert engine.store.chunks().count() == n and engine.store.size_bytes("chunks") > 0
    engine.store.clear()
    assert engine.store.chunks().count() == 0 and engine.store.files().count() == 0


def test_watch_batch_and_sessions(spark, tmp_path):
    write(tmp_path / "logs" / "p", "a.jsonl", ["q " + "w " * 60, "a " + "w " * 60])
    import time

    place = Store(spark, f"file://{tmp_path}/st")
    query = watch.watch(spark, str(tmp_path / "logs"), place, 2)

    def until(done):
        for _ in range(400):
            if done():
                return True
            time.sleep(0.5)

    assert until(place.version)
    first = place.version()
    write(tmp_path / "logs" / "p", "b.jsonl", ["other q " + "w " * 60, "other a " + "w " * 60])
    assert until(lambda: place.version() > first)
    state = watch.status(query)
    assert state["running"] and not state["errors"] and place.chunks().count() == 2 and watch.stop(query)
    # files that the watch has indexed are noted as an index run would
    assert watch.index(spark, str(tmp_path / "logs"), place).files_unchanged == 2
    again = watch.watch(spark, str(tmp_path / "logs"), place, 1)  # from where it was
    write(tmp_path / "logs" / "p", "c.jsonl", ["third q " + "w " * 60, "third a " + "w " * 60])
    assert until(lambda: place.chunks().count() == 3) and watch.stop(again)
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert watch.session_stream(ev).count() == catalogue.event_sessions(spark, "/root/testdata/sf0.001").count()


def test_indexing_survives_bad_lines_and_files(spark, tmp_path):
    logs, long = tmp_path / "logs" / "my proj+x", "word " * 30
    write(logs, "a.jsonl", ["how do I sort a list " + long, "call sorted " + long])
    with (logs / "a.jsonl").open("ab") as f:
        f.write(b'\xff\xfe no text\n{"broken": \n[1]\n')
    (logs / "b.jsonl").write_bytes(b"\xc3\x28\n")
    (logs / "deep").mkdir()
    write(logs / "deep", "c.jsonl", ["question " + long, "answer " + long], None)
    engine = Engine(spark, f"file://{tmp_path}/store")
    run = engine.index(str(tmp_path / "logs"))
    assert (run.files_listed, run.files_processed, run.files_skipped, run.chunks, run.bad_lines, run.errors) == (3, 3, 1, 2, 4, [])
    found = {r.file_path.rsplit("/", 1)[1]: r for r in engine.store.chunks().collect()}
    assert found["a.jsonl"].project_name == "my proj+x" and found["a.jsonl"].session_id == "s1" and found["c.jsonl"].session_id == "session_2024-01-15T10:00:00"
    assert found["a.jsonl"].message_uuids == ["u0", "u1"] and found["a.jsonl"].roles == ["user", "assistant"] and found["a.jsonl"].language is None
    again = engine.index(str(tmp_path / "logs"))
    assert (again.files_processed, again.files_unchanged) == (0, 3)


def test_a_file_that_cannot_be_read_is_an_error_of_its_own(spark, tmp_path, monkeypatch):
    logs, long = tmp_path / "logs" / "p", "word " * 30
    for name in ("a", "b", "c"):
        write(logs, f"{name}.jsonl", [f"question {name} " + long, "answer " + long])
    scan, tried = jsonl.scan, []

    def scanned(spark, paths, *how):
        tried.append(paths)
        if isinstance(paths, str) or any(p.endswith("b.jsonl") for p in paths):
            raise OSError("disk")
        return scan(spark, paths, *how)

    monkeypatch.setattr(jsonl, "scan", scanned)
    run = watch.index(spark, str(tmp_path / "logs"), Store(spark, f"file://{tmp_path}/st"))
    assert run.files_processed == 2 and len(run.errors) == 1 and run.errors[0].endswith("b.jsonl: disk")
    assert sum(isinstance(t, list) and len(t) == 1 and t[0].endswith("b.jsonl") for t in tried) == 1 and run.first_errors(0) == ["... and 1 more"]


def test_one_scan_and_one_parse(spark, tmp_path):
    write(tmp_path / "p", "a.jsonl", ["q", "a"])
    rows = jsonl.with_file_sessions(jsonl.messages(jsonl.numbered(jsonl.scan(spark, str(tmp_path)))))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.lower().count("parsejson") <= 2  # the node and its output's name


@pytest.mark.parametrize("kind", ["cells", "graph"])
def test_index_type_is_chosen(spark, tmp_path, kind, capsys):
    with pytest.raises(ValueError, match="unknown index type"):
        Engine(spark, f"file://{tmp_path}/st", index_type="hnsw2")
    engine = Engine(spark, f"file://{tmp_path}/st", index_type=kind)
    words = ["sort", "list", "tree", "graph", "join", "sum"]
    rows = [(f"c{i}", f"how do I {words[i % 6]} item {i}", f"f{i}", "s", f"p{i % 2}", i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string, file_path string, session_id string, project_name string, has_code boolean")
    engine.store.add(df.withColumn("embedding", encoder.embed(F.col("text"), engine.encoder)))
    with pytest.raises(ValueError, match="has been built"):
        engine.semantic_search("how do I sort item 12").count()
    engine.build_index()
    flat = Engine(spark, f"file://{tmp_path}/st")
    for filters in ({}, {"project": "p0"}):
        want = [r.id for r in flat.semantic_search("how do I sort item 12", 5, **filters).collect()]
        got = [r.id for r in engine.semantic_search("how do I sort item 12", 5, **filters).collect()]
        assert want[0] == got[0] == "c12" and len(set(want) & set(got)) >= 4
    engine.store.delete(F.col("id") == "c12")
    assert "c12" not in [r.id for r in engine.semantic_search("how do I sort item 12", 5).collect()]
    assert cli.main([f"file://{tmp_path}/st", "search", "sort item 18", "--index-type", kind, "--json"]) == 0 and "c18" in capsys.readouterr().out
    assert cli.main([f"file://{tmp_path}/st", "search", "sort", "--index-type", "none"]) == 1


def test_dates_are_checked():
    for bad in ("2024-13-01", "tomorrow", "2024-1-5", "2024-02-30"):
        with pytest.raises(ValueError, match="invalid date"):
            FL.search_filters(after=bad)


def test_json_document(spark):
    page = catalogue.results(spark, "/root/testdata/sf0.001")
    items = json.loads(L.json_document(page).first().json)["items"]
    assert len(items) == 10 and items[0]["variables"]["similarity"] == "1.000"


def test_empty_tables(spark):
    m = catalogue.X.messages(spark, "/root/testdata/sf0.001").limit(0)
    assert C.chunked(m, Chunking()).count() == 0


def test_a_hot_text_is_sent_as_a_row_a_task(spark):
    df = spark.range(5000).selectExpr("'f' AS file_path", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 't' || id END AS text", "1 AS strategy_rank", "id AS ordinal")
    out = C.dedup(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Partial")
    assert {r.ordinal for r in out.collect()} == {i for i in range(5000) if i % 3 or i == 0}
    assert V._sides(spark.range(0), *[spark.createDataFrame([(i, [1.0] * 9) for i in range(50)], "vec_id long, embedding array<double>")]) == 2
    assert V._sides(spark.range(0), spark.range(64).selectExpr("array_repeat(1.0D, 2097152) AS embedding")) == 8


def test_whole_chunks_have_every_row_and_whole_texts(spark, tmp_path):
    for docs, vectors in ((7, 3), (3, 7)):
        folder = f"{tmp_path}/{docs}"
        spark.createDataFrame([(i, f"{i} " + "w " * 500) for i in range(docs)] + [(None, "no id")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, [1.0, float(i)], i) for i in range(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
        rows = catalogue.X.chunks(spark, folder).collect()
        assert len(rows) == 8 and len({r.id for r in rows}) == 8
        assert {r.text for r in rows} == {f"{i} " + "w " * 500 for i in range(docs)} | {"no id", *([None] if docs < vectors else [])}  # with an id missing, one embedding of the 7 has no partner
        assert {r.embedding[1] for r in rows if r.embedding} == set(range(vectors))
        assert sum(r.char_count or 0 for r in rows) == sum(len(r.text or "") for r in rows)
    folder = "/root/testdata/sf0.001"
    texts = sorted(r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert sorted({r.text for r in catalogue.X.chunks(spark, folder).collect()}) == sorted(set(texts))


def test_pieces_of_long_pairs_equal_python(spark):
    folder = "/root/testdata/sf0.01"
    pairs = C.qa_pairs(catalogue.kept(spark, folder)).select("file_path", "line_no", "text").collect()
    want = sorted((r.file_path, r.line_no, i, t) for r in pairs if len(r.text) > 400 for i, t in enumerate(greedy(r.text, 400)))
    assert sorted(map(tuple, catalogue.QUERIES["split_paragraphs"](spark, folder).collect())) == want
    assert any(len(p) > 400 for r in pairs for p in r.text.split("\n\n"))
    rows = catalogue.QUERIES["chunk_pipeline"](spark, folder).collect()
    split = {(r.file_path, t) for r in pairs if len(r.text) > 2000 for t in greedy(r.text, 2000)}
    assert split and sorted((f, len(t)) for f, t in split) == sorted((r.file_path, r.char_count) for r in rows if r.chunk_type == "qa_pair_split")


def test_similarity_blocks_equal_the_matrix(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)] + [(3, [1.0, 0.0, 2.0, 0.0]), (40, None), (41, [0.0] * 4), (42, [1.0, 2.0]), (43, []), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    value = lambda r: (r.a, r.b, None if r.sim is None else round(r.sim, 5) + 0.0)
    got, want = (sorted(map(value, x.collect()), key=str) for x in (V.similarity_blocks(df, block=4), V.similarity_matrix(df)))
    assert got == want and len(got) == 35 * 36 // 2 + 1
    assert V.similarity_blocks(df.limit(0)).count() == 0


def test_similarity_blocks_send_a_vector_once_and_leave_small_files(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    kept = []

    def saved(t):
        kept.append(catalogue.saved_in(spark, f"file://{tmp_path}/t")(t))
        return kept[-1]

    got = V.similarity_blocks(e, block=500, saved=saved)
    assert "CartesianProduct" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan
    (stored,) = kept
    assert stored.selectExpr("sum(size(ids))").first()[0] == 2000 and sum(len(r.m) for r in stored.collect()) == 2000 * 64 * 4
    assert got.selectExpr("count(*)", "count(DISTINCT a, b)", "count_if(a > b)").first()[:] == (2001000, 2001000, 0)
    twice = e.select("vec_id", "embedding").union(e.selectExpr("vec_id + 2000 AS vec_id", "embedding"))
    V.similarity_blocks(twice, block=4000).write.parquet(f"file://{tmp_path}/out")
    # 8 bytes a row and more in the order of ids
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 6 * 4000 * 4001 // 2


def test_similarity_blocks_of_many_small_partitions_are_few(spark):
    kept = []
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").repartition(200)
    V.similarity_blocks(e, block=500, saved=lambda t: kept.append(t) or t)
    assert kept[0].count() <= 8


def test_rows_of_a_pair_of_blocks_equal_plain_cosines_bit_by_bit():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(40, 5)), [[0.0] * 5], [[np.nan, 1, 1, 1, 1]], [[np.inf, 1, 0, 0, 0]], [[1e-9, -1, 0, 0, 0]], [[1, 0, 0, 0, 0]], [[1e-160] * 5]])
    ids, dims = np.r_[np.arange(45), 3], np.r_[np.full(39, 5), -1, np.full(6, 5)]
    for other, itself in ((slice(None), True), (slice(20, None), False)):
        y, yi, yd = x[other], ids[other], dims[other]
        want = []
        with np.errstate(all="ignore"):
            size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
            no = (dims[:, None] != yd[None]) | (dims[:, None] < 0) | (size == 0)
            sim = np.round(x @ y.T / np.where(no, 1, size), 6)
        for i in range(len(x)):
            for j in range(i if itself else 0, len(y)):
                pair = sorted((int(ids[i]), int(yi[j])))
                want += [repr((*pair, None if no[i, j] else float(sim[i, j])))] * (1 + (pair[0] == pair[1] and not (itself and i == j)))
        assert "-0.0" in str(want) and "nan" in str(want)
        for strip, parts, rows in ((512, 8, 1 << 18), (7, 3, 11), (512, 1, 5)):
            got = [r for b in V._by_similarity((ids, dims, x), (yi, yd, y), itself, strip, parts, rows) for r in b.to_pylist()]
            assert sorted(repr((r["a"], r["b"], r["sim"])) for r in got) == sorted(want)
            finite = [r["sim"] for r in got if r["sim"] is not None and np.isfinite(r["sim"])]
            assert finite == sorted(finite)
