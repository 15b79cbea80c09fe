"""The neighbour graph against the exact join, reply threads against a walk."""

import numpy as np
import pytest

from parley.operators import vectors as V
from parley.operators.graph import NeighbourGraph
from parley.operators.threads import reply_threads
from parley.plans.catalogue import saved_in


def test_graph_recall_against_the_exact_join(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    built = NeighbourGraph.build(e, f"file://{tmp_path}/g")
    graph = NeighbourGraph(spark, f"file://{tmp_path}/g")
    assert graph.about == built.about and graph.about["nodes"] == graph.nodes().count() == 2000
    assert graph.nodes().selectExpr("max(size(near))").first()[0] <= 32 and graph.nodes().where("array_contains(near, node)").count() == 0
    queries = e.where("vec_id % 20 = 3")
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact, found = pairs(V.knn_join(queries, e, 10)), graph.search_all(queries, 10).collect()
    assert len(exact) == len(found) == 1000 and len(exact & {(r.query_id, r.id) for r in found}) >= 920
    near = {(r.query_id, r["rank"]): r.sim for r in found}
    assert all(near[q, r] >= near[q, r + 1] for q, r in near if (q, r + 1) in near)


def test_graph_of_clusters_hubs_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centers[i % 5] + rng.normal(size=6) * 0.05]) for i in range(300)]
    rows += [(400 + i, rows[2][1]) for i in range(60)]  # copies: one of them is near to all
    rows += [(500, None), (None, [1.0] * 6), (501, [0.0] * 6), (3, [9.0] * 6), (502, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    graph = NeighbourGraph.build(df, f"file://{tmp_path}/g", degree=8, parts=4)
    assert graph.about["nodes"] == 362
    queries = df.where("vec_id IN (0, 1, 7, 404, 500)")
    got = graph.search_all(queries, 5, beam=80).collect()
    exact = {(r.query_id, r["rank"]): r.sim for r in V.knn_join(queries, df.where("vec_id <> 3"), 5).collect()}
    assert sorted({r.query_id for r in got}) == [0, 1, 7, 404] and len(got) == 20
    assert sum(abs(r.sim - exact[r.query_id, r["rank"]]) < 1e-3 for r in got) >= 18


def test_graph_of_few_and_none(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<float>")
    graph = NeighbourGraph.build(df, f"file://{tmp_path}/few")
    assert [r.id for r in graph.search_all(df.where("vec_id = 0"), 10).orderBy("rank").collect()] == [1, 2, 3]
    none = NeighbourGraph.build(df.limit(0), f"file://{tmp_path}/none")
    assert none.about["nodes"] == 0 and none.search_all(df, 3).count() == 0


@pytest.mark.parametrize("nearest", [1000, 4])
def test_threads_equal_a_walk(spark, tmp_path, nearest):
    rng = np.random.default_rng(9)
    rows = [("deep", f"d{i}", f"d{i - 1}" if i else None, i) for i in range(150)]
    rows += [("tree", f"t{i}", f"t{rng.integers(0, i)}" if i % 9 else None, i) for i in range(120)]
    rows += [("odd", "a", "c", 0), ("odd", "b", "a", 1), ("odd", "c", "b", 2), ("odd", "under", "a", 3), ("odd", "self", "self", 4), ("odd", "lost", "none", 5)]
    rows += [("odd", "twice", None, 7), ("odd", "twice", "lost", 6), ("odd", "child", "twice", 8), ("odd", None, "child", 9), ("odd", None, None, 10), (None, "n1", None, 0), (None, "n2", "n1", 1), ("odd", "other scope", "n1", 11)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_path string, uuid string, parent_uuid string, line_no int, root string").drop("root").repartition(3)
    got = reply_threads(df, saved_in(spark, f"file://{tmp_path}/t"), nearest=nearest).collect()
    first = {}
    for s, u, p, n in sorted(rows, key=lambda r: r[3]):
        if u is not None:
            first.setdefault((s, u), p)

    def walk(s, u, p):
        path, seen = [u], set()
        while p is not None and (s, p) in first:
            if p in seen:
                return None, None, None, False, True
            seen.add(p)
            path.append(p)
            p = first[s, p]
        top = path[-1]
        return top, len(path) - 1, path[:nearest][::-1], len(path) == 1 and p is not None, False

    want = [(s, u, p, n, *walk(s, u, p)) for s, u, p, n in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert reply_threads(df.limit(0), saved_in(spark, f"file://{tmp_path}/e")).count() == 0


def test_threads_send_no_table_through_the_driver_and_end_by_scope(spark, tmp_path):
    # in each scope a thread of four and a cycle of two, whose pointers never end
    parents = {"a": None, "b": "a", "c": "b", "d": "c", "x": "y", "y": "x"}
    rows = [(s, u, p, n) for s in range(40) for n, (u, p) in enumerate(parents.items())]
    df = spark.createDataFrame(rows, "file_path int, uuid string, parent_uuid string, line_no int")
    saved, plans = saved_in(spark, f"file://{tmp_path}/t"), []

    def seen(t):
        plans.append(t._jdf.queryExecution().executedPlan().toString())
        return saved(t)

    got = reply_threads(df, seen)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans)
    assert len(plans) == 6  # known, first ways, rounds up to a scope's six messages, result
    assert sorted({(r.uuid, r.root, r.depth, r.cyclic) for r in got.collect()}, key=str) == [("a", "a", 0, False), ("b", "a", 1, False), ("c", "a", 2, False), ("d", "a", 3, False), ("x", None, None, True), ("y", None, None, True)]


def test_threads_deeper_than_a_way_have_whole_paths(spark, tmp_path):
    df = spark.range(1200).selectExpr("'f' AS file_path", "CAST(id AS INT) AS line_no", "'m' || id AS uuid", "CASE WHEN id > 0 THEN 'm' || (id - 1) END AS parent_uuid")
    got = {r.line_no: r for r in reply_threads(df, saved_in(spark, f"file://{tmp_path}/t")).collect()}
    assert len(got) == 1200 and all(got[n].depth == n and got[n].path == [f"m{i}" for i in range(n + 1)] for n in range(1200))


def test_paths_joined_of_short_ways_equal_the_plain_ones(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(s, f"d{i}", f"d{i - 1 - int(rng.integers(0, min(i, 3)))}" if i else None, i) for s in ("a", None) for i in range(100)]
    rows += [("a", "d40", "gone", 200), ("a", "after", "d99", 201), ("a", None, "d98", 202), ("a", "x", "y", 203), ("a", "y", "x", 204), ("a", "under", "x", 205), ("a", None, None, 206), ("b", "lost", "d1", 207)]
    df = spark.createDataFrame(rows, "file_path string, uuid string, parent_uuid string, line_no int").repartition(3)
    found = lambda **k: sorted(map(str, reply_threads(df, saved_in(spark, f"file://{tmp_path}/t"), **k).collect()))
    plain = found()
    assert found(hop=4) == plain  # stops of stops, too
    assert found(hop=4, nearest=9) == found(nearest=9) and found(hop=4, nearest=3) == found(nearest=3)
