"""All near pairs of vectors against loops, and what the bounds of blocks spare."""

import numpy as np
import pytest

from parley.operators import near as N
from parley.operators import vectors as V


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, extra string, cell int").repartition(4)


@pytest.fixture(scope="module")
def bunches():
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in heads[i % 12] + 0.08 * rng.normal(size=8)], "x", 1) for i in range(360)]
    rows += [(1000 + i, rows[0][1], None, None) for i in range(50)]  # a group of copies
    rows += [(None, rows[1][1], None, None), (2000, None, None, None), (2001, [], None, None), (2002, [0.0] * 8, None, None), (2003, [float("nan")] + [1.0] * 7, None, None), (2004, [float("inf")] * 8, None, None)]
    rows += [(2010, [1.0, 2.0], None, None), (2011, [2.0, 4.0], None, None), (2012, [-1.0, 2.0], None, None), (0, rows[5][1], None, None)]
    return rows


def classes(rows):
    out = {}
    for i, v, *_ in rows:
        x = np.array(v if v is not None else [], np.float32).astype(float)
        if i is not None and len(x) and np.isfinite(x).all() and x.any():
            out[tuple(x)] = min(i, out.get(tuple(x), i))
    return [(i, np.array(x)) for x, i in out.items()]


def pairs(rows, t):
    own, out = classes(rows), []
    for k, (i, x) in enumerate(own):
        for j, y in own[k + 1 :]:
            if i != j and len(x) == len(y):
                sim = round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6)
                if sim >= t:
                    out.append((min(i, j), max(i, j), sim))
    return sorted(out)


@pytest.mark.parametrize("t", [0.995, 0.9, 0.0])
def test_near_pairs_equal_loops(spark, bunches, t):
    got = sorted(map(tuple, N.near_pairs(table(spark, bunches), t, block=16).collect()))
    want = pairs(bunches, t)
    assert len(got) == len(want) > 0 and [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1.5e-6)


def test_bounds_spare_most_products(spark, bunches):
    one = N.pruning(table(spark, bunches), 0.98, block=16, cells=12).first()
    assert 0 < one.multiplied < one.block_pairs / 2
    blocks = N.pruning(table(spark, bunches), -1.0, block=16, cells=12).first()
    assert blocks.block_pairs == one.block_pairs and blocks.multiplied >= one.block_pairs - 60  # lengths differ in the rest


def test_copies_and_empty_tables(spark, bunches):
    got = dict(map(tuple, N.copies(table(spark, bunches)).where("id >= 1000 AND id < 2000").collect()))
    assert len(got) == 50 and set(got.values()) == {0}
    none = table(spark, bunches).limit(0)
    assert N.near_pairs(none, 0.5).count() == 0 and N.copies(none).count() == 0 and N.pruning(none, 0.5).first().block_pairs == 0


def test_nearest_by_single_precision_first_equal_plain_products():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 9))
    v[100:300] = v[7]  # more copies than anyone needs
    v[300:400] = v[8] + rng.normal(size=(100, 9)) * 1e-7  # alike but for digits that single precision lacks
    v[400], v[401], v[402], v[403] = 0, np.nan, v[5] * 1e-200, np.r_[np.inf, v[0, 1:]]
    ids = rng.permutation(700)
    ids[500:520] = ids[520]
    with np.errstate(all="ignore"):
        sim = np.round(v @ v.T / np.maximum(np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None], 1e-300), 6)
    want = {}
    for q in [*range(0, 700, 9), 7, 8, 100, 300, 400, 401, 402, 403, 505]:
        row = sorted((-s, i) for s, i in zip(sim[q], ids, strict=True) if np.isfinite(s) and i != ids[q])[:5]
        want[q] = [(int(i), -s + 0.0) for s, i in row]
    for wide in (64, 4096):
        for q, expected in want.items():
            got = V._nearest_of([(ids[q : q + 1], np.array([9]), v[q : q + 1])], ids, v, 5, wide).to_pylist()
            assert [r["id"] for r in got] == [i for i, _ in expected] and np.allclose([r["sim"] for r in got], [s for _, s in expected], atol=1.5e-6)


def test_a_cell_of_the_grid_is_bounded_and_few_queries_are_sent_to_the_vectors(spark):
    large = spark.range(200_000).selectExpr("id AS vec_id", "array(1f) AS embedding")
    few = large.limit(50)
    assert V._oblong(few, large) == (1, 8)  # not a square, whose other rows would get vectors and no query
    assert V._oblong(large, large, rows=20_000) == (10, 10) and V._sides(large, large, rows=20_000) == 10
    blocks = V._blocks(large.repartition(4), "vec_id", 512)
    spread = blocks.groupBy((blocks.own % 10).alias("i")).count().collect()
    assert len(spread) == 10 and max(r["count"] for r in spread) <= 1.3 * min(r["count"] for r in spread)


def test_cells_are_fitted_on_a_sample_that_no_task_orders(spark, tmp_path, monkeypatch):
    fitted = []

    class Seen(V.KMeans):
        def fit(self, some):
            fitted.append((some.count(), some._jdf.queryExecution().optimizedPlan().toString()))
            return super().fit(some)

    monkeypatch.setattr(V, "KMeans", Seen)
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = V.CellIndex.build(e, f"file://{tmp_path}/c", cells=4, sample=500, asked=20)
    (n, plan), = fitted
    assert 400 <= n <= 600 and "Limit" not in plan and "Sort" not in plan
    assert spark.read.parquet(f"{index.folder}/rows").count() == 2000
