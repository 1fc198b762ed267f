import numpy as np
import pytest
from pyspark.sql import functions as F

from heristat.llm import ann


def slow(rows, queries, top):
    out = []
    for q, x in rows:
        if q in queries:
            x = np.array(x, float)
            best = sorted((-(x * np.array(y, float)).sum() / (np.sqrt((x * x).sum()) * np.sqrt((np.array(y, float) ** 2).sum())), v) for v, y in rows if v != q and len(y) == len(x))[:top]
            out += [(q, k + 1, v, -s) for k, (s, v) in enumerate(best)]
    return sorted(out)


def test_few_vectors_are_searched_whole(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=6).round(2).tolist()) for i in range(0, 9)] + [(50, [1.0] * 6), (51, [2.0] * 6), (52, [3.0] * 6), (100, [1.0, 2.0])]
    bad = [(200, None), (201, []), (202, [0.0] * 6), (203, [nan] * 6), (204, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (205, [inf] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS cell", "3 AS v", "4 AS rank")
    got = sorted(map(tuple, ann.query(df).collect()))
    want = slow(good, {0, 50, 100}, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert [g[2] for g in got if g[0] == 50][:2] == [51, 52]  # a tie goes to the smaller id
    assert ann.query(df.filter("false")).count() == 0


def test_recall_and_parts(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.query(df).toPandas()
    vecs = df.toPandas()
    x, ids = np.array(vecs.embedding.tolist(), float), vecs.vec_id.to_numpy()
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hit += len(set(ids[np.argsort(-s)[:5]]) & set(g.vec_id))
    assert hit / len(got) >= 0.9
    parts = ann.neighbours(df, F.col("vec_id") % 50 == 0, part=64 * 100).toPandas()
    assert parts.sort_values(["query_id", "rank"]).to_numpy().tolist() == got.sort_values(["query_id", "rank"]).to_numpy().tolist()  # floors and parts drop nothing


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.01 * rng.normal(size=16)).tolist()) for i in range(9)] + [(i, rng.normal(size=16).tolist()) for i in range(9, 120)]
    want = slow(rows, {0, 50}, 5)
    for copies in (1, 2, 7):
        df = spark.createDataFrame(rows * copies, "vec_id long, embedding array<double>")
        got = sorted(map(tuple, ann.neighbours(df, F.col("vec_id").isin(0), tables=4, probes=4).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want if w[0] == 0]
        got = sorted(map(tuple, ann.neighbours(df, F.col("vec_id").isin(0, 50), tables=1, probes=32, part=11).collect()))  # every cell
        assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_repeated_ids_count_by_their_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 12, rng.normal(size=4).tolist()) for i in range(60)]
    best = {}
    for q, x in rows:
        for v, y in rows:
            if q == 0 and v != q:
                best[v] = max(best.get(v, -9), np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))
    want = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:5]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.neighbours(df, F.col("vec_id") == 0, tables=1, probes=8).collect()))
    assert [g[2] for g in got] == [v for v, _ in want] and [g[3] for g in got] == pytest.approx([s for _, s in want])


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann._hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1))
    near = ann.axes(ann._unit(x), 0, 0, 16)
    assert np.allclose(np.linalg.norm(near[:, :16], axis=1), 1) and np.allclose(near[:, 16:], -near[:, :16])


def test_probes_are_the_nearest_cells():
    x = ann._unit(np.random.default_rng(1).normal(size=(6, 10)))
    shape = [16, 4, 2]
    near = [ann.axes(x, 3, i, m) for i, m in enumerate(shape)]
    every = near[0][:, :, None, None] + near[1][:, None, :, None] + near[2][:, None, None, :]
    first, rest = ann.probe(x, 3, shape, 7)
    for i in range(6):
        order = np.argsort(-every[i].ravel())[:7]
        assert (first[i] * 32 + rest[i]).tolist() == order.tolist()
    a, b = ann.cells(x, 3, shape)
    assert (a == first[:, 0]).all() and (b == rest[:, 0]).all()


def test_sketches_bound_cosines():
    x = ann._unit(np.random.default_rng(2).normal(size=(200, 30)))
    raw, lost = ann.sketch(x)
    y = ann.unsketch([r.tobytes() for r in raw])
    assert (np.linalg.norm(x - y, axis=1) <= lost).all() and lost.max() < 1e-3
    assert (np.abs(x @ x.T - y @ y.T) <= lost[:, None] + lost * (1 + lost[:, None])).all()


def test_distinct_ids_reach():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k = rng.integers(1, 30), int(rng.integers(1, 7))
        score, ids = rng.integers(0, 9, n).astype(float), [sorted(rng.integers(0, 12, rng.integers(1, 4)).tolist()) for _ in range(n)]
        want = max((s for s in score if len(set().union(*(i for x, i in zip(score, ids) if x >= s))) >= k), default=-2.0)
        assert ann.kth_distinct(score, ids, k) == want


def test_any_finite_length_counts(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [3.0, 3.1]), (3, [-1e300, 1e-300]), (4, [5e-324, 0.0]), (5, [0.0, -0.0]), (6, [1e308, 1e308])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 0, top=6).collect()
    assert {r.query_id for r in got} == {0, 1, 2, 3, 4, 6} and all(sorted(x.vec_id for x in got if x.query_id == q) == sorted({0, 1, 2, 3, 4, 6} - {q}) for q in (0, 4))
    best = {(r.query_id, r.vec_id): r.score for r in got}
    assert best[0, 1] == pytest.approx(1) and best[0, 6] == pytest.approx(1) and best[0, 3] == pytest.approx(-(0.5**0.5))


def test_index_compares_few_of_many(spark):
    """Clusters, of which one holds a third of all vectors, copies and near-copies."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(200, 24))
    x = centre[np.where(rng.random(12_000) < 0.33, 0, rng.integers(200, size=12_000))] + 0.5 * rng.normal(size=(12_000, 24))
    x[:3000] = x[0]
    x[3000:5000] = x[1] + 1e-3 * rng.normal(size=(2000, 24))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = ann.neighbours(df, F.col("vec_id") % 100 == 0).toPandas()
    unit = ann._unit(x.astype(float))
    hit, compared = 0, []
    for q, g in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hit += len(set(want) & set(g.vec_id))
        compared.append(g["compared"].iloc[0])
        if q < 3000:
            assert g.sort_values("rank").vec_id.tolist() == [i for i in range(6) if i != q][:5]
    assert len(got) == 600 and hit / 600 >= 0.9 and np.quantile(compared, 0.3) < 0.05 * len(x)  # the rest are of the large cluster
