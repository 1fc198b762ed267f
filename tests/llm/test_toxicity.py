import numpy as np

from heristat.llm import toxicity as T


def test_edges(spark, documents, no_documents):
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (None, 1, 1), (4, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = T.query(documents, labels).collect()
    assert len(got) == documents.count() and T.query(no_documents, labels).count() == 0
    assert T.query(documents, labels.filter("false")).filter("toxic = 1").count() == 0
    assert T.reject(documents, labels).columns == documents.columns and T.reject(no_documents, labels).count() == 0


def loss(x, y, w, cuts):
    """Mean negative log-likelihood, straight from the model's definition."""
    total = 0.0
    for row, g in zip(x, y):
        at_least = [1.0, *(1 / (1 + np.exp(-(row @ w - b))) for b in cuts), 0.0]
        total -= np.log(at_least[g] - at_least[g + 1])
    return total / len(y)


def test_solution_is_the_optimum(monkeypatch):
    """Against numeric slopes of an independent likelihood: 0 for cuts, -l1 sign(w) for weights, within l1 where w is 0."""
    monkeypatch.setattr(T, "TOLERANCE", 1e-9)
    rng = np.random.default_rng(1)
    x = np.where(rng.random((150, 8)) < 0.4, rng.random((150, 8)) * 2, 0)
    y = np.digitize(x @ np.array([2.0, -1.5, 1, 0, 0, 0, 0, 0]) + rng.logistic(size=150), [0.5, 2.0])
    row, col = np.nonzero(x)
    l1, e = 5e-3, 1e-5
    w, cuts = T.solve(row, col, x[row, col], y, 8, l1, 20_000)
    for j in range(8):
        step = np.eye(8)[j] * e
        slope = (loss(x, y, w + step, cuts) - loss(x, y, w - step, cuts)) / (2 * e)
        assert abs(slope + l1 * np.sign(w[j])) < 1e-5 if w[j] else abs(slope) <= l1 + 1e-6
    for k in range(2):
        step = np.eye(2)[k] * e
        assert abs(loss(x, y, w, cuts + step) - loss(x, y, w, cuts - step)) / (2 * e) < 1e-5
    assert w[0] > 0.5 and w[1] < -0.3 and cuts[0] < cuts[1]


def test_severity_is_the_expected_grade(spark):
    model = T.OrdinalModel({b"foul": 2.0, b"^vile": 1.0}, np.array([1.0, 3.0]))
    rows = [(1, "foul foul"), (2, "Vileness"), (3, "clean"), (4, None), (5, "foul-vileness " * 3)]
    got = {r.doc_id: r for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, s in ((1, 2 * np.log(3)), (2, np.log(2)), (3, 0.0), (4, 0.0), (5, 3 * np.log(4))):
        p = [1 / (1 + np.exp(-(s - b))) for b in (1.0, 3.0)]
        assert abs(got[d].severity - sum(p)) < 1e-12 and abs(got[d].p_toxic - p[0]) < 1e-12
        assert got[d].toxic == (p[0] >= T.THRESHOLD) and got[d].grade == (0 if p[0] < T.THRESHOLD else 1 if p[0] - p[1] >= p[1] else 2)


def test_sampled_rows(spark):
    """One row an id whatever the documents repeat; grades come from the labels alone."""
    docs = spark.createDataFrame([(1, "foul day")] * 50 + [(1, f"text {i}") for i in range(50)] + [(2, "fine day"), (3, None), (4, "bad bad"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1), (4, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.sampled(docs, labels, 100).collect()}
    assert {d: r.grade for d, r in got.items()} == {1: 1, 2: 0, 4: 2}
    assert {bytes(f.w): f.n for f in got[4].found} == {b"bad": 2}
    few = T.sampled(docs, labels, 1).collect()
    assert len(few) == 1
    assert T.train(docs.filter("false"), labels).weights == {} and T.train(docs, labels.drop("quality"), min_docs=1, max_share=1.0).cuts.shape == (1,)


def test_both_ways_to_fit_agree(spark, real):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = T.train(real, labels, most=10**6)  # no ties at the end of the vocabulary
    held = real.join(labels, "doc_id").orderBy("doc_id").collect()
    other = T.fit([r.text.encode() for r in held], [0 if not r.toxic else 1 if r.quality else 2 for r in held], most=10**6)
    p, q = (np.array([m.at_least(r.text.encode()) for r in held]) for m in (model, other))
    assert np.allclose(model.cuts, other.cuts, atol=0.05) and np.abs(p - q).max() < 0.02


def test_dotted_names(spark, documents):
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    df = documents.withColumn("a.b", T.F.lit(1)).withColumn("a_b", T.F.lit(2)).withColumn("c`d", T.F.lit(2))
    got = T.reject(df, labels)
    assert got.columns == df.columns and got.count() == T.reject(documents, labels).count()


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = T.train(docs, labels, 2500)
    seen = {r.doc_id for r in labels.orderBy(T.F.xxhash64("doc_id"), "doc_id").limit(2500).collect()}
    got = T.score(docs, model).join(labels.select("doc_id", T.F.col("toxic").alias("label")), "doc_id").toPandas()
    got = got[~got.doc_id.isin(seen)]
    assert got[got.label == 1].toxic.mean() > 0.85 and got[got.label == 0].toxic.mean() < 0.005
    assert ((got.severity >= 0) & (got.severity <= 2)).all()
    kept = {r.doc_id for r in T.reject(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in T.query(docs, labels).filter("toxic = 0").collect()}


def test_order_and_shared_weights():
    rng = np.random.default_rng(0)
    bad = [b"foul", b"vile", b"nasty"]
    texts, grades = [], []
    for _ in range(600):
        n = int(rng.integers(0, 9))
        texts.append(b" ".join([*(b"w%c" % (97 + rng.integers(20)) for _ in range(20)), *(bad[i % 3] for i in range(n))]))
        grades.append(0 if n < 1 else 1 if n < 5 else 2)
    model = T.fit(texts[:400], grades[:400], max_share=1.0)
    p = np.array([model.at_least(t) for t in texts[400:]])
    assert (np.diff(p, axis=1) <= 0).all() and (np.diff(model.cuts) >= 0).all()
    severity = p.sum(axis=1)
    means = [severity[[g == k for g in grades[400:]]].mean() for k in range(3)]
    assert means[0] < 0.3 < means[1] < means[2] and means[2] > 1.3


def test_one_grade_only():
    assert T.fit([b"a"], [0]).at_least(b"a")[0] < 1e-9 and T.fit([b"a"], [2]).at_least(b"")[1] > 0.999 and T.fit([], []).at_least(b"")[0] < 1e-9
