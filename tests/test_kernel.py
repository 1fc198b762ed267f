import numpy as np
import pytest

from heristat import models
from heristat.plans import kernel as K


def snps(spark, d, blocks, bins, parts=3):
    rows = [(min(m // max(1, d.shape[1] // blocks), blocks - 1), m, [None if x < 0 else int(x) for x in d[:, m]], bins(m)) for m in range(d.shape[1])]
    return spark.createDataFrame(rows, K.ROW).repartition(parts)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    d = rng.binomial(2, rng.uniform(0.2, 0.8, 30), size=(60, 30))
    return d, rng.normal(size=60), rng.normal(size=(60, 2)), rng.normal(size=60)


def dense(d, y, z, sets, drop):
    """Normal equations from whole matrices."""
    mu = d.mean(axis=0)
    x = (d - mu) / np.sqrt(mu * (1 - mu / 2))
    y = y - y.mean()
    kin = [x[:, k] @ x[:, k].T / len(k) for k in ([m for m in s if m not in drop] for s in sets)]
    t = np.array([[np.sum((a @ z) * (b @ z)) / z.shape[1] for b in kin] + [len(y)] for a in kin] + [[len(y)] * (len(kin) + 1)])
    return t, np.array([y @ a @ y for a in kin] + [y @ y])


def test_against_dense_matrices(spark, data):
    d, y, _, _ = data
    study = K.Study(y, K.components("rhe", 2), 4, 6)
    t, q, m = K.run(spark, snps(spark, d, 4, lambda m: [m % 2]), study)
    sets = [list(range(0, 30, 2)), list(range(1, 30, 2))]
    for j in range(5):
        drop = set() if j == 4 else set(range(j * 7, 30 if j == 3 else (j + 1) * 7))
        want_t, want_q = dense(d, y, study.z, sets, drop)
        assert np.allclose(t[j], want_t) and np.allclose(q[j, :, 0], want_q)
        assert m[j].tolist() == [len([x for x in s if x not in drop]) for s in sets]


def test_partitions_dont_matter(spark, data):
    d, y, c, e = data
    runs = [K.run(spark, snps(spark, d, 3, lambda m: [0], p), K.Study(y, K.components("G+GxE+NxE", 1, 1), 3, 4, covariates=c, env=e))[0] for p in (1, 5)]
    assert np.allclose(*runs)


def test_split_blocks(spark, data):
    """Blocks dealt to several tasks and individuals to segments give the same equations."""
    d, y, c, e = data
    rows = snps(spark, d, 3, lambda m: [m % 2])
    for cov in (None, c):
        one, several = (K.Study(np.stack([y, e], axis=1), K.components("G+GxE+NxE", 2, 1), 3, 4, covariates=cov, env=e, segment=s) for s in (100, 17))
        for a, b in zip(K.run(spark, rows, one, splits=1), K.run(spark, rows, several, splits=3)):
            assert np.allclose(a, b)


def test_covariates_project_exactly(spark, data):
    """With covariates, T is that of the projected kinship: tr(VKV VKV), up to the random vectors."""
    d, y, c, _ = data
    z = np.eye(60) * 60**0.5  # makes the stochastic traces exact up to their scale
    study = K.Study(y, K.components("rhe", 1), 1, covariates=c, z=z)
    t, q, _ = K.run(spark, snps(spark, d, 1, lambda m: [0]), study)
    mu = d.mean(axis=0)
    x = (d - mu) / np.sqrt(mu * (1 - mu / 2))
    v = np.eye(60) - c @ np.linalg.pinv(c)
    k = v @ (x @ x.T / 30) @ v
    yc = v @ (y - y.mean())
    assert t[-1, 0, 0] == pytest.approx(np.trace(k @ k)) and q[-1, 0, 0] == pytest.approx(yc @ (x @ x.T / 30) @ yc) and t[-1, 1, 1] == 58


def whole(d, y, parts, sets, e, c, z, drop):
    """Normal equations of any components from whole matrices, left sides by the random vectors z."""
    n = len(y)
    mu = d.mean(axis=0)
    x = (d - mu) / np.sqrt(mu * (1 - mu / 2))
    dom = np.where(d == 0, 0, np.where(d == 1, mu, 2 * mu - 2))
    dom = (dom - dom.mean(axis=0)) / (mu * (1 - mu / 2))
    u = c @ np.linalg.pinv(c) if c is not None else np.zeros((n, n))
    y = y - y.mean()
    y = y - u @ y
    kin = []
    for p in parts:
        keep = [m for m in sets[p.bin] if m not in drop]
        full = {"g": x, "d": dom, "gxe": x * e[:, None]}.get(p.kind)
        kin.append(np.diag(e**2) if full is None else full[:, keep] @ full[:, keep].T / len(keep))
    b = z.shape[1]
    t = np.zeros((len(kin) + 1,) * 2)
    for k, a in enumerate(kin):
        for i, o in enumerate(kin):
            t[k, i] = (np.sum((a @ z) * (o @ z)) + np.sum((a @ u @ z) * (u @ (o @ z))) - 2 * np.sum((a @ z) * (u @ (o @ z)))) / b
        free = n if parts[k].kind in "gd" else np.sum(z * (a @ z)) / b
        t[k, -1] = t[-1, k] = free - np.sum((u @ z) * (a @ z)) / b
    t[-1, -1] = n - (c.shape[1] if c is not None else 0)
    return t, np.array([y @ a @ y for a in kin] + [y @ y])


@pytest.mark.parametrize("model", ["rhe", "rhe_dom", "G", "G+GxE", "G+GxE+NxE"])
@pytest.mark.parametrize("cov", [False, True])
def test_models_against_dense_matrices(spark, data, model, cov):
    d, y, c, e = data
    study = K.Study(y, K.components(model, 2, 1), 3, 5, covariates=c if cov else None, env=e)
    t, q, m = K.run(spark, snps(spark, d, 3, lambda m: [m % 2]), study)
    sets = [list(range(0, 30, 2)), list(range(1, 30, 2))]
    for j in range(4):
        drop = set() if j == 3 else set(range(j * 10, (j + 1) * 10))
        want_t, want_q = whole(d, y, study.parts, sets, e, c if cov else None, study.z, drop)
        assert np.allclose(t[j], want_t) and np.allclose(q[j, :, 0], want_q)


def test_kinds_of_ones_own(spark, data, monkeypatch):
    """A component of a new kind needs an entry only: squares of standardized counts."""
    d, y, _, _ = data
    monkeypatch.setitem(K.KINDS, "sq", K.Kind(lambda chunk, study, p: chunk.x**2, estimated=True))
    study = K.Study(y, [K.Component("g", 0), K.Component("sq", 0)], 1, 4)
    t, q, _ = K.run(spark, snps(spark, d, 1, lambda m: [0]), study)
    mu = d.mean(axis=0)
    x = (d - mu) / np.sqrt(mu * (1 - mu / 2))
    a, b = x @ x.T / 30, x**2 @ (x**2).T / 30
    z, yc = study.z, y - y.mean()
    assert t[-1, 0, 1] == pytest.approx(np.sum((a @ z) * (b @ z)) / 4) and t[-1, 1, 2] == pytest.approx(np.sum(z * (b @ z)) / 4)
    assert q[-1, 1, 0] == pytest.approx(yc @ b @ yc)


def test_xtxz(spark, data, tmp_path, monkeypatch):
    d = data[0]
    z = np.array([[K.gaussian_value(4, m, b) for b in range(3)] for m in range(30)])
    block = np.minimum(np.arange(30) // 7, 3)
    for numbers in (1, 60 * 3 * 2, 1 << 20):  # samples one by one, by two, all at once
        monkeypatch.setattr(K, "GROUP_NUMBERS", numbers)
        groups = lambda n=numbers: K.xtxz(spark, snps(spark, d, 4, lambda m: [0]), 60, 4, 3, 4, str(tmp_path / f"w{n}"))
        trace = {r.j: r.trace for r in K.xtxz_traces(groups(), 3).collect()}
        K.write_xtxz(groups(), str(tmp_path / f"u{numbers}"))
        kept = spark.read.parquet(str(tmp_path / f"u{numbers}")).collect()
        for j in range(5):
            own = block != j
            u = d[:, own].T @ (d[:, own] @ z[own])
            got = {r.m: r.u for r in kept if r.j == j}
            assert sorted(got) == np.nonzero(own)[0].tolist() and np.allclose([got[m] for m in sorted(got)], u)
            assert trace[j] == pytest.approx((u**2).sum() / (3 * own.sum() ** 2))


def test_missing_and_monomorphic(spark):
    d = np.array([[0, 2, -1], [1, 2, 2], [2, 2, 0], [1, 2, 1]])
    for how in ("binary", "mean", "zero"):
        t, q, _ = K.run(spark, snps(spark, d, 1, lambda m: [0]), K.Study(np.arange(4.0), K.components("rhe", 1), 1, 2, impute=how))
        assert np.isfinite(t).all() and np.isfinite(q).all()


def test_components():
    assert [p.name for p in K.components("G+GxE+NxE", 2, 1)] == ["g:0", "g:1", "gxe:0", "gxe:1", "nxe:0"]
    with pytest.raises(ValueError):
        K.components("other", 1)


def test_solvers_agree():
    t, q = np.array([[3.0, 1], [1, 2]]), np.array([[1.0], [2]])
    assert np.allclose(K.solve(t, q, "qr"), K.solve(t, q, "lstsq"))
    assert np.isfinite(K.solve(np.ones((2, 2)), q)).all()


def test_model_identities(spark, data, tmp_path):
    d, y, _, _ = data
    s = spark.createDataFrame([(m, [int(x) for x in d[:, m]]) for m in range(30)], "m long, dosage array<int>")
    pheno = spark.createDataFrame([(i, float(v), float(v) if i else None) for i, v in enumerate(y)], "i long, a double, b double")
    annot = spark.createDataFrame([(m, m % 2) for m in range(30)], "m long, bin long")
    got = models.fit(spark, models.Inputs(s, 30, pheno, annot), models.Settings(num_block=5, num_vec=4, samp_prev=0.3, pop_prev=0.1))
    h2 = got.h2.toPandas().set_index(["trait", "k"]).estimate
    assert h2[0, "total"] == pytest.approx(h2[0, "g:0"] + h2[0, "g:1"])
    over = got.overlapping.toPandas().set_index(["trait", "k"]).estimate  # equal to the plain form as bins are disjoint
    assert over[1, "0"] == pytest.approx(h2[1, "g:0"])
    assert got.liability == []  # neither trait is binary
    one = models.fit(spark, models.Inputs(s, 30, pheno.select("i", "a"), annot.withColumn("bin", annot.bin * 0)), models.Settings(num_block=5, num_vec=4))
    assert one.enrichment.toPandas().estimate.tolist() == pytest.approx([1.0])
    for model in ("rhe_dom", "genie"):
        env = spark.createDataFrame([(i, float(i % 5) - 2) for i in range(60)], "i long, env double")
        r = models.fit(spark, models.Inputs(s, 30, pheno.select("i", "a"), annot, env=env), models.Settings(model=model, num_block=5, num_vec=4))
        assert r.h2.count() and r.enrichment.count()
