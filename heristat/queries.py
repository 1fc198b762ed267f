"""One query for each operator, each with SQL that gives the same rows from the same tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from heristat import fixtures as X, model_sql
from heristat.functions.scalar import liability
from heristat.operators import genotype as G, layout as L, tables as T
from heristat.plans import kernel as K, moments as M, results as R
from heristat.sources import bed, files

FOUND: dict[str, tuple] = {}
B, J = X.VECTORS, 10


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def r6(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


# --- SQL fragments of the oracles ---------------------------------------------------------------------------------------


def gauss(seed: int, key: str) -> str:
    u = "(('0x' || substr(md5({k}), {o}, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"
    k = f"'{seed}:' || {key}"
    return f"(sqrt(-2 * ln({u.format(k=k, o=1)})) * cos(2 * pi() * {u.format(k=k, o=9)}))"


PARTS = {
    "geno": "SELECT i, m, (v > -0.08::DOUBLE)::INT + (v > 0.08::DOUBLE)::INT AS d FROM (SELECT vec_id AS i, unnest(range(len(embedding))) AS m, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "raw": "SELECT i, m, CASE WHEN (i * 31 + m * 17) % 23 <> 0 THEN d END AS d FROM geno",
    "mu": "SELECT m, avg(d) AS mu FROM geno GROUP BY m",
    "x": "SELECT i, m, (d - mu) / sqrt(mu * (1 - mu / 2)) AS x FROM geno JOIN mu USING (m) WHERE mu > 0 AND mu < 2",
    "ids": "SELECT vec_id AS i, label FROM embeddings",
    "z": f"SELECT i, b, {gauss(X.SEED, 'i || chr(58) || b')} AS z FROM ids, range({B}) r(b)",
    "y": "SELECT i, label::DOUBLE AS y FROM ids",
    "env": "SELECT i, (i % 10) / 10.0::DOUBLE - 0.45::DOUBLE AS e FROM ids",
    "cov": f"SELECT i, (i % 2)::DOUBLE AS c0, ((i % 7) - 3)::DOUBLE AS c1, {gauss(7, 'i')} AS c2 FROM ids",
    "one": f"SELECT range AS m, 0::BIGINT AS bin FROM range({X.SNPS})",
    "two": f"SELECT range AS m, range % 2 AS bin FROM range({X.SNPS})",
    "three": f"SELECT range AS m, 0::BIGINT AS bin FROM range({X.SNPS}) UNION ALL SELECT range, 1 FROM range({X.SNPS}) WHERE range % 2 = 0 UNION ALL SELECT range, 2 FROM range({X.SNPS}) WHERE range < 16",
    "blk": f"SELECT range AS m, least(range // ({X.SNPS} // {J}), {J - 1}) AS j FROM range({X.SNPS})",
    "sim": f"SELECT i, s + {gauss(13, 'i')} * sqrt(0.4::DOUBLE) AS y FROM (SELECT i, sum(x * {gauss(11, 'm')} * sqrt((CASE WHEN bin = 0 THEN 0.5 ELSE 0.1 END)::DOUBLE / 32)) AS s FROM x JOIN two USING (m) GROUP BY i)",
    # block sums, their totals and leave-one-out forms for two bins and ten blocks (j = J keeps all)
    "xb": "SELECT i, m, bin, j, x FROM x JOIN two USING (m) JOIN blk USING (m)",
    "w": "SELECT m, b, sum(x * z) AS w FROM x JOIN z USING (i) GROUP BY m, b",
    "vb": "SELECT j, bin, i, b, sum(x * w) AS v FROM xb JOIN w USING (m) GROUP BY ALL",
    "vt": "SELECT bin, i, b, sum(v) AS v FROM vb GROUP BY ALL",
    "vl": f"SELECT jj AS j, vt.bin AS bin, vt.i AS i, vt.b AS b, vt.v - coalesce(vb.v, 0) AS v FROM vt CROSS JOIN range({J + 1}) r(jj) LEFT JOIN vb ON vb.j = jj AND vb.bin = vt.bin AND vb.i = vt.i AND vb.b = vt.b",
    "nl": f"SELECT jj AS j, two.bin, sum((blk.j <> jj)::INT)::BIGINT AS n FROM two JOIN blk USING (m) CROSS JOIN range({J + 1}) r(jj) GROUP BY ALL",
    "yc": "SELECT i, y - (SELECT avg(y) FROM sim) AS y FROM sim",
    "sl": f"SELECT jj AS j, bin, sum(s) AS s FROM (SELECT m, bin, j AS own, pow(sum(x * y), 2) AS s FROM xb JOIN yc USING (i) GROUP BY ALL) CROSS JOIN range({J + 1}) r(jj) WHERE own <> jj GROUP BY ALL",
    "t": f"SELECT a.j, a.bin AS k, c.bin AS l, sum(a.v * c.v) / ({B} * any_value(p.n) * any_value(q.n)) AS t FROM vl a JOIN vl c ON a.j = c.j AND a.i = c.i AND a.b = c.b JOIN nl p ON p.j = a.j AND p.bin = a.bin JOIN nl q ON q.j = c.j AND q.bin = c.bin GROUP BY a.j, a.bin, c.bin",
    "sys": "SELECT j, (SELECT count(*)::DOUBLE FROM ids) AS n, (SELECT sum(y * y) FROM yc) AS qe, max(t) FILTER (k = 0 AND l = 0) AS t00, max(t) FILTER (k = 0 AND l = 1) AS t01, max(t) FILTER (k = 1 AND l = 1) AS t11 FROM t GROUP BY j",
    "rhs": "SELECT j, max(s / n) FILTER (bin = 0) AS q0, max(s / n) FILTER (bin = 1) AS q1 FROM sl JOIN nl USING (j, bin) GROUP BY j",
    "cr": "SELECT j, n, qe, ((q0 - qe) * (t11 - n) - (q1 - qe) * (t01 - n)) / ((t00 - n) * (t11 - n) - (t01 - n) * (t01 - n)) AS s0, ((t00 - n) * (q1 - qe) - (t01 - n) * (q0 - qe)) / ((t00 - n) * (t11 - n) - (t01 - n) * (t01 - n)) AS s1 FROM sys JOIN rhs USING (j)",
    "sg": "SELECT j, 'g:0' AS k, s0 AS value FROM cr UNION ALL SELECT j, 'g:1', s1 FROM cr UNION ALL SELECT j, 'e', qe / n - s0 - s1 FROM cr",
    "sh": "SELECT j, k, value / sum(value) OVER (PARTITION BY j) AS value FROM sg",
    "h2": "SELECT j, k, value FROM sh WHERE k <> 'e' UNION ALL SELECT j, 'total', sum(value) FROM sh WHERE k <> 'e' GROUP BY j",
}
_NEEDS = {
    "raw": ["geno"], "mu": ["geno"], "x": ["geno", "mu"], "z": ["ids"], "y": ["ids"], "env": ["ids"], "cov": ["ids"], "sim": ["x", "two"], "xb": ["x", "two", "blk"], "w": ["x", "z"], "vb": ["xb", "w"], "vt": ["vb"], "vl": ["vt", "vb"], "nl": ["two", "blk"],
    "yc": ["sim"], "sl": ["xb", "yc"], "t": ["vl", "nl"], "sys": ["t", "ids", "yc"], "rhs": ["sl", "nl"], "cr": ["sys", "rhs"], "sg": ["cr"], "sh": ["sg"], "h2": ["sh"],
}
ALSO = {"mur": ("SELECT m, avg(d) AS mu FROM raw GROUP BY m", ["raw"])}


def sql(select: str, *parts: str) -> str:
    """select behind the fragments it names and those that they need."""
    order: list[str] = []

    def need(p: str) -> None:
        if p not in order:
            for q in _NEEDS.get(p, []) if p in PARTS else ALSO[p][1]:
                need(q)
            order.append(p)

    for p in parts:
        need(p)
    return "WITH " + ", ".join(f"{p} AS MATERIALIZED ({PARTS.get(p) or ALSO[p][0]})" for p in order) + " " + select


# --- genotypes ----------------------------------------------------------------------------------------------------------


@query(sql("SELECT m, round(mu, 6) AS mu FROM mu", "mu"))
def allele_freq(spark, d):
    return G.allele_means(X.geno(spark, d)).select("m", *r6("mu"))


@query(sql("SELECT i, m, 2 - d AS d FROM raw", "raw"))
def allele_flip(spark, d):
    return X.geno_raw(spark, d).select("i", "m", G.flip(F.col("d")).alias("d"))


_U = "(('0x' || substr(md5('5:' || m), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"


@query(sql(f"SELECT i, m, coalesce(d, CASE WHEN u < (1 - p) * (1 - p) THEN 0 WHEN u < (1 - p) * (1 - p) + 2 * p * (1 - p) THEN 1 ELSE 2 END) AS d FROM raw JOIN (SELECT m, mu / 2 AS p, {_U} AS u FROM mur) USING (m)", "raw", "mur"))
def impute_binary(spark, d):
    return G.impute(X.geno_raw(spark, d), "binary", 5)


@query(sql("SELECT i, m, round(coalesce(d::DOUBLE, mu), 6) AS d FROM raw JOIN mur USING (m)", "raw", "mur"))
def impute_mean(spark, d):
    return G.impute(X.geno_raw(spark, d), "mean").select("i", "m", F.round(F.col("d").cast("double"), 6).alias("d"))


@query(sql("SELECT i, m, coalesce(d, 0) AS d FROM raw", "raw"))
def impute_zero(spark, d):
    return G.impute(X.geno_raw(spark, d), "zero")


@query(sql("SELECT i, m, round(x, 6) AS x FROM x", "x"))
def standardize(spark, d):
    return G.standardize(X.geno(spark, d)).select("i", "m", *r6("x"))


@query(sql("SELECT i, m, round(CASE d WHEN 0 THEN 0 WHEN 1 THEN mu ELSE 2 * mu - 2 END, 6) AS e FROM geno JOIN mu USING (m)", "mu"))
def dom_encode(spark, d):
    g = X.geno(spark, d)
    return g.join(G.allele_means(g), "m").select("i", "m", F.round(G.dominance(F.col("d"), F.col("mu")), 6).alias("e"))


@query(sql("SELECT i, m, round((e - avg(e) OVER (PARTITION BY m)) / (mu * (1 - mu / 2)), 6) AS x FROM (SELECT i, m, mu, CASE d WHEN 0 THEN 0 WHEN 1 THEN mu ELSE 2 * mu - 2 END AS e FROM geno JOIN mu USING (m) WHERE mu > 0 AND mu < 2)", "mu"))
def dom_standardize(spark, d):
    return G.standardize_dominance(X.geno(spark, d)).select("i", "m", *r6("x"))


@query(sql("SELECT i, m, round(x * e, 6) AS x FROM x JOIN env USING (i)", "x", "env"))
def gxe_project(spark, d):
    return G.times_environment(G.standardize(X.geno(spark, d)), X.environment(spark, d)).select("i", "m", *r6("x"))


@query(sql("SELECT i, b, round(e * e * z, 6) AS v FROM z JOIN env USING (i)", "z", "env"))
def nxe_stats(spark, d):
    return M.nxe(M.random_vectors(X.individuals(spark, d), B, X.SEED), X.environment(spark, d)).select("i", "b", *r6("v"))


@query(sql("SELECT i, sum(d)::BIGINT AS alleles FROM geno WHERE i % 37 <> 0 GROUP BY i", "geno"))
def drop_missing(spark, d):
    gone = T.missing_rows(X.pheno(spark, d).withColumn("y", F.expr("CASE WHEN i % 37 = 0 THEN -9D ELSE y END")), ["y"])
    return G.drop_individuals(X.geno(spark, d), gone).groupBy("i").agg(F.sum("d").cast("long").alias("alleles"))


@query(sql("SELECT m, list(d ORDER BY i)::VARCHAR AS dosage FROM geno GROUP BY m", "geno"))
def snp_major(spark, d):
    return G.snp_major(X.geno(spark, d)).select("m", F.concat(F.lit("["), F.array_join("dosage", ", "), F.lit("]")).alias("dosage"))


# --- layout -------------------------------------------------------------------------------------------------------------


@query(sql("SELECT bin, count(*) AS n FROM three GROUP BY bin", "three"))
def annot_bin_sizes(spark, d):
    return L.bin_sizes(X.annot_overlap(spark))


@query(sql("SELECT bin, i, round(sum(x), 6) + 0.0 AS s FROM x JOIN three USING (m) GROUP BY bin, i", "x", "three"))
def partition_bins(spark, d):
    return L.into_bins(G.standardize(X.geno(spark, d)), X.annot_overlap(spark)).groupBy("bin", "i").agg((F.round(F.sum("x"), 6) + 0.0).alias("s"))


@query(sql("SELECT m, j FROM blk", "blk"))
def jackknife_blocks(spark, d):
    return spark.range(X.SNPS).select(F.col("id").alias("m"), L.block_of(F.col("id"), X.SNPS, J).alias("j"))


@query(sql("SELECT j, bin, n FROM nl", "nl"))
def m_counts(spark, d):
    return L.counts_left_out(X.annot_disjoint(spark), X.SNPS, J).select("j", "bin", F.col("n").cast("long").alias("n"))


def _vb(spark, d) -> DataFrame:
    x = L.into_bins(G.standardize(X.geno(spark, d)), X.annot_disjoint(spark)).withColumn("j", L.block_of(F.col("m"), X.SNPS, J))
    return M.xxz(x, M.random_vectors(X.individuals(spark, d), B, X.SEED), ("j", "bin"))


@query(sql(f"SELECT j, bin, i, b, round(v, 4) AS v FROM vl WHERE j < {J}", "vl"))
def loo_stats(spark, d):
    return L.leave_one_out(_vb(spark, d), ["bin", "i", "b"], "v").select("j", "bin", "i", "b", *r6("v", digits=4))


# --- phenotypes and covariates --------------------------------------------------------------------------------------------


@query(sql("SELECT i FROM ids WHERE i % 37 = 0 OR i % 41 = 0", "ids"))
def pheno_missing(spark, d):
    p = X.pheno(spark, d).select("i", F.expr("CASE WHEN i % 37 = 0 THEN -9D ELSE y END").alias("y1"), F.expr("CASE WHEN i % 41 <> 0 THEN y END").alias("y2"))
    return T.missing_rows(p, ["y1", "y2"])


@query("SELECT false AS y1, true AS y2")
def binary_trait(spark, d):
    p = X.pheno(spark, d).select("i", F.col("y").alias("y1"), F.expr("CASE WHEN y >= 5 THEN 1D ELSE 0D END").alias("y2"))
    return T.is_binary(p, ["y1"]).withColumnRenamed("is_binary", "y1").crossJoin(T.is_binary(p, ["y2"]).withColumnRenamed("is_binary", "y2"))  # one row each


@query(sql("SELECT i, 'y' AS trait, round(y - avg(y) OVER (), 6) AS y FROM y", "y"))
def center_pheno(spark, d):
    return T.centre(X.pheno(spark, d).withColumn("trait", F.lit("y"))).select("i", "trait", *r6("y"))


_MC = "SELECT i, CASE WHEN i % 41 <> 0 THEN c1 END AS c1, CASE WHEN i % 41 <> 0 THEN c2 END AS c2 FROM cov"


def _gappy(spark, d) -> DataFrame:
    return X.covariates(spark, d).select("i", F.expr("CASE WHEN i % 41 = 0 THEN -9D ELSE c1 END").alias("c1"), F.expr("CASE WHEN i % 41 = 0 THEN -9D ELSE c2 END").alias("c2"))


@query(sql(f"SELECT i, round(coalesce(c1, avg(c1) OVER ()), 6) AS c1, round(coalesce(c2, avg(c2) OVER ()), 6) AS c2 FROM ({_MC})", "cov"))
def cov_mean_impute(spark, d):
    return T.mean_impute(_gappy(spark, d), ["c1", "c2"]).select("i", *r6("c1", "c2"))


@query(sql("SELECT i, round((c1 - avg(c1) OVER ()) / stddev_samp(c1) OVER (), 6) AS c1, round((c2 - avg(c2) OVER ()) / stddev_samp(c2) OVER (), 6) AS c2 FROM cov", "cov"))
def cov_standardize(spark, d):
    return T.z_score(X.covariates(spark, d).select("i", "c1", "c2"), ["c1", "c2"]).select("i", *r6("c1", "c2"))


@query(sql("SELECT i, level, (c1 = level)::INT AS hot FROM cov, (SELECT DISTINCT c1 AS level FROM cov)", "cov"))
def cov_one_hot(spark, d):
    return T.one_hot(X.covariates(spark, d), "c1")


@query(sql("SELECT count(DISTINCT c0) AS c0, count(DISTINCT c1) AS c1, count(DISTINCT c2) AS c2 FROM cov", "cov"))
def cov_levels(spark, d):
    return X.covariates(spark, d).agg(*(F.count_distinct(c).alias(c) for c in ("c0", "c1", "c2")))


@query(sql("SELECT i, round(y - c0 * (s0y * s22 - s2y * s02) / (s00 * s22 - s02 * s02) - c2 * (s00 * s2y - s02 * s0y) / (s00 * s22 - s02 * s02), 6) AS y FROM cov JOIN y USING (i), (SELECT sum(c0 * c0) AS s00, sum(c0 * c2) AS s02, sum(c2 * c2) AS s22, sum(c0 * y) AS s0y, sum(c2 * y) AS s2y FROM cov JOIN y USING (i))", "cov", "y"))
def regress_pheno(spark, d):
    return T.residualize(X.covariates(spark, d).join(X.pheno(spark, d), "i"), ["c0", "c2"]).select("i", *r6("y"))


@query(sql("SELECT i, round(y, 6) AS y FROM sim", "sim"))
def simulate_pheno(spark, d):
    return X.simulated(spark, d).select("i", *r6("y"))


@query(sql(f"SELECT i, rep, round(s + {gauss(13, 'rep || chr(58) || i')} * sqrt(0.5::DOUBLE) + 0.05::DOUBLE * c2, 6) AS y FROM (SELECT i, rep, sum(x * {gauss(11, 'rep || chr(58) || m')} * sqrt(0.5::DOUBLE / 64)) AS s FROM x CROSS JOIN range(3) r(rep) GROUP BY i, rep) JOIN cov USING (i)", "x", "cov"))
def simulate_replicates(spark, d):
    from heristat.operators.simulate import replicates

    return replicates(G.standardize(X.geno(spark, d)), 3, 0.5, X.SNPS, X.covariates(spark, d).select("i", "c2"), {"c2": 0.05}).select("i", "rep", *r6("y"))


@query(sql("SELECT i, round(y + (c1 - avg(c1) OVER ()) / stddev_samp(c1) OVER () + (c2 - avg(c2) OVER ()) / stddev_samp(c2) OVER (), 6) AS y FROM y JOIN cov USING (i)", "y", "cov"))
def add_covariate_effect(spark, d):
    from heristat.operators.simulate import add_covariates

    return add_covariates(X.pheno(spark, d), X.covariates(spark, d).select("i", "c1", "c2"), {"c1": 1.0, "c2": 1.0}, standardized=True).select("i", *r6("y"))


# --- statistics ---------------------------------------------------------------------------------------------------------


def _x2(spark, d) -> DataFrame:
    return L.into_bins(G.standardize(X.geno(spark, d)), X.annot_disjoint(spark))


def _z(spark, d) -> DataFrame:
    return M.random_vectors(X.individuals(spark, d), B, X.SEED)


@query(sql("SELECT i, b, round(z, 6) AS z FROM z", "z"))
def random_vectors(spark, d):
    return _z(spark, d).select("i", "b", *r6("z"))


@query(sql("SELECT bin, i, b, round(v, 4) AS v FROM vt", "vt"))
def xxz(spark, d):
    return M.xxz(_x2(spark, d), _z(spark, d), ("bin",)).select("bin", "i", "b", *r6("v", digits=4))


@query(sql("SELECT bin, round(s, 3) AS s FROM (SELECT bin, sum(s) AS s FROM (SELECT m, bin, pow(sum(x * y), 2) AS s FROM xb JOIN yc USING (i) GROUP BY m, bin) GROUP BY bin)", "xb", "yc"))
def yxxy(spark, d):
    return M.yxxy(_x2(spark, d), _centred(spark, d), ("bin",)).select("bin", *r6("s", digits=3))


def _centred(spark, d) -> DataFrame:
    return T.centre(X.simulated(spark, d).withColumn("trait", F.lit(0))).select("i", "y")


def _sizes(spark) -> DataFrame:
    return L.bin_sizes(X.annot_disjoint(spark))


@query(sql(f"SELECT k, l, round(t, 3) AS t FROM t WHERE j = {J}", "t"))
def t_matrix(spark, d):
    return M.trace_products(M.xxz(_x2(spark, d), _z(spark, d), ("bin",)), _sizes(spark), B).select("k", "l", *r6("t", digits=3))


@query(sql(f"SELECT bin, round(sum(v * z) / ({B} * 32), 4) AS t FROM vt JOIN z USING (i, b) GROUP BY bin", "vt", "z"))
def stoch_trace(spark, d):
    return M.stochastic_trace(M.xxz(_x2(spark, d), _z(spark, d), ("bin",)), _z(spark, d), _sizes(spark), B).select("bin", *r6("t", digits=4))


@query(sql(f"SELECT bin::VARCHAR AS k, round(s / n, 4) AS q FROM sl JOIN nl USING (j, bin) WHERE j = {J} UNION ALL SELECT 'e', round(sum(y * y), 4) FROM yc", "sl", "nl", "yc"))
def q_vector(spark, d):
    y = _centred(spark, d)
    return M.right_side(M.yxxy(_x2(spark, d), y, ("bin",)), _sizes(spark), y).select("k", *r6("q", digits=4))


@query(sql(f"SELECT k, l, round((t - n) * 32 * 32 / (n * n), 4) AS ld FROM t, (SELECT count(*)::DOUBLE AS n FROM ids) WHERE j = {J}", "t", "ids"))
def trace_ldsum(spark, d):
    t = M.trace_products(M.xxz(_x2(spark, d), _z(spark, d), ("bin",)), _sizes(spark), B)
    n = X.individuals(spark, d).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return t.crossJoin(F.broadcast(n)).select("k", "l", F.round(M.ld_sum(F.col("t"), F.col("n"), F.lit(32), F.lit(32)), 4).alias("ld"))  # n is one row


_SIGMA = sql("""SELECT round((q0 - qe) / (t00 - n), 6) AS sigma_g, round(qe / n - (q0 - qe) / (t00 - n), 6) AS sigma_e, round(t00, 4) AS t00, round(q0, 4) AS q0 FROM
    (SELECT (SELECT count(*)::DOUBLE FROM ids) AS n, (SELECT sum(v * v) / (4 * 64 * 64) FROM (SELECT i, b, sum(x * w) AS v FROM x JOIN w USING (m) GROUP BY i, b)) AS t00,
    (SELECT sum(s) / 64 FROM (SELECT pow(sum(x * (y - a)), 2) AS s FROM x JOIN y USING (i), (SELECT avg(y) AS a FROM y) GROUP BY m)) AS q0, (SELECT sum(pow(y - a, 2)) FROM y, (SELECT avg(y) AS a FROM y)) AS qe)""", "x", "w", "y", "ids")


@query(_SIGMA)
def rhe_sigma(spark, d):
    """The minimum model, by the kernel: one bin, no covariates, no blocks."""
    study = _study(spark, d, "rhe", 1, X.pheno(spark, d), blocks=1)
    t, q, _ = K.run(spark, K.as_rows(X.geno(spark, d), X.annot_one(spark), 1, X.SNPS), study)
    g, e = K.solve(t[-1], q[-1])[:, 0]
    return spark.createDataFrame([(round(float(g), 6), round(float(e), 6), round(float(t[-1, 0, 0]), 4), round(float(q[-1, 0, 0]), 4))], "sigma_g double, sigma_e double, t00 double, q0 double")


@query(_SIGMA)
def sigma_by_contraction(spark, d):
    """The same by joins and sums, all in Catalyst: for sparse genotypes."""
    x, y = G.standardize(X.geno(spark, d)), T.centre(X.pheno(spark, d).withColumn("trait", F.lit(0))).select("i", "y")
    t = M.xxz(x, _z(spark, d)).agg((F.sum(F.col("v") * F.col("v")) / (B * X.SNPS * X.SNPS)).alias("t00"))
    q = M.yxxy(x, y).select((F.col("s") / X.SNPS).alias("q0"))
    e = y.agg(F.sum(F.col("y") * F.col("y")).alias("qe"), F.count(F.lit(1)).cast("double").alias("n"))
    one = t.crossJoin(q).crossJoin(e)  # one row each
    g, s = M.sigma_one(F.col("t00"), F.col("n"), F.col("q0"), F.col("qe"))
    return one.select(F.round(g, 6).alias("sigma_g"), F.round(s, 6).alias("sigma_e"), *r6("t00", "q0", digits=4))


_OWN = (
    f"SELECT jj, m, b, sum(d * w) AS u FROM geno JOIN blk USING (m) JOIN (SELECT jj, i, b, sum(d * z) AS w FROM geno JOIN blk USING (m) JOIN (SELECT range AS m, b, {gauss(X.SEED, 'range || chr(58) || b')} AS z"
    f" FROM range({X.SNPS}), range({B}) r(b)) USING (m) CROSS JOIN range({J + 1}) q(jj) WHERE j <> jj GROUP BY ALL) USING (i) WHERE j <> jj GROUP BY jj, m, b"
)
_XTXZ = sql(f"SELECT j, round(trace, 3) AS trace FROM (SELECT jj AS j, sum(u * u) / ({B} * pow(count(DISTINCT m), 2)) AS trace FROM ({_OWN}) GROUP BY jj)", "geno", "blk")


def _xtxz(spark, d):
    rows = K.as_rows(X.geno(spark, d), X.annot_one(spark), J, X.SNPS)
    return K.xtxz(spark, rows, X.individuals(spark, d).count(), J, B, X.SEED, bed.scratch(spark))


@query(_XTXZ)
def xtxz_trace(spark, d):
    return K.xtxz_traces(_xtxz(spark, d), B).select("j", *r6("trace", digits=3))


@query(sql(f"SELECT jj AS j, m, b, round(u, 3) AS u FROM ({_OWN})", "geno", "blk"))
def xtxz_block_vectors(spark, d):
    """Every sample's own vectors, written by sample to the shared folder and read back."""
    path = bed.scratch(spark)
    K.write_xtxz(_xtxz(spark, d), path)
    kept = spark.read.parquet(path)
    return kept.select(F.col("j").cast("long").alias("j"), "m", F.posexplode("u").alias("b", "u")).select("j", "m", F.col("b").cast("long").alias("b"), F.round(F.col("u"), 3).alias("u"))


@query(_XTXZ)
def xtxz_trace_by_contraction(spark, d):
    return M.global_trace(X.geno(spark, d), B, X.SEED, J, X.SNPS).select("j", *r6("trace", digits=3))


@query(sql("SELECT m, b, round(sum(d * w), 3) AS u FROM geno JOIN (SELECT i, b, sum(d * z) AS w FROM geno JOIN (SELECT range AS m, b, " + gauss(X.SEED, "range || chr(58) || b") + f" AS z FROM range({X.SNPS}), range({B}) r(b)) USING (m) GROUP BY i, b) USING (i) GROUP BY m, b", "geno"))
def xtxz_vectors(spark, d):
    return M.xtxz(X.geno(spark, d), B, X.SEED).select("m", "b", *r6("u", digits=3))


@query(sql("SELECT m, bin FROM three JOIN blk USING (m) WHERE j <> 9", "three", "blk"))
def leave_block_out(spark, d):
    return L.without_block(X.annot_overlap(spark), 9, X.SNPS, J)


@query(sql(f"SELECT m, CASE WHEN u < (1 - p) * (1 - p) THEN 0 WHEN u < (1 - p) * (1 - p) + 2 * p * (1 - p) THEN 1 ELSE 2 END AS d FROM (SELECT m, mu / 2 AS p, {_U} AS u FROM mu)", "mu"))
def allele_draw(spark, d):
    from heristat.functions.rng import hwe_draw, uniform

    return G.allele_means(X.geno(spark, d)).select("m", hwe_draw(uniform(5, F.col("m")), F.col("mu") / 2).alias("d"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, count(*) AS n FROM orders GROUP BY o_orderpriority")
def run_summary(spark, d):
    return R.summarize_runs(X.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", *r6("mean", "sd", digits=4), "n")


@query("SELECT 3 AS rank")
def cov_rank(spark, d):
    c = X.covariates(spark, d).withColumn("twice", F.col("c1") * 2)
    return spark.createDataFrame([(T.rank(c, ["c0", "c1", "c2", "twice"]),)], "rank int")


@query("SELECT m, sum(d)::BIGINT AS d, any_value(least(mu / 2, 1 - mu / 2) > 0.3) AS common FROM (SELECT l_partkey AS m, o_custkey AS i, least(count(*), 2) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) JOIN (SELECT l_partkey AS m, sum(d) / (SELECT count(*) FROM customer)::DOUBLE AS mu FROM (SELECT l_partkey, o_custkey, least(count(*), 2) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY l_partkey) USING (m) GROUP BY m")
def sparse_counts(spark, d):
    """Allele counts of a sparse genotype: customers by parts, absent pairs being 0."""
    g = X.table(spark, d, "orders").join(X.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("i"), F.col("l_partkey").alias("m")).agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("d"))
    n = X.table(spark, d, "customer").agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row
    half = F.col("d") / F.col("n") / 2
    return g.groupBy("m").agg(F.sum("d").cast("long").alias("d")).crossJoin(F.broadcast(n)).select("m", "d", (F.least(half, 1 - half) > 0.3).alias("common"))


# --- models, by the Arrow kernels -----------------------------------------------------------------------------------------


def _study(spark, d, model: str, bins: int, pheno: DataFrame, blocks: int = J, cov: bool = False, env: bool = False, **more) -> K.Study:
    """Columns of individuals come to the driver, one row each."""
    frame = pheno.join(X.covariates(spark, d), "i").join(X.environment(spark, d), "i").orderBy("i").toPandas()
    z = np.array([[K.gaussian_value(X.SEED, i, b) for b in range(B)] for i in frame.i])
    return K.Study(frame.y.to_numpy(), K.components(model, bins, 1), blocks, B, z=z, covariates=frame[["c0", "c1", "c2"]].to_numpy() if cov else None, env=frame[["e"]].to_numpy() if env else None, **more)


def _fit(spark, d, model: str, annot: DataFrame, bins: int, pheno: DataFrame | None = None, **more) -> DataFrame:
    study = _study(spark, d, model, bins, X.simulated(spark, d) if pheno is None else pheno, **more)
    return K.estimate(spark, K.as_rows(X.geno(spark, d), annot, J, X.SNPS), study)


def _two(spark, d) -> DataFrame:
    return _fit(spark, d, "rhe", X.annot_disjoint(spark), 2)


def _bins(h: DataFrame) -> DataFrame:
    """Component names to bins as sizes name them."""
    return h.withColumn("k", F.regexp_replace("k", "^g:", ""))


_ROUND = "SELECT k, round(estimate, 5) AS estimate, round(se, 5) AS se FROM (SELECT k, max(value) FILTER (j = {J}) AS estimate, sqrt({J1} * var_pop(value) FILTER (j < {J})) AS se FROM {0} GROUP BY k)"


def _jack(source: str) -> str:
    return _ROUND.replace("{0}", source).replace("{J1}", str(J - 1)).replace("{J}", str(J))


@query(sql("SELECT j, k, round(value, 5) AS value FROM sg", "sg"))
def rhe_samples(spark, d):
    return _two(spark, d).select("j", "k", *r6("value", digits=5))


@query(sql(_jack("sg"), "sg"))
def jackknife_se(spark, d):
    return R.jackknife(_two(spark, d), J).select("k", *r6("estimate", "se", digits=5))


@query(sql(_jack("h2"), "h2"))
def rhe_h2(spark, d):
    return R.jackknife(R.heritability(_two(spark, d).select("j", "k", "value")), J).select("k", *r6("estimate", "se", digits=5))


_LEFT = "SELECT j, bin, n FROM nl"


@query(sql(_jack("(SELECT h2.j, h2.k, h2.value / t.value / (n / sum(n) OVER (PARTITION BY h2.j)) AS value FROM h2 JOIN h2 t ON t.j = h2.j AND t.k = 'total' JOIN nl ON nl.j = h2.j AND 'g:' || bin = h2.k)").replace("SELECT k, round", "SELECT substr(k, 3) AS k, round", 1), "h2", "nl"))
def enrichment(spark, d):
    h = _bins(R.heritability(_two(spark, d).select("j", "k", "value")))
    return R.jackknife(R.enrichment(h, L.counts_left_out(X.annot_disjoint(spark), X.SNPS, J)), J).select("k", *r6("estimate", "se", digits=5))


@query(sql("SELECT k, round(sum(value * common / n) / any_value(total), 5) AS h2 FROM (SELECT a.bin AS k, c.bin AS b, count(*) AS common FROM three a JOIN three c USING (m) GROUP BY ALL) JOIN (SELECT bin AS b, count(*) AS n, 0.1 * (bin + 1) AS value FROM three GROUP BY bin) USING (b), (SELECT 1.0::DOUBLE AS total) GROUP BY k", "three"))
def rhe_h2_overlap(spark, d):
    """Overlapping bins with variances 0.1, 0.2, 0.3 and noise 0.4."""
    sigma = spark.range(4).select(F.lit(0).cast("bigint").alias("j"), F.expr("CASE WHEN id = 3 THEN 'e' ELSE CAST(id AS STRING) END").alias("k"), ((F.col("id") + 1) * 0.1).alias("value"))
    sizes = L.bin_sizes(X.annot_overlap(spark)).withColumn("j", F.lit(0).cast("bigint"))
    return R.overlapping_heritability(sigma, X.annot_overlap(spark), sizes).select(F.col("k").cast("bigint").alias("k"), F.round("value", 5).alias("h2"))


@query(sql("SELECT j, k, round(value, 5) AS value FROM h2", "h2"))
def overlap_equals_plain(spark, d):
    """With disjoint bins both definitions agree."""
    s = _bins(_two(spark, d).select("j", "k", "value"))
    h = R.overlapping_heritability(s, X.annot_disjoint(spark).withColumn("block", L.block_of(F.col("m"), X.SNPS, J)), L.counts_left_out(X.annot_disjoint(spark), X.SNPS, J)).withColumn("k", F.concat(F.lit("g:"), "k"))
    return h.unionByName(h.groupBy("j").agg(F.sum("value").alias("value")).withColumn("k", F.lit("total"))).select("j", "k", *r6("value", digits=5))


@query(sql("SELECT trait, j, k, round(value, 5) AS value FROM (SELECT 0 AS trait, * FROM sg UNION ALL SELECT 1, j, k, 4 * value FROM sg)", "sg"))
def rhe_traits(spark, d):
    """Two traits, the second twice the first, share the left side."""
    study = _study(spark, d, "rhe", 2, X.simulated(spark, d))
    study = K.Study(np.hstack([study.y, 2 * study.y]), study.parts, J, B, z=study.z)
    return K.estimate(spark, K.as_rows(X.geno(spark, d), X.annot_disjoint(spark), J, X.SNPS), study).select("trait", "j", "k", *r6("value", digits=5))


def _model(kinds: tuple[str, ...], select: str, cov: bool = False, blocks: int = J) -> str:
    """select over the fragments of a model's equations, down to its estimates sol (j, c, value, trace)."""
    own, _ = model_sql.equations(kinds, cov, B, J)
    return sql("", "x", "xb", "nl", "z", "yc", "env", "cov", "geno", "mu").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + own + " " + select


_SOL = "(SELECT j, c AS k, value FROM sol)"


@query(_model(("g",), _jack(_SOL), cov=True))
def rhe_covariates(spark, d):
    return R.jackknife(_fit(spark, d, "rhe", X.annot_disjoint(spark), 2, cov=True), J).select("k", *r6("estimate", "se", digits=5))


@query(_model(("g", "d"), _jack(_SOL)))
def rhe_dom(spark, d):
    return R.jackknife(_fit(spark, d, "rhe_dom", X.annot_disjoint(spark), 2), J).select("k", *r6("estimate", "se", digits=5))


@query(_model(("g", "d"), _jack(_SOL), cov=True))
def rhe_dom_covariates(spark, d):
    return R.jackknife(_fit(spark, d, "rhe_dom", X.annot_disjoint(spark), 2, cov=True), J).select("k", *r6("estimate", "se", digits=5))


def _shares(spark, d, model: str, **more) -> DataFrame:
    return R.explained(_fit(spark, d, model, X.annot_disjoint(spark), 2, env=True, **more))


def _genie(spark, d, model: str, **more) -> DataFrame:
    return R.jackknife(R.class_totals(_shares(spark, d, model, **more)), J).select("k", *r6("estimate", "se", digits=5))


_SHARE = "(SELECT j, c AS k, value * trace / sum(value * trace) OVER (PARTITION BY j) AS value FROM sol)"
_CLASSES = f"(WITH s AS (SELECT * FROM {_SHARE} WHERE k <> 'e') SELECT * FROM s UNION ALL SELECT j, split_part(k, ':', 1) || ':total', sum(value) FROM s WHERE k LIKE 'g:%' OR k LIKE 'gxe:%' GROUP BY ALL UNION ALL SELECT j, 'total', sum(value) FROM s GROUP BY j)"


@query(_model(("g",), _jack(_CLASSES)))
def genie_g(spark, d):
    return _genie(spark, d, "G")


@query(_model(("g", "gxe"), _jack(_CLASSES)))
def genie_gxe(spark, d):
    return _genie(spark, d, "G+GxE")


@query(_model(("g", "gxe", "nxe"), _jack(_CLASSES)))
def genie_full(spark, d):
    return _genie(spark, d, "G+GxE+NxE")


@query(_model(("g", "gxe", "nxe"), _jack(_CLASSES), cov=True))
def genie_covariates(spark, d):
    return _genie(spark, d, "G+GxE+NxE", cov=True)


@query(_model(("g", "gxe", "nxe"), f"SELECT j, k, round(value, 5) AS value FROM {_CLASSES}"))
def genie_h2(spark, d):
    """Every sample's shares with their class totals."""
    return R.class_totals(_shares(spark, d, "G+GxE+NxE")).select("j", "k", *r6("value", digits=5))


@query(_model(("g", "gxe", "nxe"), f"SELECT split_part(k, ':', 2) AS k, round(value / sum(value) OVER () / 0.5, 5) AS value FROM {_SHARE} WHERE j = {J} AND k LIKE 'g:%'"))
def genie_enrichment(spark, d):
    """Of G bins among themselves, without covariates, over all blocks."""
    g = _bins(_shares(spark, d, "G+GxE+NxE").filter(f"k LIKE 'g:%' AND j = {J}"))
    h = g.unionByName(g.groupBy("j").agg(F.sum("value").alias("value")).select("j", F.lit("total").alias("k"), "value"))
    return R.enrichment(h, L.bin_sizes(X.annot_disjoint(spark)).withColumn("j", F.lit(J).cast("bigint"))).select("k", *r6("value", digits=5))


_HEIGHT = "(VALUES (0.01::DOUBLE, 0.026652142203457625::DOUBLE), (0.05, 0.10313564037537128), (0.1, 0.17549833193248682)) p(pop_prev, height)"  # normal density at the quantile


@query(sql(f"SELECT pop_prev, round(estimate * f, 5) AS h2, round(se * f, 5) AS se, round({model_sql.ERFC}, 5) AS p FROM (SELECT *, pow(pop_prev * (1 - pop_prev) / height, 2) / (0.4 * 0.6) AS f, abs(estimate / se) / sqrt(2) AS x FROM (SELECT max(value) FILTER (j = {J}) AS estimate, sqrt({J - 1} * var_pop(value) FILTER (j < {J})) AS se FROM h2 WHERE k = 'total'), {_HEIGHT})", "h2"))
def liability_h2(spark, d):
    """The fitted total on the liability scale, for three prevalences."""
    total = R.jackknife(R.heritability(_two(spark, d).select("j", "k", "value")), J).filter("k = 'total'").first()
    rows = [(p, *(round(x, 5) for x in liability(total.estimate, total.se, 0.4, p))) for p in (0.01, 0.05, 0.1)]
    return spark.createDataFrame(rows, "pop_prev double, h2 double, se double, p double")


@query(sql(f"SELECT k, j, round(abs(a - b), 5) AS diff FROM (SELECT k, j, value AS a, value * (1 + j % 2) AS b FROM sg) WHERE abs(a - b) > 0.1", "sg"))
def engine_diff(spark, d):
    s = _two(spark, d).select("j", "k", "value")
    return R.differences(s, s.withColumn("value", F.col("value") * (1 + F.col("j") % 2)), ["j", "k"]).select("k", "j", *r6("diff", digits=5))


_C3 = ["c0", "c1", "c2"]


@query(_model(("g",), "SELECT i, b, round(v, 4) AS v FROM (" + model_sql._fitted("SELECT i, b, sum(v) AS v FROM ct WHERE u = 0 GROUP BY i, b", "b") + ")", cov=True))
def uxxz(spark, d):
    """C (C'C)^+ C' X (X'z): the projection is applied once, to the sums."""
    v = M.xxz(G.standardize(X.geno(spark, d)), _z(spark, d))
    return T.project(v, X.covariates(spark, d), _C3, "v", ["b"]).select("i", "b", *r6("v", digits=4))


@query(_model(("g",), "SELECT i, b, round(sum(v), 4) AS v FROM ct WHERE u = 1 GROUP BY i, b", cov=True))
def xxuz(spark, d):
    """X (X' U z) with U the projection on the covariates."""
    uz = T.project(_z(spark, d), X.covariates(spark, d), _C3, "z", ["b"])
    return M.xxz(G.standardize(X.geno(spark, d)), uz).select("i", "b", *r6("v", digits=4))


@query(_model(("g",), f"SELECT split_part(k, ':', 2)::INT AS k, split_part(l, ':', 2)::INT AS l, round(t, 3) AS t FROM t WHERE j = {J} UNION ALL SELECT split_part(c, ':', 2)::INT, 2, round(base, 3) FROM base WHERE j = {J} UNION ALL SELECT 2, split_part(c, ':', 2)::INT, round(base, 3) FROM base WHERE j = {J} UNION ALL SELECT 2, 2, (SELECT count(*)::DOUBLE - 3 FROM ids)", cov=True))
def t_matrix_cov(spark, d):
    study = _study(spark, d, "rhe", 2, X.simulated(spark, d), blocks=1, cov=True)
    t, _, _ = K.run(spark, K.as_rows(X.geno(spark, d), X.annot_disjoint(spark), 1, X.SNPS), study)
    return spark.createDataFrame([(k, l, round(float(t[-1, k, l]), 3)) for k in range(3) for l in range(3)], "k int, l int, t double")


# --- sources and sinks ------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('a', 'sigma', 'g[0]', 0.5::DOUBLE, 0.1::DOUBLE), ('a', 'sigma', 'e', 0.4, 0.01), ('a', 'h2', 'g[0]', 0.55, 0.09), ('a', 'h2', 'total', 0.55, 0.09), ('a', 'enrichment', 'g[0]', 1.0, 0.0), ('a', 'runtime', '', 3.25, NULL)) t(path, metric, component, value, se)")
def parse_log(spark, d):
    text = "\n".join(["Sigma^2_g[0] : 0.5  SE : 0.1", "Sigma^2_e : 0.4  SE : 0.01", "h2_g[0] : 0.55 : 0.09", "Total h2 : 0.55 SE: 0.09", "Enrichment g[0] : 1.0 SE : 0.0", "h2_g[0] : 9.9 : 9.9", "Runtime: 3.25 seconds"])
    return files.parse_reports(spark.createDataFrame([("a", text)], "path string, value string"))


@query(sql("SELECT j::INT AS j, k::INT AS k, round(max(ld) FILTER (l = 0), 3) AS LD_SUM_0, round(max(ld) FILTER (l = 1), 3) AS LD_SUM_1, any_value(n)::BIGINT AS NSNPS_JACKKNIFE FROM (SELECT t.j AS j, k, l, p.n AS n, (t - nn) * p.n * q.n / (nn * nn) AS ld FROM t JOIN nl p ON p.j = t.j AND p.bin = t.k JOIN nl q ON q.j = t.j AND q.bin = t.l, (SELECT count(*)::DOUBLE AS nn FROM ids)) GROUP BY j, k", "t", "nl", "ids"))
def trace_summary(spark, d):
    study = _study(spark, d, "rhe", 2, X.simulated(spark, d))
    t, _, m = K.run(spark, K.as_rows(X.geno(spark, d), X.annot_disjoint(spark), J, X.SNPS), study)
    return files.trace_rows(spark, t, m, len(study.y))


@query(sql("SELECT m, sum(d)::BIGINT AS alleles, count(d) AS known FROM raw GROUP BY m", "raw"))
def bed_round_trip(spark, d):
    """Genotypes written as a PLINK file to the shared folder and read back by SNP range."""
    path = bed.scratch(spark)
    n = bed.write(X.geno_raw(spark, d), path)
    return bed.read(spark, path, n, X.SNPS).select("m", F.explode("dosage").alias("d")).groupBy("m").agg(F.sum("d").cast("long").alias("alleles"), F.count("d").alias("known"))


@query(sql("SELECT m, sum(d)::BIGINT AS alleles, count(d) AS known FROM raw WHERE m >= 5 AND m < 40 GROUP BY m", "raw"))
def bed_parts(spark, d):
    """The same as a folder of parts that executors write, read by a range that cuts parts."""
    path = bed.scratch(spark)
    n = bed.write_parts(X.geno_raw(spark, d), path, 7)
    got = bed.read(spark, path, n, X.SNPS).filter("m >= 5 AND m < 40")
    return got.select("m", F.explode("dosage").alias("d")).groupBy("m").agg(F.sum("d").cast("long").alias("alleles"), F.count("d").alias("known"))


@query(sql("SELECT m, bin FROM three", "three"))
def annot_round_trip(spark, d):
    """Annotations written as 0/1 columns and read back by line."""
    path = bed.scratch(spark)
    files.write_annot(X.annot_overlap(spark), 3, path)
    return files.read_annot(spark, path)


@query(sql("SELECT i, round(y, 6) AS y, round(c1, 6) AS c1 FROM y JOIN cov USING (i)", "y", "cov"))
def pheno_round_trip(spark, d):
    """Traits written with a header, in order of individuals, and read back by line."""
    path = bed.scratch(spark)
    files.write_pheno(X.pheno(spark, d).join(X.covariates(spark, d).select("i", "c1"), "i"), path, ("y", "c1"))
    return files.read_table(spark, path, None).select("i", *r6("y", "c1"))


@query(sql("SELECT m, ('0x' || substr(md5('3:' || m), 1, 8))::BIGINT % 8 AS bin FROM one", "one"))
def random_annotation(spark, d):
    return files.random_bins(X.annot_one(spark).select("m"), 8, 3)


def queries() -> dict:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in FOUND.items() if s}
