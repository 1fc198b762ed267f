"""Sufficient statistics by relational contraction: all of it visible to Catalyst.

x is (i, m, x), z is (i, b, z), annot is (m, bin). Products of matrices are equi-joins with sums; sums are pre-aggregated
in the map tasks. The Arrow kernels of plans.kernel compute the same for dense genotypes; this form suits sparse or small
ones and is what the SQL oracles are held against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from heristat.functions.rng import gaussian


def random_vectors(individuals: DataFrame, n: int, seed: int) -> DataFrame:
    """(i, b, z) for b < n."""
    each = individuals.select("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b")).withColumn("b", F.col("b").cast("bigint"))
    return each.select("i", "b", gaussian(seed, F.col("i"), F.col("b")).alias("z"))


def _keys(x: DataFrame, keys: list[str]) -> list[str]:
    return [k for k in keys if k in x.columns]


def xxz(x: DataFrame, z: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, b, v): v = X (X' z_b), X being x's rows of each key (bin, block)."""
    w = x.join(z, "i").groupBy(*keys, "m", "b").agg(F.sum(F.col("x") * F.col("z")).alias("w"))
    return x.join(w, [*keys, "m"]).groupBy(*keys, "i", "b").agg(F.sum(F.col("x") * F.col("w")).alias("v"))


def yxxy(x: DataFrame, y: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, s): s = |X' y|^2."""
    w = x.join(y, "i").groupBy(*keys, "m").agg(F.sum(F.col("x") * F.col("y")).alias("w"))
    return w.groupBy(*keys).agg(F.sum(F.col("w") * F.col("w")).alias("s")) if keys else w.agg(F.sum(F.col("w") * F.col("w")).alias("s"))


def nxe(z: DataFrame, env: DataFrame) -> DataFrame:
    """(i, b, v) of the noise-by-environment component, whose X is diag(e): no matrix is formed."""
    return z.join(env, "i").select("i", "b", (F.col("e") * F.col("e") * F.col("z")).alias("v"))


def trace_products(v: DataFrame, sizes: DataFrame, n_vectors: int, key: str = "bin") -> DataFrame:
    """(k, l, t): t = sum_b <v_kb, v_lb> / (B M_k M_l), 0 where a component has no SNPs. sizes is (key, n).

    The vectors are joined with themselves on individual and vector, so no pair of components meets outside one of them:
    as many rows as vectors times components.
    """
    both = v.select("i", "b", F.col(key).alias("k"), F.col("v").alias("vk")).join(v.select("i", "b", F.col(key).alias("l"), F.col("v").alias("vl")), ["i", "b"])
    sums = both.groupBy("k", "l").agg(F.sum(F.col("vk") * F.col("vl")).alias("t"))
    at = lambda name: sizes.select(F.col(key).alias(name), F.col("n").alias(f"m{name}"))
    scale = F.col("mk") * F.col("ml") * n_vectors
    return sums.join(at("k"), "k").join(at("l"), "l").select("k", "l", F.coalesce(F.try_divide("t", scale.cast("double")), F.lit(0.0)).alias("t"))


def stochastic_trace(v: DataFrame, z: DataFrame, sizes: DataFrame, n_vectors: int, key: str = "bin") -> DataFrame:
    """(key, t): sum_b z_b' K z_b / (B M)."""
    sums = v.join(z, ["i", "b"]).groupBy(key).agg(F.sum(F.col("v") * F.col("z")).alias("t"))
    return sums.join(sizes, key).select(key, F.coalesce(F.try_divide("t", (F.col("n") * n_vectors).cast("double")), F.lit(0.0)).alias("t"))


def right_side(s: DataFrame, sizes: DataFrame, y: DataFrame, key: str = "bin") -> DataFrame:
    """(k, q): y'X X'y / M by component, and y'y as the last."""
    own = s.join(sizes, key).select(F.col(key).cast("string").alias("k"), F.coalesce(F.try_divide("s", F.col("n").cast("double")), F.lit(0.0)).alias("q"))
    return own.unionByName(y.agg(F.sum(F.col("y") * F.col("y")).alias("q")).select(F.lit("e").alias("k"), "q"))


def sigma_one(t00: Column, n: Column, q0: Column, qe: Column) -> tuple[Column, Column]:
    """Cramer's rule for one component and noise, T[k, e] being n."""
    s = (q0 - qe) / (t00 - n)
    return s, qe / n - s


def ld_sum(trace: Column, n: Column, m1: Column, m2: Column) -> Column:
    """Trace of a product of kinship matrices to a sum of squared correlations."""
    return (trace - n) * m1 * m2 / (n * n)


def xtxz(geno: DataFrame, n_vectors: int, seed: int) -> DataFrame:
    """(m, b, u): u = X'X z_b over raw counts, z over SNPs. Its squares' sum is what global_trace() scales."""
    z = geno.select("m").distinct().select("m", F.explode(F.sequence(F.lit(0), F.lit(n_vectors - 1))).alias("b")).select("m", F.col("b").cast("bigint").alias("b"), gaussian(seed, F.col("m"), F.col("b")).alias("z"))
    w = geno.join(z, "m").groupBy("i", "b").agg(F.sum(F.col("d") * F.col("z")).alias("w"))
    return geno.join(w, "i").groupBy("m", "b").agg(F.sum(F.col("d") * F.col("w")).alias("u"))


def global_trace(geno: DataFrame, n_vectors: int, seed: int, blocks: int | None = None, n_snps: int = 0) -> DataFrame:
    """Trace of (X'X)^2 / M^2 over raw counts from vectors z over SNPs: sum_b |X'X z_b|^2 / (B M^2); with blocks also
    without each block's SNPs (j; j = blocks keeps all)."""
    from heristat.operators.layout import block_of

    snps = geno.select("m").distinct()
    z = snps.select("m", F.explode(F.sequence(F.lit(0), F.lit(n_vectors - 1))).alias("b")).select("m", F.col("b").cast("bigint").alias("b"), gaussian(seed, F.col("m"), F.col("b")).alias("z"))
    j = block_of(F.col("m"), n_snps, blocks) if blocks else F.lit(0)
    part = geno.join(z, "m").groupBy("i", "b", j.alias("own")).agg(F.sum(F.col("d") * F.col("z")).alias("w"))
    total = part.groupBy("i", "b").agg(F.sum("w").alias("w"))
    kept = total.select("i", "b", "w", F.lit(blocks or 0).cast("bigint").alias("j"))
    if blocks:
        each = part.select("i", "b", F.col("own").alias("j"), F.col("w").alias("ow"))
        kept = kept.unionByName(total.join(each, ["i", "b"]).select("i", "b", (F.col("w") - F.col("ow")).alias("w"), "j"))
    own = geno.select("i", "m", "d", j.alias("own"))
    back = own.join(kept, "i").filter(F.col("j") != F.col("own")) if blocks else own.join(kept, "i")
    sums = back.groupBy("j", "m", "b").agg(F.sum(F.col("d") * F.col("w")).alias("u")).groupBy("j").agg(F.sum(F.col("u") * F.col("u")).alias("t"), F.count_distinct("m").alias("n"))
    return sums.select("j", (F.col("t") / (n_vectors * F.col("n") * F.col("n"))).alias("trace"))
