"""Simulated phenotypes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from heristat.functions.rng import gaussian
from heristat.operators.tables import z_score


def _effect(weights: dict[str, float]):
    return reduce(lambda a, b: a + b, (F.col(c) * w for c, w in weights.items()))


def phenotype(x: DataFrame, annot: DataFrame, sigma: tuple[float, ...], covariates: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(i, y): sums over standardized genotypes x (i, m, x) of effects of variance sigma[bin] / (SNPs of bin), for every bin of a
    SNP, noise of variance 1 - sum(sigma), and covariates by weight. Effects are drawn by SNP and noise by individual."""
    sizes = annot.groupBy("bin").agg(F.count(F.lit(1)).alias("_n"))
    spread = F.sqrt(F.element_at(F.array(*map(F.lit, sigma)), (F.col("bin") + 1).cast("int")) / F.col("_n"))
    effects = annot.join(F.broadcast(sizes), "bin").select("m", (gaussian(11, F.col("m")) * spread).alias("_e")).groupBy("m").agg(F.sum("_e").alias("_e"))  # sizes has a row a bin
    score = x.join(effects, "m").groupBy("i").agg(F.sum(F.col("x") * F.col("_e")).alias("s"))
    y = score.select("i", (F.col("s") + gaussian(13, F.col("i")) * (1 - sum(sigma)) ** 0.5).alias("y"))
    if covariates is None:
        return y
    return y.join(covariates, "i").select("i", (F.col("y") + _effect(weights or {})).alias("y"))


def replicates(x: DataFrame, n: int, sigma: float, n_snps: int, covariates: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(i, rep, y) for rep < n: standardized genotypes x (i, m, x) times effects of variance sigma / n_snps, noise of
    variance 1 - sigma, and covariates by weight. A replicate's draws depend on its number alone.

    A SNP's n effects are drawn once and joined to its genotypes, which are added up to n sums an individual.
    """
    drawn = x.select("m").distinct().select("m", *((gaussian(11, F.lit(r).cast("bigint"), F.col("m")) * (sigma / n_snps) ** 0.5).alias(f"_e{r}") for r in range(n)))
    sums = x.join(drawn, "m").groupBy("i").agg(*(F.sum(F.col("x") * F.col(f"_e{r}")).alias(f"_s{r}") for r in range(n)))
    score = sums.select("i", F.posexplode(F.array(*(f"_s{r}" for r in range(n)))).alias("rep", "s")).withColumn("rep", F.col("rep").cast("bigint"))
    y = score.withColumn("y", F.col("s") + gaussian(13, F.col("rep"), F.col("i")) * (1 - sigma) ** 0.5)
    if covariates is not None:
        y = y.join(covariates, "i").withColumn("y", F.col("y") + _effect(weights or {}))
    return y.select("i", "rep", "y")


def add_covariates(pheno: DataFrame, covariates: DataFrame, weights: dict[str, float], standardized: bool = True) -> DataFrame:
    """pheno with covariates, z-scored first if standardized, added to y by weight."""
    c = z_score(covariates, list(weights)) if standardized else covariates
    return pheno.join(c, "i").withColumn("y", F.col("y") + _effect(weights)).select("i", "y")
