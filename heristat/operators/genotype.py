"""Genotype operators over long rows (i, m, d): individual, SNP, allele count 0, 1, 2 or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from heristat.functions.rng import hwe_draw, uniform


def from_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", low: float = -0.08, high: float = 0.08) -> DataFrame:
    """Each vector is an individual, each position a SNP; two thresholds give the allele count."""
    long = vectors.select(F.col(id_col).alias("i"), F.posexplode(vec_col).alias("m", "v")).withColumn("v", F.col("v").cast("double"))
    return long.select("i", F.col("m").cast("bigint").alias("m"), (F.when(F.col("v") > low, 1).otherwise(0) + F.when(F.col("v") > high, 1).otherwise(0)).alias("d"))


def flip(d: Column) -> Column:
    """Count the other allele."""
    return 2 - d


def allele_means(geno: DataFrame) -> DataFrame:
    """(m, mu): mean allele count over those that are known."""
    return geno.groupBy("m").agg(F.avg("d").alias("mu"))


def impute(geno: DataFrame, method: str = "binary", seed: int = 0) -> DataFrame:
    """Fill missing counts. binary: one Hardy-Weinberg draw a SNP fills all of its gaps; mean: the SNP's mean; zero: 0,
    which is what the mean method historically did ahead of standardizing. A SNP without any count gets 0."""
    if method == "zero":
        return geno.withColumn("d", F.coalesce("d", F.lit(0)))
    if method not in ("binary", "mean"):
        raise ValueError(f"unknown imputation {method!r}")
    means = allele_means(geno).withColumn("mu", F.coalesce("mu", F.lit(0.0)))
    fill = hwe_draw(uniform(seed, F.col("m")), F.col("mu") / 2) if method == "binary" else F.col("mu")
    return geno.join(means.select("m", fill.alias("fill")), "m").select("i", "m", F.coalesce("d", "fill").alias("d"))


def standardize(geno: DataFrame) -> DataFrame:
    """(i, m, x): (d - mu) / sqrt(mu (1 - mu / 2)). A SNP that doesn't vary has no scale: its rows go."""
    mu = F.col("mu")
    varying = allele_means(geno).filter((mu > 0) & (mu < 2))
    return geno.join(varying, "m").select("i", "m", ((F.col("d") - mu) / F.sqrt(mu * (1 - mu / 2))).alias("x"))


def monomorphic(geno: DataFrame) -> DataFrame:
    """The SNPs that standardize() leaves out."""
    return allele_means(geno).filter("mu <= 0 OR mu >= 2").select("m")


def dominance(d: Column, mu: Column) -> Column:
    """0, 2 maf, 4 maf - 2 for 0, 1, 2 alleles, maf being mu / 2."""
    return F.when(d == 0, 0.0).when(d == 1, mu).otherwise(2 * mu - 2)


def standardize_dominance(geno: DataFrame) -> DataFrame:
    """(i, m, x) of the dominance coding, centred and divided by 2 maf (1 - maf)."""
    means = allele_means(geno).filter("mu > 0 AND mu < 2")
    coded = geno.join(means, "m").withColumn("e", dominance(F.col("d"), F.col("mu")))
    centre = coded.groupBy("m").agg(F.avg("e").alias("centre"))
    return coded.join(centre, "m").select("i", "m", ((F.col("e") - F.col("centre")) / (F.col("mu") * (1 - F.col("mu") / 2))).alias("x"))


def times_environment(x: DataFrame, env: DataFrame) -> DataFrame:
    """x with each individual's values times their environment e."""
    return x.join(env, "i").select("i", "m", (F.col("x") * F.col("e")).alias("x"))


def drop_individuals(rows: DataFrame, missing: DataFrame) -> DataFrame:
    """rows without the individuals i of missing."""
    return rows.join(missing.select("i").distinct(), "i", "left_anti")


def snp_major(geno: DataFrame) -> DataFrame:
    """(m, dosage array<int>): a SNP's counts in order of i, as a .bed file has them."""
    return geno.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("r")).select("m", F.col("r.d").alias("dosage"))
