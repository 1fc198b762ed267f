"""Logical inputs derived from the star-schema tables, as the queries use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heristat.functions.rng import gaussian
from heristat.operators import genotype as G
from heristat.operators.simulate import phenotype

SNPS, VECTORS, SEED = 64, 4, 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geno(spark, sf_dir) -> DataFrame:
    return G.from_vectors(table(spark, sf_dir, "embeddings"))


def geno_raw(spark, sf_dir) -> DataFrame:
    """Genotypes with gaps."""
    return geno(spark, sf_dir).withColumn("d", F.expr("CASE WHEN (i * 31 + m * 17) % 23 <> 0 THEN d END"))


def individuals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), "label")


def annot_one(spark) -> DataFrame:
    return spark.range(SNPS).select(F.col("id").alias("m"), F.lit(0).cast("bigint").alias("bin"))


def annot_disjoint(spark) -> DataFrame:
    return spark.range(SNPS).select(F.col("id").alias("m"), (F.col("id") % 2).alias("bin"))


def annot_overlap(spark) -> DataFrame:
    bins = F.expr("filter(array(0L, CASE WHEN id % 2 = 0 THEN 1L END, CASE WHEN id < 16 THEN 2L END), x -> x IS NOT NULL)")
    return spark.range(SNPS).select(F.col("id").alias("m"), F.explode(bins).alias("bin"))


def pheno(spark, sf_dir) -> DataFrame:
    return individuals(spark, sf_dir).select("i", F.col("label").cast("double").alias("y"))


def covariates(spark, sf_dir) -> DataFrame:
    return individuals(spark, sf_dir).select("i", (F.col("i") % 2).cast("double").alias("c0"), ((F.col("i") % 7) - 3).cast("double").alias("c1"), gaussian(7, F.col("i")).alias("c2"))


def environment(spark, sf_dir) -> DataFrame:
    return individuals(spark, sf_dir).select("i", ((F.col("i") % 10) / 10.0 - 0.45).alias("e"))


def simulated(spark, sf_dir, sigma: tuple[float, ...] = (0.5, 0.1)) -> DataFrame:
    """(i, y): a phenotype of two disjoint bins."""
    return phenotype(G.standardize(geno(spark, sf_dir)), annot_disjoint(spark), sigma)
