"""Annotation bins and jackknife blocks over SNP indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def block_of(m: Column, n_snps: int, blocks: int) -> Column:
    """Contiguous blocks of n_snps div blocks SNPs; the last also takes the remainder."""
    step = max(1, n_snps // blocks)
    return F.least(F.floor(m / step), F.lit(blocks - 1)).cast("bigint")


def bin_sizes(annot: DataFrame) -> DataFrame:
    return annot.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def into_bins(rows: DataFrame, annot: DataFrame) -> DataFrame:
    """rows (with m) once for each bin of their SNP; bins may overlap."""
    return rows.join(annot, "m")


def counts_left_out(annot: DataFrame, n_snps: int, blocks: int) -> DataFrame:
    """(j, bin, n): SNPs of a bin outside block j; j = blocks counts all. One row for each bin and block, also where a
    block has none of the bin."""
    own = annot.withColumn("j", block_of(F.col("m"), n_snps, blocks)).groupBy("j", "bin").agg(F.count(F.lit(1)).alias("own"))
    grid = annot.select("bin").distinct().crossJoin(annot.sparkSession.range(blocks).select(F.col("id").alias("j")))  # bins x blocks rows
    full = grid.join(own, ["j", "bin"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    total = F.sum("own").over(W.partitionBy("bin"))
    left = full.select("j", "bin", (total - F.col("own")).alias("n"))
    return left.unionByName(bin_sizes(annot).select(F.lit(blocks).cast("bigint").alias("j"), "bin", "n"))


def without_block(annot: DataFrame, block: int, n_snps: int, blocks: int) -> DataFrame:
    """annot without the SNPs of a block; a block beyond the last leaves all in."""
    return annot.filter(block_of(F.col("m"), n_snps, blocks) != block)


def leave_one_out(parts: DataFrame, keys: list[str], value: str, block: str = "j") -> DataFrame:
    """parts, one row for each key and block, with value replaced by the key's total without the row's block."""
    total = F.sum(value).over(W.partitionBy(*keys))
    return parts.select(block, *keys, (total - F.col(value)).alias(value))
