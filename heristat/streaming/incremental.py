"""Incremental ingest: SNP blocks that arrive as a stream add to stored totals.

Pass 1 of plans.kernel is a sum over SNPs, so a micro-batch of new SNP rows adds its own sums. A batch's sums are written
under its number; a batch that is replayed replaces its own folder, so totals stay exact whatever is retried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from heristat.plans import kernel as K


def add_batches(path: str, statistics):
    """A foreachBatch function: statistics(batch) -> (keys..., value) rows, stored as path/batch=<n>."""

    def run(batch: DataFrame, number: int) -> None:
        statistics(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def totals(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum(value).alias(value))


def add_snps(path: str, study: K.Study):
    """A foreachBatch function for SNP rows (block, m, dosage, bins): their sums for the kernel, N x B numbers a component."""
    return add_batches(path, lambda batch: K.sums(batch, study))


def equations(spark: SparkSession, path: str, study: K.Study) -> tuple[np.ndarray, np.ndarray]:
    """T and q of all SNPs that came so far; sums of batches are added up on the executors."""
    return K.whole_sample(study, *K.gathered(K.added(spark.read.parquet(path).drop("batch")), study))
