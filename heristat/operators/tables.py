"""Phenotype, covariate and environment operators over rows keyed by i."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def missing_rows(table: DataFrame, columns: list[str], sentinel: float | None = -9.0) -> DataFrame:
    """The i of rows that lack any of columns: null, NaN or the sentinel."""

    def gone(c: str) -> Column:
        v = F.col(c).cast("double")
        return v.isNull() | F.isnan(v) | ((v == sentinel) if sentinel is not None else F.lit(False))

    return table.filter(reduce(lambda a, b: a | b, map(gone, columns))).select("i")


def is_binary(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row (is_binary): whether each known value of each trait is 0, 1 or 2."""
    fine = [F.coalesce(F.bool_and(F.col(c).isin(0, 1, 2, -9) | F.col(c).isNull()), F.lit(True)) for c in columns]
    return table.agg(reduce(lambda a, b: a & b, fine).alias("is_binary"))


def centre(pheno: DataFrame, key: str = "trait", value: str = "y") -> DataFrame:
    """pheno with each trait's mean taken off. The mean is an aggregate joined back, so no trait sits in one task."""
    means = pheno.groupBy(key).agg(F.avg(value).alias("_mean"))
    return pheno.join(F.broadcast(means), key).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")  # a row a trait


def mean_impute(table: DataFrame, columns: list[str], sentinel: float = -9.0) -> DataFrame:
    """Nulls, NaN and the sentinel become their column's mean over the rest."""
    known = {c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) == sentinel), None).otherwise(F.col(c)) for c in columns}
    clean = table.withColumns(known)
    means = clean.agg(*(F.avg(c).alias(f"_{c}") for c in columns))  # one row
    return clean.crossJoin(F.broadcast(means)).select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in table.columns))


def z_score(table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by their mean and sample standard deviation; one that doesn't vary becomes null."""
    stats = table.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))  # one row
    return table.crossJoin(F.broadcast(stats)).select(*(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) if c in columns else F.col(c) for c in table.columns))


def one_hot(table: DataFrame, column: str, max_levels: int = 100) -> DataFrame:
    """(i, level, hot) for every row and level of a column of at most max_levels distinct values; no rows otherwise."""
    levels = table.select(F.col(column).alias("level")).filter("level IS NOT NULL").distinct()
    n = W.partitionBy()
    few = levels.limit(max_levels + 1).withColumn("_n", F.count(F.lit(1)).over(n)).filter(F.col("_n") <= max_levels).drop("_n")
    return table.select("i", F.col(column).alias("_v")).crossJoin(F.broadcast(few)).select("i", "level", F.when(F.col("_v") == F.col("level"), 1).otherwise(0).alias("hot"))


def gram(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Sums of products of columns, one aggregation; comes to the driver as len(left) x len(right) numbers."""
    got = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"_{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right))).first()
    return np.array([x or 0.0 for x in got], float).reshape(len(left), len(right))


def rank(rows: DataFrame, columns: list[str]) -> int:
    """Rank of the columns as a matrix, from their products."""
    return int(np.linalg.matrix_rank(gram(rows, columns, columns), hermitian=True))


def residualize(rows: DataFrame, covariates: list[str], value: str = "y") -> DataFrame:
    """rows with value - C (C'C)^+ C' value; no intercept is added."""
    beta = np.linalg.pinv(gram(rows, covariates, covariates)) @ gram(rows, covariates, [value])[:, 0]
    fitted = reduce(lambda a, b: a + b, (F.lit(float(k)) * F.col(c) for k, c in zip(beta, covariates)))
    return rows.withColumn(value, F.col(value) - fitted)


def project(columns: DataFrame, covariates: DataFrame, names: list[str], value: str, keys: list[str]) -> DataFrame:
    """columns (keys, i, value) with value replaced by its projection C (C'C)^+ C' value on the covariates (i, names...). A key
    has len(names) numbers; what is joined back to the individuals is a row for each key."""
    inverse = np.linalg.pinv(gram(covariates, names, names))
    part = columns.join(covariates, "i").groupBy(*keys).agg(*(F.sum(F.col(value) * F.col(c)).alias(f"_s{n}") for n, c in enumerate(names)))
    fitted = reduce(lambda a, b: a + b, (F.lit(float(inverse[a, b])) * F.col(names[a]) * F.col(f"_s{b}") for a in range(len(names)) for b in range(len(names))))
    return columns.select("i", *keys).join(covariates, "i").join(part, keys).select("i", *keys, fitted.alias(value))
