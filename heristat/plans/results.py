"""From estimates (sample j, component k, value) to standard errors, heritabilities and enrichments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def jackknife(estimates: DataFrame, blocks: int, keys: tuple[str, ...] = ("k",), value: str = "value") -> DataFrame:
    """(keys, estimate, se): the full-sample value (j = blocks) and sqrt((J - 1) / J sum (x - mean)^2) of the others."""
    full = F.max(F.when(F.col("j") == blocks, F.col(value)))
    rest = F.when(F.col("j") < blocks, F.col(value))
    return estimates.groupBy(*keys).agg(full.alias("estimate"), F.sqrt((blocks - 1) * F.var_pop(rest)).alias("se"))


def heritability(sigma: DataFrame) -> DataFrame:
    """(j, k, value): each genetic component's share of the variance, and k = 'total'. sigma's k is 'e' for noise."""
    total = F.sum("value").over(W.partitionBy("j"))
    share = sigma.withColumn("value", F.try_divide("value", total)).filter("k <> 'e'")
    return share.unionByName(share.groupBy("j").agg(F.sum("value").alias("value")).select("j", F.lit("total").alias("k"), "value"))


def explained(estimates: DataFrame) -> DataFrame:
    """(j, k, value) of estimates (j, k, value, trace) whose traces differ: what each component but noise, value times trace,
    is of their sum."""
    own = F.col("value") * F.col("trace")
    return estimates.select("j", "k", F.try_divide(own, F.sum(own).over(W.partitionBy("j"))).alias("value")).filter("k <> 'e'")


def overlapping_heritability(sigma: DataFrame, annot: DataFrame, sizes: DataFrame) -> DataFrame:
    """(j, k, value) for bins that share SNPs: a SNP brings sigma_b / M_b for each of its bins b. The sum over SNPs is one
    over bins with co-occurrence counts n(k, b), of SNPs outside block j. sizes is (j, bin, n), annot (m, bin) or, where
    samples leave blocks out, (m, bin, block)."""
    if "block" not in annot.columns:
        annot = annot.withColumn("block", F.lit(-1).cast("bigint"))
    pairs = annot.select("m", "block", F.col("bin").alias("k")).join(annot.select("m", F.col("bin").alias("b")), "m").groupBy("k", "b", "block").agg(F.count(F.lit(1)).alias("own"))
    whole = pairs.groupBy("k", "b").agg(F.sum("own").alias("all_snps"))
    total = sigma.groupBy("j").agg(F.sum("value").alias("all"))
    each = sigma.filter("k <> 'e'").select("j", F.col("k").cast("bigint").alias("b"), "value").join(sizes.select("j", F.col("bin").alias("b"), "n"), ["j", "b"])
    left = each.join(whole, "b").join(pairs.withColumnRenamed("block", "j"), ["k", "b", "j"], "left").withColumn("common", F.col("all_snps") - F.coalesce("own", F.lit(0)))
    return left.groupBy("j", "k").agg(F.sum(F.try_divide(F.col("value") * F.col("common"), F.col("n").cast("double"))).alias("s")).join(total, "j").select("j", F.col("k").cast("string").alias("k"), F.try_divide("s", "all").alias("value"))


def enrichment(h2: DataFrame, sizes: DataFrame) -> DataFrame:
    """(j, k, value): (h_k / h) / (M_k / M); 0 for a bin without SNPs. h2 as from heritability()."""
    whole = h2.filter("k = 'total'").select("j", F.col("value").alias("h"))
    share = sizes.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(W.partitionBy("j")))).select("j", F.col("bin").cast("string").alias("k"), "share")
    return h2.filter("k <> 'total'").join(whole, "j").join(share, ["j", "k"]).select("j", "k", F.coalesce(F.try_divide(F.try_divide("value", "h"), "share"), F.lit(0.0)).alias("value"))


def class_totals(shares: DataFrame) -> DataFrame:
    """(j, k, value) of components k = class:bin, with subtotals 'g:total' and 'gxe:total' and the total over all."""
    kind = F.split("k", ":")[0]
    sub = shares.withColumn("c", kind).filter("c IN ('g', 'gxe')").groupBy("j", "c").agg(F.sum("value").alias("value")).select("j", F.concat("c", F.lit(":total")).alias("k"), "value")
    return shares.unionByName(sub).unionByName(shares.groupBy("j").agg(F.sum("value").alias("value")).select("j", F.lit("total").alias("k"), "value"))


def differences(a: DataFrame, b: DataFrame, keys: list[str], limit: float = 0.1) -> DataFrame:
    """Keys for which two engines' values differ by more than limit."""
    both = a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), keys)
    return both.withColumn("diff", F.abs(F.col("a") - F.col("b"))).filter(F.col("diff") > limit)


def summarize_runs(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, sd, n) of repeated measurements; sd is that of the population."""
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))
