"""Models over files or tables: the public way in."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from heristat.functions.scalar import liability
from heristat.operators import layout as L, tables as T
from heristat.plans import kernel as K, results as R
from heristat.sources import bed, files


@dataclass
class Settings:
    model: str = "rhe"  # rhe, rhe_dom or genie
    genie_model: str = "G+GxE+NxE"
    num_vec: int = 10
    num_bin: int = 8  # of a random annotation where none is given
    num_block: int = 100
    seed: int = 42
    geno_impute_method: str = "binary"
    cov_impute_method: str = "ignore"
    cov_one_hot_conversion: bool = False
    categorical_threshold: int = 100
    samp_prev: float | None = None
    pop_prev: float | None = None
    method: str = "qr"

    def __post_init__(self) -> None:
        if (self.samp_prev is None) != (self.pop_prev is None):
            raise ValueError("samp_prev and pop_prev go together")


@dataclass
class Inputs:
    """snps (m, dosage) with individuals in order of i; annot (m, bin); pheno, cov and env (i, ...)."""

    snps: DataFrame
    n_snps: int
    pheno: DataFrame
    annot: DataFrame | None = None
    cov: DataFrame | None = None
    env: DataFrame | None = None


def from_files(spark: SparkSession, genotype: str, phenotype: str, annotation: str | None = None, covariate: str | None = None, env: str | None = None, flip: bool = True) -> Inputs:
    """genotype is the stem of .bed, .bim and .fam. Lines are matched by place."""
    n, m = files.read_fam(spark, f"{genotype}.fam").count(), files.count_bim(spark, f"{genotype}.bim")
    table = lambda p: files.read_table(spark, p) if p else None
    return Inputs(bed.read(spark, f"{genotype}.bed", n, m, flip=flip), m, files.read_table(spark, phenotype), files.read_annot(spark, annotation) if annotation else None, table(covariate), table(env))


@dataclass
class Result:
    estimates: DataFrame  # trait, j, k, value, trace, n
    sigma: DataFrame  # trait, k, estimate, se
    h2: DataFrame
    enrichment: DataFrame
    overlapping: DataFrame | None = None
    overlapping_enrichment: DataFrame | None = None
    liability: list[tuple] = field(default_factory=list)  # trait's name, heritability, standard error and p-value
    traits: list[str] = field(default_factory=list)
    trace: DataFrame | None = None  # as files.trace_rows() has them
    header: dict[str, int] = field(default_factory=dict)  # of the trace's summary

    def tables(self) -> dict[str, DataFrame]:
        found = {"sigma": self.sigma, "h2": self.h2, "enrichment": self.enrichment, "h2_overlapping": self.overlapping, "enrichment_overlapping": self.overlapping_enrichment}
        return {k: v for k, v in found.items() if v is not None}

    def reports(self, runtime: float | None = None) -> list[str]:
        """The text log of each trait. A component's row a trait comes to the driver."""
        order = {"g": 0, "d": 1, "gxe": 2, "nxe": 3, "e": 4, "total": 5}
        rank = lambda c: (order.get(c.split(":")[0], -1), [int(x) if x.isdigit() else 99 for x in c.split(":")])
        parts: list[dict] = [{} for _ in self.traits]
        for name, df in self.tables().items():
            for p in parts:
                p[name] = []
            for r in df.select("trait", "k", "estimate", "se").toLocalIterator():
                k = f"g:{r.k}" if name.endswith("overlapping") and r.k != "total" else r.k
                parts[r.trait][name].append((k, r.estimate, r.se))
        for p in parts:
            for rows in p.values():
                rows.sort(key=lambda r: rank(r[0]))
        classes = any(k.startswith(("gxe", "g:total")) for p in parts for k, *_ in p["h2"])
        known = {x[0]: x[1:] for x in self.liability}
        return [files.report(p, classes, known.get(t), runtime) for t, p in zip(self.traits, parts)]


def fit(spark: SparkSession, inputs: Inputs, settings: Settings) -> Result:
    """Estimates of all traits at once: the left side doesn't depend on the trait.

    Individuals that lack a trait, or a covariate unless those are mean-imputed, are left out of every table and of the
    genotypes. Individuals' columns come to the driver: a row each.
    """
    traits = [c for c in inputs.pheno.columns if c != "i"]
    frame, names, impute = inputs.pheno, [], settings.cov_impute_method == "mean"
    if inputs.cov is not None:
        cov, names = inputs.cov, [c for c in inputs.cov.columns if c != "i"]
        if impute:
            cov = T.mean_impute(cov, names)
        if settings.cov_one_hot_conversion:
            for c in list(names):
                levels = [r[0] for r in cov.select(c).filter(F.col(c).isNotNull()).distinct().limit(settings.categorical_threshold + 1).collect()]
                if len(levels) <= settings.categorical_threshold:
                    hot = {f"{c}_{n}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for n, v in enumerate(sorted(levels))}
                    cov, names = cov.withColumns(hot).drop(c), [x for x in names if x != c] + list(hot)
        frame = frame.join(cov, "i")
    envs = []
    if settings.model == "genie":
        envs = [c for c in inputs.env.columns if c != "i"]
        frame = frame.join(inputs.env, "i")
    full = frame.orderBy("i").toPandas()
    gone = {r.i for r in T.missing_rows(frame, [*traits, *names, *envs]).toLocalIterator()}
    keep = full[~full.i.isin(gone)]
    rows = spark.sparkContext.broadcast(keep.i.to_numpy())

    def pick(batches):
        import pyarrow as pa

        for b in batches:
            dosage = b.column("dosage")
            out = [dosage[k].values.take(pa.array(rows.value)) for k in range(b.num_rows)]
            flat = pa.concat_arrays(out) if out else pa.array([], pa.int8())
            size = len(rows.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * size), flat)
            yield pa.RecordBatch.from_arrays([b.column("m"), lists], ["m", "dosage"])

    snps = inputs.snps.select("m", F.col("dosage").cast("array<tinyint>").alias("dosage")).mapInArrow(pick, "m long, dosage array<tinyint>") if gone else inputs.snps
    annot = inputs.annot if inputs.annot is not None else files.random_bins(snps.select("m"), settings.num_bin, settings.seed)
    bins = annot.agg(F.max("bin")).first()[0] + 1
    model = settings.genie_model if settings.model == "genie" else settings.model
    study = K.Study(
        keep[traits].to_numpy(float), K.components(model, bins, len(envs)), settings.num_block, settings.num_vec, settings.seed,
        keep[names].to_numpy(float) if names else None, keep[envs].to_numpy(float) if envs else None, settings.geno_impute_method, method=settings.method,
    )
    by_snp = annot.groupBy("m").agg(F.collect_set(F.col("bin").cast("int")).alias("bins"))
    source = snps.join(by_snp, "m", "left").select(L.block_of(F.col("m"), inputs.n_snps, settings.num_block).alias("block"), "m", "dosage", "bins")
    j = settings.num_block
    t, q, m = K.run(spark, source, study)
    found = K.solved(spark, study, t, q, m)
    sigma = R.jackknife(found, j, ("trait", "k"))
    value = found.withColumn("value", F.col("value") * F.col("trace")) if settings.model == "genie" else found
    keyed = value.select(F.concat_ws("/", "trait", "j").alias("j"), "k", "value")  # samples of all traits side by side
    shares = R.heritability(keyed)
    if settings.model == "genie":
        shares = R.class_totals(shares.filter("k <> 'total'"))

    def jack(rows: DataFrame) -> DataFrame:
        at = F.split("j", "/")
        return R.jackknife(rows.select(at[0].cast("int").alias("trait"), at[1].cast("long").alias("j"), "k", "value"), j, ("trait", "k"))

    genetic = shares.filter("k LIKE 'g:%' AND k NOT LIKE '%total'") if settings.model == "genie" else shares.filter("k <> 'total'")
    whole = genetic.unionByName(genetic.groupBy("j").agg(F.sum("value").alias("value")).withColumn("k", F.lit("total")))
    sizes = found.filter("k <> 'e'").select(F.concat_ws("/", "trait", "j").alias("j"), F.col("k").alias("bin"), "n")
    if settings.model == "genie":
        sizes = sizes.filter("bin LIKE 'g:%'")
    rich = R.enrichment(whole, sizes)
    result = Result(found, sigma, jack(shares), jack(rich), traits=traits, trace=files.trace_rows(spark, t, m, len(study.y)))
    result.header = {"NSAMPLE": len(study.y), "NSNPS": inputs.n_snps, "NBLKS": j, "NBINS": int(bins), "K": settings.num_vec}
    if settings.model == "rhe":
        plain = keyed.withColumn("k", F.regexp_replace("k", "^g:", ""))
        blocked = annot.withColumn("block", L.block_of(F.col("m"), inputs.n_snps, j))
        one = [R.overlapping_heritability(plain.filter(F.col("j").startswith(f"{t}/")).withColumn("j", F.split("j", "/")[1].cast("long")), blocked, L.counts_left_out(annot, inputs.n_snps, j)).withColumn("j", F.concat(F.lit(f"{t}/"), "j")) for t in range(len(traits))]
        overlap = one[0]
        for x in one[1:]:
            overlap = overlap.unionByName(x)
        total = overlap.groupBy("j").agg(F.sum("value").alias("value")).select("j", F.lit("total").alias("k"), "value")
        result.overlapping = jack(overlap.unionByName(total))
        left = sizes.withColumn("bin", F.regexp_replace("bin", "^g:", ""))
        result.overlapping_enrichment = jack(R.enrichment(overlap.unionByName(total), left))
    if settings.samp_prev is not None:
        binary = {t for t in traits if T.is_binary(inputs.pheno, [t]).first().is_binary}
        for r in result.h2.filter("k = 'total'").filter(F.col("trait").isin([i for i, t in enumerate(traits) if t in binary])).toLocalIterator():  # a row a trait
            result.liability.append((traits[r.trait], *liability(r.estimate, r.se, settings.samp_prev, settings.pop_prev)))
    return result
