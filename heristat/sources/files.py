"""Text sources and sinks. Rows of a file are known by their line, not by the ids in it.

A file's lines are numbered by their place in it: by the splits that Spark reads it in, their lines counted first, so that
no task holds more than a split and lines are not shuffled.
"""

from __future__ import annotations

import configparser

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from heristat.functions.rng import _key

FAM = ("fid", "iid", "pat", "mat", "sex", "pheno")
BIM = ("chrom", "snp", "cm", "pos", "a1", "a2")


def lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """(n bigint, line): lines of a file numbered from 0, blank ones left out; with comments, those with # too. The files of a
    folder count as one, in order of their names. The file is read twice: for the lines of each split, of which there is a row
    a split of maxPartitionBytes, and for the lines."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r", "").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    kept = raw.filter("trim(line) <> ''" + (" AND line NOT LIKE '#%'" if comments else "")).withColumn("_at", F.monotonically_increasing_id())  # rises by 1 in a split
    splits = kept.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    ahead = F.coalesce(F.sum("_lines").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = splits.select("_file", "_start", (ahead - F.col("_first")).alias("_ahead"))
    return kept.join(F.broadcast(place), ["_file", "_start"]).select((F.col("_at") + F.col("_ahead")).alias("n"), "line")


def _columns(df: DataFrame, names: tuple[str, ...], key: str) -> DataFrame:
    parts = F.split(F.trim("line"), r"\s+")
    return df.select(F.col("n").alias(key), *(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(names)))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    return _columns(lines(spark, path), FAM, "i").withColumns({"sex": F.expr("try_cast(sex AS INT)"), "pheno": F.expr("try_cast(pheno AS DOUBLE)")})


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    return _columns(lines(spark, path), BIM, "m").withColumns({"cm": F.expr("try_cast(cm AS DOUBLE)"), "pos": F.expr("try_cast(pos AS BIGINT)")})


def count_bim(spark: SparkSession, path: str) -> int:
    """Lines of a .bim file, comments included."""
    return spark.read.text(path).filter("trim(value) <> ''").count()


def read_annot(spark: SparkSession, path: str) -> DataFrame:
    """(m, bin) for every 1 of a file of 0/1 columns; lines with # are comments."""
    parts = lines(spark, path, comments=True).select(F.col("n").alias("m"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("bin", "v"))
    return parts.filter("try_cast(v AS INT) <> 0").select("m", F.col("bin").cast("bigint").alias("bin"))


def read_table(spark: SparkSession, path: str, sentinel: float | None = -9.0) -> DataFrame:
    """Phenotypes, covariates or environments: header FID IID name...; (i, name...) as doubles, NA and the sentinel null."""
    head = spark.read.text(path).first()[0].split()
    rows = _columns(lines(spark, path), tuple(head), "i").filter("i > 0").withColumn("i", F.col("i") - 1)
    number = lambda c: F.expr(f"nullif(try_cast(`{c}` AS DOUBLE), {sentinel}D)") if sentinel is not None else F.expr(f"try_cast(`{c}` AS DOUBLE)")
    return rows.select("i", *(number(c).alias(c) for c in head[2:]))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(i, fid, iid) of a file with a header."""
    return _columns(lines(spark, path), ("fid", "iid"), "i").filter("i > 0").withColumn("i", F.col("i") - 1)


def convert(text: str, default):
    """A setting's text by the type of its default; none is None."""
    if text.strip().lower() == "none":
        return None
    if isinstance(default, bool):
        return text.strip().lower() in ("true", "1", "yes")
    return type(default)(text) if isinstance(default, (int, float)) else text


def read_config(path: str, defaults: dict, section: str | None = None) -> dict:
    """defaults with what a section (none named: the first) of an INI file says."""
    parser = configparser.ConfigParser()
    with open(path) as f:
        parser.read_file(f)
    found = parser[section or parser.sections()[0]]
    return defaults | {k: convert(found[k], defaults[k]) for k in defaults if k in found}


NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_LINES = {
    "sigma": rf"Sigma\^2_(\S+)\s*:\s*{NUMBER}\s+SE\s*:\s*{NUMBER}",
    "h2": rf"(?:h2_(\S+)|(Total) h2|h\^2(?:_i/h\^2_t)? of bin (\d+))\s*:\s*{NUMBER}\s*(?:SE)?\s*:\s*{NUMBER}",
    "enrichment": rf"Enrichment (?:of bin )?(\S+)\s*:\s*{NUMBER}\s+SE\s*:\s*{NUMBER}",
    "runtime": rf"[Rr]untime\s*:\s*{NUMBER}",
}


def parse_reports(text: DataFrame) -> DataFrame:
    """(path, metric, component, value, se) of report texts (path, value); of a component's several lines the first counts."""
    each = text.select("path", F.posexplode(F.split("value", "\n")).alias("at", "line"))
    parts = []
    for metric, pattern in _LINES.items():
        hit = each.filter(F.col("line").rlike(pattern))
        got = lambda i, p=pattern: F.regexp_extract("line", p, i)
        n = {"sigma": (1, 2, 3), "enrichment": (1, 2, 3), "h2": (1, 4, 5), "runtime": (None, 1, None)}[metric]
        name = F.when(got(2) != "", F.lower(got(2))).when(got(3) != "", got(3)).otherwise(got(1)) if metric == "h2" else got(n[0]) if n[0] else F.lit("")
        parts.append(hit.select("path", "at", F.lit(metric).alias("metric"), name.alias("component"), got(n[1]).cast("double").alias("value"), (got(n[2]).cast("double") if n[2] else F.lit(None).cast("double")).alias("se")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = rows.groupBy("path", "metric", "component").agg(F.min(F.struct("at", "value", "se")).alias("f"))
    return first.select("path", "metric", "component", "f.value", "f.se")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return parse_reports(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(path, trait, metric, component, estimate, se) of write_results() files."""
    return spark.read.json(path).select("trait", "metric", "component", "estimate", "se")


def bracketed(component: str) -> str:
    """A component's name as reports have it: g:0 is g[0], a class's total its class."""
    kind, _, rest = component.partition(":")
    return kind if rest in ("", "total") else f"{kind}[{rest.replace(':', ',')}]"


def report(parts: dict[str, list[tuple[str, float, float]]], classes: bool = False, liability: tuple | None = None, runtime: float | None = None) -> str:
    """The text log of a trait, in the grammar that parse_reports() reads. parts has (component, estimate, se) of sigma, h2 (with
    total) and enrichment, and of h2_overlapping and enrichment_overlapping where there are; classes: the gene-environment form
    of h2 lines; liability: heritability, standard error and p-value."""
    se = " SE : " if classes else " : "

    def h2(rows) -> list[str]:
        own = [f"h2_{bracketed(c)} : {x}{se}{e}" for c, x, e in rows if not c.endswith("total")]
        total = [f"Total h2{'' if c == 'total' else '_' + c.split(':')[0]} : {x} SE: {e}" for c, x, e in sorted(rows, key=lambda r: r[0] != "total") if c.endswith("total")]
        return own + total

    def enrichment(rows) -> list[str]:
        return [f"Enrichment {bracketed(c)} : {x} SE : {e}" for c, x, e in rows]

    out = ["Variance components: "] + [f"Sigma^2_{bracketed(c)} : {x}  SE : {e}" for c, x, e in parts["sigma"]]
    out += ["*****", "Heritabilities:", *h2(parts["h2"]), "*****", "Enrichments: ", *enrichment(parts["enrichment"])]
    if "h2_overlapping" in parts:
        out += ["*****", "*****", "Heritabilities and enrichments computed based on overlapping setting", "Heritabilities:", *h2(parts["h2_overlapping"])]
        out += ["Enrichments (overlapping def):", *enrichment(parts["enrichment_overlapping"])]
    if liability:
        out += ["*****", "Liability Scale h2 for binary phenotype:", "Total Liability-scale h2 : {}, SE: {}, p-value: {}".format(*liability)]
    return "\n".join(out + ([f"Runtime: {runtime} seconds"] if runtime is not None else [])) + "\n"


def read_values_by_bin(spark: SparkSession, path: str, bins: int) -> DataFrame:
    """(path, bin, sigma, h2, enrichment, runtime) for bins 0, 1, ... of results kept as one JSON object a file, over many lines:
    sigma_ests_total, h2_total and, perhaps, enrichment_total, in order of bins. An enrichment that isn't there is 0."""
    schema = "sigma_ests_total array<double>, h2_total array<double>, enrichment_total array<double>, runtime double"
    each = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    rows = each.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    at = lambda c: F.get(F.col(c), F.col("bin"))
    return rows.select("path", "bin", at("sigma_ests_total").alias("sigma"), at("h2_total").alias("h2"), F.coalesce(at("enrichment_total"), F.lit(0.0)).alias("enrichment"), "runtime")


def write_summary(spark: SparkSession, folder: str, path: str) -> list[str]:
    """Every report (*.txt) below folder as one JSON object, by file, at path; the files that state no runtime."""
    texts = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = parse_reports(texts)
    entry = F.struct(F.col("component").alias("name"), F.col("value"), F.col("se").alias("SE"))
    of = lambda m: F.array_sort(F.collect_list(F.when(F.col("metric") == m, entry))).alias(m)
    each = texts.select("path").join(rows, "path", "left").groupBy("path").agg(of("sigma"), of("h2"), of("enrichment"), F.max(F.when(F.col("metric") == "runtime", F.col("value"))).alias("runtime"))
    line = F.concat(F.to_json(F.struct("path")).substr(F.lit(9), F.length(F.to_json(F.struct("path"))) - 9), F.lit(": "), F.to_json(F.struct("sigma", "h2", "enrichment", "runtime")))
    whole = each.select(F.struct("path", line.alias("line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("l"))  # a row a report
    whole.select(F.concat(F.lit("{"), F.array_join(F.transform("l", lambda x: x["line"]), ", "), F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return [r.path for r in each.filter("runtime IS NULL").orderBy("path").toLocalIterator()]


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def trace_rows(spark: SparkSession, t: np.ndarray, m: np.ndarray, n: int) -> DataFrame:
    """(j, k, LD_SUM_0..., NSNPS_JACKKNIFE): for every sample and component k a row of the traces with all components, as sums of
    squared correlations, and the SNPs of k in the sample."""
    bins = m.shape[1]
    rows = [(j, k, *(round(float((t[j, k, i] - n) * m[j, k] * m[j, i] / n**2), 3) for i in range(bins)), int(m[j, k])) for j in range(len(t)) for k in range(bins)]
    return spark.createDataFrame(rows, "j int, k int, " + ", ".join(f"LD_SUM_{i} double" for i in range(bins)) + ", NSNPS_JACKKNIFE long")


def write_trace(rows: DataFrame, header: dict[str, int], path: str) -> None:
    """The summary (NSAMPLE, NSNPS, NBLKS, NBINS, K) as path.MN and trace_rows(), by sample and component, as path.tr,
    comma-separated."""
    spark = rows.sparkSession
    spark.createDataFrame([tuple(header.values())], ", ".join(f"{c} long" for c in header)).coalesce(1).write.mode("overwrite").csv(f"{path}.MN", header=True)
    rows.coalesce(1).sortWithinPartitions("j", "k").drop("j", "k").write.mode("overwrite").csv(f"{path}.tr", header=True)


def random_bins(snps: DataFrame, bins: int, seed: int) -> DataFrame:
    """(m, bin): one bin for each SNP by hash."""
    value = F.conv(F.substring(_key(seed, F.col("m")), 1, 8), 16, 10).cast("bigint")
    return snps.select("m", (value % bins).alias("bin"))


def write_annot(annot: DataFrame, bins: int, path: str) -> None:
    """0/1 columns by SNP, in order."""
    hot = annot.groupBy("m").agg(F.collect_set("bin").alias("s"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.when(F.array_contains("s", b.cast("bigint")), "1").otherwise("0")), " ")
    hot.orderBy("m").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_one_hot(hot: DataFrame, path: str) -> None:
    """A row for each individual, a 0/1 column for each level of operators.tables.one_hot()."""
    row = hot.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "hot"))), lambda x: x["hot"].cast("string")), " ").alias("value"))
    row.orderBy("i").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_pheno(pheno: DataFrame, path: str, names: tuple[str, ...] = ("y",)) -> None:
    """FID IID name..., space-separated."""
    pheno.orderBy("i").select(F.col("i").alias("FID"), F.col("i").alias("IID"), *names).coalesce(1).write.mode("overwrite").csv(path, sep=" ", header=True)


def duplicate_last(pheno: DataFrame) -> DataFrame:
    """The last trait once more, as <name>_dup."""
    last = pheno.columns[-1]
    return pheno.withColumn(f"{last}_dup", F.col(last))
