"""python -m heristat.cli --genotype stem --phenotype file ...: fit a model; its text log goes to --output, one part a trait, its
results as JSON lines to <output>.json, and with --trace its traces to <trace_dir>/run_<phenotype>.MN and .tr."""

from __future__ import annotations

import argparse
import os
import time
from dataclasses import fields

import numpy as np
from pyspark.sql import SparkSession, functions as F

from heristat import models
from heristat.sources import files

_SHORT = {"num_vec": ["-k"], "num_bin": ["-b"], "num_block": ["-jn"], "seed": ["-s"], "categorical_threshold": ["--categorical_threshhold"]}
_CHOICES = {"model": ("rhe", "genie", "rhe_dom"), "genie_model": ("G", "G+GxE", "G+GxE+NxE"), "geno_impute_method": ("binary", "mean", "zero"), "cov_impute_method": ("ignore", "mean")}
#: Repeats of --benchmark_runtime, each with a phenotype file of its own.
REPEATS = 3


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    for short, name in (("-g", "genotype"), ("-p", "phenotype"), ("-annot", "annotation"), ("-c", "covariate"), ("-e", "env")):
        p.add_argument(f"--{name}", short)
    p.add_argument("--output", "-o", default="heristat.out")
    p.add_argument("--config", help="INI file; its settings go before the command line's")
    p.add_argument("--trace", "-tr", action="store_true", help="write the traces")
    p.add_argument("--trace_dir", default="", help="folder of the traces")
    p.add_argument("--streaming", action="store_true", help="accepted; genotypes are always streamed by block")
    p.add_argument("--benchmark_runtime", action="store_true", help=f"time {REPEATS} fits on <phenotype>/pheno[_with_cov]/bin_<num_bin>/<i>.phen")
    p.add_argument("--num_workers", type=int, default=8, help="tasks at a time, where no cluster is set")
    p.add_argument("--suppress", action="store_true", help="don't print the log")
    p.add_argument("--debug", action="store_true", help="print the settings too")
    for f in fields(models.Settings):
        names = [f"--{f.name}", *_SHORT.get(f.name, [])]
        if isinstance(f.default, bool):
            p.add_argument(*names, nargs="?", const=True, type=lambda x: x.lower() in ("true", "1", "yes"), default=f.default)
        else:
            p.add_argument(*names, type=float if "prev" in f.name else type(f.default), default=f.default, choices=_CHOICES.get(f.name))
    return p


def fit(spark: SparkSession, args: dict) -> tuple[models.Result, float]:
    """The result and the seconds until its estimates were there."""
    began = time.time()
    inputs = models.from_files(spark, *(args[k] for k in ("genotype", "phenotype", "annotation", "covariate", "env")))
    result = models.fit(spark, inputs, models.Settings(**{f.name: args[f.name] for f in fields(models.Settings)}))
    return result, time.time() - began


def benchmark(spark: SparkSession, args: dict) -> str:
    folder = os.path.join(args["phenotype"], "pheno_with_cov" if args["covariate"] else "pheno", f"bin_{args['num_bin']}")
    took = [fit(spark, args | {"phenotype": os.path.join(folder, f"{i}.phen")})[1] for i in range(REPEATS)]
    return f"runtime: {np.mean(took):.2f} ± {np.std(took):.2f} seconds"


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    if args["config"]:
        args = files.read_config(args["config"], args)
    builder = SparkSession.builder.appName("heristat")
    if "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.config("spark.default.parallelism", args["num_workers"])
    spark = builder.getOrCreate()
    if args["benchmark_runtime"]:
        print(benchmark(spark, args))
        return
    result, took = fit(spark, args)
    rows = None
    for metric, df in result.tables().items():
        own = df.select("trait", F.lit(metric).alias("metric"), F.col("k").alias("component"), "estimate", "se")
        rows = own if rows is None else rows.unionByName(own)
    files.write_results(rows, f"{args['output']}.json")
    texts = result.reports(took)
    if args["debug"]:
        texts = ["\n".join(f"{k}: {v}" for k, v in args.items()) + "\n" + texts[0], *texts[1:]]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "trait int, value string").write.mode("overwrite").partitionBy("trait").text(args["output"])
    if args["trace"]:
        files.write_trace(result.trace, result.header, os.path.join(args["trace_dir"], f"run_{os.path.basename(args['phenotype'])}"))
    if not args["suppress"]:
        print("\n".join(texts))


if __name__ == "__main__":
    main()
