"""From raw documents to packed training sequences; part of heristat.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heristat.llm import mixing, packing, secrets, simhash, toxicity
from heristat.llm.common import drop_path, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The model is fitted on the labelled rows among docs; without labels all stay. Rows of null or empty
    text stay, repeated rows go or stay alike, a table without rows gives none."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one document stays: that of the smallest doc_id. Null and empty texts are one group; rows without
    doc_id stay; of repeated rows one stays; a table without rows gives none."""
    return simhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated and null ones as they are; secrets in it are blanked. A table without rows gives none."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, shard by shard. A null source is a source; documents without
    words weigh nothing; repeated rows are documents of their own; a table without rows gives none."""
    return mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece with its sequence and offset. Null and empty texts have one piece; texts of any length are
    packed whole, repeated rows each; a table without rows gives none."""
    return packing.query(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Trained, hashed and tokenized stages aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are stored, and read by the next; what a stage stored on its way is deleted when its rows are, and these
    when the next stage's are. What the last stage reads stays until common.clean()."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
