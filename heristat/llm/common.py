"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_OWN: list[str] = []
#: Tables stored since the innermost stored() began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)

HOT_KEYS = 10_000

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spelling of the word pattern for SQL string literals and Java regexes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one, if all is one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="heristat-"))
    return f"file://{_OWN[0]}"


def own_dir(spark: SparkSession) -> str:
    """What this application stores in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/heristat/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path, was = shared_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # once written, the shuffle files behind it serve nothing
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return path, spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that outlives its executors."""
    path, found = _write(df, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return found


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """make()'s rows as a stored table and its path. The tables that make() stored on its way are deleted."""
    made: list[str] = []
    before = _MADE.set(made)
    try:
        path, found = _write(make(), name)
    finally:
        _MADE.reset(before)
        for p in made:
            drop_path(spark, p)
    if (outer := _MADE.get()) is not None:
        outer.append(path)
    return found, path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote to the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete every table this application stored in the shared folder; results not yet read are gone with them."""
    drop_path(spark, own_dir(spark))


def quoted(name: str) -> str:
    """A column's name as SQL has it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def whole(df: DataFrame) -> Column:
    """A row's columns as one, whatever their names."""
    return F.struct(*columns(df))


def plain(df: DataFrame) -> DataFrame:
    """df with names that mapInArrow takes: others than words are replaced."""
    names, taken = [], set(df.columns)
    for c in df.columns:
        new = re.sub(r"\W", "_", c)
        while new != c and new in taken:
            new += "_"
        names.append(new)
        taken.add(new)
    return df.toDF(*names)


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast df, a stored table of small rows, if it has at most so many; else leave the join to Catalyst."""
    return F.broadcast(df) if df.count() <= rows else df


def spread_join(many: DataFrame, few: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """many joined with few, a stored table with a row for each key and in its column n how many rows of many have it.

    Keys with more than 1 / HOT_KEYS of all rows, fewer than HOT_KEYS therefore, are broadcast; the others have no hot key.
    """
    total = few.agg(F.sum(n)).first()[0] or 0
    hot = materialize(few.filter(F.col(n) > max(1000, total // HOT_KEYS)), "hot")
    if hot.isEmpty():
        return many.join(few, key, how)
    named = many.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    some = many.join(F.broadcast(hot), key)
    rest = named.filter("_hot IS NULL").drop("_hot").join(few.join(F.broadcast(hot.select(key)), key, "left_anti"), key, how)
    return some.unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column's values come to about limit bytes in each piece; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> list[bytes]:
    """Values as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hex64(column) -> F.Column:
    """A signed long's bits as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u, v), both long and never null: rows (node, component), the component
    being its smallest node. Isolated nodes don't appear.

    Alternates large-star and small-star steps; each is a min-aggregation and a join, so a node with very many
    neighbours is pre-aggregated in the map tasks and its join partition can be split by AQE; no neighbour list is ever
    collected. Every round is written to the shared folder, which bounds the lineage.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # every neighbour above a node moves to the node's least neighbour
            both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))  # here u > v always
        moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now, path = stored(spark, "edges", lambda: edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = state(now)
    for _ in range(max_rounds if was[0] else 0):
        old = path
        now, path = stored(spark, "edges", lambda e=now: star(star(e, True), False))
        drop_path(spark, old)
        if (found := state(now)) == was:
            break
        was = found
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct()).groupBy("node").agg(F.min("component").alias("component"))
