"""Nearest neighbours by cosine with cross-polytope hashing.

A hash applies a pseudo-rotation H D3 H D2 H D1 (fast Hadamard transform H, random sign diagonals D) to the unit vector and
names the nearest signed axis. A table's cell is one such axis after another, the last over fewer coordinates, so that a
cell has about OCCUPANCY vectors whatever their number. A query looks, in every table, into the `probes` cells whose axes
are nearest to it; `probes` is measured: SAMPLE queries are held against all vectors, and the fewest probes that find
AIM of their neighbours are taken.

Vectors that are equal are one, with their smallest ids. What is shuffled by cell is a sketch of 2 bytes a coordinate with
the length of its error. Comparing sketches bounds the cosine from both sides: a candidate is dropped only where its upper
bound is below what the query's (top + 1)th neighbour is known to reach, first in a bounded sample of all vectors, then in
the cells at hand. Those that remain are reranked exactly on the original vectors. A query that finds fewer than asked for
goes through every cell of one table, that is, against all vectors.

Cells travel in groups by their first axis. Groups are dealt into parts by counts that are taken first, so that a
cluster with a third of all vectors, which fall into one group, is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from heristat.llm.common import bounded, materialize, partitions, quoted

TABLES, OCCUPANCY, SEED, TOP = 8, 2, 5, 5
#: Queries held against all vectors to measure recall, the recall aimed at, and most probes tried; beyond, all cells.
SAMPLE, AIM, MOST_PROBES = 128, 0.95, 4096
#: Vectors of a dimension against which a query's floor is found; dimensions, the most frequent, that are measured.
FLOOR_ROWS, DIMENSIONS = 1024, 16
#: Numbers of a part's vectors, and rows rotated at a time.
PART_NUMBERS, BLOCK = 2_000_000, 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        step *= 2
    return x


def width(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def axes(unit: np.ndarray, table: int, axis: int, size: int, seed: int = SEED) -> np.ndarray:
    """Nearness of each row to the 2 x size signed axes of a table's hash: first the positive ones."""
    n, dim = unit.shape
    d = width(dim)
    rng = np.random.default_rng([seed, table, axis, d])
    x = np.zeros((n, d))
    x[:, :dim] = unit
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], d)) / d**0.5
    return np.concatenate([x[:, :size], -x[:, :size]], axis=1)


def sizes(count: int, dim: int) -> list[int]:
    """Coordinates of each of a cell's axes, for count vectors."""
    left, out = count / OCCUPANCY, []
    while left >= 2 and len(out) < 6:
        out.append(min(width(dim), 1 << int(np.log2(left / 2))))
        left /= 2 * out[-1]
    return out or [1]


def cells(unit: np.ndarray, table: int, shape: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cell: its first axis and the number of the others."""
    found = [axes(unit, table, i, m).argmax(axis=1) for i, m in enumerate(shape)]
    rest = np.zeros(len(unit), np.int64)
    for a, m in zip(found[1:], shape[1:]):
        rest = rest * (2 * m) + a
    return found[0], rest


def probe(unit: np.ndarray, table: int, shape: list[int], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The `probes` nearest cells of each row, nearest first, by the sum of nearness to their axes."""
    near = axes(unit, table, 0, shape[0])
    first = np.argsort(-near, axis=1, kind="stable")[:, :probes]
    score, rest = np.take_along_axis(near, first, axis=1), np.zeros_like(first)
    for i, m in enumerate(shape[1:], 1):
        near = axes(unit, table, i, m)
        best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        k, n = best.shape[1], len(unit)
        both = (score[:, :, None] + np.take_along_axis(near, best, axis=1)[:, None, :]).reshape(n, -1)
        pick = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        score = np.take_along_axis(both, pick, axis=1)
        rest = np.take_along_axis(rest, pick // k, axis=1) * (2 * m) + np.take_along_axis(best, pick % k, axis=1)
        first = np.take_along_axis(first, pick // k, axis=1)
    return first, rest


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(batch: pa.RecordBatch, rows: int = BLOCK) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim))
        for at in range(0, part.num_rows, rows):
            yield int(dim), part.slice(at, rows)


def _vectors(docs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vec_id, dim, node, v) of usable vectors: v the bytes of doubles, scaled by a power of two, node its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                if i is None or not x or None in x:
                    continue
                a = np.array(x, np.float64)
                most = np.abs(a).max()
                if np.isfinite(most) and most > 0:  # no square over- or underflows then
                    a = np.ldexp(a, -int(np.frexp(most)[1])) + 0.0
                    ids.append(i), dims.append(len(a)), out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "v"])

    found = docs.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vec_col)).alias("v")).mapInArrow(run, "vec_id long, dim int, v binary")
    return found.select("vec_id", "dim", F.unhex(F.md5("v")).alias("node"), "v")


def _classes(vectors: DataFrame, top: int) -> DataFrame:
    """Rows (dim, node, v, ids): each different vector with its top + 1 smallest ids, packed. A search needs no more of them:
    ties go to smaller ids, and a query leaves out one, its own."""
    own = W.partitionBy("dim", "node").orderBy("vec_id")
    few = vectors.select("dim", "node", "vec_id").distinct().withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= top + 1)
    ids = few.groupBy("dim", "node").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    packed = ids.select("dim", "node", F.col("ids")[0].alias("vec_id"), "ids")
    return vectors.dropDuplicates(["dim", "node", "vec_id"]).join(packed, ["dim", "node", "vec_id"]).select("dim", "node", "v", "ids")


@dataclass
class Index:
    """A dimension's cells and probes (None: all cells), and the sample in which floors are found."""

    shape: list[int]
    probes: int | None
    floor: np.ndarray  # units
    ids: list[list[int]]


def _measured(sample: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """Rows (dim, node, other, score): the top neighbours among nodes, other than itself, of each of sample, exactly."""
    held = {}
    for r in sample.toLocalIterator():  # SAMPLE rows for each of DIMENSIONS at most
        held.setdefault(r.dim, []).append((bytes(r.node), bytes(r.v)))
    asked = nodes.sparkSession.sparkContext.broadcast({d: ([n for n, _ in x], _unit(np.frombuffer(b"".join(v for _, v in x), np.float64).reshape(-1, d))) for d, x in held.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch, 8192):
                if dim not in asked.value:
                    continue
                names, units = asked.value[dim]
                own = part.column("node").to_pylist()
                near = units @ _unit(_matrix(part.column("v"), dim)).T
                rows = [(dim, names[q], own[i], part.column("v")[int(i)].as_py(), float(near[q, i])) for q in range(len(names)) for i in np.argsort(-near[q])[: top + 1] if own[i] != names[q]]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()))], ["dim", "node", "other", "v", "score"])

    found = nodes.mapInArrow(run, "dim int, node binary, other binary, v binary, score double")
    return found.withColumn("nth", F.row_number().over(W.partitionBy("dim", "node").orderBy(F.desc("score"), "other"))).filter(F.col("nth") <= top)


def plan(nodes: DataFrame, queries: DataFrame, top: int, tables: int, probes: int | None) -> dict[int, Index]:
    """An index for each of the DIMENSIONS most frequent dimensions. What the driver sees: SAMPLE queries with their neighbours
    and FLOOR_ROWS vectors of each, all chosen by hash."""
    counts = [(r.dim, r.n) for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(DIMENSIONS).collect()]
    some = lambda df, n: df.filter(F.col("dim").isin([d for d, _ in counts])).withColumn("nth", F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("node"), "node"))).filter(F.col("nth") <= n)
    floors: dict[int, list] = {}
    for r in some(nodes, FLOOR_ROWS).select("dim", "v", "ids").toLocalIterator():
        floors.setdefault(r.dim, []).append((bytes(r.v), r.ids))
    pairs: dict[int, list] = {}
    if probes is None and counts:
        sample = materialize(some(queries.select("dim", "node", "v").dropDuplicates(["dim", "node"]), SAMPLE).select("dim", "node", "v"), "sample")
        near = _measured(sample, nodes, top).select("dim", "node", F.col("v").alias("there"))
        for r in near.join(F.broadcast(sample), ["dim", "node"]).select("dim", "v", "there").toLocalIterator():
            pairs.setdefault(r.dim, []).append((bytes(r.v), bytes(r.there)))
    found = {}
    for dim, n in counts:
        shape, few = sizes(n, dim), floors.get(dim, [])
        units = _unit(np.frombuffer(b"".join(v for v, _ in few), np.float64).reshape(-1, dim))
        found[dim] = Index(shape, probes or _fewest(pairs.get(dim, []), dim, shape, tables), units, [ids for _, ids in few])
    return found


def _fewest(pairs: list[tuple[bytes, bytes]], dim: int, shape: list[int], tables: int) -> int | None:
    """The fewest probes with which AIM of the pairs (query, neighbour) meet in a table."""
    if not pairs:
        return None
    q, v = (_unit(np.frombuffer(b"".join(x), np.float64).reshape(-1, dim)) for x in zip(*pairs))
    most = min(MOST_PROBES, int(np.prod([2.0 * m for m in shape])))
    needed = np.full(len(pairs), most + 1)
    for t in range(tables):
        a, rest = cells(v, t, shape)
        for at in range(0, len(q), 32):
            first, more = probe(q[at : at + 32], t, shape, most)
            hit = (first == a[at : at + 32, None]) & (more == rest[at : at + 32, None])
            needed[at : at + 32] = np.minimum(needed[at : at + 32], np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, most + 1))
    enough = int(np.sort(needed)[int(np.ceil(AIM * len(needed))) - 1])
    return enough if enough <= most else None


# --- cells ----------------------------------------------------------------------------------------------------------

CELL = "dim int, t int, a int, node binary, ids binary, rest binary, sketch binary, error double, floor double"
_CELL = pa.schema([("dim", pa.int32()), ("t", pa.int32()), ("a", pa.int32()), ("node", pa.binary()), ("ids", pa.binary()), ("rest", pa.binary()), ("sketch", pa.binary()), ("error", pa.float64()), ("floor", pa.float64())])


def sketch(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' coordinates as whole multiples of their largest / 32767, that number before them as a float, and the lengths of
    what is lost, rounded up."""
    step = (np.abs(unit).max(axis=1, keepdims=True) / 32767).astype("<f4").astype(float)
    level = np.clip(np.round(unit / step), -32767, 32767)
    lost = np.sqrt(((unit - level * step) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return np.concatenate([step.astype("<f4").view("<i2"), level.astype("<i2")], axis=1), lost


def unsketch(raw: list[bytes]) -> np.ndarray:
    both = np.frombuffer(b"".join(raw), "<i2").reshape(len(raw), -1)
    return both[:, 2:] * np.ascontiguousarray(both[:, :2]).view("<f4").astype(float)


def kth_distinct(score: np.ndarray, ids: list[list[int]], k: int) -> float:
    """The score that k distinct ids reach; -2 where there are fewer."""
    if len(score) >= k:
        seen: set[int] = set()
        m = k
        while True:
            part = np.argpartition(-score, m - 1)[:m] if m < len(score) else np.arange(len(score))
            seen.clear()
            for i in part[np.argsort(-score[part], kind="stable")].tolist():
                seen.update(ids[i])
                if len(seen) >= k:
                    return float(score[i])
            if m >= len(score):
                break
            m = min(2 * m, len(score))
    seen = set()
    for i in np.argsort(-score, kind="stable").tolist():
        seen.update(ids[i])
        if len(seen) >= k:
            return float(score[i])
    return -2.0


def _pack(ids) -> bytes:
    return np.array(ids, "<i8").tobytes()


def _stored(index, tables: range):
    """nodes to a row for each table: the cell of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch):
                unit = _unit(_matrix(rows.column("v"), dim))
                flat, lost = sketch(unit)
                n, shape = len(unit), index.value[dim].shape if dim in index.value else [1]
                raw, ids = pa.array([x.tobytes() for x in flat], pa.binary()), pa.array([_pack(x) for x in rows.column("ids").to_pylist()], pa.binary())
                for t in tables:
                    a, rest = cells(unit, t, shape)
                    yield pa.RecordBatch.from_arrays([
                        rows.column("dim"), pa.array(np.full(n, t), pa.int32()), pa.array(a.astype(np.int32)), rows.column("node"), ids,
                        pa.array([x.tobytes() for x in rest.astype("<i8")], pa.binary()), raw, pa.array(lost), pa.nulls(n, pa.float64())], schema=_CELL)

    return run


def _asked(index, tables: range, top: int, everywhere: bool):
    """queries (dim, node, v) to a row for each table and first axis: the other axes' numbers of the cells they look into (none:
    all), and the cosine that top + 1 ids are known to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch, 64):
                unit, own = _unit(_matrix(rows.column("v"), dim)), rows.column("node").to_pylist()
                flat, lost = sketch(unit)
                at = index.value.get(dim)
                floor = [kth_distinct(s, at.ids, top + 1) - 1e-9 for s in unit @ at.floor.T] if at else [-2.0] * len(unit)
                out = []
                for t in tables if at and at.probes and not everywhere else tables[:1]:
                    if at is None or at.probes is None or everywhere:
                        groups = [(i, a, b"") for i in range(len(unit)) for a in range(2 * (at.shape if at else [1])[0])]
                    else:
                        first, rest = probe(unit, t, at.shape, at.probes)
                        groups = [(i, int(a), np.sort(rest[i][first[i] == a]).astype("<i8").tobytes()) for i in range(len(unit)) for a in np.unique(first[i])]
                    out += [(dim, t, a, own[i], None, rest, flat[i].tobytes(), float(lost[i]), floor[i]) for i, a, rest in groups]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CELL)], schema=_CELL)

    return run


FOUND = "dim int, node binary, other binary, compared long"


def _best(top: int):
    """Over rows of CELL and (qp, vp, kind), sorted so that a part's vectors (kind 0), by cell, come before its queries (kind
    1): the vectors that may be among a query's top + 1, and how many it was compared with (in a row without other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vectors = None, None
        held: list[tuple] = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["dim", "node", "other", "compared"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "t", "a", "qp", "vp", "kind"))))
            rows = zip(keys, *(batch.column(c).to_pylist() for c in ("node", "ids", "rest", "sketch", "error", "floor")))
            for k, node, ids, rest, raw, error, floor in rows:
                if k[:5] != key:
                    key, vectors, held = k[:5], None, []
                if k[5] == 0:
                    held.append((int.from_bytes(rest, "little"), node, np.frombuffer(ids, "<i8").tolist(), raw, error))
                    continue
                if not held:
                    continue
                if vectors is None:
                    held.sort(key=lambda x: x[0])
                    vectors = np.array([x[0] for x in held]), unsketch([x[3] for x in held]), np.array([x[4] for x in held])
                where, x, lost = vectors
                if rest:
                    wanted = np.frombuffer(rest, "<i8")
                    lo, hi = np.searchsorted(where, wanted), np.searchsorted(where, wanted, side="right")
                    pick = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
                    if not len(pick):
                        continue
                else:
                    pick = np.arange(len(where))
                out.append((k[0], node, None, len(pick)))
                near = x[pick] @ unsketch([raw])[0]
                off = lost[pick] + error * (1 + lost[pick]) + 1e-9
                least = max(floor, kth_distinct(near - off, [held[i][2] for i in pick], top + 1) if len(pick) > top else -2.0)
                out.extend((k[0], node, held[i][1], 0) for i in pick[near + off >= least].tolist())
                if len(out) > 20_000:
                    yield flush()
        yield flush()

    return run


def _look(nodes: DataFrame, queries: DataFrame, index, tables: range, top: int, part: int, everywhere: bool) -> DataFrame:
    stored = nodes.mapInArrow(_stored(index, tables), CELL)
    asked = materialize(queries.mapInArrow(_asked(index, tables, top, everywhere), CELL), "asked")
    own = ["dim", "t", "a"]
    count = lambda df, name: df.groupBy(*own).agg(F.expr(f"CAST(ceil(count(1) / greatest(16D, floor({part}D / dim))) AS INT)").alias(name))
    parts = bounded(materialize(count(stored.select(*own), "vps").join(count(asked.select(*own), "qps"), own), "parts"))
    deal = lambda df, mine, other, kind: (
        df.join(parts, own).withColumn(mine, F.expr(f"CAST(pmod(xxhash64(node), {mine}s) AS INT)")).withColumn(other, F.explode(F.expr(f"sequence(0, {other}s - 1)")))
        .select(*own, "qp", "vp", F.lit(kind).alias("kind"), "node", "ids", "rest", "sketch", "error", "floor")
    )
    rows = deal(stored, "vp", "qp", 0).unionByName(deal(asked, "qp", "vp", 1))
    group = [*own, "qp", "vp"]
    return rows.repartition(partitions(nodes.sparkSession), *group).sortWithinPartitions(*group, "kind").mapInArrow(_best(top), FOUND)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, rows in _by_dim(batch, 8192):
            q, v = _matrix(rows.column("q"), dim), _matrix(rows.column("v"), dim)
            score = (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([rows.column("dim"), rows.column("node"), rows.column("ids"), pa.array(score)], ["dim", "node", "ids", "score"])


def neighbours(vecs: DataFrame, is_query, top: int = TOP, tables: int = TABLES, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", part: int = PART_NUMBERS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score, compared): for each id for which is_query (a Column over vec_id) holds, its `top`
    nearest found, nearest first, ties to the smaller vec_id; compared counts the vectors that its sketch was held against,
    those met in several tables each time.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and rows without id, take no part. Vectors
    meet only vectors of their length. Rows that repeat an id are one candidate, the nearest; no query is its own. No rows:
    no rows. Other columns don't count. probes None: as many as a bounded sample needs.
    """
    spark = vecs.sparkSession
    vectors = materialize(_vectors(vecs, id_col, vec_col), "vectors")
    nodes = materialize(_classes(vectors, top), "nodes")
    asking = materialize(vectors.filter(is_query).select("dim", "node", F.col("vec_id").alias("query_id")).distinct(), "asking")
    queries = nodes.join(asking.select("dim", "node").distinct(), ["dim", "node"]).select("dim", "node", "v")
    queries = materialize(queries, "queries")
    index = spark.sparkContext.broadcast(plan(nodes, queries, top, tables, probes))  # bounded by SAMPLE, FLOOR_ROWS and DIMENSIONS

    def reranked(found: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of the candidates, exactly."""
        pairs = found.filter("other IS NOT NULL").select("dim", "node", "other").distinct()
        whole = pairs.join(nodes.select("dim", F.col("node").alias("other"), "v", "ids"), ["dim", "other"]).join(queries.select("dim", "node", F.col("v").alias("q")), ["dim", "node"])
        scored = whole.select("dim", "node", "q", "v", "ids").mapInArrow(_exact, "dim int, node binary, ids array<bigint>, score double")
        each = scored.join(asking, ["dim", "node"]).select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
        return each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    found = materialize(_look(nodes, queries, index, range(tables), top, part, False), "found")
    scored = materialize(reranked(found), "scored")
    enough = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {int(top)}")
    short = materialize(queries.join(asking.join(enough, "query_id", "left_anti").select("dim", "node").distinct(), ["dim", "node"]), "short")
    if not short.isEmpty():
        again = materialize(_look(nodes, short, index, range(1), top, part, True), "again")
        found = found.unionByName(again)
        scored = scored.unionByName(reranked(again)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    compared = found.groupBy("dim", "node").agg(F.sum("compared").alias("compared")).join(asking, ["dim", "node"]).groupBy("query_id").agg(F.sum("compared").alias("compared"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {int(top)}")
    return best.join(compared, "query_id").select("query_id", "rank", "vec_id", "score", "compared")


def query(embeddings: DataFrame) -> DataFrame:
    return neighbours(embeddings, F.col("vec_id") % 50 == 0)
