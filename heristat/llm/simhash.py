"""SimHash fingerprints and near-duplicate groups found with BK-trees.

A BK-tree keeps, below each fingerprint, one child per integer Hamming distance; a search for radius r enters only the
edges whose label differs from the distance to the node by at most r. One tree over a whole corpus fits nowhere, so
trees are built per shard. Shards come from the pigeonhole rule: of `blocks` bit blocks of two fingerprints within
`radius` bits, at least blocks - radius agree, so fingerprints meet in a shard for every choice of blocks - radius
blocks, and no link is lost. A shard of several `chunk`s of fingerprints is first cut finer by the same rule. What still is
above a chunk is dealt into chunks; a chunk's tree goes to the tasks that put the later chunks' fingerprints to it, a
stream each, so a task holds one chunk's tree whatever the shard's size. Trees are sent by shuffle, not by a broadcast from
the driver, which must not hold the fingerprints of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from heristat.llm.common import components, hex64, materialize, partitions, quoted, slices, spread_join, utf8, whole

RADIUS, BLOCKS, CHUNK, SEED = 3, 5, 4096, 42
#: Chunks from which a shard is cut finer, and whose queries a task's tree answers at most.
FINER, SPREAD = 4, 16


def simhash(text: bytes, width: int = 3) -> int:
    """Signed 64-bit fingerprint over word shingles of whole text; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _key(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (doc_id, key, fp), key a hash of the text: one per input row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            fps = pa.array([simhash(t, width) for t in utf8(part.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), fps], ["doc_id", "key", "fp"])

    narrow = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), _key(text_col).alias("key"), F.col(quoted(text_col)).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, key long, fp long")


class BKTree:
    """Integers by Hamming distance; nodes are rows of parallel lists."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                break
            at = nxt
        self.values.append(value)
        self.children.append({})

    def search(self, value: int, radius: int) -> list[int]:
        """Positions of the values within radius, in tree order."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


class Forest:
    """Union of small numbered sets."""

    def __init__(self) -> None:
        self.root: list[int] = []

    def top(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        if (a := self.top(x)) == (b := self.top(y)):
            return False
        self.root[a] = b
        return True


def _shard_links(radius: int):
    """Over rows (key, t, part, c, fp, rep) sorted so that a group's tree (c = t) comes before its queries (c > t): the edges
    (u, v) that connect what links in the tree and from the queries to it connect. A group holds its tree and its
    queries' numbers; the tree is built once, and every query follows only the edges within the radius."""
    mask = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        tree, forest, reps = BKTree(), Forest(), []
        out: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            u, v = zip(*out) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for key, t, part, c, fp, rep in zip(*(batch.column(n).to_pylist() for n in ("key", "t", "part", "c", "fp", "rep"))):
                if (key, t, part) != group:
                    group, tree, forest, reps = (key, t, part), BKTree(), Forest(), []
                value, i = fp & mask, len(reps)
                found = tree.search(value, radius)
                if c != t and not found:
                    continue
                forest.root.append(i)
                reps.append(rep)
                out.extend((rep, reps[j]) for j in found if forest.join(i, j))
                if c == t:  # in the tree, positions are numbers of the forest: the tree's come first
                    tree.add(value)
            if len(out) > 50_000:
                yield flush()
        yield flush()

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _spans(bits: list[int], parts: int) -> list[int]:
    """Masks of `parts` runs of the given bits, of about equal length."""
    cuts = [round(len(bits) * i / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def masks(radius: int, blocks: int) -> list[tuple[int, list[int]]]:
    """By the pigeonhole rule two fingerprints within radius bits agree on one of the first masks; and, agreeing there, on one
    of those that go with it, which cut the other bits finer by the same rule."""
    first = _spans(list(range(64)), blocks)
    out = []
    for kept in combinations(first, blocks - radius):
        rest = [b for b in range(64) if not sum(kept) >> b & 1]
        fine = _spans(rest, 2 * radius)
        out.append((_signed(sum(kept)), [_signed(sum(kept) + sum(x)) for x in combinations(fine, radius)]))
    return out


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) between the reps of distinct fingerprints (fp, rep) within radius bits; enough of them to connect
    whatever all links connect.

    A shard of more than FINER chunks is cut again by the bits its key leaves open. What is still above a chunk is dealt
    into chunks; each chunk's tree is built by as many tasks as it takes for none to answer more than SPREAD chunks.
    """
    plan = masks(radius, blocks)
    coarse = F.array(*(F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(m))).alias("key")) for n, (m, _) in enumerate(plan)))
    rows = distinct.select("fp", "rep", F.explode(coarse).alias("x")).select("fp", "rep", "x.n", "x.key")
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    sized = spread_join(rows, sizes, "key", "size")
    fine = F.lit(None)
    for n, (_, more) in enumerate(plan):
        fine = F.when(F.col("n") == n, F.array(*(F.xxhash64(F.col("key"), F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(more)))).otherwise(fine)
    cut = materialize(sized.filter(f"size > {FINER * chunk}").select("fp", "rep", F.explode(fine).alias("key")), "fine")
    again = cut.join(cut.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "key")
    dealt = (
        sized.filter(f"size <= {FINER * chunk}").select("fp", "rep", "key", "size").unionByName(again.select("fp", "rep", "key", "size"))
        .withColumn("k", F.expr(f"CAST(ceil(size / {chunk}D) AS INT)")).withColumn("c", F.expr("CAST(pmod(xxhash64(fp), k) AS INT)"))
        .withColumn("t", F.explode(F.expr("sequence(0, c)"))).withColumn("parts", F.expr(f"greatest(1, (k - 1 - t + {SPREAD - 1}) div {SPREAD})"))
        .withColumn("part", F.explode(F.expr("CASE WHEN c = t THEN sequence(0, CAST(parts AS INT) - 1) ELSE array(CAST(pmod(xxhash64(fp, 7), parts) AS INT)) END")))
        .select("key", "t", "part", "c", "fp", "rep")
    )
    n = partitions(distinct.sparkSession)
    return dealt.repartition(n, "key", "t", "part").sortWithinPartitions("key", "t", "part", "c", "fp").mapInArrow(_shard_links(radius), "u long, v long")


def _named(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Rows (fp, c, component_id, rows) of the distinct fingerprints: c tells components apart, also two of one component_id;
    rows counts the documents of a fingerprint."""
    # nodes are fingerprints, not ids: rows that share an id but not a link stay apart
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius, chunk=chunk))
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("c"))
    return materialize(named.join(named.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fp", "c", "component_id", "rows"), "named")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per input row.

    component_id is the smallest doc_id reachable over links of at most radius bits, the row's own included; ids may be any
    long. Null text: like empty, fingerprint 0. Null doc_id: the row takes part, but only ids that aren't null can name a
    component; it is null where there is none. Texts of any length count whole. Repeated rows: each is returned. No rows:
    no rows. Other columns don't count.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "fps")
    return spread_join(fps, _named(fps, radius, chunk), "fp", "rows").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents whose id names their component, with their columns; rows without doc_id stay. Rows that share a
    doc_id and a component are one document: one of them, the least by its columns in order, stays. Rows that share a
    doc_id alone are told apart by their text. Null and empty texts are one group; no rows: no rows."""
    fps = materialize(fingerprints(docs), "fps")
    own = spread_join(fps, _named(fps), "fp", "rows").filter("doc_id = component_id").groupBy("doc_id", "c", "key").agg(F.count(F.lit(1)).alias("n"))
    own = materialize(own, "own")
    kept = own.drop("n").join(own.groupBy("doc_id", "c").agg(F.sum("n").alias("n")), ["doc_id", "c"])
    rows = docs.select(F.col("doc_id").alias("id"), _key("text").alias("text_key"), whole(docs).alias("row"))
    found = rows.join(kept, (F.col("id") == kept["doc_id"]) & (F.col("text_key") == kept["key"])).select("id", "c", "row", "n")
    several = found.filter("n > 1").groupBy("id", "c").agg(F.min("row").alias("row"))
    return found.filter("n = 1").select("row.*").unionByName(several.select("row.*")).unionByName(docs.filter("doc_id IS NULL"))
