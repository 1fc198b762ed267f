"""Packing token pieces into fixed-length sequences by the linear grouping scheme.

There are at most `capacity` distinct piece lengths, so the histogram of lengths, whatever the corpus, has at most
`capacity` numbers. The driver plans on that histogram alone:

1. Lengths above `small` are sorted, dealt into groups of equal cardinality and rounded up to their group's largest.
2. Few distinct sizes remain. Configurations (multisets that fit) are optimised by column generation: a linear program
   over counts of configurations, priced by an integer knapsack; its solution is rounded down.
3. Actual lengths take the places of rounded ones: the longest left that the rounded size holds, and in a sequence's last
   place the longest left that still fits, as rounding up left room. What rounding down left over, and the small
   lengths, go best-fit, longest first, into the fullest sequence that holds them, or else a new one.

The plan is a list of (lengths of a sequence, how many such sequences). Pieces are ranked within their length in a
distributed way, and rank r of a length takes that length's r-th place.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from heristat.llm.common import materialize, partitions, plain, quoted, slices

CAPACITY, END_ID, TOKENIZER = 1024, 2, "byte_bpe_50k"
#: Pieces up to a quarter of the capacity are small; the others are dealt into so many groups.
SMALL, GROUPS = 256, 64

#: Where a text longer than STRETCH may be cut without a change of its ids: before a single space between two other characters
#: than white space. By the tokenizer's pattern nothing but white space has a space in it or behind its first place, and a
#: single space goes with what follows it. Python's white space includes the tokenizer's.
STRETCH, SEAM = 1 << 20, re.compile(r"(?<=\S) (?=\S)")

PIECE = "piece int, start long, length int, ids_crc32 long"


# --- tokens ---------------------------------------------------------------------------------------------------------


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """text in parts of about size characters, each cut at a seam; whole where it has none."""
    at = 0
    while len(text) - at > size and (seam := SEAM.search(text, at + size)):
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:] if at else text


def load_encoder(name: str = TOKENIZER):
    """A function from text to its ids, a uint32 array: those of tokenizers on <name>.json without added special tokens.

    Most are computed with tiktoken on the same vocabulary, four to five times as fast; the tests hold them against
    tokenizers. As there, <|endoftext|> in a text is its own id. What tiktoken's pattern can't take, runs of white space
    near 10^6, goes to tokenizers itself. Long texts go through in stretches, which bounds memory.
    """
    import base64

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    end_of_text = "<|endoftext|>"
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end_of_text: len(ranks)})
    loaded: list[Tokenizer] = []

    def encode(part: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(part, allowed_special={end_of_text})
        except ValueError:
            if not loaded:
                loaded.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return np.array(loaded[0].encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32)

    return lambda text: np.concatenate([encode(part).astype("<u4") for part in stretches(text)])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): a document's ids with end_id, whole if they fit, else cut into
    pieces of `capacity` of which the first holds the remainder. Null text counts as empty; an empty text is one piece, of
    end_id alone. Repeated rows and rows without id are documents of their own. No rows, no pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = load_encoder(tokenizer), np.array([end_id], "<u4")
        for part in slices(batches, "text", 2 << 20):
            at, cols = [], ([], [], [], [])
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = np.concatenate([encode(text or ""), end])
                cut = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cut, cut[1:])):
                    at.append(i)
                    for col, x in zip(cols, (k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        col.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, {PIECE}")


# --- the plan -------------------------------------------------------------------------------------------------------


def group_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(rounded size, cardinality) of equal-cardinality groups of the sorted items; neighbours of one size are merged."""
    total, out, seen, k = sum(counts.values()), [], 0, 1
    for size in sorted(counts):
        left = counts[size]
        while left:
            room = -(-total * k // groups) - seen  # to the end of group k
            take = min(left, room)
            seen, left = seen + take, left - take
            if out and out[-1][2] == k:
                out[-1] = (size, out[-1][1] + take, k)
            elif take:
                out.append((size, take, k))
            k += take == room
    merged: dict[int, int] = {}
    for size, n, _ in out:
        merged[size] = merged.get(size, 0) + n
    return sorted(merged.items())


def _best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Unbounded integer knapsack: the configuration of most worth."""
    width, best, pick = np.array(sizes), np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(min(sizes), capacity + 1):
        fits = int(np.searchsorted(width, c, side="right"))
        value = best[c - width[:fits]] + worth[:fits]
        i = int(value.argmax())
        best[c], pick[c] = (value[i], i) if value[i] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    got, c = [0] * len(sizes), capacity
    while c >= min(sizes):
        if pick[c] < 0:
            c -= 1
        else:
            got[pick[c]] += 1
            c -= sizes[pick[c]]
    return best[capacity], got


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Configurations and whole counts of them that use no more than the demand: the linear program's optimum, rounded down."""
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, column = _best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9:
            break
        x, d = inverse @ need, inverse @ np.array(column, float)
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x, left, out = np.linalg.inv(basis) @ need, np.array(demand), []
    for j in np.argsort(-x):
        column = basis[:, j].round().astype(int)
        n = int(min([int(np.floor(x[j] + 1e-9)), *(left[i] // column[i] for i in range(m) if column[i])]))
        if n > 0:
            out.append((column.tolist(), n))
            left -= n * column
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that use each length exactly as often as the histogram has it."""
    done: list[tuple[tuple[int, ...], int]] = []
    counts = {int(k): int(v) for k, v in histogram.items() if v}
    if counts.get(capacity):
        done.append(((capacity,), counts.pop(capacity)))
    large, rest = {k: v for k, v in counts.items() if k > small}, {k: v for k, v in counts.items() if k <= small}
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if gap == 0:
            done.append((lengths, n))
            return
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((lengths, n))

    if large:
        grouped = group_sizes(large, groups)
        sizes, demand = [s for s, _ in grouped], [n for _, n in grouped]
        have, ready = dict(counts), sorted(counts)
        for column, n in configurations(sizes, demand, capacity):
            slots = [s for g, s in reversed(list(enumerate(sizes))) for _ in range(column[g])]
            while n:  # runs of sequences that get the same actual lengths
                lengths, gap = [], capacity
                for k, rounded in enumerate(slots):
                    most = gap if k + 1 == len(slots) else min(rounded, gap)
                    at = bisect_right(ready, most) - 1
                    while at >= 0 and lengths.count(ready[at]) >= have[ready[at]]:
                        at -= 1
                    if at < 0:
                        break
                    lengths.append(ready[at])
                    gap -= ready[at]
                if len(lengths) < len(slots):
                    break
                step = min([n, *(have[x] // k for x, k in Counter(lengths).items())])
                put(tuple(lengths), step)
                n -= step
                for x in lengths:
                    have[x] -= step
                for x in set(lengths):
                    if not have[x]:
                        ready.remove(x)
        rest = {x: have[x] for x in ready}
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                    n %= each
                else:
                    put((length,) * n, 1)
                    n = 0
                continue
            gap = gaps[at]
            lengths, have = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            take = min(n, have)
            if take < have:
                put(lengths, have - take)
            put((*lengths, length), take)
            n -= take
    return done + [x for gap in gaps for x in open_[gap]]


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for lengths, n in bins:
        offset = 0
        for length in lengths:
            rank = ranks.get(length, 0)
            runs.setdefault(length, []).append((rank, first, offset))
            ranks[length] = rank + n
            offset += length
        first += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


# --- assignment -----------------------------------------------------------------------------------------------------


def pack(cut: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """cut (with columns length <= capacity, no _deal) plus sequence_id and offset (long).

    The pieces are stored with a deal, a hash of the place they are written at, so that no id, length or group of equal
    rows stays together. Ranks within a length come from counts by (length, deal): a length that a third of all pieces have
    is ranked by as many tasks as there are deals. Rows that are equal get places of their own.
    """
    spark, names = cut.sparkSession, cut.columns
    cut, deals = plain(cut), partitions(spark)
    dealt = materialize(cut.withColumn("_deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(deals)).cast("int")), "pieces")
    counts = materialize(dealt.groupBy("length", "_deal").agg(F.count(F.lit(1)).alias("n")), "counts")  # capacity x deals rows at most
    before = W.partitionBy("length").orderBy("_deal").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("length", "_deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}  # capacity rows at most
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity, small, groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = where.value
        used: dict[tuple[int, int], int] = {}
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for i, key in enumerate(zip(lengths, batch.column("_deal").to_pylist(), batch.column("_base").to_pylist())):
                nth = used.get(key[:2], 0)
                used[key[:2]] = nth + 1
                rank = key[2] + nth
                ranks, first, offset = runs[key[0]]
                at = int(np.searchsorted(ranks, rank, side="right")) - 1
                seq[i], off[i] = first[at] + rank - ranks[at], offset[at]
            keep = [c for c in batch.schema.names if c not in ("_deal", "_base")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    fields = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    placed = dealt.join(base, ["length", "_deal"]).select(*cut.columns, "_deal", "_base").repartitionById(deals, "_deal").sortWithinPartitions("_deal", "length")
    return placed.mapInArrow(run, fields).toDF(*names, "sequence_id", "offset")


def query(docs: DataFrame) -> DataFrame:
    """Every piece of every row with its place. A text of any length is tokenized whole. Null and empty texts, repeated rows,
    rows without id and empty tables as in pieces(); columns besides id and text don't count."""
    return pack(pieces(docs)).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
