"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of `least` bytes that covers it also starts in a document with a smaller id. The steps:

1. Anchors. Every window of `least` bytes holds `least - gram + 1` grams; the one with the least hash is the window's
   anchor, so equal windows have equal anchors at equal offsets, and a document has few anchors. A window holds all of
   half the bytes that it has besides the gram either ahead of the gram or behind it. Anchors whose gram occurs in two
   documents with either of these sides are wanted; all other text is out. The gram alone would not do: the larger the
   corpus, the more grams two documents have by chance.
2. Contexts. Of each wanted anchor the bytes that its own windows cover are cut out of the whole text and sent to the
   bucket of its gram. Contexts that are equal within a batch are settled there: all but those with the batch's smallest
   id go whole. A context that a third of all documents hold is thus sent once per batch.
3. Suffix sorting of a bucket. The suffixes of the contexts that start in one column are sorted at a time. Those that tie
   on the first COVER bytes are told apart by ranks computed beforehand for a sample of columns: the residues mod COVER
   in a difference cover, which for any two suffixes has a column at the same small distance from both. Suffixes of
   one column only can be equal, their anchors being aligned, so the distance depends on the column alone. Sorted
   neighbours that agree on `least` bytes form a class; members whose id is above the class's smallest are repeats.
4. The repeats' intervals go back to their documents, where they are merged and cut out.

Everything shuffled between the steps is packed, compressed arrays, one row for each batch and bucket, texts too.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from heristat.llm.common import materialize, partitions, quoted, slices, stored

LEAST, GRAM = 50, 16
#: Bytes of text for each bucket, of text hashed at a time, and of text after which a batch is sent.
BUCKET_BYTES, SLICE_BYTES, BATCH_BYTES = 16 << 20, 1 << 20, 12 << 20
CONTEXTS = 50_000
HOT = 10_000
#: Grams that are known as frequent everywhere, at most.
OFTEN = 4 << 20
#: Keys that a batch sends to at most; where there are more buckets, rows go by way of so many groups of buckets.
FAN = 4096
#: Partitions at most, unless the session has more; each takes its buckets one after the other.
TASKS = 16384
#: Buckets of contexts for each bucket of anchors.
FINER = 2
#: Contexts whose suffixes are sorted together.
BLOCK = 8192
#: Occurrences of a gram in a batch above which its sides aren't looked at: it then goes out once, whatever is beside it.
MANY = 8
#: Sides (16 bits): there is none, and any.
NONE, ANY = 0, 65535
COVER, RESIDUES = 16, (0, 1, 2, 5, 8)  # every difference mod 16 is one of two of these residues

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)


# --- packed arrays --------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        kind = a.dtype.str.encode().ljust(4)
        parts += [kind, struct.pack("<QQ", len(raw), a.shape[1] if a.ndim == 2 else 0), raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, (size, width) = raw[at : at + 4].decode().strip(), struct.unpack_from("<QQ", raw, at + 4)
        a = np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 20)
        out.append(a.reshape(-1, width) if width else a)
        at += 20 + size
    return out


def _delta(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _dealt(keys: np.ndarray, arrays: tuple[np.ndarray, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """arrays cut by key, in their order within a key."""
    order = np.argsort(keys, kind="stable")
    ends = np.nonzero(np.diff(keys[order], append=-1))[0] + 1
    start = 0
    for end in ends.tolist():
        pick = order[start:end]
        yield int(keys[pick[0]]), [a[pick] for a in arrays]
        start = end


BLOBS = "kind int, key int, blob binary"
#: How the arrays of each kind are packed for their bucket: anchors, positions asked for, contexts, intervals, windows.
_PACKED = {
    0: lambda low, high, left, right, ids, tag, deal, q: pack(low, high, left, right, _delta(ids), tag, deal, q),
    1: lambda ids, tag, q: pack(_delta(ids), tag, _delta(q)),
    2: pack,
    3: pack,
    4: pack,
}


def _sent(kind: int, keys: np.ndarray, arrays: tuple[np.ndarray, ...], fan: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows (kind, key, blob) of arrays by key. With a fan the key is that of a group of buckets, kind is below 0 and the blob
    holds the keys too: a row a bucket would be next to a row a number where there are millions of buckets."""
    if fan:
        for group, (k, *own) in _dealt(keys % fan, (keys.astype(np.int32), *arrays)):
            yield -1 - kind, group, pack(k, *own)
        return
    for key, own in _dealt(keys, arrays):
        yield kind, key, _PACKED[kind](*own)


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of groups of buckets become rows of their buckets, about BATCH_BYTES at a time; other rows stay as they are."""
    for kind, key, blobs in _by_key(batches):
        if kind >= 0:
            for blob in blobs:
                yield _rows([(kind, key, blob)])
            continue
        held, size = [], 0

        def send(held: list) -> pa.RecordBatch:
            keys, *arrays = (np.concatenate(x) for x in zip(*held))
            if kind == -2:
                order = np.lexsort((arrays[2], arrays[1], arrays[0]))
                keys, arrays = keys[order], [a[order] for a in arrays]
            return _rows(list(_sent(-1 - kind, keys.astype(np.int64), tuple(arrays), 0)))

        for blob in blobs:
            held.append(unpack(blob))
            if (size := size + sum(a.nbytes for a in held[-1])) >= BATCH_BYTES:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)


# --- anchors --------------------------------------------------------------------------------------------------------


def _gram_hash(words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = words[0] * np.uint64(_MIX[0])
        h ^= h >> np.uint64(29)
        h += words[1] * np.uint64(_MIX[1])
        h ^= h >> np.uint64(32)
        h *= np.uint64(_MIX[2])
        h ^= h >> np.uint64(31)
    return h


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        a, span = op(a[:-span], a[span:]), span * 2
    return op(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def anchors(text: bytes, starts: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Positions in text and gram hashes of the anchors of the documents text[start:end], each of `least` bytes or more."""
    width = least - GRAM + 1
    raw = np.frombuffer(text + b"\0" * 8, np.uint8)
    words = np.ndarray((len(text) - 7,), "<u8", raw, strides=(1,))
    hashes = _gram_hash((words[: len(text) - GRAM + 1], words[8 : len(text) - GRAM + 9]))
    order = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = _slide(order, width, np.minimum)
    for end in ends.tolist():  # windows that would leave their document
        low[end - least + 1 : end] = 0
    edge = np.zeros(width - 1, np.uint32)
    high = _slide(np.concatenate([edge, low, edge]), width, np.maximum)
    at = np.nonzero(high == order)[0]
    return at, hashes[at]


def _hashed(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """1 to 65534, by the `size` bytes from each position on; words holds the 8 bytes from each byte on."""
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for o in [*range(0, size - 8, 8), max(size - 8, 0)]:
            h = (h ^ (words[at + o] & np.uint64((1 << 8 * min(size, 8)) - 1))) * np.uint64(_MIX[0])
            h ^= h >> np.uint64(29)
        h *= np.uint64(_MIX[2])
    return ((h >> np.uint64(32)) % np.uint64(ANY - 1) + np.uint64(1)).astype(np.uint16)


def sides(text: bytes, at: np.ndarray, start: np.ndarray, end: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """What stands ahead of and behind the grams at these positions of documents text[start:end], as 16 bits of its hash. A
    window of the gram holds all of the one or of the other; a side that would leave the document is NONE."""
    half = (least - GRAM + 1) // 2
    raw = np.frombuffer(b"\0" * half + text + b"\0" * (half + 8), np.uint8)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    left = np.where(at - half >= start, _hashed(words, at, half), np.uint16(NONE))
    return left, np.where(at + GRAM + half <= end, _hashed(words, at + half + GRAM, half), np.uint16(NONE))


def own_windows(text: np.ndarray, left: np.ndarray, right: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """left and right of contexts (rows, the anchor's gram in column least - GRAM) cut down to the windows whose least gram
    the anchor is; a window is of its anchor alone then. They are next to each other. Where there is none, right is 0."""
    before, width = least - GRAM, text.shape[1]
    left, right = left.astype(np.int64), right.astype(np.int64)
    for at in range(0, len(text), 8192):
        part = slice(at, at + 8192)
        raw = np.ascontiguousarray(text[part])
        words = np.ndarray((len(raw), width - 7), "<u8", np.concatenate([raw.ravel(), np.zeros(8, np.uint8)]), strides=(width, 1))
        order = (_gram_hash((words[:, : width - GRAM + 1], words[:, 8 : width - GRAM + 9])) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        lower = order < order[:, before, None]
        ahead = np.argmax(np.concatenate([lower[:, :before][:, ::-1], np.ones((len(raw), 1), bool)], axis=1), axis=1)
        behind = np.argmax(np.concatenate([lower[:, before + 1 :], np.ones((len(raw), 1), bool)], axis=1), axis=1)
        most = np.minimum(left[part], ahead)
        fewest = np.maximum(np.maximum(before - behind, least - right[part]), 0)
        left[part], right[part] = most, np.where(most >= fewest, least - fewest, 0)
    return left.astype(np.uint8), right.astype(np.uint8)


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of each run of equal keys, and each position's run."""
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    return np.nonzero(new)[0], np.cumsum(new) - 1


def _beside(h: np.ndarray, side: np.ndarray) -> np.ndarray:
    """One key for a gram and what is beside it."""
    with np.errstate(over="ignore"):
        return (h ^ side.astype(np.uint64)) * np.uint64(_MIX[1]) ^ side.astype(np.uint64) * np.uint64(_MIX[0])


def _shared(key: np.ndarray, ids: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Whether a key also is of another id, or known to be for one of its rows."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key)
    first, run = _groups(key[order])
    own = ids[order]
    both = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    if known is not None:
        both |= np.logical_or.reduceat(known[order], first)
    out = np.empty(len(key), bool)
    out[order] = both[run]
    return out


def _requests(deal: np.ndarray, ids: np.ndarray, tag: np.ndarray, q: np.ndarray, fan: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((q, tag, ids))
    return _sent(1, deal[order].astype(np.int64), (ids[order], tag[order], q[order]), fan)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind, key, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int32()), pa.array(blob, pa.binary())], ["kind", "key", "blob"])


def _find_anchors(buckets: int, least: int, fan: int):
    """docs (doc_id, tag, deal, text) to rows of kind 0 (anchors, by gram bucket) and 1 (positions already known to be
    wanted, by document deal)."""

    def send(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, left, right, ids, tag, deal, q = (np.concatenate(x) for x in zip(*held))
        every = np.sort(h)
        many = np.isin(h, every[MANY:][every[MANY:] == every[:-MANY]])
        many[many] = _shared(h[many], ids[many])
        left[many] = right[many] = ANY
        by_left = _shared(_beside(h, left), ids) & (left != NONE)
        by_right = _shared(_beside(h, right), ids) & (right != NONE)
        both = by_left | by_right
        rows = list(_requests(deal[both], ids[both], tag[both], q[both], fan))
        # what is shared here goes out once with its count and the sides that are shared, asking for nothing
        at = np.nonzero(both)[0]
        key = _beside(_beside(h[at], left[at]), right[at])
        order = np.argsort(key, kind="stable")
        first, run = _groups(key[order]) if len(at) else (at, at)
        one = at[order[first]]
        q = q.copy()
        q[one] = -(np.bincount(run, minlength=len(first)).astype(np.int32) << 2 | by_left[one] * np.int32(2) | by_right[one])
        keep = ~both
        keep[one] = True
        h, left, right, ids, tag, deal, q = (a[keep] for a in (h, left, right, ids, tag, deal, q))
        bucket, rest = (h % np.uint64(buckets)).astype(np.int64), h // np.uint64(buckets)
        rows += _sent(0, bucket, (rest.astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8), left, right, ids, tag, deal, q), fan)
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text", SLICE_BYTES):
            texts = part.column("text").to_pylist()
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            at, h = anchors(b"".join(texts), ends - sizes, ends, least)
            doc = np.searchsorted(ends, at, side="right")
            pick = lambda c: part.column(c).to_numpy(zero_copy_only=False)[doc]
            held.append((h, *sides(b"".join(texts), at, (ends - sizes)[doc], ends[doc], least), pick("doc_id"), pick("tag").astype(np.uint32), pick("deal").astype(np.int32), (at - (ends - sizes)[doc]).astype(np.int32)))
            if (size := size + int(ends[-1])) >= BATCH_BYTES:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Iterator[list[np.ndarray]]]]:
    """(kind, key, unpacked blobs) of each kind and key, by which rows are sorted. The blobs must be used up before the
    next key is asked for."""
    rows = ((k, x, b.column("blob"), i) for b in batches for i, (k, x) in enumerate(zip(b.column("kind").to_pylist(), b.column("key").to_pylist())))
    head = next(rows, None)
    while head is not None:
        now = head[:2]

        def blobs():
            nonlocal head
            while head is not None and head[:2] == now:
                yield head[2][head[3]].as_py()
                head = next(rows, None)

        yield *now, blobs()


def _joined(blobs: Iterator[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(unpack, blobs))]


def _gram_id(bucket: np.ndarray, rest: np.ndarray, buckets: int) -> np.ndarray:
    """What a gram is known by: 40 bits of its hash beside its bucket."""
    return ((rest & np.uint64((1 << 40) - 1)).astype(np.int64)) * buckets + bucket


def _want(buckets: int, hot: int, fan: int):
    """Kind 0 rows become kind 1: anchors whose gram two documents have with what is ahead of it or behind it, and kind 5: the
    grams with more than `hot` occurrences of that sort, and how many. Other rows stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, key, blobs in _by_key(batches):
            if kind != 0:
                for blob in blobs:
                    yield _rows([(kind, key, blob)])
                continue
            parts = [(a.astype(np.uint64) | b.astype(np.uint64) << np.uint64(32), l, r, np.cumsum(i), t, d, p) for a, b, l, r, i, t, d, p in map(unpack, blobs)]
            h, left, right, ids, tag, deal, q = (np.concatenate(x) for x in zip(*parts))
            own, known = q >= 0, np.where(q < 0, -q, 0)
            shared = _shared(_beside(h, left), ids, known & 2 > 0) & (left != NONE) | _shared(_beside(h, right), ids, known & 1 > 0) & (right != NONE)
            order = np.argsort(h, kind="stable")
            first, run_ = _groups(h[order])
            shared[order] |= np.logical_or.reduceat(left[order] == ANY, first)[run_]
            pick = np.nonzero(shared & own)[0]
            yield _rows(list(_requests(deal[pick], ids[pick], tag[pick], q[pick], fan)))
            count = np.add.reduceat(np.where(own, shared, known >> 2).astype(np.int64)[order], first)
            if (often := count > hot).any():
                yield _rows([(5, key, pack(_gram_id(np.int64(key), h[order][first[often]], buckets), count[often]))])

    return run


def _most_frequent(lists: Iterator[list[np.ndarray]], most: int = OFTEN) -> np.ndarray:
    """The grams of most occurrences from lists of grams and occurrences, sorted: `most` of them, and twice as many held."""
    held, size = [np.zeros((0, 2), np.int64)], 0

    def cut() -> np.ndarray:
        every = np.concatenate(held)
        return every if len(every) <= most else every[np.argpartition(-every[:, 1], most)[:most]]

    for gram, count in lists:
        held.append(np.stack([gram, count], axis=1))
        if (size := size + len(gram)) > most:
            held, size = [cut()], 0
    return np.sort(cut()[:, 0])


# --- contexts -------------------------------------------------------------------------------------------------------


def _framed(text: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Rows of bytes, more columns of bytes behind them, filled up to whole words."""
    width = text.shape[1]
    wide = np.zeros((len(text), -(-(width + len(more)) // 8) * 8), np.uint8)
    wide[:, :width] = text
    for k, a in enumerate(more):
        wide[:, width + k] = a
    return wide


def _row_hash(wide: np.ndarray) -> np.ndarray:
    factors = np.random.default_rng(1).integers(1 << 63, size=(2, wide.shape[1] // 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    words, key = wide.view("<u8"), np.empty(len(wide), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(words), BLOCK):
            part = words[at : at + BLOCK]
            key[at : at + BLOCK] = ((part ^ (part * factors[0] >> np.uint64(31))) * factors[1]).sum(axis=1)
        key ^= key >> np.uint64(29)
    return key


def _settled(wide: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows equal one of a smaller id, and every row's hash."""
    key = _row_hash(wide)
    order = np.lexsort((ids, key))
    first, run = _groups(key[order])
    lead = order[first][run]
    done = np.zeros(len(ids), bool)
    above = np.nonzero(ids[order] > ids[lead])[0]
    for at in range(0, len(above), BLOCK):
        one, other = order[above[at : at + BLOCK]], lead[above[at : at + BLOCK]]
        done[one] = (wide[one] == wide[other]).all(axis=1)
    return done, key


def _cut_contexts(buckets: int, least: int, frequent, fan: int):
    """Requests and documents of a deal to rows of kind 2 (contexts, by gram bucket), 3 (intervals, by document deal) and
    4 (windows of frequent grams, by their own bucket)."""
    before = least - GRAM  # bytes of context ahead of the anchor
    width = before + least

    def windows(deal: int, text: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, tag: np.ndarray, q: np.ndarray) -> list[tuple]:
        c = np.arange(before + 1)
        row, c = np.nonzero((left[:, None] >= before - c) & (right[:, None] >= least - before + c))
        each = np.lib.stride_tricks.sliding_window_view(text, least, axis=1)[row, c]
        i, g, p = ids[row], tag[row], (q[row] - before + c).astype(np.int32)
        done, key = _settled(_framed(each), i)
        rows = [(3, deal, pack(i[done], g[done], p[done], p[done] + np.int32(least)))] if done.any() else []
        keep = ~done
        own = (each[keep], i[keep], g[keep], p[keep], np.full(int(keep.sum()), deal, np.int32))
        return rows + list(_sent(4, (key[keep] % np.uint64(buckets)).astype(np.int64), own, fan))

    def send(deal: int, held: list[tuple[np.ndarray, ...]], often: np.ndarray) -> pa.RecordBatch:
        text, left, right, ids, tag, q = (np.concatenate(x) for x in zip(*held))
        left, right = own_windows(text, left, right, least)
        own = right > 0
        text, left, right, ids, tag, q = (a[own] for a in (text, left, right, ids, tag, q))
        grams = np.ascontiguousarray(text[:, before : before + GRAM]).view("<u8")
        h = _gram_hash((grams[:, 0], grams[:, 1]))
        column = np.arange(width)
        text = np.where((column >= before - left[:, None]) & (column < before + right[:, None]), text, 0).astype(np.uint8)
        if not len(text):
            return _rows([])
        done, _ = _settled(_framed(text, left, right), ids)
        rows = []
        if done.any():
            rows.append((3, deal, pack(ids[done], tag[done], (q - left)[done], (q + right)[done])))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        frequent = np.isin(_gram_id(bucket, h // np.uint64(buckets), buckets), often)
        if (split := np.nonzero(~done & frequent)[0]).size:
            rows += windows(deal, *(a[split] for a in (text, left, right, ids, tag, q)))
        keep = np.nonzero(~done & ~frequent)[0]
        keep = keep[np.argsort(h[keep], kind="stable")]
        bucket = (h[keep] % np.uint64(FINER * buckets)).astype(np.int64)
        rows += _sent(2, bucket, (*(a[keep] for a in (text, left, right, ids, tag, q)), np.full(len(keep), deal, np.int32)), fan)
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for deal, wanted, docs in _by_deal(batches):
            often = frequent.value
            asked = [(np.cumsum(w[0]), w[1], np.cumsum(w[2])) for w in wanted]
            ids, tag, q = (np.concatenate(x) for x in zip(*asked)) if asked else (np.array([], np.int64),) * 3
            where = _spots(ids, tag)
            held, size = [], 0
            for doc_id, t, text in docs:
                if (spot := where.get((doc_id, t))) is None or len(text) < least:
                    continue
                p = np.unique(q[spot])
                p = p[p <= len(text) - GRAM]  # another text of this id and tag may be shorter
                padded = np.frombuffer(b"\0" * before + text + b"\0" * least, np.uint8)
                cut = np.lib.stride_tricks.sliding_window_view(padded, width)[p]
                held.append((cut, np.minimum(p, before).astype(np.uint8), np.minimum(len(text) - p, least).astype(np.uint8), np.full(len(p), doc_id), np.full(len(p), t, np.uint32), p.astype(np.int32)))
                if (size := size + len(p)) >= CONTEXTS:
                    yield send(deal, held, often)
                    held, size = [], 0
            if held:
                yield send(deal, held, often)

    return run


def _spots(ids: np.ndarray, tag: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Positions of each (id, tag)."""
    if not len(ids):
        return {}
    order = np.lexsort((tag, ids))
    i, t = ids[order], tag[order]
    new = np.nonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]))[0]
    return {(int(i[a]), int(t[a])): order[a:b] for a, b in zip(new, np.append(new[1:], len(i)))}


def _pack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """docs (deal, doc_id, tag, text) to rows (deal, docs, blob): the documents of a deal, about BATCH_BYTES of all at a time."""

    def send(held: list[tuple]) -> pa.RecordBatch:
        deal, ids, tag, texts = (sum(x, []) for x in zip(*held))
        rows = []
        for key, (pick,) in _dealt(np.array(deal, np.int64), (np.arange(len(deal)),)):
            own = [texts[k] for k in pick.tolist()]
            rows.append((key, pack(np.array(ids, np.int64)[pick], np.array(tag, np.int64)[pick], np.array([len(t) for t in own], np.int64), np.frombuffer(b"".join(own), np.uint8))))
        keys, blobs = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([True] * len(rows)), pa.array(blobs, pa.binary())], ["deal", "docs", "blob"])

    held, size = [], 0
    for part in slices(batches, "text", SLICE_BYTES):
        held.append(tuple(part.column(c).to_pylist() for c in ("deal", "doc_id", "tag", "text")))
        if (size := size + sum(map(len, held[-1][3]))) >= BATCH_BYTES:
            yield send(held)
            held, size = [], 0
    if held:
        yield send(held)


def _by_deal(batches: Iterator[pa.RecordBatch]):
    """(deal, unpacked blobs, iterator of documents) for each deal; its blobs are sorted before its documents. The
    documents must be used up before the next deal is asked for."""
    rows = ((*r, b.column("blob"), i) for b in batches for i, r in enumerate(zip(b.column("deal").to_pylist(), b.column("docs").to_pylist())))
    head = next(rows, None)
    while head is not None:
        deal, blobs = head[0], []
        while head is not None and head[0] == deal and not head[1]:
            blobs.append(unpack(head[2][head[3]].as_py()))
            head = next(rows, None)

        def docs():
            nonlocal head
            while head is not None and head[0] == deal and head[1]:
                ids, tag, sizes, text = unpack(head[2][head[3]].as_py())
                ends = np.cumsum(sizes)
                for doc_id, t, start, end in zip(ids.tolist(), tag.tolist(), (ends - sizes).tolist(), ends.tolist()):
                    yield doc_id, t, text[start:end].tobytes()
                head = next(rows, None)

        if head is None or head[0] != deal:
            continue
        yield deal, blobs, docs()
        while head is not None and head[0] == deal and head[1]:
            head = next(rows, None)


# --- suffix sorting -------------------------------------------------------------------------------------------------


def cover_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the sampled suffixes of each row by `depth` bytes or more (zeros to its right belong to it): column c's is
    in [:, c], -1 if c isn't sampled. Ranks by COVER bytes first; each doubling joins the rank COVER, 2 COVER, ... columns
    on, which the sample, being periodic, holds as well."""
    rows, width = text.shape
    cols = np.array([c for c in range(width) if c % COVER in RESIDUES])
    padded = np.zeros((rows, width + COVER), np.uint8)
    padded[:, :width] = text
    words = [np.stack([_word(padded, c + o) for c in cols], axis=1).ravel() for o in (0, 8)]
    rank = _rank(words)
    span = COVER
    place = {c: k for k, c in enumerate(cols.tolist())}
    while span < depth and len(rank) and rank.max() + 1 < len(rank):
        table = rank.reshape(rows, -1)
        on = np.stack([table[:, place[c + span]] + 1 if c + span in place else np.zeros(rows, np.int64) for c in cols.tolist()], axis=1)
        rank = _rank([rank.astype(np.uint64) << np.uint64(32) | on.ravel().astype(np.uint64)])
        span *= 2
    out = np.full((rows, width), -1, np.int64)
    out[:, cols] = rank.reshape(rows, -1)
    return out


def _word(a: np.ndarray, c: int) -> np.ndarray:
    return np.ascontiguousarray(a[:, c : c + 8]).view(">u8").ravel().astype(np.uint64)


def _rank(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows of keys, the first the most significant."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _sorted_column(text: np.ndarray, ranks: np.ndarray, own: np.ndarray, c: int, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows `own` in the order of their suffixes from column c on, and whether each one's window there is also in another
    row of a smaller id. COVER bytes are compared, then ranks of the cover sample, step columns on."""
    step = next(d for d in range(COVER) if (c + d) % COVER in RESIDUES)
    wide = text[own, c : c + COVER]
    order = own[np.lexsort((ranks[own, c + step], _word(wide, 8), _word(wide, 0)))]
    window = text[order, c : c + least]
    new = np.concatenate([[True], (window[1:] != window[:-1]).any(axis=1)])
    return order, ids[order] > np.minimum.reduceat(ids[order], np.nonzero(new)[0])[np.cumsum(new) - 1]


def repeats(text: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For contexts (rows; the anchor in column least - GRAM, left and right bytes of text around its start) whether the
    window that starts in each of the first columns also occurs in another row of a smaller id."""
    before = least - GRAM
    out = np.zeros((len(text), before + 1), bool)
    if not len(text):
        return out
    ranks = cover_ranks(text, least)
    for c in range(before + 1):  # one bucket of suffixes at a time
        own = np.nonzero((left >= before - c) & (right >= least - before + c))[0]
        if len(own) > 1:
            order, again = _sorted_column(text, ranks, own, c, ids, least)
            out[order, c] = again
    return out


def repeated_windows(window: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Which windows also are of a smaller id, by the same sort, in blocks: equal windows have equal hashes and so one block."""
    out = np.zeros(len(window), bool)
    key = _row_hash(_framed(window))
    order = np.argsort(key, kind="stable")
    new = np.nonzero(np.diff(key[order], prepend=key[order][:1]) != 0)[0]
    a = 0
    while a < len(order):
        after = np.searchsorted(new, a + block)
        b = int(new[after]) if after < len(new) else len(order)
        part = order[a:b]
        if len(part) > 1:
            text = window[part]
            at, again = _sorted_column(text, cover_ranks(text, text.shape[1]), np.arange(len(part)), 0, ids[part], text.shape[1])
            out[part[at]] = again
        a = b
    return out


def _settle(least: int, fan: int):
    """Contexts (kind 2) and windows (kind 4) of a bucket become intervals (kind 3), which stay as they are."""
    before = least - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, key, blobs in _by_key(batches):
            if kind == 3:
                for blob in blobs:
                    yield _rows([(3, key, blob)])
                continue
            if kind == 4:
                window, ids, tag, p, deal = _joined(blobs)
                hit = repeated_windows(window, ids)
                yield _rows(list(_sent(3, deal[hit].astype(np.int64), (ids[hit], tag[hit], p[hit], p[hit] + np.int32(least)), fan)))
                continue
            text, left, right, ids, tag, q, deal = _joined(blobs)
            whole, _ = _settled(_framed(text, left, right), ids)  # equal contexts of several batches: the smallest id stands for all
            start, end = q - left.astype(np.int32), q + right.astype(np.int32)
            yield _rows(list(_sent(3, deal[whole].astype(np.int64), (ids[whole], tag[whole], start[whole], end[whole]), fan)))
            text, left, right, ids, tag, q, deal = (a[~whole] for a in (text, left, right, ids, tag, q, deal))
            grams = np.ascontiguousarray(text[:, before : before + GRAM]).view("<u8")
            h = _gram_hash((grams[:, 0], grams[:, 1]))
            order = np.lexsort((ids, h))
            first, runs = _groups(h[order])
            last = np.append(first[1:], len(h)) - 1
            pick = order[(ids[order][first] != ids[order][last])[runs]]  # an anchor of one document only meets none
            hit = np.zeros((len(pick), before + 1), bool)
            new = np.nonzero(np.diff(h[pick], prepend=h[pick][:1]) != 0)[0]
            a = 0
            while a < len(pick):  # whole grams, about BLOCK contexts at a time
                after = np.searchsorted(new, a + BLOCK)
                b = int(new[after]) if after < len(new) else len(pick)
                part = pick[a:b]
                hit[a:b] = repeats(text[part], left[part], right[part], ids[part], least)
                a = b
            edges = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            (row, c0), (_, c1) = np.nonzero(edges == 1), np.nonzero(edges == -1)
            at = pick[row]
            start, end = q[at] - before + c0, q[at] - before + c1 - 1 + least
            yield _rows(list(_sent(3, deal[at].astype(np.int64), (ids[at], tag[at], start.astype(np.int32), end.astype(np.int32)), fan)))

    return run


# --- cutting out ----------------------------------------------------------------------------------------------------


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def send(rows: list[tuple]) -> pa.RecordBatch:
        ids, n, spans, kept = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    rows, size = [], 0
    for _, blobs, docs in _by_deal(batches):
        ids, tag, start, end = (np.concatenate(x) for x in zip(*blobs)) if blobs else (np.array([], np.int64),) * 4
        where = _spots(ids, tag)
        for doc_id, t, text in docs:
            spans, kept = [], text
            if (spot := where.get((doc_id, t))) is not None:
                depth = np.bincount(start[spot], minlength=len(text) + 1) - np.bincount(end[spot], minlength=len(text) + 1)
                gone = np.cumsum(depth)[:-1] > 0
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                spans = [{"start": a, "end": b} for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist())]
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((doc_id, len(text), spans, kept))
            if (size := size + len(text)) >= SLICE_BYTES:
                yield send(rows)
                rows, size = [], 0
    yield send(rows)


def dedup(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN, tasks: int = TASKS) -> DataFrame:
    """Rows (doc_id, n_bytes, spans array<struct<start, end>>, kept binary), one per input row: the removed byte runs and
    the bytes that stay, of the text's UTF-8.

    Null text is empty; texts below `least` bytes stay whole; texts of any length count whole. A row without doc_id has no
    smaller one and is smaller than none: it stays whole. Rows that share a doc_id don't remove each other's strings. No
    rows: no rows. Other columns don't count. least is 24 at least.

    The contexts of a gram are sorted in one task, unless it has more than `hot` occurrences, or more than leave about OFTEN
    such grams: then its windows are, each in a bucket of its own hash, by the same sort. It changes no result, nor does it that
    of more grams the OFTEN most frequent are taken. Documents are
    dealt by id and text, so that a repeated id stays together only as far as its text does too.

    Buckets are as many as `bucket_bytes` go into the text; a task holds one at a time, whatever their number, and there are
    `tasks` tasks at most, or as many as the session has partitions. Where there are more than `fan` buckets, what is sent to
    them goes to groups of buckets first, and from there to each; texts are never sent that way.
    """
    if not GRAM + 8 <= least <= 128:
        raise ValueError(f"least must be from {GRAM + 8} to 128")
    spark = docs.sparkSession
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = partitions(spark)
    buckets = max(n, -(-total // bucket_bytes))
    tasks = min(buckets, max(n, tasks))
    groups = fan if buckets > fan else 0
    tag = F.xxhash64(text).bitwiseAND(F.lit(4294967295))
    own = F.col(quoted(id_col)).cast("long")
    rows = docs.select(F.pmod(F.xxhash64(own, tag), F.lit(buckets)).cast("int").alias("deal"), own.alias("doc_id"), tag.alias("tag"), text.cast("binary").alias("text"))
    whole = f"doc_id IS NULL OR octet_length(text) < {least}"  # these lose nothing
    settled = rows.filter(whole).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans"), F.col("text").alias("kept"))
    rows = rows.filter(f"NOT ({whole})")
    hot = max(hot, -(-total // (least - GRAM + 1) * 2 // OFTEN))  # two anchors for each width of a window

    def by_key(blobs: DataFrame) -> DataFrame:
        return blobs.repartition(tasks, "kind", "key").sortWithinPartitions("kind", "key")

    def routed(blobs: DataFrame) -> DataFrame:
        return by_key(blobs).mapInArrow(_route, BLOBS) if groups else blobs

    def with_docs(blobs: DataFrame) -> DataFrame:
        side = blobs.select(F.col("key").alias("deal"), F.lit(False).alias("docs"), "blob")
        both = side.unionByName(rows.mapInArrow(_pack_docs, "deal int, docs boolean, blob binary"))
        return both.repartition(tasks, "deal").sortWithinPartitions("deal", "docs")

    def repeats_of() -> DataFrame:
        found = rows.mapInArrow(_find_anchors(buckets, least, groups), BLOBS)
        wanted = materialize(routed(by_key(routed(found)).mapInArrow(_want(buckets, hot, groups), BLOBS)), "anchors")
        frequent = spark.sparkContext.broadcast(_most_frequent(unpack(bytes(r.blob)) for r in wanted.filter("kind = 5").select("blob").toLocalIterator()))
        cut = with_docs(wanted.filter("kind = 1")).mapInArrow(_cut_contexts(buckets, least, frequent, groups), BLOBS)
        return routed(by_key(routed(cut)).mapInArrow(_settle(least, groups), BLOBS))

    gone, _ = stored(spark, "repeats", repeats_of)
    return settled.unionByName(with_docs(gone).mapInArrow(_cut_out, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"))


def query(docs: DataFrame) -> DataFrame:
    found = dedup(docs)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
