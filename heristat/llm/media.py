"""Media columns: bytes kept as lossless WebP images and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from heristat.llm import webp
from heristat.llm.common import plain, quoted, slices, utf8

UNIT = webp.WIDTH
#: Bytes of payload coded at a time.
BATCH_BYTES = 2 << 20


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of UNIT."""
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): a WebP file of each row's padded UTF-8. Null text counts as empty; repeated rows are
    stored each, alike; no rows, no files. Texts are stored whole, up to 2^24 rows of UNIT samples, 1 GB. Other columns don't
    count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BATCH_BYTES):
            texts = utf8(part.column("text"))
            files = webp.encode_samples([padded(t) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    narrow = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, n_bytes long, media binary")


def decode_column(media: DataFrame, with_pixels: bool = True) -> DataFrame:
    """media's columns, media itself replaced by width, height, what is derived from the pixel array and (with_pixels) the
    array's samples, row by row: mean and standard deviation, distinct values, entropy in bits. No rows, no rows; other
    columns stay, whatever their names."""
    names, safe = [c for c in media.columns if c != "media"], plain(media)
    keep = [f for f in safe.schema.fields if f.name != "media"]
    derived = StructType.fromDDL("width int, height int, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string" + ", pixels binary" * with_pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", BATCH_BYTES):
            files = part.column("media").to_pylist()
            got = webp.decode_samples(files)
            rows = [(w, h, len(f), hashlib.sha256(f).hexdigest(), len(px), hashlib.sha256(px).hexdigest(), zlib.crc32(px[-UNIT:]), feature(w, h, px), *([px] * with_pixels)) for f, (w, h, px) in zip(files, got)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), *([pa.binary()] * with_pixels))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [f.name for f in keep] + derived.names)

    return safe.mapInArrow(run, StructType([*keep, *derived.fields])).toDF(*names, *derived.names)


def feature(width: int, height: int, pixels: bytes) -> str:
    counts = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
    share = counts[counts > 0] / len(pixels)
    mean = float(counts @ np.arange(256)) / len(pixels)
    spread = (float(counts @ (np.arange(256) - mean) ** 2) / len(pixels)) ** 0.5
    return f"{width}x{height} mean={mean:.4f} sd={spread:.4f} values={len(share)} bits={float(-(share * np.log2(share)).sum()) + 0.0:.4f}"


def query(docs: DataFrame) -> DataFrame:
    """Every row's text stored and read back; nulls, long and repeated texts and empty tables as in encode_column()."""
    found = decode_column(encode_column(docs), with_pixels=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
