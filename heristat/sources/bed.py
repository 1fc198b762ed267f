"""PLINK 1 binary genotypes (.bed), SNP-major: read by SNP range through a Python data source, one partition a range.

After three magic bytes a SNP has ceil(N / 4) bytes, two bits an individual, low bits first: 00 two of the first allele,
01 missing, 10 one, 11 none. Counts are of the first allele unless flipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

MAGIC = b"\x6c\x1b\x01"
#: Two bits to an allele count; -1 is missing.
COUNTS = np.array([2, -1, 1, 0], np.int8)
RANGE = 256  # SNPs a partition, unless asked otherwise
SCHEMA = "m long, dosage array<tinyint>"


def _open(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return open(uri, "rb")
    if uri.startswith("file:"):
        return open(uri.removeprefix("file://").removeprefix("file:"), "rb")
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _store(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _parts(uri: str) -> list[tuple[str, int, int]]:
    """(name, first SNP, SNP after the last) of a folder's parts, in order; none of a file."""
    from pyarrow import fs

    store, path = _store(uri)
    if store.get_file_info(path).type != fs.FileType.Directory:
        return []
    found = (re.fullmatch(r"part-(\d+)-(\d+)\.bed", f.base_name) for f in store.get_file_info(fs.FileSelector(path)))
    return sorted(((x[0], int(x[1]), int(x[2])) for x in found if x), key=lambda x: x[1])


def decode(raw: bytes, n: int) -> np.ndarray:
    """Allele counts (SNPs x n) of packed SNPs; -1 is missing."""
    packed = np.frombuffer(raw, np.uint8).reshape(-1, -(-n // 4))
    return COUNTS[np.stack([(packed >> (2 * k)) & 3 for k in range(4)], axis=-1).reshape(len(packed), -1)[:, :n]]


def encode(counts: np.ndarray) -> bytes:
    """decode()'s inverse for one SNP."""
    code = np.array([3, 2, 0, 1], np.uint8)[counts]  # -1 is the last
    wide = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    wide[: len(code)] = code
    return (wide.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


class _Range(InputPartition):
    def __init__(self, start: int, end: int, path: str | None = None, first: int = 0):
        self.start, self.end, self.path, self.first = start, end, path, first  # first: of the file's SNPs


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n = options["path"], int(options["individuals"])
        self.first, self.last = int(options.get("start", 0)), int(options["end"])
        self.size, self.flip = int(options.get("range", RANGE)), options.get("flip", "false") == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on m narrow the SNPs that are read; other filters are left to Spark."""
        for f in filters:
            at = f.value if getattr(f, "attribute", None) == ("m",) and isinstance(getattr(f, "value", None), int) else None
            if at is None or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.first = max(self.first, at + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.last = min(self.last, at + (not isinstance(f, LessThan)))

    def partitions(self) -> list[InputPartition]:
        if parts := _parts(self.path):
            each = [_Range(max(a, self.first), min(b, self.last), f"{self.path.rstrip('/')}/{name}", a) for name, a, b in parts]
            if self.last > parts[-1][2] or any(b != a for (_, _, b), (_, a, _) in zip(parts, parts[1:])):
                raise ValueError(f"{self.path} lacks SNPs before {self.last}")
            return [r for r in each if r.start < r.end] or [_Range(0, 0)]
        return [_Range(a, min(a + self.size, self.last)) for a in range(self.first, self.last, self.size)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.start >= part.end:
            return
        each = -(-self.n // 4)
        path = part.path or self.path
        with _open(path) as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{path} is not a SNP-major .bed file")
            f.seek(3 + (part.start - part.first) * each)
            raw = f.read((part.end - part.start) * each)
        if len(raw) != (part.end - part.start) * each:
            raise ValueError(f"{path} ends before SNP {part.end}")
        counts = decode(raw, self.n)
        if self.flip:
            counts = np.where(counts < 0, counts, 2 - counts)
        flat = pa.array(counts.ravel(), mask=counts.ravel() < 0)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * self.n), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.start, part.end), pa.int64()), rows], ["m", "dosage"])


class BedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, individuals: int, end: int, start: int = 0, flip: bool = False, size: int = RANGE) -> DataFrame:
    """(m, dosage) of SNPs start <= m < end; only their bytes are read, and of these only those that filters on m leave."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BedSource)
    return spark.read.format("bed").options(individuals=individuals, start=start, end=end, flip=str(flip).lower(), range=size).load(path)


def scratch(spark: SparkSession) -> str:
    """A new file name in the folder that driver and executors share; a temporary one only where all is one process."""
    import tempfile
    import uuid

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='heristat-')}"
    return f"{folder.rstrip('/')}/heristat/bed-{uuid.uuid4().hex}.bed"


def _pack(dosage: pa.ListArray) -> list[bytes]:
    return [encode(d.values.cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)) for d in dosage]


def write_parts(geno: DataFrame, path: str, size: int = RANGE) -> int:
    """Write long genotypes (i, m, d), individuals in order of i and SNPs 0, 1, ..., as a folder of .bed files of `size` SNPs,
    part-<first>-<end>.bed, which read() takes for the whole; the number of individuals.

    Executors write the parts, each under a name of its own first, so that a repeated task replaces a whole file by the same.
    Parts that the folder held before go.
    """
    import os
    import uuid

    from heristat.operators.genotype import snp_major

    store, inner = _store(path)
    store.create_dir(inner, recursive=True)
    for name, _, _ in _parts(path):
        store.delete_file(f"{inner}/{name}")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = _store(path)
        part, held, first, n = None, [], 0, 0

        def close() -> None:
            name = os.path.join(inner, f"_{uuid.uuid4().hex}")
            with store.open_output_stream(name) as f:
                f.write(MAGIC + b"".join(held))
            store.move(name, os.path.join(inner, f"part-{first:012}-{first + len(held):012}.bed"))

        for b in batches:
            for m, d, raw in zip(b.column("m").to_pylist(), b.column("dosage"), _pack(b.column("dosage"))):
                if m // size != part:
                    if held:
                        close()
                    part, held, first = m // size, [], m
                if m != first + len(held) or (n and n != len(d)):
                    raise ValueError(f"SNP {m} is out of order or not of {n} individuals")
                held.append(raw)
                n = len(d)
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = snp_major(geno).withColumn("_part", F.expr(f"m DIV {size}")).repartition("_part").sortWithinPartitions("m").select("m", "dosage")
    return rows.mapInArrow(save, "n long").agg(F.max("n")).first()[0] or 0


def write(geno: DataFrame, path: str, size: int = RANGE) -> int:
    """The same as one file, for programs that want one: the parts, written beside it, are put together by the driver, a part at
    a time."""
    import os

    beside = f"{path}.parts"
    n = write_parts(geno, beside, size)
    parts = _parts(beside)
    if any(a != end for (_, a, _), end in zip(parts, [0, *(b for _, _, b in parts)])):
        raise ValueError("SNPs must be 0, 1, ... without gaps")
    (store, inner), (_, folder) = _store(path), _store(beside)
    if os.path.dirname(inner):
        store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as out:
        out.write(MAGIC)
        for name, _, _ in parts:
            with store.open_input_file(f"{folder}/{name}") as f:
                out.write(f.read()[len(MAGIC) :])
    store.delete_dir(folder)
    return n
