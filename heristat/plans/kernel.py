"""Variance components of dense genotypes: Arrow block kernels in two passes over SNP-major rows.

Pass 1 streams (block, m, dosage, bins) rows through each task. A task standardizes a chunk of SNPs, multiplies it once
with [Z | UZ | y...] and adds X (X'Z) to one N x B sum for each component; the sums of all tasks are added up by
component and segment of individuals. Pass 2 streams the rows again, sorted by block: it makes the block's own sums,
takes them from the broadcast totals, and returns only the small inner products of the sample without the block. What a
task holds is K sums of N x B numbers, not a block's genotypes. On a cluster with more slots than blocks a block is dealt
to several tasks, and inner products are added up over segments of individuals.

The driver holds individuals' columns (phenotypes, covariates, environments, N x B random numbers) and J + 1 systems of
K + 1 equations; never genotypes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from heristat.functions.rng import gaussian_value

CHUNK = 256


@dataclass(frozen=True)
class Component:
    kind: str  # of KINDS
    bin: int = 0
    env: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.env}" if self.kind == "nxe" else f"{self.kind}:{self.bin}" if self.env == 0 else f"{self.kind}:{self.bin}:{self.env}"


@dataclass(frozen=True)
class Chunk:
    """Some SNPs: standardized x (N x m), filled counts and their means."""

    x: np.ndarray
    counts: np.ndarray
    mean: np.ndarray


@dataclass(frozen=True)
class Kind:
    """What makes a kind of component: the columns it has of a chunk of SNPs, or the squares of a diagonal matrix that no SNP
    enters. estimated: the trace of its kinship matrix isn't N by construction."""

    columns: Callable[[Chunk, Study, Component], np.ndarray] | None = None
    squares: Callable[[Study, Component], np.ndarray] | None = None
    estimated: bool = False


#: Components may be of any kind that is entered here; executors get the kinds of a study with its tasks.
KINDS: dict[str, Kind] = {
    "g": Kind(lambda chunk, study, p: chunk.x),
    "d": Kind(lambda chunk, study, p: _dominance_matrix(chunk.counts, chunk.mean)),
    "gxe": Kind(lambda chunk, study, p: chunk.x * study.env[:, p.env][:, None], estimated=True),
    "nxe": Kind(squares=lambda study, p: study.env[:, p.env] ** 2, estimated=True),
}


def components(model: str, bins: int, envs: int = 0) -> list[Component]:
    """rhe: g by bin. rhe_dom: g, then d. genie models G, G+GxE, G+GxE+NxE: g, then gxe by environment and bin, then nxe."""
    g = [Component("g", k) for k in range(bins)]
    if model == "rhe":
        return g
    if model == "rhe_dom":
        return g + [Component("d", k) for k in range(bins)]
    if model not in ("G", "G+GxE", "G+GxE+NxE"):
        raise ValueError(f"unknown model {model!r}")
    parts = model.split("+")
    gxe = [Component("gxe", k, e) for e in range(envs) for k in range(bins)] if "GxE" in parts else []
    return g + gxe + ([Component("nxe", 0, e) for e in range(envs)] if "NxE" in parts else [])


@dataclass
class Study:
    """Individuals' columns, all N long: y (N x traits), optional covariates and environments."""

    y: np.ndarray
    parts: list[Component]
    blocks: int
    vectors: int = 10
    seed: int = 42
    covariates: np.ndarray | None = None
    env: np.ndarray | None = None
    impute: str = "mean"  # binary, mean or zero
    z: np.ndarray | None = None
    method: str = "qr"
    segment: int = 8192  # individuals whose sums travel together

    def __post_init__(self) -> None:
        self.y = np.asarray(self.y, float).reshape(len(self.y), -1)
        self.y = self.y - self.y.mean(axis=0)
        n = len(self.y)
        if self.z is None:
            self.z = np.array([[gaussian_value(self.seed, i, b) for b in range(self.vectors)] for i in range(n)])
        if self.covariates is not None:
            c = np.asarray(self.covariates, float).reshape(n, -1)
            self.inverse = np.linalg.pinv(c.T @ c)
            self.covariates, self.y = c, self.y - self.project(self.y, c)
            self.uz = self.project(self.z)
        if self.env is not None:
            self.env = np.asarray(self.env, float).reshape(n, -1)

    def project(self, v: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
        c = self.covariates if c is None else c
        return c @ (self.inverse @ (c.T @ v))

    def right(self) -> np.ndarray:
        """What X' is multiplied with: random vectors, their projections, phenotypes."""
        return np.hstack([self.z, *([self.uz] if self.covariates is not None else []), self.y])


def _chunk_matrix(dosage: list[np.ndarray], snps: list[int], impute: str, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Standardized additive X (N x m), filled counts and mean counts; a SNP that doesn't vary is a zero column."""
    d = np.stack(dosage, axis=1)
    gap = np.isnan(d)
    known = np.maximum((~gap).sum(axis=0), 1)
    mu = np.where(gap, 0, d).sum(axis=0) / known
    if gap.any():
        if impute == "mean":
            fill = mu
        elif impute == "zero":
            fill = np.zeros(len(mu))
        else:
            import hashlib

            u = np.array([(int(hashlib.md5(f"{seed}:{m}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0 for m in snps])
            p = mu / 2
            fill = (u >= (1 - p) ** 2).astype(float) + (u >= (1 - p) ** 2 + 2 * p * (1 - p))
        d = np.where(gap, fill, d)
        mu = d.mean(axis=0)
    scale = np.sqrt(np.maximum(mu * (1 - mu / 2), 0))
    varies = (mu > 0) & (mu < 2)
    return np.where(varies, (d - mu) / np.where(varies, scale, 1), 0), d, mu


def _dominance_matrix(d: np.ndarray, mu: np.ndarray) -> np.ndarray:
    varies = (mu > 0) & (mu < 2)
    e = np.where(d == 0, 0, np.where(d == 1, mu, 2 * mu - 2))
    spread = mu * (1 - mu / 2)
    return np.where(varies, (e - e.mean(axis=0)) / np.where(varies, spread, 1), 0)


class _Sums:
    """X (X' right) by component, |X'y|^2 by component and trait, and SNP counts."""

    def __init__(self, study: Study, right: np.ndarray, kinds: dict[str, Kind]):
        self.study, self.right, self.kinds = study, right, kinds
        n_z = right.shape[1] - study.y.shape[1]
        self.n_z, k = n_z, len(study.parts)
        self.xx = np.zeros((k, len(right), n_z))
        self.yy = np.zeros((k, study.y.shape[1]))
        self.m = np.zeros(k, np.int64)
        self.dosage: list[np.ndarray] = []
        self.snps: list[int] = []
        self.bins: list[list[int]] = []

    def add(self, m: int, dosage: np.ndarray, bins: list[int]) -> None:
        self.snps.append(m), self.dosage.append(dosage), self.bins.append(bins)
        if len(self.snps) == CHUNK:
            self.flush()

    def flush(self) -> None:
        if not self.snps:
            return
        chunk = Chunk(*_chunk_matrix(self.dosage, self.snps, self.study.impute, self.study.seed))
        made: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for k, p in enumerate(self.study.parts):
            if (columns := self.kinds[p.kind].columns) is None:
                continue
            key = (p.kind, p.env)
            if key not in made:
                full = columns(chunk, self.study, p)
                made[key] = full, full.T @ self.right
            full, w = made[key]
            pick = np.array([i for i, b in enumerate(self.bins) if p.bin in b], int)
            if len(pick):
                self.xx[k] += full[:, pick] @ w[pick, : self.n_z]
                self.yy[k] += (w[pick, self.n_z :] ** 2).sum(axis=0)
                self.m[k] += len(pick)
        self.snps, self.dosage, self.bins = [], [], []


def _closed_forms(study: Study, right: np.ndarray, xx: np.ndarray, yy: np.ndarray, m: np.ndarray, kinds: dict[str, Kind], rows: slice = slice(None)) -> None:
    """The components without SNPs over some individuals."""
    for k, p in enumerate(study.parts):
        if (squares := kinds[p.kind].squares) is not None:
            e2 = squares(study, p)[:, None]
            xx[k], m[k] = e2[rows] * right[rows, : xx.shape[2]], 1
            yy[k] = (e2 * study.y**2).sum(axis=0)


def contract(study: Study, xx: np.ndarray, rows: slice = slice(None)) -> np.ndarray:
    """What normal equations need of X (X' right) over some individuals, as one vector. It adds up over individuals: inner
    products of components, with random vectors and their projections, and products with the covariates, by which
    projected vectors' inner products can be had without projecting any."""
    b, z = study.z.shape[1], study.z[rows]
    a = xx[:, :, :b]
    parts = [np.einsum("knb,lnb->kl", a, a).ravel(), (a * z).sum(axis=(1, 2))]
    if study.covariates is not None:
        c = study.covariates[rows]
        parts += [(a * study.uz[rows]).sum(axis=(1, 2)), np.einsum("nc,knb->kbc", c, a).ravel(), np.einsum("nc,knb->kbc", c, xx[:, :, b:]).ravel()]
    return np.concatenate(parts)


def normal_equations(study: Study, sums: np.ndarray, yy: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """T ((K + 1) x (K + 1)) and q ((K + 1) x traits) from contract()'s sums over all individuals."""
    k, n, b = len(study.parts), len(study.y), study.z.shape[1]
    g, own, rest = sums[: k * k].reshape(k, k), sums[k * k : k * k + k], sums[k * k + k :]
    t, base = np.zeros((k + 1, k + 1)), np.full(k, float(n))
    for i, p in enumerate(study.parts):  # the trace of a kinship matrix that isn't N by construction is estimated
        if KINDS[p.kind].estimated and m[i]:
            base[i] = own[i] / (b * m[i])
    t[k, k] = n
    if study.covariates is not None:
        with_uz, (ca, cau) = rest[:k], rest[k:].reshape(2, k, b, -1)
        g = g + np.einsum("kbc,cd,lbd->kl", cau, study.inverse, ca) - 2 * np.einsum("kbc,cd,lbd->kl", ca, study.inverse, ca)
        base = base - np.divide(with_uz, b * m, out=np.zeros(k), where=m > 0)
        t[k, k] = n - study.covariates.shape[1]
    scale = np.outer(m, m).astype(float) * b
    t[:k, :k] = np.divide(g, scale, out=np.zeros_like(g), where=scale > 0)
    t[:k, k] = t[k, :k] = base
    q = np.vstack([np.divide(yy, m[:, None], out=np.zeros_like(yy), where=m[:, None] > 0), (study.y**2).sum(axis=0)[None]])
    return t, q


def solve(t: np.ndarray, q: np.ndarray, method: str = "qr") -> np.ndarray:
    """Least squares, or QR; a singular system falls back to least squares."""
    if method == "qr":
        a, r = np.linalg.qr(t)
        if np.abs(np.diag(r)).min() > 1e-10 * max(1.0, np.abs(np.diag(r)).max()):
            return np.linalg.solve(r, a.T @ q)
    return np.linalg.lstsq(t, q, rcond=None)[0]


ROW = "block long, m long, dosage array<tinyint>, bins array<int>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, list[int]]]:
    for batch in batches:
        for i, (block, m, bins) in enumerate(zip(batch.column("block").to_pylist(), batch.column("m").to_pylist(), batch.column("bins").to_pylist())):
            yield block, m, batch.column("dosage")[i].values.cast(pa.float64()).to_numpy(zero_copy_only=False), bins or []


SUMS = "block long, k int, at long, xx array<double>, yy array<double>, n long"


def _emit(block: int, sums: _Sums) -> list[tuple]:
    """A task's sums by component and segment of individuals."""
    rows, step = [], sums.study.segment
    for k, n in enumerate(sums.m.tolist()):
        for at in range(0, len(sums.right) if n else 0, step):
            rows.append((block, k, at, sums.xx[k, at : at + step].ravel(), sums.yy[k] if at == 0 else np.zeros(0), n if at == 0 else 0))
    return rows


def _batch(rows: list[tuple], kinds: tuple, names: tuple[str, ...]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], list(names))


_FLOATS = pa.list_(pa.float64())
_SUM_KINDS = (pa.int64(), pa.int32(), pa.int64(), _FLOATS, _FLOATS, pa.int64())


def _blocks(batches: Iterator[pa.RecordBatch], study: Study, right: np.ndarray, kinds: dict[str, Kind]) -> Iterator[tuple[int, _Sums]]:
    """The sums of each block, rows being sorted by block."""
    block, sums = None, None
    for j, snp, dosage, bins in _rows(batches):
        if j != block:
            if sums is not None:
                sums.flush()
                yield block, sums
            block, sums = j, _Sums(study, right, kinds)
        sums.add(snp, dosage, bins)
    if sums is not None:
        sums.flush()
        yield block, sums


def _add(pdf):
    """Sums of tasks, or of groups of them, added up one by one."""
    xx, yy = np.zeros(len(pdf.xx.iloc[0])), np.zeros(len(pdf.yy.iloc[0]))
    for a, b in zip(pdf.xx, pdf.yy):
        xx += a
        yy += b
    return pdf.iloc[:1].assign(xx=[xx], yy=[yy], n=int(pdf.n.sum()))


NAMES = ("block", "k", "at", "xx", "yy", "n")


def _kinds(study: Study) -> dict[str, Kind]:
    return {p.kind: KINDS[p.kind] for p in study.parts}


def added(parts: DataFrame) -> DataFrame:
    """One row a component and segment of individuals from those of many tasks (SUMS), added up in two steps."""
    several = parts.withColumn("block", F.spark_partition_id().cast("long") % int(np.ceil(parts.sparkSession.sparkContext.defaultParallelism**0.5)))
    return several.groupBy("block", "k", "at").applyInPandas(_add, SUMS).groupBy("k", "at").applyInPandas(_add, SUMS)


def sums(snps: DataFrame, study: Study, shared=None) -> DataFrame:
    """Pass 1: rows (block, m, dosage, bins) to sums over their SNPs (SUMS). Sums of several sets of SNPs add up by added()."""
    context, kinds = snps.sparkSession.sparkContext, _kinds(study)
    shared = shared or context.broadcast((study, study.right()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        study, right = shared.value
        sums = _Sums(study, right, kinds)
        for _, m, dosage, bins in _rows(batches):
            sums.add(m, dosage, bins)
        sums.flush()
        yield _batch(_emit(0, sums), _SUM_KINDS, NAMES)

    # a task returns K sums of N x B numbers however few SNPs it has: no more tasks than run at once
    return added(snps.coalesce(context.defaultParallelism).mapInArrow(first, SUMS))


def gathered(totals: DataFrame, study: Study) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X (X' right), |X'y|^2 and SNPs by component, on the driver: K sums of N x B numbers."""
    n_z = study.right().shape[1] - study.y.shape[1]
    xx, yy, m = np.zeros((len(study.parts), len(study.y), n_z)), np.zeros((len(study.parts), study.y.shape[1])), np.zeros(len(study.parts), np.int64)
    for batch in totals.toArrow().to_batches():  # numbers stay in Arrow's buffers
        for i, (part, at) in enumerate(zip(batch.column("k").to_pylist(), batch.column("at").to_pylist())):
            values = batch.column("xx")[i].values.to_numpy().reshape(-1, n_z)
            xx[part, at : at + len(values)] = values
            if at == 0:
                yy[part], m[part] = batch.column("yy")[i].values.to_numpy(), batch.column("n")[i].as_py()
    return xx, yy, m


def whole_sample(study: Study, xx: np.ndarray, yy: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """T and q of all SNPs that gathered() sums are of."""
    xx, yy, m = xx.copy(), yy.copy(), m.copy()
    _closed_forms(study, study.right(), xx, yy, m, _kinds(study))
    return normal_equations(study, contract(study, xx), yy, m)


def run(spark: SparkSession, snps: DataFrame, study: Study, splits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """T (J + 1), q (J + 1) and M (J + 1, K) of every sample; sample j leaves block j out, the last none.

    snps has rows (block, m, dosage, bins). It is read twice; store it if it is dear to compute. Where more tasks run at
    once than there are blocks, pass 2 deals each block to `splits` tasks, whose sums meet by block and segment of
    individuals; otherwise a block's sums never leave its task.
    """
    right, slots, kinds = study.right(), spark.sparkContext.defaultParallelism, _kinds(study)
    splits = splits or -(-slots // study.blocks)
    shared = spark.sparkContext.broadcast((study, right))
    xx, yy, m = gathered(sums(snps, study, shared), study)
    n_z, k, traits, j = xx.shape[2], len(study.parts), study.y.shape[1], study.blocks
    whole = spark.sparkContext.broadcast((xx, yy, m))
    types, fields = (pa.int64(), _FLOATS, _FLOATS, pa.list_(pa.int64())), "block long, sums array<double>, yy array<double>, m array<long>"

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        study, right = shared.value
        out = []
        for block, sums in _blocks(batches, study, right, kinds):
            a, y, n = (t - own for t, own in zip(whole.value, (sums.xx, sums.yy, sums.m)))
            _closed_forms(study, right, a, y, n, kinds)
            out.append((block, contract(study, a), y.ravel(), n))
        yield _batch(out, types, ("block", "sums", "yy", "m"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        study, right = shared.value
        for block, sums in _blocks(batches, study, right, kinds):
            yield _batch(_emit(block, sums), _SUM_KINDS, NAMES)

    def meet(pdf):
        """A block's segment of individuals, from all of its tasks and components."""
        import pandas as pd

        study, right = shared.value
        total, all_y, all_m = whole.value
        at = int(pdf["at"].iloc[0])
        rows = slice(at, at + study.segment)
        a, y, n = total[:, rows].copy(), np.zeros((k, traits)), np.zeros(k, np.int64)
        for part, values, own, count in zip(pdf.k, pdf.xx, pdf.yy, pdf.n):
            a[part] -= np.asarray(values).reshape(-1, n_z)
            if at == 0:
                y[part] += own
                n[part] += count
        y, n = all_y - y, all_m - n
        _closed_forms(study, right, a, y, n, kinds, rows)
        first = float(at == 0)  # what isn't by individual counts once
        return pd.DataFrame({"block": pdf.block.iloc[:1].to_list(), "sums": [contract(study, a, rows)], "yy": [y.ravel() * first], "m": [(n * int(first)).tolist()]})

    def together(pdf):
        return pdf.iloc[:1].assign(**{c: [np.sum(np.stack(pdf[c].to_list()), axis=0)] for c in ("sums", "yy", "m")})

    _closed_forms(study, right, xx, yy, m, kinds)
    t_all, q_all, m_all = np.zeros((j + 1, k + 1, k + 1)), np.zeros((j + 1, k + 1, traits)), np.zeros((j + 1, k), np.int64)
    t_all[:], q_all[:] = normal_equations(study, contract(study, xx), yy, m)
    m_all[:] = m  # a block without SNPs leaves nothing out
    if j > 1:
        if splits == 1:
            left = snps.repartition(j, "block").sortWithinPartitions("block", "m").mapInArrow(within, fields)
        else:
            dealt = snps.withColumn("_part", F.expr(f"pmod(xxhash64(m), {splits})")).repartition(j * splits, "block", "_part").drop("_part")
            parts = dealt.sortWithinPartitions("block", "m").mapInArrow(across, SUMS)
            left = parts.groupBy("block", "at").applyInPandas(meet, fields).groupBy("block").applyInPandas(together, fields)
        for r in left.toArrow().to_pylist():
            b, n = r["block"], np.array(r["m"])
            t_all[b], q_all[b] = normal_equations(study, np.array(r["sums"]), np.array(r["yy"]).reshape(k, traits), n)
            m_all[b] = n
    return t_all, q_all, m_all


def estimate(spark: SparkSession, snps: DataFrame, study: Study) -> DataFrame:
    """(trait, j, k, value, trace, n): variance components of every sample; k is a component's name or 'e'. trace is T[k, e],
    n the component's SNPs (null for noise). All traits share T, which doesn't depend on them."""
    return solved(spark, study, *run(spark, snps, study))


def solved(spark: SparkSession, study: Study, t: np.ndarray, q: np.ndarray, m: np.ndarray) -> DataFrame:
    """estimate() of normal equations at hand."""
    names, rows = [p.name for p in study.parts] + ["e"], []
    for j in range(len(t)):
        sigma = solve(t[j], q[j], study.method)
        for trait in range(sigma.shape[1]):
            rows += [(trait, j, name, float(sigma[i, trait]), float(t[j, i, -1]), int(m[j, i]) if i < m.shape[1] else None) for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "trait int, j long, k string, value double, trace double, n long")


def as_rows(geno: DataFrame, annot: DataFrame, blocks: int, n_snps: int) -> DataFrame:
    """Kernel rows from long genotypes (i, m, d) and (m, bin)."""
    from heristat.operators.genotype import snp_major
    from heristat.operators.layout import block_of

    bins = annot.groupBy("m").agg(F.collect_set(F.col("bin").cast("int")).alias("bins"))
    return snp_major(geno).join(bins, "m", "left").select(block_of(F.col("m"), n_snps, blocks).alias("block"), "m", F.col("dosage").cast("array<tinyint>").alias("dosage"), "bins")


# --- vectors X'X z over raw counts -------------------------------------------------------------------------------------------

#: Numbers of N x B sums that the driver holds and broadcasts at a time.
GROUP_NUMBERS = 1 << 23


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(block, m, counts (SNPs x N)) of chunks of one block's neighbouring rows; missing counts are 0."""
    block, snps, held = None, [], []
    for j, m, dosage, _ in _rows(batches):
        if held and (j != block or len(held) == CHUNK):
            yield block, snps, np.stack(held)
            snps, held = [], []
        block = j
        snps.append(m), held.append(np.nan_to_num(dosage))
    if held:
        yield block, snps, np.stack(held)


def xtxz(spark: SparkSession, snps: DataFrame, n: int, blocks: int, vectors: int, seed: int, path: str) -> Iterator[DataFrame]:
    """Rows (j, m, u array<double>) with u = X'X z over raw counts of n individuals, from SNPs outside block j and for those
    only; j = blocks keeps all. z is drawn by SNP and vector.

    snps is (block, m, dosage, bins). The sums X z of each block are kept as a table at path; they are broadcast for as many
    samples at a time as make GROUP_NUMBERS numbers, one DataFrame each. A DataFrame must be used before the next is asked for.
    A SNP's counts meet all vectors of these samples in one product, and no genotype is shuffled but once by block.
    """
    step = 8192

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros((n, vectors))

        def rows() -> pa.RecordBatch:
            return _batch([(block, at, total[at : at + step].ravel()) for at in range(0, n, step)], (pa.int64(), pa.int64(), _FLOATS), ("block", "at", "w"))

        for j, m, x in _counts(batches):
            if block is not None and j != block:
                yield rows()
                total = np.zeros((n, vectors))
            block = j
            total += x.T @ np.array([[gaussian_value(seed, s, b) for b in range(vectors)] for s in m])
        if block is not None:
            yield rows()

    snps.repartition(blocks, "block").sortWithinPartitions("block", "m").mapInArrow(within, "block long, at long, w array<double>").write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)

    def matrix(rows: DataFrame, count: int) -> np.ndarray:
        out = np.zeros((count, n, vectors))
        for b in rows.toArrow().to_batches():
            for i, (place, at) in enumerate(zip(b.column("place").to_pylist(), b.column("at").to_pylist())):
                out[place, at : at + step] = b.column("w")[i].values.to_numpy().reshape(-1, vectors)
        return out

    def plus(pdf):
        return pdf.iloc[:1].assign(w=[np.sum(np.stack(pdf.w.to_list()), axis=0)], place=0)[["place", "at", "w"]]

    whole = matrix(stored.groupBy("at").applyInPandas(plus, "place int, at long, w array<double>"), 1)[0]
    size = max(1, GROUP_NUMBERS // max(1, n * vectors))
    for a in range(0, blocks + 1, size):
        samples = list(range(a, min(a + size, blocks + 1)))
        own = matrix(stored.filter(F.col("block").isin(samples)).select((F.col("block") - a).alias("place"), "at", "w"), len(samples))
        shared = spark.sparkContext.broadcast(np.concatenate(list(whole - own), axis=1))

        def across(batches: Iterator[pa.RecordBatch], samples=samples, shared=shared) -> Iterator[pa.RecordBatch]:
            for block, m, x in _counts(batches):
                u = (x @ shared.value).reshape(len(m), len(samples), vectors)
                rows = [(j, s, u[i, k]) for k, j in enumerate(samples) if j != block for i, s in enumerate(m)]
                yield _batch(rows, (pa.int64(), pa.int64(), _FLOATS), ("j", "m", "u"))

        yield snps.mapInArrow(across, "j long, m long, u array<double>")


def _squares(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("j").cast("long").alias("j")).agg(F.sum(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)).alias("s"), F.count(F.lit(1)).alias("n"))


def xtxz_traces(groups: Iterator[DataFrame], vectors: int) -> DataFrame:
    """(j, trace) of xtxz()'s rows: |u|^2 / (B M^2) over a sample's M SNPs. A row a sample comes to the driver."""
    spark, rows = SparkSession.getActiveSession(), []
    for g in groups:
        rows += [(r.j, r.s / (vectors * r.n * r.n)) for r in _squares(g).collect()]
    return spark.createDataFrame(rows, "j long, trace double")


def write_xtxz(groups: Iterator[DataFrame], path: str) -> None:
    """Write xtxz()'s rows as Parquet at path, a folder a sample."""
    mode = "overwrite"
    for g in groups:
        g.write.partitionBy("j").mode(mode).parquet(path)
        mode = "append"
