"""Toxicity severity by cumulative-link ordinal regression.

P(grade >= k | x) = sigmoid(w.x - b_k): one sparse weight vector shared by all ordered thresholds b_1 <= b_2 <= ...;
x holds log(1 + count) of words and of word beginnings. Fitted by proximal gradient with an L1 penalty on a bounded sample
of labelled rows, so that only words that carry the label keep a weight. The output is the expected severity, sum over k
of P(grade >= k).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heristat.llm.common import materialize, plain, slices, utf8

#: At most so many labelled rows are fitted on: those with the least hash of their id.
SAMPLE = 4000
#: A feature counts if so many documents of the sample have it, and at most this share of them.
MIN_DOCS, MAX_SHARE = 5, 0.25
#: Of those, so many are fitted: the most associated with toxicity.
VOCABULARY = 3000
L1, STEPS, TOLERANCE = 2e-4, 3000, 1e-4
#: Lengths, in bytes, of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7, 8)
#: P(grade >= 1) from which a document counts as toxic; on held-out rows clean documents stay well below.
THRESHOLD = 0.3

#: Everything but letters becomes a space; bytes above ASCII count as letters.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_LETTERS).split()


def features(found: list[bytes]) -> Counter:
    """Counts of words, and of beginnings of longer words, written ^beginning."""
    counts = Counter(found)
    for w, n in list(counts.items()):
        for k in BEGINNINGS:
            if k < len(w):
                counts[b"^" + w[:k]] += n
    return counts


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    weights: dict[bytes, float]
    cuts: np.ndarray  # ascending

    def __post_init__(self) -> None:
        self.whole = {w for w in self.weights if w[:1] != b"^"}
        starts = [w[1:] for w in self.weights if w[:1] == b"^"]
        self.begun = {k: {w for w in starts if len(w) == k} for k in {len(w) for w in starts}}
        self.gate = {w[: BEGINNINGS[0]] for w in starts}

    def at_least(self, text: bytes) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        found = words(text)
        bag = set(found)
        hit = self.whole & bag
        gate, n = self.gate, BEGINNINGS[0]
        hit |= {w for w in bag if w[:n] in gate and any(w[:k] in s for k, s in self.begun.items())}
        score = 0.0
        if hit:
            counts = features([w for w in found if w in hit])
            score = sum(self.weights[w] * math.log1p(counts[w]) for w in sorted(self.weights.keys() & counts.keys()))
        return _sigmoid(score - self.cuts)


def association(n, k, docs: int, toxic: int):
    """How far k of the n documents with a feature being toxic is from chance, squared and in standard deviations."""
    expected = n * toxic / docs
    return (k - expected) ** 2 / np.maximum(expected * (1 - toxic / docs) * (docs - n) / max(docs - 1, 1), 1e-12)


def solve(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, width: int, l1: float = L1, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts that minimise the mean negative log-likelihood of grades y given a sparse matrix, plus l1 times
    the weights' sizes: accelerated proximal gradient, restarted where it turns, until no number moves by TOLERANCE."""
    n, v, top = len(y), width, int(y.max())
    share = np.clip([(y >= k).mean() for k in range(1, top + 1)], 1e-6, 1 - 1e-6)
    w, cuts = np.zeros(v), -np.log(share / (1 - share))
    probe, size = np.ones(v), 1.0  # power iteration for the curvature's bound
    for _ in range(20 if len(row) else 0):
        probe = np.bincount(col, val * np.bincount(row, val * probe[col], minlength=n)[row], minlength=v)
        size = max(float(np.linalg.norm(probe)), 1e-12)
        probe = probe / size
    rate = 2.0 * n / max(size, n)

    def gradient(w, cuts):
        score = np.bincount(row, val * w[col], minlength=n)
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = ends[y], ends[y + 1]  # P(y) = sigmoid(s - low) - sigmoid(s - high)
        a, b = np.where(np.isinf(low), 1.0, _sigmoid(score - low)), np.where(np.isinf(high), 0.0, _sigmoid(score - high))
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        by_score = -(da - db) / n
        by_cut = np.bincount(np.maximum(y - 1, 0), np.where(y > 0, da, 0) / n, minlength=top) - np.bincount(np.minimum(y, top - 1), np.where(y < top, db, 0) / n, minlength=top)
        return np.bincount(col, val * by_score[row], minlength=v), by_cut

    move, move_cuts, t = w.copy(), cuts.copy(), 1.0
    for _ in range(steps):
        gw, gc = gradient(move, move_cuts)
        new = move - rate * gw
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_cuts = np.maximum.accumulate(move_cuts - rate * gc)
        moved = max(float(np.abs(new - w).max(initial=0)), float(np.abs(new_cuts - cuts).max()))
        if (move - new) @ (new - w) + (move_cuts - new_cuts) @ (new_cuts - cuts) > 0:
            t = 1.0
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        move, move_cuts = new + (t - 1) / t_new * (new - w), np.maximum.accumulate(new_cuts + (t - 1) / t_new * (new_cuts - cuts))
        w, cuts, t = new, new_cuts, t_new
        if moved < TOLERANCE:
            break
    return w, cuts


def constant(grades: list[int]) -> OrdinalModel | None:
    """The model of fewer than two distinct grades: always the one there is, or 0."""
    if len(set(grades)) > 1:
        return None
    return OrdinalModel({}, np.array([-40.0] * max(grades, default=0) or [40.0]))


def fit(texts: list[bytes], grades: list[int], min_docs: int = MIN_DOCS, l1: float = L1, steps: int = STEPS, max_share: float = MAX_SHARE, most: int = VOCABULARY) -> OrdinalModel:
    """train() for texts and grades 0, 1, ... at hand."""
    if (model := constant(grades)) is not None:
        return model
    bags = [features(words(t)) for t in texts]
    seen, toxic = Counter(), Counter()
    for bag, g in zip(bags, grades):
        seen.update(bag.keys())
        toxic.update(bag.keys() if g else ())
    known = sorted(w for w, n in seen.items() if min_docs <= n <= max_share * len(texts))
    worth = association(np.array([seen[w] for w in known], float), np.array([toxic[w] for w in known], float), len(texts), sum(g > 0 for g in grades))
    vocab = {known[i]: j for j, i in enumerate(np.lexsort((np.arange(len(known)), -worth))[:most])}
    cells = [(i, vocab[w], math.log1p(n)) for i, bag in enumerate(bags) for w, n in sorted(bag.items()) if w in vocab]
    row, col, val = (np.array(x) for x in zip(*cells)) if cells else (np.array([], int), np.array([], int), np.array([]))
    w, cuts = solve(row, col, val, np.array(grades), len(vocab), l1, steps)
    return OrdinalModel({x: float(w[i]) for x, i in vocab.items() if w[i]}, cuts)


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Rows (doc_id, grade, found array<struct<w binary, n int>>) of at most `sample` labelled documents, one row an id.

    Grades come from the labels alone: 0 if not toxic, 1 if toxic, 2 if toxic and of quality 0. An id's several labels count
    as the largest grade; of its several texts the one with the least hash counts. Rows without toxic label, id or text
    aren't sampled. Features are counted by the executors.
    """
    quality = F.col("quality") if "quality" in labels.columns else F.lit(1)
    graded = F.when(F.col("toxic") <= 0, 0).when(F.coalesce(quality, F.lit(1)) <= 0, 2).otherwise(1)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", graded.alias("grade")).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # sample rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").withColumn("h", F.xxhash64("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int32())]))
        for batch in batches:
            bags = [[{"w": w, "n": n} for w, n in features(words(t)).items()] for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), batch.column("h"), pa.array(bags, kind)], ["doc_id", "grade", "h", "found"])

    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    rows = texts.join(chosen, "doc_id").select("doc_id", "grade", "h", "text").mapInArrow(count, f"doc_id {id_type}, grade int, h bigint, found array<struct<w:binary,n:int>>")
    return rows.groupBy("doc_id").agg(F.min(F.struct("h", "grade", "found")).alias("r")).select("doc_id", "r.grade", "r.found")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = VOCABULARY, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> OrdinalModel:
    """Fit on the `sample` labelled documents of least id hash, as sampled() has them. Without labelled documents, or with one
    grade alone, the model always gives that grade, 0 where there is none.

    The driver gets the `most` features that are most associated with toxicity, of those that min_docs documents have and
    at most max_share of them, and their counts in the sample: nothing that grows with the corpus.
    """
    rows = materialize(sampled(docs, labels, sample), "sampled")
    grades = {r.doc_id: r.grade for r in rows.select("doc_id", "grade").toLocalIterator()}  # sample rows
    if (model := constant(list(grades.values()))) is not None:
        return model
    n, toxic = len(grades), sum(g > 0 for g in grades.values())
    each = rows.select("doc_id", "grade", F.explode("found").alias("f")).select("doc_id", "grade", "f.w", "f.n")
    seen = each.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") > 0).alias("k")).filter(f"n >= {int(min_docs)} AND n <= {max_share * n}")
    expected = F.col("n") * toxic / n
    worth = (F.col("k") - expected) ** 2 / F.greatest(expected * (1 - toxic / n) * (n - F.col("n")) / max(n - 1, 1), F.lit(1e-12))
    vocab = materialize(seen.select("w", worth.alias("worth")).orderBy(F.desc("worth"), "w").limit(most).select("w"), "vocabulary")
    names = sorted(bytes(r.w) for r in vocab.toLocalIterator())
    place, order = {w: i for i, w in enumerate(names)}, {d: i for i, d in enumerate(sorted(grades))}
    held = each.join(F.broadcast(vocab), "w").select("doc_id", "w", "n").toArrow()
    row = np.array([order[d] for d in held.column("doc_id").to_pylist()], np.int64)
    col = np.array([place[w] for w in held.column("w").to_pylist()], np.int64)
    at = np.lexsort((col, row))  # sums don't depend on the order rows came in
    val = np.log1p(held.column("n").to_numpy().astype(float))
    w, cuts = solve(row[at], col[at], val[at], np.array([grades[d] for d in sorted(grades)]), len(names))
    return OrdinalModel({x: float(w[i]) for x, i in place.items() if w[i]}, cuts)


def score(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs' doc_id with severity (expected grade), p_toxic (of grade 1 or more), toxic (1 from the threshold on) and grade (0
    where not toxic, else the likeliest of the others). Null text counts as empty; a text of any length counts whole; each
    row is scored, repeated ones alike. No rows: no rows. Columns besides id and text don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8 << 20):
            p = np.array([model.at_least(t) for t in utf8(part.column("text"))])
            each = -np.diff(np.column_stack([p, np.zeros(len(p))]), axis=1)
            toxic = p[:, 0] >= threshold
            cols = (p.sum(axis=1), p[:, 0], np.where(toxic, each.argmax(axis=1) + 1, 0).astype(np.int32), toxic.astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, cols)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, severity double, p_toxic double, grade int, toxic int")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score by the model fitted on the labels; without labels all are 0."""
    return score(docs, train(docs, labels))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't toxic, in one pass, with docs' columns, whatever their names. Null and empty texts, and all
    where there are no labels, stay; repeated rows go or stay alike."""
    model, safe = train(docs, labels), plain(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(model.at_least(t)[0] < threshold) for t in utf8(batch.column("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return safe.mapInArrow(run, safe.schema).toDF(*docs.columns)
