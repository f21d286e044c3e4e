"""Document quality by support vectors over naive Bayes features.

Indicators of hashed n-grams (bytes by threes with case kept, word pairs with repeats marked) are scaled by
the log ratio of their smoothed counts in the two classes; a linear hinge-loss model is then fitted by
dual coordinate descent. Counts are over all labelled training rows; the margin model is fitted, and its scores
calibrated, on a bounded sample of them. Every document is scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessitura.llm.wordhash import WHITE, Slice, mix, slices, words

BITS = 18
#: Rows the margin model is fitted on; 4 bytes per distinct n-gram of each reach the driver.
SAMPLE_ROWS = 4096
SMOOTH = 1.0
BLEND = 0.25
COST = 1.0
PASSES = 12


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text leaves 1 modulo 3; so does a row without an id, which never trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def features(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram buckets of each document of a slice, one after the other, and how many."""
    docs = len(part.bounds) - 1
    data = part.data.astype(np.uint64)
    owner = np.repeat(np.arange(docs), np.diff(part.bounds))
    keys, owners = [], []
    if len(data) >= 3:
        whole = owner[2:] == owner[:-2]
        keys.append((data[:-2] | data[1:-1] << np.uint64(8) | data[2:] << np.uint64(16))[whole])
        owners.append(owner[2:][whole])
    w = words(part, WHITE, fold=False)
    if len(w.hash) >= 2:
        same = w.doc[1:] == w.doc[:-1]
        pair = np.where(w.hash[1:] == w.hash[:-1], np.uint64(7), w.hash[:-1] * np.uint64(3) + w.hash[1:])
        keys.append((pair | np.uint64(1 << 63))[same])
        owners.append(w.doc[1:][same])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(docs, np.int64)
    bucket = (mix(np.concatenate(keys)) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique((np.concatenate(owners) << BITS) | bucket)
    return both & ((1 << BITS) - 1), np.bincount(both >> BITS, minlength=docs)


class Model(NamedTuple):
    """Weights of the buckets, and the calibration of a margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(counts))
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            sums[some] = np.add.reduceat(self.weights[buckets], starts) / np.sqrt(counts[some])
        return sums + self.bias

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def log_ratios(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    p, q = pos + SMOOTH, neg + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss; y is -1 or 1, cost bounds each row's dual value."""
    draw = np.random.default_rng(seed)
    values = [scale[r] / math.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([float(v @ v) for v in values]) + 1.0
    weights, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    for _ in range(passes):
        for i in draw.permutation(len(rows)):
            slack = y[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return weights, bias


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """A logistic curve through held-back margins, by Newton steps; targets are drawn in from 0 and 1."""
    pos, neg = labels.sum(), (1 - labels).sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class, in how many of the task's documents each bucket occurs."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for part in slices(batch.column("text")):
            buckets, n = features(part)
            own = np.repeat(label[part.first : part.first + len(n)], n)
            for c in (0, 1):
                counts[c] += np.bincount(buckets[own == c], minlength=1 << BITS)
    seen = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(seen), 1 << 16):
        some = seen[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1][some]), pa.array(counts[0][some])], names=["bucket", "pos", "neg"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label")
        for part in slices(batch.column("text")):
            buckets, n = features(part)
            rows = [b.astype(np.int32).tobytes() for b in np.split(buckets, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([label.slice(part.first, len(n)), pa.array(rows, pa.binary())], names=["label", "buckets"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the labelled rows of `docs` (doc_id, text) that are not held out; labels: doc_id, label 0 or 1.

    Labels that are NULL or neither 0 nor 1 are left out. With rows of one class or none at all, every
    document gets the share of label 1 among them (or 0.5) as its score.
    """
    usable = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").where(~held_out("doc_id")).select("doc_id", F.col("label").cast("int"))
    # Both sides grow with the corpus, so they meet by a sort-merge join at every size.
    known = docs.where(~held_out("doc_id")).join(usable.hint("merge"), "doc_id").select("label", "text")
    grouped = known.mapInArrow(_count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = grouped.toPandas()  # 2^BITS rows at most
    pos, neg = (np.bincount(counts["bucket"], counts[c], minlength=1 << BITS) for c in ("pos", "neg"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows))  # sample_rows of 12 bytes
    sample = docs.join(chosen, "doc_id").select("label", "text").mapInArrow(_gather, "label int, buckets binary").collect()
    sample.sort(key=lambda r: (r["buckets"], r["label"]))
    order = np.random.default_rng(0).permutation(len(sample))[:sample_rows]
    rows = [np.frombuffer(sample[i]["buckets"], np.int32) for i in order]
    y = np.array([sample[i]["label"] for i in order], np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(1 << BITS), 0.0, 1.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
    scale = log_ratios(pos, neg)
    back = max(1, len(rows) // 5)
    # Either class weighs as much in total, so that the rarer one is learned too.
    cost = COST * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    fit = lambda k: fit_hinge(rows[k:], scale, 2 * y[k:] - 1, cost[k:], PASSES)
    blend = lambda w: scale * ((1 - BLEND) * np.abs(w).mean() + BLEND * w)
    counted = np.array([len(r) for r in rows])
    weights, bias = fit(back)
    trial = Model(blend(weights), BLEND * bias, 1.0, 0.0)
    held = trial.margins(np.concatenate(rows[:back]), counted[:back])
    slope, shift = calibrated(held, y[:back])
    weights, bias = fit(0)
    return Model(blend(weights), BLEND * bias, slope, shift)


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
                  into: str = "quality_score", keep: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` (columns `keep`, all by default) with `into`: a score from 0 to 1, higher for label 1.

    `labels` has doc_id and `label`; ids not in `docs` are ignored, repeated labels count each. NULL and
    empty texts have no n-grams and get the score of the model's bias. Rows are scored one by one, so
    repeated rows agree. A column named like `into` is replaced. An empty table gives an empty result.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(plain, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")), sample_rows))
    names = [c for c in (keep or docs.columns) if c != into]
    rows = docs.select(*names, *([F.col(text).cast("string").alias("__text")] if text not in names else []))
    read = text if text in names else "__text"
    schema = StructType([*docs.select(*names).schema.fields, StructField(into, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        for batch in batches:
            out = [fitted.probability(fitted.margins(*features(part))) for part in slices(batch.column(read))]
            scores = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), scores], names=[*names, into])

    return rows.mapInArrow(score, schema)
