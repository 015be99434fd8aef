"""Operator 3, quality classifier: Naive Bayes support vectors.

A text's character 3-grams (of its UTF-8 bytes) and whether they occur are its features. Each indicator is scaled by
the log-count ratio of the two classes, and a linear hinge-loss model is fitted on the scaled indicators by dual
coordinate descent; its weights are mixed with their mean magnitude, as the published method does. A
logistic curve over the margin, fitted on labelled texts the model didn't see, gives the score.

Fitting takes a bounded sample of labelled rows (`Fit.sample`, the first by a hash of doc_id, counted after the join
with the texts, so that repeated doc_ids don't lengthen it). Tasks turn its texts into grams, and the driver holds
no more than those; scoring is one narrow pass over whole texts. Texts are cut into pieces of `Fit.piece` bytes while
grams are looked up, so a very long text needs no more memory than its own bytes and 2 MB of bits.

Edge cases: null and empty texts have no grams and get the score of the intercept alone; without labels, or with
one class only, the score is 0.5 or that class's share (smoothed); repeated rows are scored alike; labels that
repeat or contradict each other all count; null labels are ignored; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sets import distinct

GRAMS = 1 << 24


@dataclass(frozen=True)
class Fit:
    sample: int = 6000
    held_back: int = 4  # every 4th sampled text sets the curve
    smoothing: float = 1.0
    cost: float = 1.0
    rounds: int = 30
    mix: float = 0.25
    piece: int = 1 << 20
    seed: int = 7


def grams(data: bytes, piece: int = 1 << 20) -> np.ndarray:
    """The distinct 3-grams of a text, ascending; a space stands at both ends."""
    b = np.frombuffer(b" " + data + b" ", dtype=np.uint8)
    if not data:
        return np.zeros(0, dtype=np.int32)
    out = np.zeros(0, dtype=np.int32)
    for at in range(0, len(b) - 2, piece):
        p = b[at : at + piece + 2].astype(np.int32)
        g = distinct((p[:-2] << 16) | (p[1:-1] << 8) | p[2:])
        out = g if not len(out) else np.union1d(out, g)
    return out


@dataclass
class Model:
    index: np.ndarray  # the grams that have a weight, ascending
    weight: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        """The weights of a text's grams over the root of their number: long texts don't score higher for their length."""
        if not len(found) or not len(self.index):
            return self.intercept
        at = np.minimum(np.searchsorted(self.index, found), len(self.index) - 1)
        hit = self.index[at] == found
        return float(self.weight[at[hit]].sum() / np.sqrt(len(found)) + self.intercept)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -40, 40))))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, cost: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Weights (the last one is the intercept) of the L2-regularised hinge loss; rows are (columns, values)."""
    w, alpha = np.zeros(n + 1), np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            columns, values = rows[i]
            slope = y[i] * (values @ w[columns] + w[n]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[columns] += step * values
                w[n] += step
                alpha[i], most = new, max(most, abs(step))
        if most < 1e-3:
            break
    return w


def fit(texts: list[str | np.ndarray], labels: list[int], how: Fit = Fit()) -> Model:
    """`texts`: whole texts, or the grams() of them."""
    y = np.where(np.array(labels, dtype=np.int64) == 1, 1, -1)
    good = int((y > 0).sum())
    if good in (0, len(y)):
        share = (good + 1) / (len(y) + 2)
        return Model(np.zeros(0, np.int32), np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    found = [t if isinstance(t, np.ndarray) else grams((t or "").encode(), how.piece) for t in texts]
    back = np.arange(len(y)) % how.held_back == 0
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back[:] = False
    train = np.flatnonzero(~back)
    index = np.unique(np.concatenate([found[i] for i in train]))
    columns = [np.searchsorted(index, found[i]) for i in train]
    counts = {s: how.smoothing + np.bincount(np.concatenate([c for c, i in zip(columns, train, strict=True) if y[i] == s]), minlength=len(index)) for s in (1, -1)}
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[-1] / counts[-1].sum()))
    rows = [(c, ratio[c] / np.sqrt(max(len(c), 1))) for c in columns]
    share = {s: (y[train] == s).mean() for s in (1, -1)}
    cost = np.array([how.cost / (2 * share[y[i]]) for i in train])  # both classes weigh alike
    w = dual_coordinate_descent(rows, y[train], len(index), cost, how.rounds, how.seed)
    mean = np.abs(w[:-1]).mean()
    model = Model(index, ((1 - how.mix) * w[:-1] + how.mix * mean) * ratio, float(w[-1]), 1.0, 0.0)
    held = np.flatnonzero(back) if back.any() else train
    m = np.array([model.margin(found[i]) for i in held])
    model.slope, model.shift = _curve(m, y[held] > 0)
    return model


def _curve(m: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift by Newton's method, with the targets drawn in from 0 and 1."""
    t = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.column_stack([m, np.ones_like(m)])
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (t - p) - 1e-4 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """At most `how.sample` labelled rows that aren't held out, those whose doc_id hashes lowest: doc_id, quality, and the
    text's distinct grams as bytes of 32-bit integers."""
    chosen = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(how.sample)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # how.sample rows at most

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = pa.array([grams((t or "").encode(), how.piece).astype("<i4").tobytes() for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), g], ["doc_id", "quality", "grams"])

    rows = labelled.select("doc_id", "quality", "text").mapInArrow(found, "doc_id bigint, quality int, grams binary")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "grams").limit(how.sample)


def score(docs: DataFrame, model: Model, piece: int = Fit.piece) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's grams

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        dense = np.zeros(GRAMS, dtype=np.float32)
        dense[m.index] = m.weight
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                found = grams((text or "").encode(), piece)
                margin = m.intercept if not len(found) else float(dense[found].sum(dtype=np.float64) / np.sqrt(len(found)) + m.intercept)
                out.append(1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -40, 40))))
            s = np.array(out, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = sample(docs, table(spark, sf_dir, "labels", "doc_id", "quality")).toPandas().sort_values(["doc_id", "grams"])
    return score(docs, fit([np.frombuffer(g, dtype="<i4") for g in rows["grams"]], rows["quality"].tolist()))
