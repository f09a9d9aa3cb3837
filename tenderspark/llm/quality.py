"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams are scaled by the log-count ratios of the two classes; a linear hinge-loss model is fitted to the
scaled indicators by dual coordinate descent, and its margins are mapped to probabilities by a logistic curve."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.llm.common import with_text_columns
from tenderspark.llm.ngrams import codes

#: Byte n-grams: buckets and orders.
BITS = 17
ORDERS = (1, 2, 3)
#: Word n-grams by their shape, which keeps only what repeats what: each word is the place of its first use in the n-gram.
SHAPE_BITS = 13
SHAPES = (3, 5, 8)
SIZE = (1 << BITS) + (1 << SHAPE_BITS)


def _shapes(words: list[bytes]) -> Iterator[np.ndarray]:
    """Buckets of the shapes of all word n-grams, repeats included."""
    number: dict[bytes, int] = {}
    own = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    same = [own[: max(0, len(own) - d)] == own[d:] for d in range(max(SHAPES))]
    for n in SHAPES:
        size = len(own) - n + 1
        if size < 1:
            break
        code = np.full(size, n, np.uint32)
        for k in range(1, n):
            first = np.full(size, k, np.uint32)
            for j in reversed(range(k)):
                first[same[k - j][j : j + size]] = j
            code = code * np.uint32(9) + first
        yield code * np.uint32(0x9E3779B1) >> np.uint32(32 - SHAPE_BITS)


def _indicators(text: str | None) -> np.ndarray:
    """Buckets of the n-grams that a whole text holds, each once."""
    data = b" " + (text or "").encode() + b" "
    held = np.zeros(SIZE, bool)
    for c in codes(data, ORDERS, BITS):
        held[c] = True
    for c in _shapes(data.split()):
        held[(1 << BITS) + c] = True
    return np.flatnonzero(held)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, log-count ratio included
    bias: float
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        at = _indicators(text)
        margin = self.weight[at].sum() / max(1.0, len(at)) ** 0.5 + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def dual_coordinate_descent(
    rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, c: np.ndarray, passes: int = 12, seed: int = 0
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of c * hinge. Row i has values[rows[i]] / sqrt(len) at rows[i]."""
    x = [values[r] / max(1.0, len(r)) ** 0.5 for r in rows]
    q = np.array([v @ v + 1 for v in x])
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in random.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), c[i])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * x[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps; targets are drawn in a little (Platt)."""
    up, down = weight[y > 0].sum(), weight[y < 0].sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - t)) + 1e-3 * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, gradient)
    return float(theta[0]), float(theta[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_per_class: int = 2000,
    cost: float = 1.0,
) -> Model:
    """Learn from labelled rows where `train` holds; null labels and null ids teach nothing.

    Whole texts are read, of any length; a row that repeats in `docs` or `labels` teaches as often as it occurs, as do
    both labels of one id; other columns are ignored, whatever their names; empty tables teach nothing.

    Log-count ratios come from all of them. The hinge-loss model is fitted on a sample: the `sample_per_class` different
    pairs of id and text of each class that come first by a hash, all if there are fewer. If a class is missing, every
    score is the share of label 1 (0.5 without labels)."""
    known = labels.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("i"), (F.col(label_col) == 1).alias("good")
    )
    rows = docs.where(train).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    rows = rows.join(known.hint("merge"), "i")  # one plan at every size: labels grow with the corpus

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, texts = np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, good in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n[int(good), _indicators(text)] += 1
                texts[int(good)] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, SIZE)), *(pa.array(np.append(n[k, at], texts[k])) for k in (0, 1))], names=["b", "bad", "good"]
        )

    counts = (
        rows.select("t", "good")
        .mapInArrow(count, "b long, bad long, good long")
        .groupBy("b")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .toPandas()  # a row for each bucket that occurs, at most
    )
    n = np.zeros((2, SIZE + 1))
    at = counts["b"].to_numpy(int)
    n[0, at], n[1, at] = counts["bad"].to_numpy(float), counts["good"].to_numpy(float)
    texts, n = n[:, SIZE], n[:, :SIZE]
    if not texts.all():
        share = texts[1] / texts.sum() if texts.sum() else 0.5
        return Model(np.zeros(SIZE), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    p = (n + 1) / (n + 1).sum(1, keepdims=True)
    ratio = np.log(p[1] / p[0])

    # the different texts of each class that come first by hash: keys without texts are ranked, at most
    # 2 * sample_per_class of them are broadcast
    keyed = docs.where(train).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    keys = keyed.select("i", "h").join(known.hint("merge"), "i").distinct()
    place = F.row_number().over(W.partitionBy("good").orderBy(F.xxhash64("i", "h"), "i", "h"))
    picked = keys.withColumn("place", place).where(F.col("place") <= sample_per_class).select("i", "h", "good")
    sample = keyed.join(F.broadcast(picked), ["i", "h"]).groupBy("i", "h", "good").agg(F.min("t").alias("t"))
    got = with_text_columns(
        sample, ["i", "h", "good"], "t", "at array<int>", lambda: lambda texts: [[_indicators(t).astype(np.int32) for t in texts]]
    ).toArrow().sort_by([("i", "ascending"), ("h", "ascending"), ("good", "ascending")])
    good, lists = got["good"].to_numpy(), got["at"].combine_chunks()
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    x = [flat[a:b] for a, b in zip(ends, ends[1:])]
    y = np.where(good, 1.0, -1.0)
    # each text of the sample stands for so many of its class
    weight = np.where(good, texts[1] / max(1, good.sum()), texts[0] / max(1, (~good).sum()))
    balance = np.where(good, len(y) / (2 * max(1, good.sum())), len(y) / (2 * max(1, (~good).sum())))
    fold = np.arange(len(y)) % 4 == 0  # left out for the curve
    parts = [i for i in np.flatnonzero(~fold)] if (~fold).any() else list(range(len(y)))
    w, bias = dual_coordinate_descent([x[i] for i in parts], ratio, y[parts], cost * balance[parts])
    margin = np.array([(w[r] * ratio[r]).sum() / max(1.0, len(r)) ** 0.5 + bias for r in x])
    held = fold if fold.any() else ~fold
    slope, shift = _logistic(margin[held], y[held], weight[held])
    return Model((w * ratio).astype(np.float64), bias, max(slope, 1e-6), shift)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with score (0 to 1, higher: label 1 likelier) for each row; null and empty texts too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each bucket, whatever the corpus

    def start():
        return lambda texts: [[shared.value.score(t) for t in texts]]

    return with_text_columns(docs, keep, text_col, "score double", start)
