"""Language identification by nearest centroid.

Texts are normalised TF-IDF vectors of hashed letter n-grams; every language has several centroids, found by spherical
k-means, and a text gets the language of the centroid with the largest cosine. Where even that one is farther than the
distance learned from the training texts, the text is rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.llm.common import with_text_columns
from tenderspark.llm.ngrams import codes

BITS = 15
ORDERS = (1, 2, 3, 4)
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than small letters reads as a blank; bytes of other letters stay.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the letter n-grams of a whole text."""
    data = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "
    total = np.zeros(1 << BITS, np.int64)
    for c in codes(data, ORDERS, BITS):
        total += np.bincount(c, minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = _counts(text)
    v = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(v @ v)
    return at, v / norm if norm else v


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # buckets x centroids
    least: np.ndarray  # smallest cosine that a centroid accepts


def _centroids(x: np.ndarray, clusters: int) -> np.ndarray:
    k = min(clusters, len(x))
    chosen = [0]
    far = 1 - x @ x[0]
    while len(chosen) < k:  # farthest first
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(12):
        own = (x @ c.T).argmax(1)
        member = (own[:, None] == np.arange(k)).astype(x.dtype)
        c = np.where(member.any(0)[:, None], member.T @ x, c)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _kmeans(idf: np.ndarray, clusters: int):
    """Centroids of one language from its bounded sample of texts, and the cosines that new texts have to them.

    For these each half of the sample is held against centroids of the other: a text draws its own centroid near."""

    def fit(lang: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(rows), len(idf)), np.float32)
        texts = list(rows.sort_values(["h", "t"])["t"])
        for i, text in enumerate(texts):
            at, v = _vector(text, idf)
            x[i, at] = v
        c = _centroids(x, clusters)
        near = np.ones(len(x))
        if len(x) > 1:
            for own, other in ((0, 1), (1, 0)):
                near[own::2] = (x[own::2] @ _centroids(x[other::2], clusters).T).max(1)
        near = near[[bool(_LETTER.search(t)) for t in texts]]
        seen = [near, *[near[:0]] * (len(c) - 1)]
        return pd.DataFrame({"lang": lang[0], "centroid": list(c.astype(np.float32)), "seen": seen})

    return fit


def fit(
    docs: DataFrame,
    train: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    clusters: int = 4,
    sample_per_language: int = 500,
    slack: float = 0.5,
    nearest: float = 0.05,
    quantile: float = 0.005,
) -> Model:
    """Learn from the rows where `train` holds and text and language are not null.

    Document frequencies cover all of them. Centroids are fitted, one task a language, on its `sample_per_language` different
    texts of smallest hash (all, if there are fewer), so a text that very many rows share counts as one and no language
    with a text is left out.
    Cosines under `slack` times the `quantile` of those of all samples' texts are rejected, and always ones under `nearest`."""
    rows = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("t"), F.col(lang_col).alias("lang")
    )
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[_counts(text)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["b", "n"])

    found = rows.select("t").mapInArrow(frequencies, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    df[found["b"].to_numpy(int)] = found["n"].to_numpy(float)
    idf = np.log((1 + rows.count()) / (1 + df)) + 1

    hashed = rows.withColumn("h", F.pmod(F.xxhash64("t"), F.lit(1 << 62)))
    # the last hash that each language takes: first of slices of its hashes, then of what they leave
    some = hashed.select("lang", "h").distinct().withColumn("slice", F.col("h") % 64)
    for by in (["lang", "slice"], ["lang"]):
        at = F.row_number().over(W.partitionBy(*by).orderBy("h"))
        some = some.withColumn("n", at).where(F.col("n") <= sample_per_language)
    last = some.groupBy("lang").agg(F.max("h").alias("last"))
    # one row for each language, of which the model itself holds several centroids
    picked = hashed.join(F.broadcast(last), "lang").where("h <= last").groupBy("lang", "h").agg(F.min("t").alias("t"))
    got = (
        picked.select("t", "lang", "h").groupBy("lang")
        .applyInPandas(_kmeans(idf, clusters), "lang string, centroid array<float>, seen array<double>")
        .toPandas()
        .sort_values("lang", kind="stable")
    )
    centroids = np.stack(got["centroid"].to_list()).T if len(got) else np.zeros((1 << BITS, 0), np.float32)
    seen = np.concatenate([np.zeros(0), *got["seen"]])
    # a short text lies far from any centroid: what is rejected must lie well beyond almost all that were seen
    least = max(nearest, slack * float(np.quantile(seen, quantile, method="lower"))) if len(seen) else nearest
    return Model(idf, got["lang"].to_list(), np.ascontiguousarray(centroids), np.full(len(got), least))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", unknown: str = "und") -> DataFrame:
    """The columns `keep` with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected, for each row.

    Whole texts are read, of any length; repeated rows are repeated; other columns are ignored, whatever their names.
    Null texts and texts without a letter are `unknown`, score 0, rejected; so is every text if nothing was learned.
    A rejected text still names the nearest language. Of equal cosines the first centroid by language wins."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed number of buckets, a few centroids a language

    def start():
        m = shared.value

        def label(texts: list) -> list[list]:
            out = []
            for text in texts:
                if text is None or not m.languages or not _LETTER.search(text):
                    out.append((unknown, 0.0, True))
                    continue
                at, v = _vector(text, m.idf)
                cos = v @ m.centroids[at]
                best = int(cos.argmax())
                score = float(min(1.0, max(0.0, cos[best])))
                out.append((m.languages[best], score, score < m.least[best]))
            return [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]

        return label

    return with_text_columns(docs, keep, text_col, "lang_pred string, score double, rejected boolean", start)
