"""Approximate nearest neighbours by an inverted multi-index.

Both halves of every vector are quantised separately; a cell is a pair of half centroids. A query visits the cells in
order of the summed distance of its halves, with a heap, until they hold the share of all vectors that reached the
wanted recall on a sample; the vectors in these cells are reranked by the exact inner product."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.llm.common import stored

#: Vectors that one task holds for reranking, and queries that one task answers: bound memory, not what is searched.
BLOCK, CHUNK, SLICE = 8192, 4096, 256
#: Half centroids at most, so that the cells' counts stay a table of bounded size.
MOST_CENTROIDS = 512


def _matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        for j in np.unique(own):
            c[j] = x[own == j].mean(0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1) if x.shape[1] else np.zeros(len(x), int)


@dataclass
class Index:
    first: np.ndarray  # centroids of the first half
    second: np.ndarray
    counts: np.ndarray  # vectors in each cell
    probe: float  # share of all vectors that a query's cells have to hold
    block: np.ndarray  # first block of each cell
    blocks: np.ndarray  # over how many blocks each cell is dealt

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cell(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.first) * len(self.second) + _nearest(x[:, self.half :], self.second)

    def visit(self, q: np.ndarray) -> list[int]:
        """Cells by the summed distance of both halves (negative inner products), until they hold `probe` of all."""
        a, b = -(self.first @ q[: self.half]), -(self.second @ q[self.half :])
        p, r = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b, k = a.tolist(), b.tolist(), len(self.second)
        need, cells = self.probe * self.counts.sum(), []
        counts = self.counts
        heap, reached = [(a[p[0]] + b[r[0]], 0, 0)], np.full(len(p), -1)
        while heap and need > 0:
            _, i, j = heapq.heappop(heap)
            cell = p[i] * k + r[j]
            if counts[cell]:
                cells.append(cell)
                need -= counts[cell]
            # a pair is pushed once: along its row, and down the first column
            if j + 1 < k and reached[i] < j + 1:
                reached[i] = j + 1
                heapq.heappush(heap, (a[p[i]] + b[r[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(p):
                heapq.heappush(heap, (a[p[i + 1]] + b[r[0]], i + 1, 0))
        return cells


def _probe(index: Index, sample: np.ndarray, k: int, recall: float) -> float:
    """Share of the sample to visit so that `recall` of the true k nearest of some sample vectors are met."""
    asked = np.linspace(0, len(sample) - 1, min(256, len(sample))).astype(int)
    cell = index.cell(sample)
    own = np.bincount(cell, minlength=len(index.counts))
    whole = Index(index.first, index.second, own, 1.0, index.block, index.blocks)
    needs = []
    for i in asked:
        s = sample @ sample[i]
        s[i] = -np.inf
        near = np.argsort(-s, kind="stable")[: min(k, len(sample) - 1)]
        order = whole.visit(sample[i])
        held = np.zeros(len(own))
        held[order] = np.cumsum(own[order])
        needs.append(held[cell[near]] / len(sample))
    needs = np.sort(np.concatenate(needs)) if needs else np.ones(1)
    return float(needs[min(len(needs) - 1, int(recall * len(needs)))]) if len(needs) else 1.0


def _distinct(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(uid, v, ids): each different vector once, with the k smallest ids of the rows that hold it."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    low = rows.withColumn("at", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("at") <= k)
    ids = low.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return stored(ids.select(F.monotonically_increasing_id().alias("uid"), "v", "ids"))


def fit(distinct: DataFrame, k: int, recall: float, sample: int) -> Index:
    """Quantisers and probe share from at most `sample` of the vectors, all of one length (smallest hashes); cells
    counted over all."""
    n = distinct.count()
    some = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).toArrow()["v"]
    x = _matrix(some, len(some[0]))
    half = (x.shape[1] + 1) // 2
    size = int(min(MOST_CENTROIDS, len(x), max(1, round((n / 48) ** 0.5))))
    first = _kmeans(x[:, :half], size)
    second = _kmeans(x[:, half:], size if x.shape[1] > 1 else 1)
    cells = len(first) * len(second)
    index = Index(first, second, np.zeros(cells, int), 1.0, np.zeros(cells, int), np.ones(cells, int))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(index.cell(_matrix(batch.column(0), x.shape[1])), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = distinct.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    index.counts[got["cell"].to_numpy(int)] = got["n"].to_numpy(int)
    index.blocks = np.maximum(1, -(-index.counts // BLOCK))
    # small cells share a block, a large one is dealt over several of its own
    index.block = (np.cumsum(index.counts) - index.counts) // BLOCK + np.cumsum(index.blocks - 1) - (index.blocks - 1)
    index.probe = _probe(index, x, k, recall)
    return index


def _rerank(dim: int, best: int):
    """Of the queries and vectors of one block and chunk: each query's best vectors among the cells it visits."""

    def work(_: tuple, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(entries) and len(queries):
            e, uid, low = np.stack(entries["v"]).astype(np.float64), entries["uid"].to_numpy(), entries["low"].to_numpy()
            reach = np.linalg.norm(e, axis=1).max()
            cells, at = np.unique(entries["cell"].to_numpy(), return_inverse=True)
            for a in range(0, len(queries), SLICE):
                some = queries.iloc[a : a + SLICE]
                q = np.stack(some["v"]).astype(np.float64)
                met = np.stack([np.isin(cells, c) for c in some["cells"]])
                s = np.where(met[:, at], q @ e.T, -np.inf)
                take = min(best, len(e))
                # the matrix product is near the exact score; all that may reach the best few, ties among them, get that
                least = np.partition(s, len(e) - take, axis=1)[:, len(e) - take] - 1e-9 * (1 + reach * np.linalg.norm(q, axis=1))
                row, near = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                score = np.zeros(len(row))
                for d in range(dim):  # term by term, so that equal vectors score equal in every block
                    score += q[row, d] * e[near, d]
                order = np.lexsort((low[near], -score, row))
                row, near, score = row[order], near[order], score[order]
                ok = np.arange(len(row)) - np.searchsorted(row, row) < best
                row, near, score = row[ok], near[ok], score[ok]
                parts.append(pd.DataFrame({"quid": some["uid"].to_numpy()[row], "uid": uid[near], "score": score}))
        return pd.concat(parts) if parts else pd.DataFrame({"quid": [], "uid": [], "score": []})

    return work


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    recall: float = 0.97,
    sample: int = 16_384,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k vectors of largest inner product found, ties to smaller ids.

    `queries` are rows of `vectors`; a query's own id is never among its neighbours. Null ids, and vectors that are
    null, zero or hold null or non-finite components take no part. Vectors of each length have an index of their own:
    a query meets those of its length. Equal vectors are indexed and searched once, with their k + 1 smallest ids, which
    is all that k neighbours can need; so a vector that very many rows share costs no more than another. Rows that
    repeat id and vector count once. `recall` is what the sample has to reach; empty tables give an empty result; other
    columns are ignored, whatever their names."""
    distinct = _distinct(vectors, id_col, vector_col, k + 1)
    parts = []
    for row in distinct.select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        of_length = F.size("v") == row["d"]
        asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(of_length)
        parts.append(_search(distinct.where(of_length), asked, k, recall, sample))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, parts)


def _search(
    distinct: DataFrame,
    queries: DataFrame,
    k: int,
    recall: float,
    sample: int,
) -> DataFrame:
    spark = distinct.sparkSession
    index = fit(distinct, k, recall, sample)
    dim = index.half + index.second.shape[1]
    shared = spark.sparkContext.broadcast(index)  # bounded: centroids and one count for each cell

    asked = (
        queries.where(F.col("id").isNotNull())
        .select(F.col("id").cast("long").alias("query_id"), "v")
        .distinct()
    )
    asked = stored(asked.join(distinct.select("uid", "v"), "v"))
    different = asked.select("uid", "v").distinct()
    chunks = max(1, -(-asked.count() // CHUNK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = shared.value.cell(_matrix(batch.column(1), dim))
                uid = batch.column(0).to_numpy()
                block = shared.value.block[cell] + uid * 2654435761 % (1 << 31) % shared.value.blocks[cell]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell), pa.array(block)], names=["uid", "v", "low", "cell", "block"]
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out: list[tuple] = []
            for uid, v, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(1), dim), strict=True):
                by_block: dict[int, list[int]] = {}
                for cell in own.visit(q):
                    for b in range(own.block[cell], own.block[cell] + own.blocks[cell]):
                        by_block.setdefault(int(b), []).append(cell)
                out += [(uid, v, b, cells) for b, cells in by_block.items()]
            uid, v, b, cells = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), batch.schema.field(1).type, pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip((uid, v, b, cells), kinds, strict=True)], names=["uid", "v", "block", "cells"]
            )

    kind = distinct.schema["v"].dataType.simpleString()
    chunk = F.pmod(F.xxhash64("uid"), F.lit(chunks))
    entries = (
        distinct.select("uid", "v", F.col("ids")[0].alias("low")).mapInArrow(place, f"uid long, v {kind}, low long, cell long, block long")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    )
    visits = (
        different.repartition("uid").mapInArrow(ask, f"uid long, v {kind}, block long, cells array<int>").withColumn("chunk", chunk)
    )
    met = (
        entries.groupBy("block", "chunk")
        .cogroup(visits.groupBy("block", "chunk"))
        .applyInPandas(_rerank(dim, k + 1), "quid long, uid long, score double")
    )
    met = met.join(distinct.select("uid", "ids"), "uid")
    order = W.partitionBy("quid").orderBy(F.desc("score"), F.col("ids")[0])
    best = met.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    each = best.select("quid", (-F.col("score")).alias("far"), F.explode("ids").alias("id"))
    # at most (k + 1) squared for a query
    lists = each.groupBy("quid").agg(F.array_sort(F.collect_list(F.struct("far", "id"))).alias("n"))
    found = asked.select("query_id", F.col("uid").alias("quid")).join(lists, "quid")
    own = F.slice(F.filter("n", lambda x: x["id"] != F.col("query_id")), 1, k)
    return found.select("query_id", F.posexplode(own).alias("at", "n")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.far")).alias("score")
    )
