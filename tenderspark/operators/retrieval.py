"""Vector retrieval by exact similarity and assembly of context from won and lost cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot product over the shorter length by the norms of the whole vectors; 0 where either is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(_dot(a, b) / scale)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


#: Vectors, and queries, that meet in one task, and how many of these queries have their scores in memory at once.
VECTORS, QUERIES, ROWS = 8192, 2048, 128


def _best(side: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, track, rank, chunk_id, score): each query's `k` nearest chunks of its scope in each track.

    `side` is (scope, track, chunk_id, vector), `asked` (scope, query_id, query_vector). Either side of a scope is dealt
    into blocks by its size, so tasks grow in number and not in what they hold; a task multiplies the matrices of two
    blocks and keeps the best `k` of each query and track. Scores are cosines to nine digits over the shorter length,
    0 where either vector is zero; ties go to smaller ids. Null vectors, and such with null or non-finite components,
    take no part."""
    finite = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))  # both may be made of the same columns
    side, asked = side.where(F.col("vector").isNotNull() & finite("vector")), asked.where(F.col("query_vector").isNotNull() & finite("query_vector"))
    count = lambda df, size, name: df.groupBy("scope").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = count(side, VECTORS, "nc").join(count(asked, QUERIES, "nq"), "scope")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = side.join(sizes, "scope").withColumn("cb", own("chunk_id", "nc")).withColumn("qb", every("nq")).drop("nc", "nq")
    right = asked.join(sizes, "scope").withColumn("qb", own("query_id", "nq")).withColumn("cb", every("nc")).drop("nc", "nq")

    def by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Row numbers and matrix of the vectors of each length."""
        vectors = column.combine_chunks()
        flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum([0, *vectors.value_lengths().to_pylist()])
        length = np.diff(ends)
        return {n: (at := np.flatnonzero(length == n), np.stack([flat[ends[r] : ends[r + 1]] for r in at])) for n in np.unique(length)}

    def meet(have: pa.Table, want: pa.Table) -> pa.Table:
        have = have.sort_by("chunk_id")
        tracks = have["track"].to_numpy(zero_copy_only=False)
        members = {track: np.flatnonzero(tracks == track) for track in dict.fromkeys(tracks)}
        lengths = [(n, at, m, np.sqrt((m * m).sum(1))) for n, (at, m) in by_length(have["vector"]).items()]
        out_q, out_c, out_s = [], [], []
        for first in range(0, len(want), ROWS):
            some = want.slice(first, ROWS)
            score = np.zeros((len(some), len(have)))
            for w, (rows, q) in by_length(some["query_vector"]).items():
                for n, at, m, norm in lengths:
                    scale = np.sqrt((q * q).sum(1))[:, None] * norm
                    dot = q[:, : min(n, w)] @ m[:, : min(n, w)].T
                    score[np.ix_(rows, at)] = np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
            score = np.round(score, 9)
            for of in members.values():
                # chunks lie in the order of their ids, so a stable sort leaves ties to the smaller ones
                top = of[np.argsort(-score[:, of], axis=1, kind="stable")[:, :k]]
                at = np.repeat(np.arange(len(some)), top.shape[1])
                out_q.append(first + at)
                out_c.append(top.ravel())
                out_s.append(score[at, top.ravel()])
        q, c, scores = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, np.int64), (out_c, np.int64), (out_s, np.float64)))
        return pa.table({"query_id": want["query_id"].take(pa.array(q)), "track": have["track"].take(pa.array(c)), "chunk_id": have["chunk_id"].take(pa.array(c)), "score": scores})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(asked, 'query_id')}, track string, chunk_id {kind(side, 'chunk_id')}, score double"
    some = left.groupBy("scope", "cb", "qb").cogroup(right.groupBy("scope", "cb", "qb")).applyInArrow(meet, schema)
    rank = F.row_number().over(W.partitionBy("query_id", "track").orderBy(F.desc("score"), "chunk_id"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "track", "rank", "chunk_id", "score")


def search(chunks: DataFrame, queries: DataFrame, k: int = 5, chunk_type: str | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, score): each query's nearest usable chunks of its own project, of one type if asked.

    Deprecated chunks and null vectors take no part."""
    side = chunks.where(~F.col("is_deprecated"))
    if chunk_type is not None:
        side = side.where(F.col("chunk_type") == chunk_type)
    side = side.where("project is not null").select(F.col("project").alias("scope"), F.lit("").alias("track"), "chunk_id", "vector")
    asked = queries.where("project is not null").select(F.col("project").cast(side.schema["scope"].dataType).alias("scope"), "query_id", "query_vector")
    return _best(side, asked, k).drop("track")


def rerank(candidates: DataFrame, group: str, item: str, k: int = 5) -> DataFrame:
    """The k candidates of largest score of each group, ties to smaller items."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), item))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k).select(group, "rank", item, "score")


def tag_filter(rows: DataFrame, **wanted: list[str]) -> DataFrame:
    """Rows whose tag arrays overlap with every given list; empty lists ask for nothing."""
    for column, values in wanted.items():
        if values:
            rows = rows.where(F.arrays_overlap(column, F.array(*map(F.lit, values))))
    return rows


#: Kinds of sources that samples come from.
HISTORICAL = ("historical_tender", "internal_postmortem")


def _best_of_all(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, win_signal, rank, chunk_id, score): each query's nearest usable historical chunks of each outcome,
    whatever their project. Exact: every query meets every chunk, block by block."""
    usable = ~F.col("is_deprecated") & F.col("source_type").isin(*HISTORICAL)
    side = chunks.where(usable).select(F.lit(0).alias("scope"), F.col("win_signal").alias("track"), "chunk_id", "vector")
    return _best(side, queries.select(F.lit(0).alias("scope"), "query_id", "query_vector"), k).withColumnRenamed("track", "win_signal")


def retrieve_samples(
    chunks: DataFrame,
    queries: DataFrame,
    win_signal: str,
    regions: list[str] | None = None,
    k: int = 5,
    loss_tags: list[str] | None = None,
    dimensions: list[str] | None = None,
    project_type: str | None = None,
) -> DataFrame:
    """(query_id, rank, chunk_id, score): the nearest historical chunks of one outcome, of any project.

    Dimension and region tags have to overlap, the project type has to be among the chunk's; loss tags count on the
    negative track only."""
    rows = chunks.where(F.col("win_signal") == win_signal)
    rows = tag_filter(rows, region_tags=regions or [], dimension_tags=dimensions or [], project_type_tags=[project_type] if project_type else [])
    if win_signal == "negative" and loss_tags:
        rows = tag_filter(rows, loss_tags=loss_tags)
    return _best_of_all(rows, queries, k).drop("win_signal")


def dual_track(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, win_signal, rank, chunk_id, score): the best of won and of lost cases, in one pass."""
    return _best_of_all(chunks.where(F.col("win_signal").isin("positive", "negative")), queries, k)


#: The header's lines, how an outcome is called, what stands for missing labels and tags, the note on a cut
#: section, the sections' headings and what stands for none.
HEADER = ("【历史资产摘要 — %d/%d】", "案例标签：%s", "胜负信号：%s", "评分维度：%s", "地区标签：%s", "项目类型：%s")
SIGNAL_NAMES = {"positive": "成功经验", "negative": "失败教训"}
NO_LABEL, NO_TAGS, CUT_NOTE = "未标注", "通用", "\n...（已截断，共 %d 字符）"
HEADINGS = {"positive": "【成功经验参考】\n", "negative": "【失败教训参考】\n"}
NO_CONTEXT, NO_TYPE = "(当前无历史资产参考)", "文档片段"


def build_context(found: DataFrame, chunks: DataFrame, each: int = 800, most: int = 3000) -> DataFrame:
    """(query_id, positive, negative, context): excerpts of the chunks found, under a header of the chunk's number (from 1)
    and how many were found, its label (else its type), outcome, dimensions, regions and project types.

    Each section is cut at `most` characters, with a note of its whole length; context holds both under their headings.
    Neutral chunks count among those found and are not shown."""
    about = chunks.select("chunk_id", "content", "source_label", "chunk_type", "chunk_index", "dimension_tags", "region_tags", "project_type_tags")
    rows = found.join(found.groupBy("query_id").agg(F.count("*").cast("int").alias("_total")), "query_id").join(about, "chunk_id")
    tags = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(NO_TAGS))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    signal = F.create_map(*(F.lit(x) for pair in SIGNAL_NAMES.items() for x in pair))[F.col("win_signal")]
    head = F.format_string(
        "\n".join(HEADER), F.coalesce("chunk_index", F.lit(0)) + 1, F.col("_total"), F.coalesce(some("source_label"), some("chunk_type"), F.lit(NO_LABEL)),
        signal, tags("dimension_tags"), tags("region_tags"), tags("project_type_tags"),
    )
    part = F.concat(head, F.lit("\n\n正文：\n"), F.substring(F.coalesce("content", F.lit("")), 1, each), F.lit("\n\n---"))
    by_track = rows.groupBy("query_id", "win_signal").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("text")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.format_string(CUT_NOTE, F.length(text)))).otherwise(text)
    pick = lambda s: F.coalesce(F.max(F.when(F.col("win_signal") == s, F.col("cut"))), F.lit("")).alias(s)
    out = by_track.withColumn("cut", cut).groupBy("query_id").agg(pick("positive"), pick("negative"))
    shown = F.array_compact(F.array(*(F.when(F.col(s) != "", F.concat(F.lit(h), F.col(s))) for s, h in HEADINGS.items())))
    return out.withColumn("context", F.coalesce(F.nullif(F.array_join(shown, "\n\n"), F.lit("")), F.lit(NO_CONTEXT)))


def legacy_context(found: DataFrame, chunks: DataFrame, each: int = 500) -> DataFrame:
    """(query_id, context): starts of the chunks found under their label (else their type), joined by blank lines."""
    rows = found.join(chunks.select("chunk_id", "content", "source_label", "chunk_type"), "chunk_id")
    label = F.coalesce(F.nullif("source_label", F.lit("")), "chunk_type", F.lit(NO_TYPE))
    part = F.concat(F.lit("["), label, F.lit("]\n"), F.substring(F.coalesce("content", F.lit("")), 1, each))
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("text"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"))
