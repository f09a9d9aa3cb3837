"""Registered queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.operators import retrieval as R
from tenderspark.plans.base import chunks, query, query_vectors, table

COS = "round(list_dot_product(CAST(c.vector AS DOUBLE[]), CAST(q.query_vector AS DOUBLE[])) / (sqrt(list_dot_product(CAST(c.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.query_vector AS DOUBLE[]), CAST(q.query_vector AS DOUBLE[])))), 9)"


def _found(where: str, k: int, by: str = "query_id", extra: str = "", on: str = "c.project = q.project") -> str:
    return f"""pairs AS (SELECT q.query_id, c.chunk_id, c.win_signal, {COS} AS score FROM query_vec q JOIN chunk c ON {on}
WHERE NOT c.is_deprecated AND c.vector IS NOT NULL {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) AS rank FROM pairs),
found AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score{extra} FROM ranked WHERE rank <= {k})"""


@query("""SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def c1_cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(R.cosine_similarity(F.col("embedding"), F.col("other")), 9).alias("cosine"))


@query(f"WITH {_found('', 5)} SELECT * FROM found")
def c2_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search(chunks(spark, d), query_vectors(spark, d))


@query(f"WITH {_found("AND c.chunk_type = 'technical'", 5)} SELECT * FROM found")
def c2_search_of_a_type(spark: SparkSession, d: str) -> DataFrame:
    return R.search(chunks(spark, d), query_vectors(spark, d), chunk_type="technical")


PAST = "c.source_type IN ('historical_tender', 'internal_postmortem')"
NEGATIVE = _found("AND c.win_signal = 'negative' AND c.region_tag IN ('en', 'fr') AND list_contains(c.dims, 'dim') AND c.ptype = 'goods'", 5, on=PAST)


@query(f"WITH {NEGATIVE} SELECT * FROM found")
def c3_retrieve_samples(spark: SparkSession, d: str) -> DataFrame:
    return R.retrieve_samples(chunks(spark, d), query_vectors(spark, d), "negative", ["en", "fr"], dimensions=["dim", "other"], project_type="goods")


DUAL = _found("AND c.win_signal <> 'neutral'", 5, "query_id, win_signal", ", win_signal", PAST)


@query(f"WITH {DUAL} SELECT * FROM found")
def c4_dual_track(spark: SparkSession, d: str) -> DataFrame:
    return R.dual_track(chunks(spark, d), query_vectors(spark, d)).select("query_id", "win_signal", "rank", "chunk_id", "score")


@query(f"""WITH {DUAL}, t AS (SELECT query_id, win_signal, string_agg('【历史资产摘要 — ' || (chunk_index + 1) || '/' || total || '】' || chr(10) || '案例标签：' || coalesce(source_label, chunk_type, '未标注') || chr(10) || '胜负信号：' || CASE win_signal WHEN 'positive' THEN '成功经验' ELSE '失败教训' END || chr(10) || '评分维度：' || CASE WHEN len(dims) > 0 THEN array_to_string(dims, ', ') ELSE '通用' END
|| chr(10) || '地区标签：' || region_tag || chr(10) || '项目类型：' || ptype || chr(10) || chr(10) || '正文：' || chr(10) || substr(content, 1, 800) || chr(10) || chr(10) || '---', chr(10) ORDER BY rank) AS t
FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM found) f JOIN chunk USING (chunk_id, win_signal) GROUP BY 1, 2), c AS (SELECT query_id, win_signal, CASE WHEN length(t) > 3000 THEN substr(t, 1, 3000) || chr(10) || '...（已截断，共 ' || length(t) || ' 字符）' ELSE t END AS t FROM t)
SELECT query_id, md5(coalesce(max(t) FILTER (WHERE win_signal = 'positive'), '')) AS positive, md5(coalesce(max(t) FILTER (WHERE win_signal = 'negative'), '')) AS negative,
md5(string_agg(CASE win_signal WHEN 'positive' THEN '【成功经验参考】' ELSE '【失败教训参考】' END || chr(10) || t, chr(10) || chr(10) ORDER BY win_signal DESC)) AS context FROM c GROUP BY 1""")
def c5_build_context(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    found = R.build_context(R.dual_track(c, query_vectors(spark, d)), c)
    return found.select("query_id", *(F.md5(c).alias(c) for c in ("positive", "negative", "context")))


@query(f"""WITH {_found('', 3)} SELECT query_id, md5(string_agg('[' || coalesce(source_label, chunk_type, '文档片段') || ']' || chr(10) || substr(content, 1, 500), chr(10) || chr(10) ORDER BY rank)) AS context
FROM found JOIN chunk USING (chunk_id) GROUP BY 1""")
def c6_legacy_context(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return R.legacy_context(R.search(c, query_vectors(spark, d), 3), c).withColumn("context", F.md5("context"))


@query("""SELECT user_id, CAST(rank AS INTEGER) AS rank, event_id, score FROM (SELECT user_id, event_id, value AS score,
row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def c7_rerank(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(table(spark, d, "events").withColumnRenamed("value", "score"), "user_id", "event_id")


@query("""SELECT vec_id, i, round(x / n, 9) AS x FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i,
sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)""")
def c8_l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(R.l2_normalize(F.col("embedding"))).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 9).alias("x"))
