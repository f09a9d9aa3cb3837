"""The registered queries of this subpackage: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.llm import brown_lm, byte_bpe, filter_audit, importance, langid, line_dedup, multi_index, packing, pii, quality, secret_scan, simhash, spotsigs
from tenderspark.llm.common import id_bucket


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 5) == 0
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(secret_scan.count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        "base_sha256",
        secret_scan.listed(secret_scan.all_spans()).alias("spans"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.where("vec_id % 20 = 0"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"), short=True)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 4) == 2
    found = langid.predict(docs, langid.fit(docs, ~held_out), ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 7) == 2
    found = brown_lm.score(docs, brown_lm.fit(docs, ~held_out), ["doc_id"])
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_against_next(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.coalesce("lang", F.lit(""))
    return filter_audit.audit(filter_audit.failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), part))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs), ["doc_id"])
    return found.select("doc_id", *(pii.count_kind(k).alias(f"n_{k}") for k in pii.KINDS), "base_sha256", "spans", F.size("added").cast("long").alias("n_added"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nb_svm_quality,
        op2_secret_scan,
        op3_best_fit_packing,
        op4_inverted_multi_index,
        op5_simhash_near_dedup,
        op6_line_dedup,
        op7_byte_bpe,
        op8_language_id,
        op9_brown_lm,
        op10_spot_signatures,
        op11_filter_audit,
        op12_importance_resampling,
        op13_personal_data,
    )
}

ORACLES: dict[str, str] = {
    "op11_filter_audit": r"""
WITH known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS t,
    regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce("text", '')) AS least
  FROM documents
), hist AS (
  SELECT d.part,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
      + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(least < d.doc_id, false)::INT AS mask,
    coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic, count(*) AS n
  FROM docs d LEFT JOIN known k ON d.doc_id = k.doc_id GROUP BY ALL
), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(l, b)), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE (a.b | b.b | c.b | d.b | e.b) = 31
), steps AS (
  SELECT filter_order, s.step::INT AS step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS state
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (state | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & state = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & state <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & state = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & state = 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM hist, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM counted"""
}
