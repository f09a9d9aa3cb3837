"""Certificates: suggestion by name, matching of requirements, validity and confirmation of extractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.functions.text import strip
from tenderspark.operators.names import BLOCK, best_certificates, block_pairs


def suggest_cert(texts: DataFrame, certs: DataFrame, least: float = 0.5, size: int = BLOCK) -> DataFrame:
    """(text, cert_code, score): the best certificate for each different text, to two digits, none under `least`.

    Blocks of texts meet blocks of certificates, and each task gives its best certificate for a text: names that contain
    one another and keywords come from automata, and only pairs that share enough characters for a ratio over 0.6 are
    compared. Of equal scores the smallest cert_id counts. Texts are compared without the blanks around them; null and
    blank texts have no row, null and empty names, aliases and lists match nothing."""

    def meet(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("cert_id")
        rows, given, bare = known.to_pylist(), asked["text"].to_pylist(), asked["bare"].to_pylist()
        found = [(t, *hit) for t, hit in zip(given, best_certificates(bare, rows)) if hit]
        return pa.table({
            "text": pa.array([t for t, _, _ in found], pa.string()), "cert_id": pa.array([rows[k]["cert_id"] for _, k, _ in found], pa.int64()),
            "cert_code": pa.array([rows[k]["cert_code"] for _, k, _ in found], pa.string()), "exact": pa.array([s for *_, s in found], pa.float64()),
            "score": pa.array([round(s, 2) for *_, s in found], pa.float64()),
        })

    asked = texts.select("text").distinct().withColumn("bare", strip(F.col("text"))).where("bare <> ''").withColumn("key", F.col("text"))
    known = certs.select(F.col("cert_id").cast("long").alias("cert_id"), "cert_code", "cert_full_name", "cert_short_name", "aliases", "required_keywords", "exclude_keywords")
    known = known.where("cert_id is not null").withColumn("key", F.col("cert_id").cast("string"))
    rows = block_pairs(asked, known, "key", meet, "text string, cert_id long, cert_code string, exact double, score double", size)
    best = rows.groupBy("text").agg(F.min_by(F.struct("cert_code", "score"), F.struct(-F.col("exact"), "cert_id")).alias("b"))
    return best.select("text", "b.cert_code", "b.score").where(F.col("score") >= least)


def extract_validity_date(text: Column) -> Column:
    """The first year-month-day with dashes, else with slashes; null if that is no date."""
    first = lambda sep: F.nullif(F.regexp_extract(text, rf"(\d{{4}}{sep}\d{{1,2}}{sep}\d{{1,2}})", 1), F.lit(""))
    return F.coalesce(F.try_to_date(first("-"), "yyyy-M-d"), F.when(first("-").isNull(), F.try_to_date(first("/"), "yyyy/M/d")))


def classify_validity(valid_until: Column, open_date: Column, soon: int = 90) -> tuple[Column, Column]:
    """(status, days left): unknown, expired, expiring_soon under 90 days, valid."""
    days = F.datediff(valid_until, open_date)
    return F.when(days.isNull(), "unknown").when(days < 0, "expired").when(days < soon, "expiring_soon").otherwise("valid"), days


def match_qualifications(requirements: DataFrame, extractions: DataFrame, certs: DataFrame, projects: DataFrame) -> DataFrame:
    """Each requirement (project, cert_code, is_mandatory) with the status of its first validated extraction.

    missing, wrong (an excluding keyword of the certificate in its value), expired, expiring_soon, valid."""
    first = F.row_number().over(W.partitionBy("project", "cert_code").orderBy("id"))
    own = extractions.where("is_validated").withColumn("n", first).where("n = 1").select("project", "cert_code", "value", "valid_until")
    rows = (
        requirements.join(own, ["project", "cert_code"], "left")
        .join(certs.select("cert_code", "exclude_keywords"), "cert_code", "left")
        .join(projects.select(F.col("id").alias("project"), "bid_open_date"), "project")
    )
    wrong = F.exists("exclude_keywords", lambda k: F.contains(F.col("value"), k))
    validity, _ = classify_validity(F.col("valid_until"), F.col("bid_open_date"))
    status = F.when(F.col("value").isNull(), "missing").when(F.coalesce(wrong, F.lit(False)), "wrong").otherwise(
        F.when(validity == "unknown", "valid").otherwise(validity)
    )
    return rows.select("project", "cert_code", "is_mandatory", status.alias("status"))


def qualification_score(projects: DataFrame, matched: DataFrame) -> DataFrame:
    """(project, score, passed, n_failed): share of mandatory certificates that are not missing, in whole percent.

    Wrong and expired ones count for the score yet fail the pass. Without mandatory ones the share of optional ones
    that are held; without any requirement, or none of the optional ones, 0 and failed."""
    bad = F.col("status").isin("missing", "wrong", "expired")
    per = matched.groupBy("project").agg(
        F.count_if("is_mandatory").alias("m"), F.count("*").alias("n"),
        F.count_if(F.col("is_mandatory") & (F.col("status") == "missing")).alias("gone"),
        F.count_if(F.col("is_mandatory") & bad).alias("failed"),
        F.count_if(~F.col("is_mandatory") & ~F.col("status").isin("missing", "wrong")).alias("held"),
    )
    rows = projects.select(F.col("id").alias("project")).join(per, "project", "left").na.fill(0)
    score = F.when(F.col("m") > 0, F.floor((F.col("m") - F.col("gone")) * 100 / F.col("m"))).when(
        F.col("n") > 0, F.floor(F.col("held") * 100 / F.col("n"))
    ).otherwise(0).cast("int")
    system = (F.col("m") == 0) & (F.col("held") == 0)
    failed = F.col("failed") + system.cast("int")
    return rows.select("project", score.alias("score"), (failed == 0).alias("passed"), failed.alias("n_failed"))


#: The system's own fatal rows, for a tender without requirements and for one whose optional ones were all missed.
NOT_EXTRACTED, NONE_MATCHED = "SYSTEM_EXTRACTION_FAILED", "SYSTEM_CERT_EXTRACTION_FAILED"


def qualification_report(projects: DataFrame, matched: DataFrame) -> DataFrame:
    """(id, score, passed, missing, extraction_valid): `qualification_score` with the codes of its fatal rows, sorted, and
    whether the tender's requirements were extracted at all."""
    bad = F.col("is_mandatory") & F.col("status").isin("missing", "wrong", "expired")
    codes = matched.groupBy("project").agg(F.array_sort(F.collect_list(F.when(bad, F.col("cert_code")))).alias("codes"), F.count_if("is_mandatory").alias("m"))
    rows = qualification_score(projects, matched).join(codes, "project", "left")
    none = F.array().cast("array<string>")
    system = F.when(F.col("m").isNull(), F.array(F.lit(NOT_EXTRACTED))).when(~F.col("passed") & (F.col("m") == 0), F.array(F.lit(NONE_MATCHED)))
    return rows.select(
        F.col("project").alias("id"), "score", "passed", F.concat(F.coalesce("codes", none), F.coalesce(system, none)).alias("missing"), F.col("m").isNotNull().alias("extraction_valid")
    )


def review_queue(extractions: DataFrame, least: float = 0.8) -> DataFrame:
    """Extractions of low confidence."""
    return extractions.where(F.col("confidence") < least)


def confirmation_summary(images: DataFrame, extractions: DataFrame) -> DataFrame:
    """(project, n, pending, images): each project's images (project, image, page, ...) by page with their extracted fields.

    Extractions (id, image, confidence, is_validated, ...) under 0.8 that nobody validated need a review; n counts the
    fields, pending those. Images without any field stay, with an empty list."""
    needs = F.coalesce((F.col("confidence") < 0.8) & ~F.col("is_validated"), F.lit(False))
    own = [c for c in extractions.columns if c not in ("id", "image", "project")]
    fields = extractions.withColumn("needs_review", needs).groupBy("image").agg(
        F.array_sort(F.collect_list(F.struct("id", *own, "needs_review"))).alias("fields"), F.count_if("needs_review").alias("pending")
    )
    rows = images.join(fields, "image", "left")
    empty = F.array().cast(fields.schema["fields"].dataType)
    about = [c for c in images.columns if c not in ("project", "image", "page")]
    image = F.struct("page", "image", *about, F.coalesce("fields", empty).alias("fields"))
    return rows.groupBy("project").agg(
        F.sum(F.coalesce(F.size("fields"), F.lit(0))).alias("n"), F.sum(F.coalesce("pending", F.lit(0))).alias("pending"),
        F.array_sort(F.collect_list(image)).alias("images"),
    )


def apply_corrections(extractions: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new extractions, rejected corrections): only extractions that are not validated change.

    Corrections name an extraction by its id, where they have a project by both."""
    key = [c for c in ("id", "project") if c in corrections.columns]
    new = corrections.select(*key, F.col("value").alias("_value"), F.col("note").alias("_note"))
    take = ~F.col("is_validated") & F.col("_value").isNotNull()
    rows = extractions.join(new, key, "left").select(
        "id", "project", F.when(take, F.col("_value")).otherwise(F.col("value")).alias("value"),
        (F.col("is_validated") | take).alias("is_validated"),
        F.when(take, F.coalesce("_note", F.lit("人工修正"))).alias("note"),
    )
    return rows, corrections.join(extractions.where(~F.col("is_validated")), key, "left_anti")


def confirm_gate(projects: DataFrame, extractions: DataFrame) -> DataFrame:
    """Projects none of whose extractions waits for validation, as they move on to evaluation."""
    waiting = extractions.where(~F.col("is_validated")).select(F.col("project").alias("id"))
    return projects.join(waiting, "id", "left_anti").select("id", F.lit("evaluating").alias("new_status"))
