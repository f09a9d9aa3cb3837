"""Formal review: checklists, their progress, readiness, and item actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.operators.certs import classify_validity
from tenderspark.operators.pricing import latest

# Seal and packaging items of a bid without instructions of its own.
SEAL_ITEMS = ("法定代表人签字或签章", "授权委托书签字盖章", "骑缝章完整性", "正副本份数与标识")
PACKAGE_ITEMS = ("投标文件分别封装", "封套粘贴与密封", "电子版文件一致性", "包封标注完整性")


def validity_rows(extractions: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, item, risk_level, system_status) of dated extractions: expired fatal, under 90 days warning, else info."""
    rows = extractions.where("valid_until is not null").join(projects.select(F.col("id").alias("project"), "bid_open_date"), "project")
    status, _ = classify_validity(F.col("valid_until"), F.col("bid_open_date"))
    return rows.withColumn("s", status).select(
        "project", F.concat(F.lit("cert:"), F.col("id")).alias("item"),
        F.when(F.col("s") == "expired", "fatal").when(F.col("s") == "expiring_soon", "warning").otherwise("info").alias("risk_level"),
        F.when(F.col("s") == "expired", "failed").when(F.col("s") == "expiring_soon", "warning").otherwise("passed").alias("system_status"),
    )


def price_rows(projects: DataFrame, prices: DataFrame) -> DataFrame:
    """(project, item, risk_level, system_status): the latest decided price against the budget; no budget, no row."""
    last = latest(prices, "project", F.desc("version"))
    rows = projects.where("budget is not null").join(last.select(F.col("project").alias("id"), "price"), "id")
    over = F.col("price") > F.col("budget")
    return rows.select(
        F.col("id").alias("project"), F.lit("price").alias("item"),
        F.when(over, "fatal").otherwise("info").alias("risk_level"), F.when(over, "failed").otherwise("passed").alias("system_status"),
    )


def scoring_standard(tenders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(required, broken) of tenders (project, scoring): the sections (project, name) that a scoring standard, a JSON list,
    asks for by name, section_title or title; and the projects whose standard cannot be read."""
    rows = tenders.where("scoring <> ''").withColumn("items", F.from_json("scoring", "array<struct<name:string,section_title:string,title:string>>"))
    good = F.try_parse_json("scoring").isNotNull()
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    names = rows.where(good).select("project", F.inline("items")).select("project", F.coalesce(some("name"), some("section_title"), some("title")).alias("name"))
    return names.where("name is not null").distinct(), rows.where(~good).select("project").distinct()


def section_coverage(projects: DataFrame, required: DataFrame, proposals: DataFrame, sections: DataFrame, broken: DataFrame) -> DataFrame:
    """(project, item, risk_level, system_status) of required sections (project, name) that no section title covers.

    A title covers a name if either contains the other; the join is keyed by project. One row instead for projects without
    a confirmed proposal (a warning), for those whose scoring standard cannot be read (fatal), and for those where the
    standard and the proposal are both empty (a warning)."""
    key = lambda df: df.select("project").distinct()
    every = projects.select(F.col("id").alias("project"))
    made, asked = every.join(key(proposals), "project", "left_semi"), key(required)
    titles = sections.where("title <> ''").select("project", "title").distinct()
    hit = required.join(titles, "project").where(F.contains("title", "name") | F.contains("name", "title")).select("project", "name")
    unread = made.join(key(broken), "project", "left_semi").join(asked, "project", "left_anti")
    empty = made.join(key(broken), "project", "left_anti").join(asked, "project", "left_anti").join(key(sections), "project", "left_anti")
    open_ = required.distinct().join(hit, ["project", "name"], "left_anti").join(made, "project", "left_semi")
    row = lambda df, item, level, status: df.select("project", item.alias("item"), F.lit(level).alias("risk_level"), F.lit(status).alias("system_status"))
    return (
        row(open_, F.concat(F.lit("section:"), F.col("name")), "fatal", "failed")
        .unionByName(row(every.join(key(proposals), "project", "left_anti"), F.lit("proposal"), "warning", "warning"))
        .unionByName(row(unread, F.lit("scoring"), "fatal", "failed"))
        .unionByName(row(empty, F.lit("sections"), "warning", "warning"))
    )


def seal_rows(projects: DataFrame) -> DataFrame:
    """(project, category, item, risk_level, system_status): what only the specialist can see, so all uncertain warnings.

    Signatures follow the tender's own seal list where it has any, else the usual items; packaging follows that list too,
    then the tender's packaging list, then the usual items."""
    usual = lambda items: F.array(*map(F.lit, items))
    seals = F.when(F.size("seals") > 0, F.col("seals"))
    packaging = F.when(F.size("packaging") > 0, F.col("packaging"))
    kinds = F.array(
        F.struct(F.lit("signature_seal").alias("category"), F.coalesce(seals, usual(SEAL_ITEMS)).alias("items")),
        F.struct(F.lit("seal_requirement").alias("category"), F.coalesce(seals, packaging, usual(PACKAGE_ITEMS)).alias("items")),
    )
    rows = projects.select(F.col("id").alias("project"), F.inline(kinds)).select("project", "category", F.explode("items").alias("item"))
    return rows.select("*", F.lit("warning").alias("risk_level"), F.lit("uncertain").alias("system_status"))


def checklist(*parts: DataFrame) -> DataFrame:
    """All parts in one list of items that wait for the specialist."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("specialist_status", F.lit("pending"))


def review_status(items: DataFrame) -> DataFrame:
    """Per project: items, confirmed ones, pending fatal and warning ones, and whether documents can be made."""
    pending = F.col("specialist_status") == "pending"
    return items.groupBy("project").agg(
        F.count("*").alias("total"), F.count_if(F.col("specialist_status") == "confirmed").alias("confirmed"),
        F.count_if(pending & (F.col("risk_level") == "fatal")).alias("fatal_pending"),
        F.count_if(pending & (F.col("risk_level") == "warning")).alias("warning_pending"),
    ).withColumn("can_generate", F.col("fatal_pending") == 0).withColumn(
        "reason", F.when(F.col("fatal_pending") > 0, "fatal_pending").when(F.col("warning_pending") > 0, "warnings").otherwise("ready")
    )


def category_progress(items: DataFrame) -> DataFrame:
    """Per project and category: items, and those no longer pending; percent is the project's: all that are no longer
    pending over its fatal and warning items, halves up, 0 where it has none of these."""
    g = items.groupBy("project", "category").agg(
        F.count("*").alias("total"), F.count_if(F.col("specialist_status") != "pending").alias("confirmed"),
        F.count_if(F.col("risk_level").isin("fatal", "warning")).alias("needed"),
    )
    own = W.partitionBy("project")
    done, needed = F.sum("confirmed").over(own), F.sum("needed").over(own)
    percent = F.when(needed > 0, F.floor((done * 200 + needed) / (needed * 2))).otherwise(0).cast("long")
    return g.select("project", "category", "total", "confirmed", percent.alias("percent"))


def package_readiness(projects: DataFrame, sections: DataFrame, extractions: DataFrame, prices: DataFrame, finals: DataFrame) -> DataFrame:
    """Per project whether each part of the bid package exists; the seal never does by itself."""
    rows = projects.select(F.col("id").alias("project"))
    for name, df in (("section", sections), ("extraction", extractions), ("price", prices), ("document", finals)):
        have = df.select("project").distinct().withColumn(f"has_{name}", F.lit(True))
        rows = rows.join(have, "project", "left")
    flags = [F.coalesce(f"has_{n}", F.lit(False)).alias(f"has_{n}") for n in ("section", "extraction", "price", "document")]
    return rows.select("project", *flags, F.lit(False).alias("has_seal"))


def draft_preview(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Per project: items in all, by risk level, passed and pending ones, and the latest decided price."""
    n = items.groupBy("project").agg(
        F.count("*").alias("total"), *(F.count_if(F.col("risk_level") == r).alias(r) for r in ("fatal", "warning", "info")),
        F.count_if(F.col("system_status") == "passed").alias("passed"), F.count_if(F.col("specialist_status") == "pending").alias("pending"),
    )
    return n.join(latest(prices, "project", F.desc("version")).select("project", "price"), "project", "left")


def filter_items(items: DataFrame, status: str | None = None, risk: str | None = None) -> DataFrame:
    rows = items if status is None else items.where(F.col("specialist_status") == status)
    return rows if risk is None else rows.where(F.col("risk_level") == risk)


def apply_item_actions(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Items (id, text, specialist_status) after confirm, toggle (back to pending), correct (evidence, and a note after
    ` | `) or delete; the text stays as it was checked."""
    rows = items.join(actions.select("id", "action", "payload"), "id", "left")
    parts = F.split("payload", r" \| ", 2)
    a, s = F.col("action"), F.col("specialist_status")
    status = F.when(a == "confirm", "confirmed").when(a == "toggle", "pending").when(
        a == "correct", "corrected"
    ).when(a == "delete", "deleted").otherwise(s)
    return rows.select(
        "id", "text", F.when(a == "correct", parts[0]).alias("evidence"),
        F.when(a == "correct", F.get(parts, 1)).alias("note"), status.alias("specialist_status"),
    )


def archive_abandoned(projects: DataFrame, prices: DataFrame) -> DataFrame:
    """(project, price_version): a draft for each abandoned project with its latest decided price, if it has one."""
    last = latest(prices, "project", F.desc("version")).select("project", F.col("version").alias("price_version"))
    gone = projects.where("status = 'abandoned'").select(F.col("id").alias("project"))
    return gone.join(last, "project", "left")
