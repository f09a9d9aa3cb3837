"""Whether to bid: time, owner, cost, probability, recommendation and risks for whole tables of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Scores of the time levels.
TIME_SCORES = {"expired": 0, "urgent": 40, "tight": 60, "normal": 80, "relaxed": 100}


def days_left(open_at: Column, now: Column) -> Column:
    """Whole days until the opening, rounded down also below zero."""
    return F.floor((F.unix_micros(open_at) - F.unix_micros(now)) / F.lit(86_400_000_000)).cast("long")


def time_urgency(open_at: Column, now: Column) -> dict[str, Column]:
    """Level, whether the time suffices and working days; unknown without an opening date."""
    n = days_left(open_at, now)
    level = (
        F.when(n.isNull(), "unknown").when(n < 0, "expired").when(n <= 3, "urgent").when(n <= 7, "tight").when(n <= 15, "normal").otherwise("relaxed")
    )
    return {
        "days": n, "level": level, "sufficient": n > 3,
        "working_days": F.when(n < 0, 0).otherwise(F.floor(n * 7 / F.lit(10).cast("decimal(3,0)"))).cast("long"),
    }


def owner_profile(projects: DataFrame, owners: DataFrame) -> DataFrame:
    """Projects with their owner's relationship level; an unknown owner is new and has none."""
    known = owners.select("owner_unit", "region", "relationship")
    return projects.join(known, ["owner_unit", "region"], "left").select(
        projects["*"], F.coalesce("relationship", F.lit("none")).alias("relationship"), F.col("relationship").isNull().alias("is_new_owner")
    )


def heuristic_cost(staff: Column, months: Column, deposit: Column, special: Column) -> dict[str, Column]:
    """Staff months at 8000 and the deposit, 15 % more for special equipment; a range and a confidence by known fields."""
    # special equipment is a known field only where it is needed
    known = sum((c.isNotNull().cast("int") for c in (months, deposit)), staff.isNotNull().cast("int")) + F.coalesce(special, F.lit(False)).cast("int")
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = (zero(staff) * zero(months) * 8000 + zero(deposit)).cast("decimal(15,2)")
    total = F.when(F.coalesce(special, F.lit(False)), base * F.lit("1.15").cast("decimal(3,2)")).otherwise(base).cast("decimal(18,4)")
    return {
        "total": total, "low": F.bround(total * F.lit("0.90").cast("decimal(3,2)"), 2), "high": F.bround(total * F.lit("1.15").cast("decimal(3,2)"), 2),
        "confidence": F.when(known >= 4, "high").when(known >= 2, "medium").otherwise("low"),
    }


def win_probability(qual: Column, level: Column, relationship: Column, competitors: Column) -> Column:
    """0 under 60 points or after the deadline; else a weighted sum of qualification, time, relationship and competition."""
    time = F.lit(0)
    for name, score in TIME_SCORES.items():
        time = F.when(level == name, score).otherwise(time)
    base = (qual * 0.4 + time * 0.2 + relationship * 0.3 + F.greatest(F.lit(0), 100 - competitors * 10) * 0.1) / 100
    return F.when((qual < 60) | (level == "expired"), 0.0).otherwise(F.round(F.greatest(F.least(base, F.lit(1.0)), F.lit(0.0)), 9))


def relationship_index(level: Column) -> Column:
    """0 to 3: none or unknown, weak, medium, strong."""
    low = F.lower(level)
    return F.when(low == "strong", 3).when(low == "medium", 2).when(low == "weak", 1).otherwise(0)


def recommend(p: Column, qual: Column, level: Column, extraction_valid: Column) -> tuple[Column, Column]:
    """(recommendation, reason code): a zero chance is abandoned for the first cause that holds."""
    what = F.when(p == 0, "abandon").when(p > 0.60, "worth_bidding").otherwise("conditional")
    why = F.when(p == 0, F.when(level == "expired", "expired").when(qual < 60, "qualification").when(~extraction_valid, "extraction").otherwise("fatal"))
    return what, F.coalesce(why, F.when(p > 0.60, "strong").otherwise("review"))


def collect_risks(passed: Column, missing: Column, level: Column, new_owner: Column) -> dict[str, Column]:
    """Fatal rows (kind, code) of missing certificates and expiry, the owner warning, and the overall level."""
    row = lambda kind, code: F.struct(F.lit(kind).alias("kind"), code.alias("code"))
    certs = F.when(~passed, F.transform(missing, lambda m: row("qualification", m))).otherwise(F.array().cast("array<struct<kind:string,code:string>>"))
    fatal = F.concat(certs, F.array_compact(F.array(F.when(level == "expired", row("time", F.lit("expired"))))))
    return {
        "fatal": fatal, "warnings": F.when(new_owner, 1).otherwise(0),
        "risk_level": F.when(F.size(fatal) > 0, "high").when(new_owner, "medium").otherwise("low"),
    }


def evaluate(projects: DataFrame, owners: DataFrame, qualification: DataFrame, now: Column, competitors: int = 1, scale: DataFrame | None = None) -> DataFrame:
    """One report row per project from its qualification (id, score, passed, missing, extraction_valid), time, owner and
    the figures of its scale (id, staff, months, deposit, special), which give a cost, its range and a confidence.

    `certs.qualification_report` gives the qualification; a project without one has no score and no valid extraction.
    Without figures of scale the cost is 0 and of low confidence."""
    rows = owner_profile(projects, owners).join(qualification, "id", "left")
    if scale is None:
        scale = projects.sparkSession.createDataFrame([], "id long, staff int, months int, deposit decimal(15,2), special boolean")
    rows = rows.join(scale.select("id", "staff", "months", "deposit", "special"), "id", "left")
    cost = heuristic_cost(*map(F.col, ("staff", "months", "deposit", "special")))
    costs = F.struct(*(cost[k].alias(k) for k in ("total", "low", "high", "confidence"))).alias("cost")
    valid = F.coalesce("extraction_valid", F.lit(False)).alias("extraction_valid")
    qual, passed = F.coalesce("score", F.lit(0)), F.coalesce("passed", F.lit(False))
    missing = F.coalesce("missing", F.array().cast("array<string>"))
    time = time_urgency(F.col("bid_open_date"), now)
    rows = rows.select("id", qual.alias("qual"), passed.alias("passed"), missing.alias("missing"), time["level"].alias("level"), relationship_index(F.col("relationship")).alias("rel"), "is_new_owner", valid, costs)
    p = win_probability(F.col("qual"), F.col("level"), F.col("rel"), F.lit(competitors))
    rows = rows.withColumn("probability", p)
    what, why = recommend(F.col("probability"), F.col("qual"), F.col("level"), F.col("extraction_valid"))
    risks = collect_risks(F.col("passed"), F.col("missing"), F.col("level"), F.col("is_new_owner"))
    return rows.select("id", "qual", "level", "probability", what.alias("recommendation"), why.alias("reason"), F.size(risks["fatal"]).alias("n_fatal"), risks["risk_level"].alias("risk_level"),
        "extraction_valid", F.col("cost.total").alias("estimated_cost"), F.col("cost.low").alias("price_low"), F.col("cost.high").alias("price_high"), F.col("cost.confidence").alias("cost_confidence"))


def next_versions(reports: DataFrame, key: str = "project") -> DataFrame:
    """(key, latest, next): the newest version of each project and the one to come."""
    return reports.groupBy(key).agg(F.max("version").alias("latest"), (F.max("version") + 1).alias("next"))


def latest_reports(reports: DataFrame, key: str = "project") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("version"), F.desc("id")))
    return reports.withColumn("_n", rank).where("_n = 1").drop("_n")
