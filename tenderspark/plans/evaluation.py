"""Registered queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.operators import certs as C
from tenderspark.operators import evaluation as E
from tenderspark.plans.base import bids, half_even, projects, query, table
from tenderspark.plans.ingest import MATCHED, matched

NOW = "TIMESTAMP '1998-06-15 12:00:00'"
TIME = f"""timed AS (SELECT *, CAST(floor((epoch_us(bid_open_date) - epoch_us({NOW})) / 86400000000) AS BIGINT) AS days FROM project),
leveled AS (SELECT *, CASE WHEN days IS NULL THEN 'unknown' WHEN days < 0 THEN 'expired' WHEN days <= 3 THEN 'urgent' WHEN days <= 7 THEN 'tight' WHEN days <= 15 THEN 'normal' ELSE 'relaxed' END AS level FROM timed)"""
OWNERS = "owners AS (SELECT c_name AS owner_unit, CASE c_custkey % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'medium' WHEN 2 THEN 'weak' WHEN 3 THEN 'none' ELSE 'Medium' END AS relationship FROM customer WHERE c_custkey % 4 <> 0)"


def _now():
    return F.lit("1998-06-15 12:00:00").cast("timestamp_ntz")


def _projects(spark: SparkSession, d: str) -> DataFrame:
    return projects(spark, d).withColumn("bid_open_date", F.col("bid_open_date").cast("timestamp_ntz"))


@query(f"WITH {TIME} SELECT id, days, level, days > 3 AS sufficient, CAST(CASE WHEN days < 0 THEN 0 ELSE days * 7 // 10 END AS BIGINT) AS working_days FROM leveled")
def e1_time_urgency(spark: SparkSession, d: str) -> DataFrame:
    return _projects(spark, d).select("id", *(c.alias(k) for k, c in E.time_urgency(F.col("bid_open_date").cast("timestamp"), _now().cast("timestamp")).items()))


def _owners(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    own = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(
        F.col("c_name").alias("owner_unit"), F.when(k == 0, "strong").when(k == 1, "medium").when(k == 2, "weak").when(k == 3, "none").otherwise("Medium").alias("relationship")
    )
    return own.join(projects(spark, d).select("owner_unit", "region").distinct(), "owner_unit")


@query(f"WITH {OWNERS} SELECT id, coalesce(relationship, 'none') AS relationship, relationship IS NULL AS is_new_owner FROM project LEFT JOIN owners USING (owner_unit)")
def e2_owner_profile(spark: SparkSession, d: str) -> DataFrame:
    return E.owner_profile(projects(spark, d), _owners(spark, d)).select("id", "relationship", "is_new_owner")


@query(f"""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS staff, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 12 + 1 END AS months,
CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey * 10 AS BIGINT) END AS deposit, CASE WHEN p_partkey % 2 = 0 THEN p_size > 25 END AS special FROM part),
t AS (SELECT *, (coalesce(staff, 0) * coalesce(months, 0) * 8000 + coalesce(deposit, 0)) * (CASE WHEN special THEN 115 ELSE 100 END) AS c FROM c)
SELECT id, c / 100.0::DOUBLE AS total, CAST({half_even('c * 90', 100)} AS DOUBLE) / 100 AS low, CAST({half_even('c * 115', 100)} AS DOUBLE) / 100 AS high,
CASE WHEN (staff IS NOT NULL)::INT + (months IS NOT NULL)::INT + (deposit IS NOT NULL)::INT + coalesce(special, false)::INT >= 4 THEN 'high'
WHEN (staff IS NOT NULL)::INT + (months IS NOT NULL)::INT + (deposit IS NOT NULL)::INT + coalesce(special, false)::INT >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM t""")
def e3_heuristic_cost(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    c = E.heuristic_cost(F.when(k % 5 != 0, F.col("p_size")), F.when(k % 3 != 0, k % 12 + 1), F.when(k % 7 != 0, k * 10), F.when(k % 2 == 0, F.col("p_size") > 25))
    return table(spark, d, "part").select(k.alias("id"), *(c[x].cast("double").alias(x) for x in ("total", "low", "high")), c["confidence"].alias("confidence"))


CHANCE = """round(CASE WHEN qual < 60 OR level = 'expired' THEN 0 ELSE greatest(least((qual * 0.4::DOUBLE + (CASE level WHEN 'urgent' THEN 40 WHEN 'tight' THEN 60 WHEN 'normal' THEN 80 WHEN 'relaxed' THEN 100 ELSE 0 END) * 0.2::DOUBLE
+ rel * 0.3::DOUBLE + greatest(0, 100 - competitors * 10) * 0.1::DOUBLE) / 100, 1.0::DOUBLE), 0.0::DOUBLE) END, 9)"""


@query(f"WITH {TIME} SELECT id, {CHANCE} AS probability FROM (SELECT id, level, 50 + id % 51 AS qual, id % 101 AS rel, id % 12 AS competitors FROM leveled)")
def e4_win_probability(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    level = E.time_urgency(F.col("bid_open_date").cast("timestamp"), _now().cast("timestamp"))["level"]
    return _projects(spark, d).select("id", E.win_probability(50 + k % 51, level, k % 101, k % 12).alias("probability"))


@query(f"WITH {OWNERS} SELECT id, CASE lower(relationship) WHEN 'strong' THEN 3 WHEN 'medium' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END AS rel FROM project LEFT JOIN owners USING (owner_unit)")
def e5_relationship_index(spark: SparkSession, d: str) -> DataFrame:
    rows = projects(spark, d).join(_owners(spark, d), ["owner_unit", "region"], "left")
    return rows.select("id", E.relationship_index(F.col("relationship")).alias("rel"))


@query(f"""WITH {TIME}, p AS (SELECT id, level, qual, valid, {CHANCE} AS p FROM (SELECT id, level, 50 + id % 51 AS qual, id % 3 <> 0 AS valid, id % 101 AS rel, id % 12 AS competitors FROM leveled))
SELECT id, CASE WHEN p = 0 THEN 'abandon' WHEN p > 0.6 THEN 'worth_bidding' ELSE 'conditional' END AS recommendation,
CASE WHEN p = 0 THEN CASE WHEN level = 'expired' THEN 'expired' WHEN qual < 60 THEN 'qualification' WHEN NOT valid THEN 'extraction' ELSE 'fatal' END WHEN p > 0.6 THEN 'strong' ELSE 'review' END AS reason FROM p""")
def e6_recommend(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    level = E.time_urgency(F.col("bid_open_date").cast("timestamp"), _now().cast("timestamp"))["level"]
    what, why = E.recommend(E.win_probability(50 + k % 51, level, k % 101, k % 12), 50 + k % 51, level, k % 3 != 0)
    return _projects(spark, d).select("id", what.alias("recommendation"), why.alias("reason"))


@query(f"""WITH {TIME} SELECT id, (CASE WHEN id % 7 = 0 THEN 2 ELSE 0 END) + (level = 'expired')::INT AS n_fatal, (id % 4 = 0)::INT AS warnings,
CASE WHEN id % 7 = 0 OR level = 'expired' THEN 'high' WHEN id % 4 = 0 THEN 'medium' ELSE 'low' END AS risk_level FROM leveled""")
def e7_collect_risks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    level = E.time_urgency(F.col("bid_open_date").cast("timestamp"), _now().cast("timestamp"))["level"]
    r = E.collect_risks(k % 7 != 0, F.array(F.lit("FOOD"), F.lit("ISO")), level, k % 4 == 0)
    return _projects(spark, d).select("id", F.size(r["fatal"]).alias("n_fatal"), r["warnings"].alias("warnings"), r["risk_level"].alias("risk_level"))


SCALE = """scale AS (SELECT id, CASE WHEN id % 5 <> 0 THEN id % 40 END AS staff, CASE WHEN id % 3 <> 0 THEN id % 12 + 1 END AS months, CASE WHEN id % 7 <> 0 THEN id % 1000 * 10 END AS deposit,
CASE WHEN id % 2 = 0 THEN id % 4 = 0 END AS special FROM project WHERE id % 13 <> 0),
cost AS (SELECT id, (coalesce(staff, 0) * coalesce(months, 0) * 8000 + coalesce(deposit, 0)) * (CASE WHEN special THEN 115 ELSE 100 END) AS c,
(staff IS NOT NULL)::INT + (months IS NOT NULL)::INT + (deposit IS NOT NULL)::INT + coalesce(special, false)::INT AS known FROM scale)"""


@query(f"""WITH {TIME}, {OWNERS}, {MATCHED}, {SCALE}, per AS (SELECT project, count(*) FILTER (WHERE is_mandatory) AS m, count(*) AS n, count(*) FILTER (WHERE is_mandatory AND status = 'missing') AS gone,
count(*) FILTER (WHERE is_mandatory AND status IN ('missing', 'wrong', 'expired')) AS failed, count(*) FILTER (WHERE NOT is_mandatory AND status NOT IN ('missing', 'wrong')) AS held FROM matched GROUP BY 1),
r AS (SELECT l.id, level, CASE WHEN m > 0 THEN (m - gone) * 100 // m WHEN n > 0 THEN held * 100 // n ELSE 0 END AS qual, coalesce(failed, 0) + (coalesce(m, 0) = 0 AND coalesce(held, 0) = 0)::INT AS n_bad, n IS NOT NULL AS valid,
relationship IS NULL AS is_new, CASE lower(coalesce(relationship, 'none')) WHEN 'strong' THEN 3 WHEN 'medium' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END AS rel, 1 AS competitors
FROM leveled l LEFT JOIN owners USING (owner_unit) LEFT JOIN per ON per.project = l.id), p AS (SELECT *, {CHANCE} AS p FROM r)
SELECT p.id, CAST(qual AS INTEGER) AS qual, level, p AS probability, CASE WHEN p = 0 THEN 'abandon' WHEN p > 0.6 THEN 'worth_bidding' ELSE 'conditional' END AS recommendation,
CASE WHEN p = 0 THEN CASE WHEN level = 'expired' THEN 'expired' WHEN qual < 60 THEN 'qualification' WHEN NOT valid THEN 'extraction' ELSE 'fatal' END WHEN p > 0.6 THEN 'strong' ELSE 'review' END AS reason,
CAST(n_bad + (level = 'expired')::INT AS INTEGER) AS n_fatal, CASE WHEN n_bad > 0 OR level = 'expired' THEN 'high' WHEN is_new THEN 'medium' ELSE 'low' END AS risk_level, valid AS extraction_valid,
coalesce(c, 0) / 100.0::DOUBLE AS estimated_cost, CAST({half_even("coalesce(c, 0) * 90", 100)} AS DOUBLE) / 100 AS price_low, CAST({half_even("coalesce(c, 0) * 115", 100)} AS DOUBLE) / 100 AS price_high,
CASE WHEN coalesce(known, 0) >= 4 THEN 'high' WHEN coalesce(known, 0) >= 2 THEN 'medium' ELSE 'low' END AS cost_confidence FROM p LEFT JOIN cost ON cost.id = p.id""")
def e8_evaluate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    p = _projects(spark, d).withColumn("bid_open_date", F.col("bid_open_date").cast("timestamp"))
    scale = p.where("id % 13 <> 0").select(
        "id", F.when(k % 5 != 0, k % 40).alias("staff"), F.when(k % 3 != 0, k % 12 + 1).alias("months"), F.when(k % 7 != 0, k % 1000 * 10).alias("deposit"), F.when(k % 2 == 0, k % 4 == 0).alias("special")
    )
    report = E.evaluate(p, _owners(spark, d), C.qualification_report(p, matched(spark, d)), _now().cast("timestamp"), scale=scale)
    return report.withColumns({c: F.col(c).cast("double") for c in ("estimated_cost", "price_low", "price_high")})


@query("SELECT project, CAST(max(place) AS INTEGER) AS latest, CAST(max(place) + 1 AS INTEGER) AS next FROM bid GROUP BY 1")
def e9_next_versions(spark: SparkSession, d: str) -> DataFrame:
    return E.next_versions(bids(spark, d).select("project", F.col("place").alias("version")))


@query("SELECT project, CAST(place AS INTEGER) AS version, bidder AS id FROM bid WHERE place = bidders")
def e9_latest_reports(spark: SparkSession, d: str) -> DataFrame:
    return E.latest_reports(bids(spark, d).select("project", F.col("place").alias("version"), F.col("bidder").alias("id")))
