"""Registered queries of the pricing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.operators import pricing as P
from tenderspark.plans.base import MONEY, bids, half_even, our_bids, price_history, projects, query, tenders

ELIGIBLE = "eligible AS (SELECT *, CAST(winning_price AS DOUBLE) / nullif(CAST(budget AS DOUBLE), 0) AS rate FROM tender WHERE closed AND revealed AND winning_price IS NOT NULL)"
BUCKET = """CASE WHEN winning_price <> 0 THEN CASE WHEN (price - winning_price) * 100 < winning_price * -5 THEN 'underpriced'
  WHEN (price - winning_price) * 100 <= winning_price * 2 THEN 'winning'
  WHEN (price - winning_price) * 100 <= winning_price * 10 THEN 'slightly_high' ELSE 'overpriced' END END"""
GAP = "(CAST(price AS DOUBLE) - CAST(winning_price AS DOUBLE)) / nullif(CAST(winning_price AS DOUBLE), 0) * 100"
BENCHMARK = f"""{ELIGIBLE}, market AS (
  SELECT region, project_type, avg(rate) AS r, median(rate) AS mr FROM eligible GROUP BY 1, 2),
own AS (SELECT region, project_type, avg({GAP}) AS gap, count(*) FILTER (WHERE won) AS wins, count(*) AS n,
  avg(o.bidders) AS b, median(o.bidders) AS mb
  FROM eligible e JOIN our_bid o ON o.project = e.id GROUP BY 1, 2),
benchmark AS (SELECT m.region, m.project_type, round(r, 6) AS avg_rate, round(mr, 6) AS median_rate, round(b, 6) AS avg_bidders,
  round(mb, 6) AS median_bidders, round(gap, 6) AS avg_gap, coalesce(wins, 0) AS wins, coalesce(n, 0) AS sample_size,
  coalesce(n, 0) > 0 AS has_data, round(wins / n, 6) AS win_rate, round(greatest(least(r, 1.5), 0.01), 4) AS multiplier
  FROM market m LEFT JOIN own o USING (region, project_type))"""


def _ours(spark: SparkSession, d: str) -> DataFrame:
    return our_bids(spark, d).join(tenders(spark, d).select("id", "winning_price"), F.col("project") == F.col("id")).select(
        "id", F.col("price").alias("our_price"), "winning_price", "bidders"
    )


@query(f"SELECT t.id, {GAP} AS gap_pct, {BUCKET} AS gap_bucket, o.bidders = 1 AS sole_bidder FROM our_bid o JOIN tender t ON t.id = o.project")
def f1_price_gap(spark: SparkSession, d: str) -> DataFrame:
    return P.price_gaps(_ours(spark, d))


@query(f"WITH {ELIGIBLE} SELECT region, project_type, count(*) AS tenders, min(id) AS first_id FROM eligible GROUP BY 1, 2")
def f2_eligible_tenders(spark: SparkSession, d: str) -> DataFrame:
    return P.eligible_tenders(tenders(spark, d)).groupBy("region", "project_type").agg(
        F.count("*").alias("tenders"), F.min("id").alias("first_id")
    )


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    return P.market_benchmark(tenders(spark, d), our_bids(spark, d))


@query(f"WITH {BENCHMARK} SELECT * FROM benchmark")
def f3_market_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return _benchmark(spark, d)


@query(f"""WITH {ELIGIBLE}, b AS (SELECT region, project_type, {BUCKET} AS bucket FROM eligible e JOIN our_bid o ON o.project = e.id)
SELECT region, project_type, bucket, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2, 3""")
def f4_gap_distribution(spark: SparkSession, d: str) -> DataFrame:
    found = P.gap_distribution(tenders(spark, d), our_bids(spark, d))
    return found.select("region", "project_type", F.explode("buckets").alias("bucket", "n"))


@query(f"""WITH {BENCHMARK} SELECT p.id, coalesce(has_data, false) AS has_data, coalesce(sample_size, 0) AS sample_size,
coalesce(wins, 0) AS wins, CASE WHEN has_data THEN multiplier END AS multiplier
FROM project p LEFT JOIN (SELECT * FROM benchmark WHERE region <> 'ASIA') b USING (region, project_type)""")
def f5_cold_start(spark: SparkSession, d: str) -> DataFrame:
    return P.with_context(projects(spark, d), _benchmark(spark, d).where("region <> 'ASIA'"))


SIMILAR = """alike AS (
SELECT p.id, p.budget, h.id AS history_id, h.budget AS history_budget, h.cost, 1 / (1 + abs(CAST(p.budget AS DOUBLE) - CAST(h.budget AS DOUBLE)) / CAST(h.budget AS DOUBLE)) AS weight FROM project p
JOIN price_history h USING (region, project_type) WHERE h.budget BETWEEN p.budget * 0.8 AND p.budget * 1.2 AND h.budget > 0)"""


@query(f"WITH {SIMILAR} SELECT id, count(*) AS n, min(history_id) AS first, CAST(sum(history_budget) AS DOUBLE) AS budgets FROM alike GROUP BY 1")
def f6_similar_history(spark: SparkSession, d: str) -> DataFrame:
    return P.similar_summary(projects(spark, d), price_history(spark, d)).select("id", "n", "first", F.round("budgets", 2).alias("budgets"))


@query(f"""WITH {SIMILAR}, f AS (SELECT id, count(*) AS n, sum(cost * weight) / sum(weight) * 1.05::DOUBLE AS cost FROM alike GROUP BY 1)
SELECT p.id, coalesce(round_even(f.cost, 2), CAST(p.budget AS DOUBLE) * 0.75::DOUBLE) AS estimate, coalesce(n, 0) AS n,
CASE WHEN coalesce(n, 0) >= 3 THEN 'medium' ELSE 'low' END AS confidence, coalesce(n, 0) = 0 AS fallback
FROM project p LEFT JOIN f USING (id)""")
def f7_estimate_from_history(spark: SparkSession, d: str) -> DataFrame:
    p = projects(spark, d)
    return P.estimate_from_history(p, P.similar_summary(p, price_history(spark, d)))


@query("SELECT id, " + ", ".join(
    f"CAST({half_even(f'CAST(budget * 100 AS BIGINT) * {percent}', 100)} AS DOUBLE) / 100 AS {name}"
    for name, percent in (("food", 55), ("labour", 25), ("logistics", 12), ("management", 8))
) + " FROM project")
def f8_breakdown_cost(spark: SparkSession, d: str) -> DataFrame:
    parts = projects(spark, d).select("id", *P.breakdown_cost(F.col("budget")))
    return parts.select("id", *(F.col(c).cast("double").alias(c) for c in P.BREAKDOWN))


COSTS = f"""costs AS (SELECT id, region, project_type, budget, id % 101 AS relationship,
CAST({half_even("CAST(budget * 100 AS BIGINT) * 75", 100)} AS DECIMAL(15,2)) / 100 AS cost_d,
{half_even("CAST(budget * 100 AS BIGINT) * 75", 100)} AS cost_c, CAST(budget * 100 AS BIGINT) AS budget_c FROM project)"""


def _measures(price: str) -> str:
    """SQL of the measures of a price in ten-thousandths (integer), over costs; whole numbers until the last division."""
    x = f"CAST({price} AS HUGEINT)"
    business = "CASE WHEN relationship >= 50 THEN 2700 ELSE 2250 END"
    # the score times the price, in hundredths of points; at most 85 % of the budget has the full price score
    whole = f"CASE WHEN {x} * 100 <= CAST(budget_c AS HUGEINT) * 8500 THEN (3000 + {business} + 3000) * {x} ELSE (3000 + {business}) * {x} + CAST(budget_c AS HUGEINT) * 255000 END"
    by = f"(CASE WHEN {whole} >= 9000 * {x} THEN 85 WHEN {whole} >= 8000 * {x} THEN 65 WHEN {whole} >= 7000 * {x} THEN 40 ELSE 15 END)"
    chance = f"(CASE WHEN relationship >= 80 THEN greatest({by}, 75) ELSE {by} END)"
    profit = f"({x} - cost_c * 100)"
    return (
        f"CAST({half_even(whole, x)} AS DOUBLE) / 100 AS total_score, {chance} / 100.0::DOUBLE AS win_probability, "
        f"CAST({half_even(f'{profit} * {chance}', 10000)} AS DOUBLE) / 100 AS expected_profit, CAST({half_even(f'{profit} * 10000', x)} AS DOUBLE) / 10000 AS profit_margin"
    )


def _costs(spark: SparkSession, d: str) -> DataFrame:
    cost = F.bround(F.col("budget") * P.dec("0.75"), 2).cast(MONEY)
    return projects(spark, d).select("id", "region", "project_type", "budget", cost.alias("cost"), (F.col("id") % 101).alias("relationship"))


@query(f"WITH {COSTS} SELECT id, {_measures('(budget_c * 90)')} FROM costs")
def f9_price_win_probability(spark: SparkSession, d: str) -> DataFrame:
    price = (F.col("budget") * P.dec("0.9")).cast("decimal(20,4)")
    measures = P.win_probability(price, F.col("cost"), F.col("budget"), F.col("relationship"))
    return _costs(spark, d).select("id", *(c.alias(k) for k, c in measures.items()))


_TIER_SQL = " UNION ALL ".join(
    f"""SELECT id, relationship, cost_c, budget_c, '{n}' AS tier, CASE WHEN multiplier_c IS NOT NULL
    THEN greatest({half_even("multiplier_c * budget_c", 10000)} * {of_market}, {half_even("cost_c * 101", 100)} * 100)
    ELSE {half_even(f"cost_c * {of_cost}", 100)} * 100 END AS price_x FROM priced"""
    for n, of_market, of_cost in (("aggressive", 96, 103), ("balanced", 100, 108), ("conservative", 106, 115))
)
SCENARIOS = f"""{BENCHMARK}, {COSTS}, priced AS (SELECT c.*, CASE WHEN c.id % 2 = 0 AND has_data THEN CAST(round(multiplier * 10000) AS BIGINT) END AS multiplier_c
FROM costs c LEFT JOIN benchmark USING (region, project_type)), tiers AS ({_TIER_SQL}),
measured AS (SELECT id, tier, price_x / 10000.0::DOUBLE AS price, price_x, {_measures("price_x")} FROM tiers WHERE cost_c > 0 AND budget_c > 0),
scenario AS (SELECT id, tier, price, price_x, total_score, win_probability, expected_profit, profit_margin,
CASE WHEN win_probability > 0.7 THEN 'low' WHEN win_probability > 0.4 THEN 'medium' ELSE 'high' END AS risk,
tier = 'conservative' AS recommended,
row_number() OVER (PARTITION BY id ORDER BY expected_profit DESC, tier) = 1 AS best_ev FROM measured)"""


def _priced(spark: SparkSession, d: str) -> DataFrame:
    bench = _benchmark(spark, d).select("region", "project_type", F.when(F.col("has_data"), F.col("multiplier")).alias("m"))
    rows = _costs(spark, d).join(bench, ["region", "project_type"], "left")
    return rows.withColumn("multiplier", F.when(F.col("id") % 2 == 0, F.col("m")))


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    return P.price_scenarios(_priced(spark, d))


@query(f"WITH {SCENARIOS} SELECT * EXCLUDE (price_x) FROM scenario")
def f10_price_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return _scenarios(spark, d).withColumn("price", F.col("price").cast("double"))


@query("""SELECT t.id, CASE WHEN o.price < c * 1.01 THEN 'error' WHEN o.price > t.budget THEN 'over_limit'
WHEN abs(o.price - t.winning_price) > t.winning_price * 0.05 THEN 'warning' ELSE 'ok' END AS level,
CAST(abs(o.price - t.winning_price) AS DOUBLE) / nullif(CAST(t.winning_price AS DOUBLE), 0) AS deviation,
c > t.budget * 0.95 AS near_limit
FROM tender t JOIN (SELECT project, price, CAST(price * 0.5 AS DECIMAL(20,3)) AS c FROM our_bid) o ON o.project = t.id""")
def f11_check_intercepts(spark: SparkSession, d: str) -> DataFrame:
    rows = our_bids(spark, d).join(tenders(spark, d).drop("bidders"), F.col("project") == F.col("id")).withColumn(
        "c", (F.col("price") * P.dec("0.5")).cast("decimal(20,3)")
    )
    level, deviation = P.check_intercepts(F.col("price"), F.col("c"), F.col("budget"), F.col("winning_price"))
    return rows.select("id", level.alias("level"), deviation.alias("deviation"), P.near_limit(F.col("c"), F.col("budget")).alias("near_limit"))


@query("""WITH v AS (SELECT project, place AS version, bidder % 2 = 0 AS confirmed, price FROM bid),
l AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY version DESC) AS seq FROM v WHERE confirmed)
SELECT project, version, CAST(price * 2 AS DOUBLE) AS total FROM l WHERE seq = 1""")
def f12_confirmed_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = bids(spark, d).select(
        "project", F.col("place").alias("version"), (F.col("bidder") % 2 == 0).alias("confirmed"), "price", F.col("price").alias("other")
    )
    return P.confirmed_cost(rows, ["price", "other"]).withColumn("total", F.col("total").cast("double"))


@query(f"""WITH {SCENARIOS}, decided AS (SELECT project AS id, CAST(price * 100 AS BIGINT) AS final_c, repeat('x', bidders) AS reason FROM our_bid)
SELECT d.id, {half_even("cost_c * 102", 100)} / 100.0::DOUBLE AS suggested_low, {half_even("cost_c * 115", 100)} / 100.0::DOUBLE AS suggested_high,
s.price AS optimal, (abs(final_c * 100 - price_x) / 10000.0::DOUBLE) / s.price AS deviation, final_c <= budget_c AS under_limit,
CASE WHEN final_c * 100 < cost_c * 101 THEN 'error' WHEN final_c > budget_c THEN 'over_limit'
WHEN abs(final_c * 100 - price_x) * 100 > price_x * 5 THEN 'warning' ELSE 'ok' END AS level,
NOT (abs(final_c * 100 - price_x) * 100 > price_x * 5) OR length(reason) >= 10 AS reason_ok
FROM decided d JOIN costs c ON c.id = d.id JOIN scenario s ON s.id = d.id AND s.recommended""")
def f13_derive_decision(spark: SparkSession, d: str) -> DataFrame:
    decided = our_bids(spark, d).select(
        F.col("project").alias("id"), F.col("price").alias("final_price"), F.repeat(F.lit("x"), F.col("bidders").cast("int")).alias("reason")
    )
    found = P.derive_decision(_costs(spark, d).select("id", "cost", "budget"), _scenarios(spark, d), decided)
    return found.withColumns({c: F.col(c).cast("double") for c in ("suggested_low", "suggested_high", "optimal")})


@query("""WITH act AS (SELECT user_id AS project, event_id, ts, CASE event_type WHEN 'click' THEN 'draft' WHEN 'view' THEN 'submit' WHEN 'purchase' THEN 'boss_final' ELSE 'draft' END AS action FROM events),
last AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) AS seq FROM act),
p AS (SELECT id, CASE id % 3 WHEN 0 THEN 'awaiting_review' WHEN 1 THEN 'uploaded' ELSE status END AS status FROM project)
SELECT id, action, status = 'awaiting_review' AS blocked,
CASE WHEN status = 'awaiting_review' THEN status WHEN action = 'submit' THEN 'pending_boss_approval'
WHEN action = 'boss_final' THEN 'awaiting_review' WHEN status = 'uploaded' THEN 'awaiting_pricing' ELSE status END AS new_status FROM p JOIN last ON project = id AND seq = 1""")
def f14_apply_pricing_actions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    action = F.when(t == "view", "submit").when(t == "purchase", "boss_final").otherwise("draft")
    acts = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").alias("project"), F.col("event_id").alias("action_id"), F.col("ts").alias("at"), action.alias("action")
    )
    p = projects(spark, d).select("id", F.when(F.col("id") % 3 == 0, "awaiting_review").when(F.col("id") % 3 == 1, "uploaded").otherwise(F.col("status")).alias("status"))
    return P.apply_pricing_actions(p, acts)


@query(f"""WITH {SCENARIOS} SELECT c.id, cost_c / 100.0::DOUBLE AS cost, budget_c / 100.0::DOUBLE AS budget,
max(s.price) FILTER (WHERE tier = 'conservative') AS conservative, max(s.price) FILTER (WHERE tier = 'balanced') AS balanced,
max(s.price) FILTER (WHERE tier = 'aggressive') AS aggressive, max(tier) FILTER (WHERE best_ev) AS best_tier,
coalesce(any_value(sample_size), 0) AS sample_size, round(any_value(multiplier) * (budget_c / 100.0::DOUBLE), 6) AS expected_competitive_price
FROM costs c JOIN scenario s ON s.id = c.id LEFT JOIN benchmark b ON b.region = c.region AND b.project_type = c.project_type
GROUP BY c.id, cost_c, budget_c""")
def f15_pricing_dashboard(spark: SparkSession, d: str) -> DataFrame:
    found = P.pricing_dashboard(_priced(spark, d), _benchmark(spark, d))
    return found.withColumns({c: F.col(c).cast("double") for c in ("cost", "budget", "conservative", "balanced", "aggressive")})
