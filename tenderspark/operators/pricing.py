"""Price gaps, market benchmarks, cost estimates, scenarios and decisions over whole tables."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.functions.text import strip

MONEY = "decimal(15,2)"


def dec(value: str) -> Column:
    """A decimal literal."""
    return F.lit(Decimal(value))


def gap_percent(ours: Column, winning: Column) -> Column:
    """How far our price lies above the winning one, in percent; null without a winning price."""
    win = F.when(winning != 0, winning).cast("double")
    return (ours.cast("double") - win) / win * 100


def gap_bucket(ours: Column, winning: Column) -> Column:
    """underpriced under -5 %, winning to 2 %, slightly_high to 10 %, overpriced above; decided in exact decimals."""
    over = lambda p: (ours - winning) * 100 > winning * p
    return F.when(
        winning != 0,
        F.when((ours - winning) * 100 < winning * -5, "underpriced").when(~over(2), "winning").when(~over(10), "slightly_high")
        .otherwise("overpriced"),
    )


def price_gaps(bids: DataFrame) -> DataFrame:
    """Rows (id, our_price, winning_price, bidders) with gap_pct, gap_bucket and sole_bidder."""
    return bids.select(
        "id",
        gap_percent(F.col("our_price"), F.col("winning_price")).alias("gap_pct"),
        gap_bucket(F.col("our_price"), F.col("winning_price")).alias("gap_bucket"),
        (F.col("bidders") == 1).alias("sole_bidder"),
    )


def eligible_tenders(tenders: DataFrame) -> DataFrame:
    """Closed tenders whose winning price is known and revealed."""
    return tenders.where(F.col("closed") & F.col("revealed") & F.col("winning_price").isNotNull())


def discount_rate() -> Column:
    """Winning price over budget; null where either is zero or missing."""
    rate = F.col("winning_price").cast("double") / F.when(F.col("budget") != 0, F.col("budget")).cast("double")
    return F.when(rate != 0, rate)


def market_benchmark(tenders: DataFrame, our_bids: DataFrame) -> DataFrame:
    """Per (region, project_type): rates of eligible tenders; bidders, gaps and wins of our bids on them.

    Keys with tenders but no bid of ours have has_data false, sample 0 and an empty win rate. Either table is read once:
    a tender and its bids become counted values, of which means and exact medians are made, so a key's rows never meet in
    one task."""
    key = ["region", "project_type"]
    sold = eligible_tenders(tenders).select("id", *key, "winning_price", discount_rate().alias("rate"))
    per = our_bids.groupBy(F.col("project").alias("id")).agg(F.collect_list(F.struct("price", "bidders", "won")).alias("bids"))
    value = lambda kind, v, gap, won: F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("value"), gap.alias("gap"), won.alias("won"))
    none = (F.lit(None).cast("double"), F.lit(None).cast("boolean"))
    ours = F.transform("bids", lambda b: value("bid", b["bidders"], gap_percent(b["price"], F.col("winning_price")), b["won"]))
    told = F.concat(F.array(value("rate", F.col("rate"), *none)), F.coalesce(ours, F.array().cast("array<struct<kind:string,value:double,gap:double,won:boolean>>")))
    counts = sold.join(per, "id", "left").select(*key, F.inline(told)).groupBy(*key, "kind", "value").agg(
        F.count("*").alias("n"), F.sum("gap").alias("gap"), F.count("gap").alias("gaps"), F.count_if("won").alias("won")
    )
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    # a tender without rate, or a bid without bidders, counts for neither mean nor median
    times = lambda kind: F.when((F.col("kind") == kind) & F.col("value").isNotNull(), F.col("n"))
    mean = lambda kind: F.sum(of(kind, "value") * F.col("n")) / F.sum(times(kind))
    median = lambda kind: F.percentile(of(kind, "value"), 0.5, F.coalesce(times(kind), F.lit(0)))
    rows = counts.groupBy(*key).agg(
        mean("rate").alias("avg_rate"), median("rate").alias("median_rate"), mean("bid").alias("avg_bidders"), median("bid").alias("median_bidders"),
        F.try_divide(F.sum("gap"), F.sum("gaps")).alias("avg_gap"), F.sum("won").alias("wins"), F.coalesce(F.sum(of("bid", "n")), F.lit(0)).alias("sample_size"),
    )
    return rows.select(
        *key,
        *(F.round(c, 6).alias(c) for c in ("avg_rate", "median_rate", "avg_bidders", "median_bidders", "avg_gap")),
        "wins", "sample_size", (F.col("sample_size") > 0).alias("has_data"),
        F.round(F.try_divide("wins", "sample_size"), 6).alias("win_rate"),
        F.round(F.greatest(F.least("avg_rate", F.lit(1.5)), F.lit(0.01)), 4).alias("multiplier"),
    )


def gap_distribution(tenders: DataFrame, our_bids: DataFrame) -> DataFrame:
    """Per (region, project_type) a map from gap bucket to our bids in it; null buckets do not count."""
    sold = eligible_tenders(tenders)
    each = sold.join(our_bids, F.col("id") == F.col("project")).select(
        "region", "project_type", gap_bucket(F.col("price"), F.col("winning_price")).alias("bucket")
    )
    counts = each.where("bucket is not null").groupBy("region", "project_type", "bucket").count()
    return counts.groupBy("region", "project_type").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "count")))).alias("buckets")
    )


def with_context(projects: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Projects with their market's benchmark; keys nobody bid on get the neutral context."""
    return projects.join(benchmark, ["region", "project_type"], "left").select(
        "id",
        F.coalesce("has_data", F.lit(False)).alias("has_data"),
        F.coalesce("sample_size", F.lit(0)).alias("sample_size"),
        F.coalesce("wins", F.lit(0)).alias("wins"),
        F.when(F.col("has_data"), F.col("multiplier")).alias("multiplier"),
    )


def similar_history(projects: DataFrame, history: DataFrame, within: str = "0.2") -> DataFrame:
    """(id, budget, history_id, history_budget, cost): same region and type, budget within +-20 %.

    One row for each pair; `similar_summary` gives what estimates need without them. Budgets are dealt to bins as wide
    as the band is on a logarithmic scale, so a project meets its own and the two neighbouring bins only."""
    projects = projects.withColumn("_bin", F.explode(F.sequence(_band(within) - 1, _band(within) + 1)))
    h = history.select(
        "region", "project_type", _band(within).alias("_bin"), F.col("id").alias("history_id"), F.col("budget").alias("history_budget"), "cost"
    )
    band = F.col("history_budget").between(F.col("budget") * (1 - dec(within)), F.col("budget") * (1 + dec(within)))
    rows = projects.select("id", "region", "project_type", "budget", "_bin").join(h, ["region", "project_type", "_bin"])
    return rows.where(band).select("id", "budget", "history_id", "history_budget", "cost")


def _band(within: str) -> Column:
    """Bin of a budget on a logarithmic scale, as wide as the band; budgets of zero or less have a bin of their own."""
    width = math.log((1 + float(within)) / (1 - float(within)))
    return F.when(F.col("budget") > 0, F.floor(F.log(F.col("budget").cast("double")) / width)).otherwise(F.lit(-10_000)).cast("int")


#: Projects of one bin that a task sums up at most; windows of up to so many rows are summed one by one; the steps of
#: budgets, on a logarithmic scale, whose moments stand for their rows, and how many moments.
SWEEP, FEW, STEP, MOMENTS = 200_000, 64, 0.02, 10


SUMMARY = pa.schema([*((c, pa.int64()) for c in ("id", "n", "first")), *((c, pa.float64()) for c in ("budgets", "weights", "costs"))])


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest of values[start:end] for each window; no window is empty."""
    out, size, low = np.empty(len(start), values.dtype), 1, values
    while True:
        own = np.flatnonzero((end - start >= size) & (end - start < 2 * size))
        out[own] = np.minimum(low[start[own]], low[end[own] - size])
        if not (end - start >= 2 * size).any():
            return out
        low, size = np.minimum(low[:-size], low[size:]), 2 * size


def _above(b: np.ndarray, h: np.ndarray, by: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Sums of v * h / (2 h - b) over h[start:end], all of them over b, for each v of `by`; b and h ascend.

    h / (2 h - b) is 1/2 + b/2 / (2 h - b). Within a step of h about c the last factor is the geometric series of
    2 (h - c) / (2 c - b), which is under 0.021 and of which ten terms give all digits of a double, so the running sums
    of powers of h - c stand for the rows."""
    half, inverse = [np.zeros(len(b)) for _ in by], [np.zeros(len(b)) for _ in by]
    cuts = np.flatnonzero(np.diff(np.floor(np.log(h) / STEP))) + 1
    for s, e in zip([0, *cuts], [*cuts, len(h)]):
        of = slice(np.searchsorted(end, s, "right"), np.searchsorted(start, e, "left"))
        if of.start >= of.stop:
            continue
        c, low, high = (h[s] + h[e - 1]) / 2, np.clip(start[of], s, e) - s, np.clip(end[of], s, e) - s
        width = max((h[e - 1] - h[s]) / 2, 1.0)
        t, over = (h[s:e] - c) / width, 2 * c - b[of]
        for v, plain, series in zip(by, half, inverse):
            power = v[s:e].astype(np.float64)
            factor = 1 / over
            for k in range(MOMENTS):
                run = np.concatenate([[0.0], np.cumsum(power)])
                moment = run[high] - run[low]
                if not k:
                    plain[of] += moment
                series[of] += moment * factor
                power, factor = power * t, factor * (-2 * width / over)
    return [x / 2 + b / 2 * y for x, y in zip(half, inverse)]


def similar_summary(projects: DataFrame, history: DataFrame, within: str = "0.2") -> DataFrame:
    """(id, n, first, budgets, weights, costs) of the projects that have similar history: how many rows, their smallest
    id and sum of budgets, the sum of their weights and of weighted costs; a weight is 1 / (1 + |budget - h| / h).

    History of equal budgets is one row. A bin of projects meets the history of its own and the neighbouring bins in one
    task (several, if it is crowded), where both lie in the order of budgets and a window slides along; no pair of rows
    is made, and sums over a window come from running sums, so the work of a task grows with its rows. Rows without region, type or budget have no history; history of no budget above zero is left out."""
    key, cents = ["region", "project_type"], (F.col("budget") * 100).cast("long")
    asked = projects.where("budget is not null").select("id", *key, _band(within).alias("bin"), cents.alias("b"))
    known = history.where("budget > 0").select("id", *key, _band(within).alias("bin"), cents.alias("h"), F.col("cost").cast("double").alias("cost"))
    known = known.groupBy(*key, "bin", "h").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.sum("cost").alias("cost"))
    parts = asked.groupBy(*key, "bin").agg(F.ceil(F.count("*") / SWEEP).cast("int").alias("parts"))
    asked = asked.join(parts, [*key, "bin"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    near = known.withColumn("bin", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1))).join(parts, [*key, "bin"])
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    low, high = (int((1 + sign * Decimal(within)) * 1000) for sign in (-1, 1))

    def sweep(mine: pa.Table, past: pa.Table) -> pa.Table:
        past = past.sort_by("h")
        h, n, cost, first = (past[c].to_numpy() for c in ("h", "n", "cost", "first"))
        mine = mine.sort_by("b")
        b = mine["b"].to_numpy()
        start, end = np.searchsorted(h * 1000, b * low, "left"), np.searchsorted(h * 1000, b * high, "right")
        some = np.flatnonzero(end > start)
        if not len(some):
            return SUMMARY.empty_table()
        b, start, end = b[some], start[some], end[some]
        middle = np.searchsorted(h, b, "right")  # up to it a weight is h / b, behind it h / (2 h - b)
        over = lambda values, kind: (lambda run: lambda i, j: run[j] - run[i])(np.concatenate([np.zeros(1, kind), np.cumsum(values, dtype=kind)]))
        counts, budgets, priced = over(n, np.int64), over(h * n, np.int64), over(h * cost, np.longdouble)
        upper = _above(b, h, [n, cost], middle, end)
        weights = budgets(start, middle) / b + upper[0]
        costs = priced(start, middle).astype(np.float64) / b + upper[1]
        for at in np.flatnonzero(end - start <= FEW):
            s = slice(start[at], end[at])
            weight = h[s] / (h[s] + np.abs(b[at] - h[s]))
            weights[at], costs[at] = (weight * n[s]).sum(), (weight * cost[s]).sum()
        return pa.table([mine["id"].take(pa.array(some)), counts(start, end), _least(first, start, end), budgets(start, end) / 100, weights, costs], schema=SUMMARY)

    near = near.select(*(F.col(c).alias(c) for c in near.columns))  # `history` may be made of the same columns
    groups = [df.groupBy(*key, "bin", "part") for df in (asked, near)]
    return groups[0].cogroup(groups[1]).applyInArrow(sweep, "id long, n long, first long, budgets double, weights double, costs double")


def estimate_from_history(projects: DataFrame, summary: DataFrame) -> DataFrame:
    """Cost per project: mean of similar costs, weighted by closeness of budgets, plus 5 %, to the cent with halves to
    even; 75 % of the budget for a project without a row in `summary`."""
    found = summary.select("id", F.col("n").alias("_n"), F.bround(F.col("costs") / F.col("weights") * 1.05, 2).alias("_cost"))
    n = F.coalesce("_n", F.lit(0))
    return projects.select("id", "budget").join(found, "id", "left").select(
        "id",
        F.coalesce("_cost", F.col("budget").cast("double") * 0.75).alias("estimate"),
        n.alias("n"),
        F.when(n >= 3, "medium").otherwise("low").alias("confidence"),
        (n == 0).alias("fallback"),
    )


#: Shares of the cost components.
BREAKDOWN = {"food": "0.55", "labour": "0.25", "logistics": "0.12", "management": "0.08"}


def breakdown_cost(cost: Column) -> list[Column]:
    return [F.bround(cost * dec(share), 2).cast(MONEY).alias(name) for name, share in BREAKDOWN.items()]


def win_probability(price: Column, cost: Column, budget: Column, relationship: Column, tech: str = "75", weight: str = "0.3") -> dict[str, Column]:
    """Score, probability and profit of a price against an assumed lowest competitor at 85 % of the budget.

    All in decimals: the probability follows the score as it is; score and profit are given to two digits, the margin to
    four, halves to even. A price of zero or less has zeros."""
    exact = lambda c: c.cast("decimal(20,4)")
    price, lowest = exact(price), exact(budget * dec("0.85"))
    price_score = F.when(price <= lowest, dec("100")).otherwise(lowest / price * 100).cast("decimal(24,16)")
    business = F.when(relationship >= 50, dec("90")).otherwise(dec("75"))
    rest = str(1 - Decimal(weight) - Decimal("0.3"))
    total = (dec(tech) * dec(rest) + business * dec("0.3") + price_score * dec(weight)).cast("decimal(24,16)")
    by_score = F.when(total >= 90, dec("0.85")).when(total >= 80, dec("0.65")).when(total >= 70, dec("0.40")).otherwise(dec("0.15"))
    chance = F.when(relationship >= 80, F.greatest(by_score, dec("0.75"))).otherwise(by_score)
    profit = price - exact(cost)
    number = lambda c: F.when(price > 0, c.cast("double")).otherwise(F.lit(0.0))
    return {
        "total_score": number(F.bround(total, 2)),
        "win_probability": number(chance),
        "expected_profit": number(F.bround(profit * chance, 2)),
        "profit_margin": number(F.bround(profit / F.when(price > 0, price), 4)),
    }


#: Tier, factor on the historical price, factor on the cost.
TIERS = (("aggressive", "0.96", "1.03"), ("balanced", "1.00", "1.08"), ("conservative", "1.06", "1.15"))


def priced_tiers(costs: DataFrame) -> DataFrame:
    """`costs` (id, cost, budget, multiplier or null, relationship) with three priced tiers in an array and best_tier.

    With a market multiplier: its price, to the cent, times the tier's factor, but never under 1.01 of the cost, to the cent; else
    the cost times the tier's other factor. best_tier has the largest expected profit, of equal ones the first name. Rows
    without a positive cost and budget are left out."""
    market = F.bround(F.col("multiplier").cast("decimal(6,4)") * F.col("budget"), 2).cast(MONEY)

    def price(of_market: str, of_cost: str) -> Column:
        floor = F.bround(F.col("cost") * dec("1.01"), 2).cast("decimal(20,4)")
        return F.when(
            F.col("multiplier").isNotNull(), F.greatest((market * dec(of_market)).cast("decimal(20,4)"), floor)
        ).otherwise(F.bround(F.col("cost") * dec(of_cost), 2).cast("decimal(20,4)"))

    def measured(t: Column) -> Column:
        measures = win_probability(t["price"], F.col("cost"), F.col("budget"), F.col("relationship"))
        return F.struct(t["tier"].alias("tier"), t["price"].alias("price"), *(c.alias(k) for k, c in measures.items()))

    tiers = F.array(*(F.struct(F.lit(n).alias("tier"), price(m, c).alias("price")) for n, m, c in TIERS))
    rows = costs.where("cost > 0 and budget > 0").withColumn("tiers", tiers).withColumn("tiers", F.transform("tiers", measured))
    top = F.array_max(F.col("tiers.expected_profit"))
    best = F.array_min(F.transform(F.filter("tiers", lambda t: t["expected_profit"] == top), lambda t: t["tier"]))
    return rows.withColumn("best_tier", best)


def price_scenarios(costs: DataFrame) -> DataFrame:
    """The tiers of `priced_tiers`, a row for each, with their risk; the conservative one is recommended."""
    each = priced_tiers(costs).select("id", "best_tier", F.inline("tiers"))
    p = F.col("win_probability")
    return each.select(
        *(c for c in each.columns if c != "best_tier"),
        F.when(p > 0.7, "low").when(p > 0.4, "medium").otherwise("high").alias("risk"),
        (F.col("tier") == "conservative").alias("recommended"),
        (F.col("tier") == F.col("best_tier")).alias("best_ev"),
    )


def check_intercepts(price: Column, cost: Column, budget: Column, optimal: Column) -> tuple[Column, Column]:
    """(level, deviation): loss before over-limit before deviation over 5 %, and the deviation from the optimum."""
    off = F.abs(price - optimal)
    level = (
        F.when(price < cost * dec("1.01"), "error")
        .when(price > budget, "over_limit")
        .when(off > optimal * dec("0.05"), "warning")
        .otherwise("ok")
    )
    return level, off.cast("double") / F.when(optimal != 0, optimal).cast("double")


def near_limit(cost: Column, budget: Column) -> Column:
    """The cost leaves hardly any profit under the limit."""
    return cost > budget * dec("0.95")


def latest(rows: DataFrame, key: str, *newest_first: Column | str) -> DataFrame:
    """The newest row of each key."""
    at = F.row_number().over(W.partitionBy(key).orderBy(*newest_first))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def confirmed_cost(estimates: DataFrame, components: list[str]) -> DataFrame:
    """(project, version, total): the latest confirmed version of each project."""
    total = sum((F.col(c) for c in components[1:]), F.col(components[0]))
    return latest(estimates.where("confirmed"), "project", F.desc("version")).select("project", "version", total.alias("total"))


def derive_decision(costs: DataFrame, scenarios: DataFrame, decided: DataFrame) -> DataFrame:
    """Suggested range, optimum and deviation of each decided price; a deviation needs a reason of ten characters."""
    optimum = scenarios.where("recommended").select("id", F.col("price").alias("optimal"))
    rows = decided.join(costs, "id").join(optimum, "id")
    level, deviation = check_intercepts(F.col("final_price"), F.col("cost"), F.col("budget"), F.col("optimal"))
    needs = F.abs(F.col("final_price") - F.col("optimal")) > F.col("optimal") * dec("0.05")
    return rows.select(
        "id",
        F.bround(F.col("cost") * dec("1.02"), 2).cast(MONEY).alias("suggested_low"),
        F.bround(F.col("cost") * dec("1.15"), 2).cast(MONEY).alias("suggested_high"),
        "optimal",
        deviation.alias("deviation"),
        (F.col("final_price") <= F.col("budget")).alias("under_limit"),
        level.alias("level"),
        (~needs | (F.length(strip(F.col("reason"))) >= 10)).alias("reason_ok"),
    )


#: Pricing action, the status it leads to.
PRICING_ACTIONS = {"submit": "pending_boss_approval", "boss_final": "awaiting_review"}


def apply_pricing_actions(projects: DataFrame, actions: DataFrame) -> DataFrame:
    """Each project's latest action applied: next status, or blocked, whatever the action, while it awaits review.

    A draft takes an uploaded project to pricing and changes no other status."""
    last = latest(actions, "project", F.desc("at"), F.desc("action_id"))
    rows = projects.join(last, F.col("id") == F.col("project"))
    blocked = F.col("status") == "awaiting_review"
    to = F.when((F.col("action") == "draft") & (F.col("status") == "uploaded"), "awaiting_pricing")
    for action, status in PRICING_ACTIONS.items():
        to = F.when(F.col("action") == action, F.lit(status)).otherwise(to)
    return rows.select(
        "id", "action", blocked.alias("blocked"), F.when(blocked, F.col("status")).otherwise(F.coalesce(to, "status")).alias("new_status")
    )


def pricing_dashboard(costs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per project of `costs` (as for `priced_tiers`, with region and project_type) that has scenarios: cost,
    budget, benchmark in yuan and the three prices."""
    price = lambda t: F.filter("tiers", lambda x: x["tier"] == t)[0]["price"].alias(t)
    market = benchmark.select("region", "project_type", F.col("multiplier").alias("market_multiplier"), "sample_size")
    return priced_tiers(costs).join(market, ["region", "project_type"], "left").select(
        "id", "cost", "budget", *(price(t) for t, _, _ in TIERS), "best_tier",
        F.coalesce("sample_size", F.lit(0)).alias("sample_size"),
        F.round(F.col("market_multiplier") * F.col("budget").cast("double"), 6).alias("expected_competitive_price"),
    )
