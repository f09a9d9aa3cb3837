"""What outcomes teach: price history, winning sections, traps, rebids, revivals and reports over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.operators.pricing import latest


def win_history(wins: DataFrame) -> DataFrame:
    """(id, profit_rate, aggressive) of won projects (id, final_price, cost, budget): under 5 % of the budget is aggressive."""
    gain = F.col("final_price") - F.col("cost")
    rate = F.when(F.col("budget") != 0, gain.cast("double") / F.col("budget").cast("double")).otherwise(0.0)
    return wins.select("id", rate.alias("profit_rate"), (rate < 0.05).alias("aggressive"))


def lose_history(losses: DataFrame) -> DataFrame:
    """History rows of lost projects (id, project_type, region, budget, cost, final_price, competitor_price) of which both
    prices are known: the discount rate is what the price leaves over the cost, by the budget, 0 without one."""
    known = losses.where("competitor_price is not null and final_price is not null")
    gain = (F.col("final_price") - F.col("cost")).cast("double")
    rate = F.when(F.col("budget") > 0, gain / F.col("budget").cast("double")).otherwise(0.0)
    return known.select("id", "project_type", "region", "budget", "cost", "final_price", "competitor_price", rate.alias("discount_rate"), F.lit(False).alias("won"))


def extract_dna(proposals: DataFrame) -> DataFrame:
    """(project, title, content, contribution) of each section in a confirmed proposal's JSON, {"sections": [...]}.

    A section without a title is named by its section_title, or Unknown."""
    items = F.from_json("json", "sections array<struct<title:string,section_title:string,content:string>>")["sections"]
    rows = proposals.where("confirmed").select("project", F.explode(items).alias("s")).where("s is not null")
    title = F.coalesce(F.nullif("s.title", F.lit("")), "s.section_title", F.lit("Unknown"))
    return rows.select("project", title.alias("title"), F.col("s.content").alias("content"), F.lit(8).alias("contribution"))


def evolution_log(outcomes: DataFrame, chunks: DataFrame, delta: int = 20) -> DataFrame:
    """(project, chunk_id, event, delta, new_quality): each outcome on its project's chunks; only wins change quality."""
    won = F.col("outcome") == "win"
    return outcomes.join(chunks.select("project", "chunk_id", "quality"), "project").select(
        "project", "chunk_id", F.col("outcome").alias("event"), F.when(won, delta).alias("delta"),
        F.when(won, F.col("quality") + delta).otherwise(F.col("quality")).alias("new_quality"),
    )


def upsert_traps(traps: DataFrame, disqualified: DataFrame) -> DataFrame:
    """Traps (title, code, n) with new reasons (id, category, reason) counted in; a new title gets TRAP_<category>_<id>.

    Without a reason the title is Unknown disqualification, without a category it is format."""
    title = F.coalesce(F.nullif(F.substring("reason", 1, 255), F.lit("")), F.lit("Unknown disqualification"))
    new = disqualified.groupBy(title.alias("title")).agg(
        F.count("*").alias("more"), F.min_by("category", "id").alias("category"), F.min("id").alias("first")
    )
    return traps.join(new, "title", "full_outer").select(
        "title", F.coalesce("code", F.format_string("TRAP_%s_%d", F.coalesce(F.nullif("category", F.lit("")), F.lit("format")), "first")).alias("code"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"),
    )


def manual_errors(disqualified: DataFrame, items: DataFrame) -> DataFrame:
    """(project, manual_error): a fatal item was deleted by hand."""
    bad = items.where("specialist_status = 'deleted' and risk_level = 'fatal'").select("project").distinct().withColumn("bad", F.lit(True))
    return disqualified.select("project").distinct().join(bad, "project", "left").select("project", F.col("bad").isNotNull().alias("manual_error"))


def detect_rebids(asked: DataFrame, projects: DataFrame, outcomes: DataFrame, now: Column, within: int = 365) -> DataFrame:
    """(id, rebid_of, outcome, score, confidence): the owner's other project of the latest opening within a year."""
    old = projects.where(F.to_date("bid_open_date") >= F.date_sub(now, within)).select(
        "owner_unit", F.col("id").alias("rebid_of"), F.col("bid_open_date").alias("opened")
    )
    # an owner's two latest are enough: one of them is not the project itself
    rank = F.row_number().over(W.partitionBy("owner_unit").orderBy(F.desc("opened"), F.desc("rebid_of")))
    two = old.withColumn("n", rank).where("n <= 2").groupBy("owner_unit").agg(F.array_sort(F.collect_list(F.struct("n", "rebid_of"))).alias("two"))
    other = F.get(F.filter("two", lambda x: x["rebid_of"] != F.col("id")), 0)["rebid_of"]
    best = asked.select("id", "owner_unit").join(two, "owner_unit").select("id", other.alias("rebid_of")).where("rebid_of is not null")
    last = latest(outcomes, "project", F.desc("id")).select(F.col("project").alias("rebid_of"), "outcome")
    return best.join(last, "rebid_of", "left").select("id", "rebid_of", F.coalesce("outcome", F.lit("unknown")).alias("outcome"), F.lit(0.95).alias("score"), F.lit("high").alias("confidence"))


def revivable_drafts(rebids: DataFrame, drafts: DataFrame) -> DataFrame:
    """(id, drafts): ids of the drafts that can be revived for each rebid, in order."""
    own = drafts.where("can_be_revived").select(F.col("project").alias("rebid_of"), F.col("id").alias("draft_id"))
    return rebids.join(own, "rebid_of").groupBy("id").agg(F.array_sort(F.collect_list("draft_id")).alias("drafts"))


def revive_drafts(drafts: DataFrame, now: Column, within: int = 365) -> DataFrame:
    """(id, project, ok, reason, new_status): drafts that can be revived and were archived within a year."""
    reason = F.when(~F.col("can_be_revived"), "not_revivable").when(F.col("archived_at").isNull(), "not_archived").when(F.datediff(now, F.to_date("archived_at")) > within, "too_old")
    return drafts.select("id", "project", reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), "evaluation_ready").alias("new_status"))


def revived_drafts(drafts: DataFrame, now: Column, within: int = 365) -> DataFrame:
    """The drafts after their revival: those that may be are marked with time and project and cannot be revived again."""
    ok = revive_drafts(drafts, now, within).where("ok").select("id", F.lit(True).alias("_ok"))
    hit = F.col("_ok").isNotNull()
    return drafts.join(ok, "id", "left").withColumns(
        {"can_be_revived": ~hit & F.col("can_be_revived"), "revived_at": F.when(hit, now), "revived_to_project_id": F.when(hit, F.col("project"))}
    ).drop("_ok")


def draft_revivals(drafts: DataFrame, now: Column, by: Column, notes: Column, within: int = 365) -> DataFrame:
    """A revival row for each draft (id, project, termination_reason, ...) that may be revived, for the same project."""
    ok = revive_drafts(drafts, now, within).where("ok").select("id")
    kind = F.lit("rebid_same_project")
    content = F.struct(F.col("project").alias("original_project_id"), "termination_reason", kind.alias("revival_type"))
    return drafts.join(ok, "id").select(
        F.col("id").alias("abandoned_draft_id"), F.col("project").alias("new_project_id"), kind.alias("revival_type"), content.alias("revived_content"),
        notes.alias("adaptation_notes"), by.alias("revived_by"), now.alias("revived_at"), F.lit(True).alias("is_successful"),
    )


def evolution_report(chunks: DataFrame, dna: DataFrame, traps: DataFrame, quality: DataFrame, now: Column) -> DataFrame:
    """One row: chunks, those deprecated, DNA and traps since 30 days before `now` (that moment included), and the trend of
    mean quality against the 30 days before (up or down by more than 2; no chunks count as 0)."""
    since = lambda days: F.col("at") >= now - F.make_dt_interval(F.lit(days))
    recent = F.coalesce(since(30), F.lit(False))
    a = chunks.agg(F.count("*").alias("total_chunks"), F.count_if(F.col("is_deprecated") & recent).alias("deprecated"))
    b = dna.agg(F.count_if(recent).alias("new_dna"))
    c = traps.agg(F.count_if(recent).alias("new_traps"))
    q = quality.agg(F.avg(F.when(recent, F.col("quality"))).alias("now"), F.avg(F.when(since(60) & ~recent, F.col("quality"))).alias("before"))
    change = F.coalesce("now", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    trend = F.when(change > 2, "up").when(change < -2, "down").otherwise("stable")
    one = a.crossJoin(b).crossJoin(c).crossJoin(q)  # single rows
    return one.select("total_chunks", "deprecated", "new_dna", "new_traps", F.round("now", 6).alias("quality"), trend.alias("trend"))


def review_analysis(outcomes: DataFrame, dna: DataFrame) -> DataFrame:
    """(project, outcome, n_dna, first_dna) of each project's latest outcome."""
    d = dna.groupBy("project").agg(F.count("*").alias("n_dna"), F.min("id").alias("first_dna"))
    return latest(outcomes, "project", F.desc("id")).select("project", "outcome").join(d, "project", "left").na.fill(0, ["n_dna"])


def corpus_inventory(chunks: DataFrame) -> DataFrame:
    """Per source and outcome: chunks, share with tags, median and 95th percentile of tokens."""
    tokens = F.floor(F.length("content") * 4 / F.lit(10).cast("decimal(3,0)")).cast("long")
    return chunks.withColumn("tokens", tokens).groupBy("source_label", "win_signal").agg(
        F.count("*").alias("n"), F.round(F.avg((F.size("tags") > 0).cast("double")), 6).alias("coverage"),
        F.round(F.percentile("tokens", 0.5), 6).alias("median_tokens"), F.round(F.percentile("tokens", 0.95), 6).alias("p95_tokens"),
    )


def inventory_by_dimension(chunks: DataFrame) -> DataFrame:
    """(dimension, n, share): chunks with each dimension tag, and their share of all chunks."""
    n = chunks.select(F.explode(F.array_distinct("tags")).alias("dimension")).groupBy("dimension").agg(F.count("*").alias("n"))
    every = chunks.agg(F.count("*").alias("every"))  # a single row
    return n.crossJoin(every).select("dimension", "n", F.round(F.col("n") / F.col("every"), 6).alias("share"))


def weekly_evolution(chunks: DataFrame, wins: DataFrame) -> DataFrame:
    """(chunk_id, quality, deprecate): 10 more for each win; unused old chunks under 50 are deprecated."""
    n = wins.groupBy("project").agg(F.count("*").alias("wins"))
    q = F.col("quality") + 10 * F.coalesce("wins", F.lit(0))
    return chunks.join(n, "project", "left").select("chunk_id", q.alias("quality"), (~F.col("used") & F.col("old") & (q < 50)).alias("deprecate"))


def mine_traps(reasons: DataFrame, least: int = 2) -> DataFrame:
    """(month, kind, reason, n) of reasons that came up at least twice in a month."""
    return reasons.groupBy(F.date_format("at", "yyyy-MM").alias("month"), "kind", "reason").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def daily_kpi(outcomes: DataFrame) -> DataFrame:
    """Per day the share of wins, over all and by relationship."""
    won = F.col("won").cast("double")
    return outcomes.groupBy(F.to_date("at").alias("day")).agg(
        F.round(F.avg(won), 6).alias("win_rate"), F.round(F.avg(F.when(F.col("related"), won)), 6).alias("win_rate_related"),
        F.round(F.avg(F.when(~F.col("related"), won)), 6).alias("win_rate_unrelated"), F.count("*").alias("n"),
    )


def boss_kpi(projects: DataFrame, now: Column) -> DataFrame:
    """One row: active projects, those awaiting a price, due within seven days, and of low probability."""
    live = ~F.col("deleted") & ~F.col("status").isin("discarded", "completed")
    due = F.datediff(F.to_date("bid_open_date"), now).between(0, 7)
    return projects.agg(
        F.count_if(live).alias("active"), F.count_if(live & (F.col("status") == "awaiting_pricing")).alias("awaiting_price"),
        F.count_if(live & due).alias("due"), F.count_if(live & (F.col("probability") < 0.4)).alias("low_probability"),
    )
