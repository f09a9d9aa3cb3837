"""Registered queries of the formal review and outcome operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.operators import outcomes as O
from tenderspark.operators import review as R
from tenderspark.plans.base import bids, chunks, our_bids, price_history, projects, query, table
from tenderspark.plans.ingest import EXTRACTION, _requirements

ITEMS = """items AS (SELECT event_id AS id, user_id AS project, CASE event_id % 3 WHEN 0 THEN 'fatal' WHEN 1 THEN 'warning' ELSE 'info' END AS risk_level, event_type AS category,
CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'deleted' ELSE 'pending' END AS specialist_status FROM events)"""
LASTP = "lastp AS (SELECT project, max(place) AS version, arg_max(price, place) AS price FROM bid GROUP BY 1)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select(
        k.alias("id"), F.col("user_id").alias("project"), F.when(k % 3 == 0, "fatal").when(k % 3 == 1, "warning").otherwise("info").alias("risk_level"),
        F.col("event_type").alias("category"), F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "deleted").otherwise("pending").alias("specialist_status"), "ts", "props", "value",
    )


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return bids(spark, d).select("project", F.col("place").alias("version"), "price")


H1 = f"""dated AS (SELECT e.project, 'cert:' || e.id AS item, date_diff('day', CAST(bid_open_date AS DATE), valid_until) AS days FROM ext e JOIN project p ON p.id = e.project),
validity AS (SELECT project, item, CASE WHEN days < 0 THEN 'fatal' WHEN days < 90 THEN 'warning' ELSE 'info' END AS risk_level, CASE WHEN days < 0 THEN 'failed' WHEN days < 90 THEN 'warning' ELSE 'passed' END AS system_status FROM dated)"""
H2 = "priced AS (SELECT id AS project, 'price' AS item, CASE WHEN price > budget THEN 'fatal' ELSE 'info' END AS risk_level, CASE WHEN price > budget THEN 'failed' ELSE 'passed' END AS system_status FROM project JOIN lastp ON lastp.project = id)"
H3 = """need AS (SELECT DISTINCT user_id AS project, event_type AS name FROM events WHERE user_id % 7 <> 0), broken AS (SELECT DISTINCT user_id AS project FROM events WHERE user_id % 7 = 0),
title AS (SELECT DISTINCT conv_id AS project, CASE role WHEN 'user' THEN 'the view of all' WHEN 'assistant' THEN 'sign' ELSE 'errors' END AS title FROM conversations),
made AS (SELECT id AS project FROM project WHERE id % 3 <> 1),
cover AS (SELECT project, 'section:' || name AS item, 'fatal' AS risk_level, 'failed' AS system_status FROM need n WHERE project IN (SELECT project FROM made)
AND NOT EXISTS (SELECT 1 FROM title t WHERE t.project = n.project AND (contains(title, name) OR contains(name, title)))
UNION ALL SELECT id, 'proposal', 'warning', 'warning' FROM project WHERE id % 3 = 1
UNION ALL SELECT project, 'scoring', 'fatal', 'failed' FROM broken WHERE project IN (SELECT project FROM made)
UNION ALL SELECT project, 'sections', 'warning', 'warning' FROM made WHERE project NOT IN (SELECT project FROM need) AND project NOT IN (SELECT project FROM broken) AND project NOT IN (SELECT project FROM title))"""


def _h1(spark, d):
    return R.validity_rows(_requirements(spark, d)[1], projects(spark, d))


def _h3(spark, d):
    # each user's event types as the scoring standard of one project, every seventh cut off
    kind = F.when(F.col("user_id") % 2 == 0, F.struct(F.col("event_type").alias("name"), F.lit(None).cast("string").alias("title"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("name"), F.col("event_type").alias("title"))
    )
    said = table(spark, d, "events").groupBy(F.col("user_id").alias("project")).agg(F.to_json(F.collect_set(kind)).alias("json"))
    said = said.select("project", F.when(F.col("project") % 7 == 0, F.expr("left(json, length(json) - 2)")).otherwise(F.col("json")).alias("scoring"))
    required, broken = R.scoring_standard(said)
    r = F.col("role")
    title = F.when(r == "user", "the view of all").when(r == "assistant", "sign").otherwise("errors")
    sections = table(spark, d, "conversations").select(F.col("conv_id").alias("project"), title.alias("title"))
    p = projects(spark, d)
    return R.section_coverage(p, required, p.where("id % 3 <> 1").select(F.col("id").alias("project")), sections, broken)


@query(f"WITH {EXTRACTION}, {H1} SELECT * FROM validity")
def h1_validity_rows(spark: SparkSession, d: str) -> DataFrame:
    return _h1(spark, d)


@query(f"WITH {LASTP}, {H2} SELECT * FROM priced")
def h2_price_compliance(spark: SparkSession, d: str) -> DataFrame:
    return R.price_rows(projects(spark, d), _prices(spark, d))


@query(f"WITH {H3} SELECT * FROM cover")
def h3_section_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _h3(spark, d)


H4 = """seal AS (SELECT id AS project, 'signature_seal' AS category, unnest(CASE WHEN id % 3 = 0 THEN [region] ELSE ['法定代表人签字或签章', '授权委托书签字盖章', '骑缝章完整性', '正副本份数与标识'] END) AS item FROM project
UNION ALL SELECT id, 'seal_requirement', unnest(CASE WHEN id % 3 = 0 THEN [region] WHEN id % 3 = 1 THEN [owner_unit] ELSE ['投标文件分别封装', '封套粘贴与密封', '电子版文件一致性', '包封标注完整性'] END) FROM project)"""


@query(f"WITH {H4} SELECT *, 'warning' AS risk_level, 'uncertain' AS system_status FROM seal")
def h4_seal_rows(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    own = lambda k, c: F.when(F.col("id") % 3 == k, F.array(c)).otherwise(none)
    return R.seal_rows(projects(spark, d).select("id", own(0, "region").alias("seals"), own(1, "owner_unit").alias("packaging")))


@query(f"""WITH {EXTRACTION}, {LASTP}, {H1}, {H2}, {H3}, {H4} SELECT *, 'pending' AS specialist_status FROM (SELECT * FROM validity UNION ALL SELECT * FROM priced UNION ALL SELECT * FROM cover
UNION ALL SELECT project, item, 'warning', 'uncertain' FROM seal)""")
def h5_checklist(spark: SparkSession, d: str) -> DataFrame:
    return R.checklist(_h1(spark, d), R.price_rows(projects(spark, d), _prices(spark, d)), _h3(spark, d), h4_seal_rows(spark, d).drop("category"))


@query(f"""WITH {ITEMS}, g AS (SELECT project, count(*) AS total, count(*) FILTER (WHERE specialist_status = 'confirmed') AS confirmed,
count(*) FILTER (WHERE specialist_status = 'pending' AND risk_level = 'fatal') AS fatal_pending, count(*) FILTER (WHERE specialist_status = 'pending' AND risk_level = 'warning') AS warning_pending FROM items GROUP BY 1)
SELECT *, fatal_pending = 0 AS can_generate, CASE WHEN fatal_pending > 0 THEN 'fatal_pending' WHEN warning_pending > 0 THEN 'warnings' ELSE 'ready' END AS reason FROM g""")
def h6_review_status(spark: SparkSession, d: str) -> DataFrame:
    return R.review_status(_items(spark, d))


@query(f"""WITH {ITEMS}, g AS (SELECT project, category, count(*) AS total, count(*) FILTER (WHERE specialist_status <> 'pending') AS confirmed FROM items GROUP BY 1, 2),
p AS (SELECT project, count(*) FILTER (WHERE specialist_status <> 'pending') AS done, count(*) FILTER (WHERE risk_level <> 'info') AS needed FROM items GROUP BY 1)
SELECT g.*, CAST(CASE WHEN needed > 0 THEN (done * 200 + needed) // (needed * 2) ELSE 0 END AS BIGINT) AS percent FROM g JOIN p USING (project)""")
def h7_category_progress(spark: SparkSession, d: str) -> DataFrame:
    return R.category_progress(_items(spark, d))


@query("""SELECT id AS project, id IN (SELECT conv_id FROM conversations) AS has_section, id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) AS has_extraction,
id IN (SELECT project FROM bid) AS has_price, id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS has_document, false AS has_seal FROM project""")
def h8_package_readiness(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, k, w="true": table(spark, d, t).where(w).select(F.col(k).alias("project"))
    return R.package_readiness(
        projects(spark, d), part("conversations", "conv_id"), part("lineitem", "l_orderkey", "l_linenumber = 3"), _prices(spark, d), part("events", "user_id", "event_type = 'purchase'")
    )


@query(f"""WITH {ITEMS}, {LASTP} SELECT i.project, count(*) AS total, count(*) FILTER (WHERE id % 5 = 0) AS passed, count(*) FILTER (WHERE risk_level = 'fatal') AS fatal, count(*) FILTER (WHERE risk_level = 'warning') AS warning, count(*) FILTER (WHERE risk_level = 'info') AS info,
count(*) FILTER (WHERE specialist_status = 'pending') AS pending, CAST(any_value(price) AS DOUBLE) AS price FROM items i LEFT JOIN lastp ON lastp.project = i.project GROUP BY 1""")
def h9_draft_preview(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).withColumn("system_status", F.when(F.col("id") % 5 == 0, "passed").otherwise("warning"))
    return R.draft_preview(items, _prices(spark, d)).withColumn("price", F.col("price").cast("double"))


@query(f"WITH {ITEMS} SELECT id, project FROM items WHERE specialist_status = 'pending' AND risk_level = 'fatal'")
def h10_filter_items(spark: SparkSession, d: str) -> DataFrame:
    return R.filter_items(_items(spark, d), "pending", "fatal").select("id", "project")


@query(f"""WITH {ITEMS}, a AS (SELECT *, CASE WHEN id % 5 < 4 THEN (['confirm', 'toggle', 'correct', 'delete'])[CAST(id % 5 + 1 AS INTEGER)] END AS action FROM items)
SELECT id, category AS text, CASE WHEN action = 'correct' THEN 'new' END AS evidence, CASE WHEN action = 'correct' AND id % 2 = 0 THEN 'why | so' END AS note,
CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'toggle' THEN 'pending' WHEN 'correct' THEN 'corrected' WHEN 'delete' THEN 'deleted' ELSE specialist_status END AS specialist_status FROM a""")
def h11_apply_item_actions(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).withColumnRenamed("category", "text")
    k = F.col("id")
    acts = items.where("id % 5 < 4").select("id", F.element_at(F.array(*map(F.lit, ("confirm", "toggle", "correct", "delete"))), (k % 5 + 1).cast("int")).alias("action"), F.when(k % 2 == 0, "new | why | so").otherwise("new").alias("payload"))
    return R.apply_item_actions(items.select("id", "text", "specialist_status"), acts)


@query(f"WITH {LASTP} SELECT id AS project, CAST(version AS INTEGER) AS price_version FROM project LEFT JOIN lastp ON lastp.project = id WHERE id % 9 = 0")
def h12_archive_abandoned(spark: SparkSession, d: str) -> DataFrame:
    gone = projects(spark, d).withColumn("status", F.when(F.col("id") % 9 == 0, "abandoned").otherwise(F.col("status")))
    return R.archive_abandoned(gone, _prices(spark, d))


@query("""SELECT id, CASE WHEN budget <> 0 THEN (CAST(CAST(final_price * 100 AS BIGINT) - CAST(round(cost * 100) AS BIGINT) AS DOUBLE) / 100) / CAST(budget AS DOUBLE) ELSE 0 END AS profit_rate,
CASE WHEN budget <> 0 THEN (CAST(CAST(final_price * 100 AS BIGINT) - CAST(round(cost * 100) AS BIGINT) AS DOUBLE) / 100) / CAST(budget AS DOUBLE) ELSE 0 END < 0.05 AS aggressive FROM price_history WHERE won""")
def i1_win_history(spark: SparkSession, d: str) -> DataFrame:
    return O.win_history(price_history(spark, d).where("won"))


@query("""SELECT h.id, h.project_type, h.region, CAST(h.budget AS DOUBLE) AS budget, h.cost, CAST(h.final_price AS DOUBLE) AS final_price, CAST(w.price AS DOUBLE) AS competitor_price,
CASE WHEN h.budget > 0 THEN (CAST(CAST(h.final_price * 100 AS BIGINT) - CAST(round(h.cost * 100) AS BIGINT) AS DOUBLE) / 100) / CAST(h.budget AS DOUBLE) ELSE 0 END AS discount_rate, false AS won
FROM price_history h JOIN bid w ON w.project = h.id AND w.place = 1 WHERE NOT h.won AND h.id % 3 <> 0""")
def i2_lose_history(spark: SparkSession, d: str) -> DataFrame:
    best = bids(spark, d).where("place = 1").select("project", F.when(F.col("project") % 3 != 0, F.col("price")).alias("competitor_price"))
    rows = price_history(spark, d).where("not won").join(best.withColumnRenamed("project", "id"), "id")
    money = ("budget", "cost", "final_price", "competitor_price")
    return O.lose_history(rows).withColumns({c: F.col(c).cast("double") for c in money})


@query("""WITH c AS (SELECT conv_id AS project, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE conv_id % 2 = 0)
SELECT project, CASE WHEN n % 3 = 1 THEN role WHEN n % 3 = 2 THEN 'part ' || role ELSE 'Unknown' END AS title, md5(text) AS content, 8 AS contribution FROM c""")
def i3_extract_dna(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) % 3
    item = F.struct(
        "turn", F.when(F.col("n") == 1, F.col("role")).when(F.col("n") == 2, "").alias("title"),
        F.when(F.col("n") == 2, F.concat(F.lit("part "), "role")).alias("section_title"), F.md5("text").alias("content"),
    )
    rows = table(spark, d, "conversations").withColumn("n", n).groupBy(F.col("conv_id").alias("project")).agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("sections"))).alias("json")
    )
    return O.extract_dna(rows.withColumn("confirmed", F.col("project") % 2 == 0))


@query("""WITH o AS (SELECT DISTINCT user_id AS project, CASE event_type WHEN 'purchase' THEN 'win' WHEN 'error' THEN 'disqualified' ELSE 'lose' END AS outcome FROM events WHERE user_id < 10)
SELECT c.project, chunk_id, outcome AS event, CASE WHEN outcome = 'win' THEN 20 END AS delta, chunk_id % 100 + CASE WHEN outcome = 'win' THEN 20 ELSE 0 END AS new_quality FROM o JOIN chunk c ON c.project = o.project""")
def i4_evolution_log(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    out = table(spark, d, "events").where("user_id < 10").select(F.col("user_id").alias("project"), F.when(t == "purchase", "win").when(t == "error", "disqualified").otherwise("lose").alias("outcome")).distinct()
    c = table(spark, d, "documents").select((F.col("doc_id") % 10).alias("project"), F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 100).alias("quality"))
    return O.evolution_log(out, c)


@query("""WITH n AS (SELECT CASE WHEN p_size % 10 = 3 THEN 'Unknown disqualification' ELSE p_brand END AS title, count(*) AS more, arg_min(CASE WHEN p_size % 4 = 0 THEN 'format' ELSE CAST(p_size AS VARCHAR) END, p_partkey) AS category, min(p_partkey) AS first FROM part GROUP BY 1),
t AS (SELECT DISTINCT p_brand AS title, 'OLD' AS code, 3 AS n FROM part WHERE p_size > 40 UNION ALL SELECT 'gone', 'OLD', 1)
SELECT coalesce(t.title, n.title) AS title, coalesce(code, 'TRAP_' || category || '_' || first) AS code, coalesce(t.n, 0) + coalesce(more, 0) AS n FROM t FULL JOIN n ON n.title = t.title""")
def i5_upsert_traps(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    old = p.where("p_size > 40").select(F.col("p_brand").alias("title"), F.lit("OLD").alias("code"), F.lit(3).alias("n")).distinct()
    gone = p.limit(1).select(F.lit("gone").alias("title"), F.lit("OLD").alias("code"), F.lit(1).alias("n"))
    return O.upsert_traps(old.union(gone), p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 8 == 0, "").when(F.col("p_size") % 4 != 0, F.col("p_size").cast("string")).alias("category"), F.when(F.col("p_size") % 10 != 3, F.col("p_brand")).when(F.col("p_size") > 20, "").alias("reason")))


@query(f"WITH {ITEMS} SELECT project, bool_or(specialist_status = 'deleted' AND risk_level = 'fatal') AS manual_error FROM items GROUP BY 1")
def i6_manual_errors(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return O.manual_errors(items, items)


REBIDS = """pair AS (SELECT a.id, b.id AS rebid_of, row_number() OVER (PARTITION BY a.id ORDER BY b.bid_open_date DESC, b.id DESC) AS n FROM project a JOIN project b ON a.owner_unit = b.owner_unit AND a.id <> b.id
WHERE a.status = 'evaluating' AND CAST(b.bid_open_date AS DATE) >= DATE '2001-01-01' - 365), rebid AS (SELECT id, rebid_of FROM pair WHERE n = 1)"""


def _rebids(spark: SparkSession, d: str) -> DataFrame:
    p = projects(spark, d)
    out = our_bids(spark, d).select("project", F.col("bidder").alias("id"), F.when(F.col("won"), "win").otherwise("lose").alias("outcome"))
    return O.detect_rebids(p.where("status = 'evaluating'"), p, out, F.lit("2001-01-01").cast("date"))


@query(f"""WITH {REBIDS} SELECT r.id, r.rebid_of, CASE WHEN o.won THEN 'win' WHEN NOT o.won THEN 'lose' ELSE 'unknown' END AS outcome, 0.95::DOUBLE AS score, 'high' AS confidence
FROM rebid r LEFT JOIN our_bid o ON o.project = r.rebid_of""")
def i7_detect_rebids(spark: SparkSession, d: str) -> DataFrame:
    return _rebids(spark, d)


@query(f"""WITH {REBIDS} SELECT r.id, string_agg(b.bidder, ',' ORDER BY b.bidder) AS drafts FROM rebid r JOIN bid b ON b.project = r.rebid_of WHERE b.bidder % 2 = 0 GROUP BY 1""")
def i8_revivable_drafts(spark: SparkSession, d: str) -> DataFrame:
    drafts = bids(spark, d).select("project", F.col("bidder").alias("id"), (F.col("bidder") % 2 == 0).alias("can_be_revived"))
    return O.revivable_drafts(_rebids(spark, d), drafts).select("id", F.array_join("drafts", ",").alias("drafts"))


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    return projects(spark, d).select(
        "id", k.alias("project"), (k % 4 != 0).alias("can_be_revived"), F.when(k % 7 != 0, F.col("bid_open_date")).alias("archived_at"), F.col("region").alias("termination_reason")
    )


@query("""WITH r AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'not_revivable' WHEN id % 7 = 0 THEN 'not_archived' WHEN date_diff('day', CAST(bid_open_date AS DATE), DATE '2001-01-01') > 365 THEN 'too_old' END AS reason FROM project)
SELECT id, id AS project, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN 'evaluation_ready' END AS new_status FROM r""")
def i9_revive_drafts(spark: SparkSession, d: str) -> DataFrame:
    return O.revive_drafts(_drafts(spark, d), F.lit("2001-01-01").cast("date"))


@query("""WITH ok AS (SELECT id, region FROM project WHERE id % 4 <> 0 AND id % 7 <> 0 AND date_diff('day', CAST(bid_open_date AS DATE), DATE '2001-01-01') <= 365)
SELECT id AS abandoned_draft_id, id AS new_project_id, 'rebid_same_project' AS revival_type, id AS original_project_id, region AS termination_reason,
'again' AS adaptation_notes, 7 AS revived_by, DATE '2001-01-01' AS revived_at, true AS is_successful FROM ok""")
def i9_draft_revivals(spark: SparkSession, d: str) -> DataFrame:
    return O.draft_revivals(_drafts(spark, d), F.lit("2001-01-01").cast("date"), F.lit(7), F.lit("again")).select("*", "revived_content.original_project_id", "revived_content.termination_reason").drop("revived_content")


@query("""SELECT id, id AS project, CASE WHEN ok THEN false ELSE id % 4 <> 0 END AS can_be_revived, CASE WHEN id % 7 <> 0 THEN CAST(bid_open_date AS DATE) END AS archived_at, region AS termination_reason,
CASE WHEN ok THEN DATE '2001-01-01' END AS revived_at, CASE WHEN ok THEN id END AS revived_to_project_id
FROM (SELECT *, id % 4 <> 0 AND id % 7 <> 0 AND date_diff('day', CAST(bid_open_date AS DATE), DATE '2001-01-01') <= 365 AS ok FROM project)""")
def i9_revived_drafts(spark: SparkSession, d: str) -> DataFrame:
    return O.revived_drafts(_drafts(spark, d), F.lit("2001-01-01").cast("date")).withColumn("archived_at", F.to_date("archived_at"))


@query(f"""WITH e AS (SELECT event_type, value, ts >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY AS recent, ts >= TIMESTAMP '2024-02-15' - INTERVAL 60 DAY AND ts < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY AS earlier FROM events),
q AS (SELECT avg(value) FILTER (WHERE recent) AS a, avg(value) FILTER (WHERE earlier) AS b FROM e)
SELECT (SELECT count(*) FROM e) AS total_chunks, (SELECT count(*) FROM e WHERE event_type = 'error' AND recent) AS deprecated,
(SELECT count(*) FROM e WHERE event_type = 'view' AND recent) AS new_dna, (SELECT count(*) FROM e WHERE event_type = 'click' AND recent) AS new_traps,
round(a, 6) AS quality, CASE WHEN coalesce(a, 0) > coalesce(b, 0) + 2 THEN 'up' WHEN coalesce(a, 0) < coalesce(b, 0) - 2 THEN 'down' ELSE 'stable' END AS trend FROM q""")
def i10_evolution_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("ts").alias("at"), "event_type", F.col("value").alias("quality"), (F.col("event_type") == "error").alias("is_deprecated"))
    return O.evolution_report(e, e.where("event_type = 'view'"), e.where("event_type = 'click'"), e, F.lit("2024-02-15").cast("timestamp"))


@query("""SELECT o.project, CASE WHEN won THEN 'win' ELSE 'lose' END AS outcome, count(c.turn) AS n_dna, min(c.turn) AS first_dna
FROM our_bid o LEFT JOIN conversations c ON c.conv_id = o.project GROUP BY 1, 2""")
def i11_review_analysis(spark: SparkSession, d: str) -> DataFrame:
    out = our_bids(spark, d).select("project", F.col("bidder").alias("id"), F.when(F.col("won"), "win").otherwise("lose").alias("outcome"))
    return O.review_analysis(out, table(spark, d, "conversations").select(F.col("conv_id").alias("project"), F.col("turn").alias("id")))


@query("""SELECT source_label, win_signal, count(*) AS n, round(avg(CASE WHEN chunk_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
round(quantile_cont(length(content) * 4 // 10, 0.5), 6) AS median_tokens, round(quantile_cont(length(content) * 4 // 10, 0.95), 6) AS p95_tokens FROM chunk GROUP BY 1, 2""")
def i12_corpus_inventory(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return O.corpus_inventory(chunks(spark, d).withColumn("tags", F.when(F.col("chunk_id") % 3 == 0, F.array(F.lit("x"))).otherwise(none)))


@query("""WITH t AS (SELECT chunk_id, unnest(dims) AS dimension FROM chunk) SELECT dimension, count(*) AS n, round(count(*) / (SELECT count(*) FROM chunk), 6) AS share FROM t GROUP BY 1""")
def i12_inventory_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    return O.inventory_by_dimension(chunks(spark, d).withColumnRenamed("dimension_tags", "tags"))


@query("""WITH w AS (SELECT user_id AS project, count(*) AS wins FROM events WHERE event_type = 'purchase' GROUP BY 1),
q AS (SELECT doc_id AS chunk_id, doc_id % 40 + 10 * coalesce(wins, 0) AS quality FROM documents LEFT JOIN w ON w.project = doc_id % 200)
SELECT chunk_id, quality, chunk_id % 3 <> 0 AND chunk_id % 2 = 0 AND quality < 50 AS deprecate FROM q""")
def j1_weekly_evolution(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    c = table(spark, d, "documents").select(k.alias("chunk_id"), (k % 200).alias("project"), (k % 40).alias("quality"), (k % 3 == 0).alias("used"), (k % 2 == 0).alias("old"))
    return O.weekly_evolution(c, table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("project")))


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type AS kind, CAST(user_id AS VARCHAR) AS reason, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def j2_mine_traps(spark: SparkSession, d: str) -> DataFrame:
    return O.mine_traps(table(spark, d, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("reason")))


@query("""SELECT CAST(ts AS DATE) AS day, round(avg((event_type = 'purchase')::INT), 6) AS win_rate, round(avg((event_type = 'purchase')::INT) FILTER (WHERE user_id % 2 = 0), 6) AS win_rate_related,
round(avg((event_type = 'purchase')::INT) FILTER (WHERE user_id % 2 <> 0), 6) AS win_rate_unrelated, count(*) AS n FROM events GROUP BY 1""")
def j3_daily_kpi(spark: SparkSession, d: str) -> DataFrame:
    return O.daily_kpi(table(spark, d, "events").select(F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("won"), (F.col("user_id") % 2 == 0).alias("related")))


@query("""WITH p AS (SELECT *, NOT deleted AND status NOT IN ('discarded', 'completed') AS live, date_diff('day', DATE '2001-01-01', CAST(bid_open_date AS DATE)) AS days FROM project)
SELECT count(*) FILTER (WHERE live) AS active, count(*) FILTER (WHERE live AND status = 'awaiting_pricing') AS awaiting_price, count(*) FILTER (WHERE live AND days BETWEEN 0 AND 7) AS due,
count(*) FILTER (WHERE live AND id % 10 < 4) AS low_probability FROM p""")
def j5_boss_kpi(spark: SparkSession, d: str) -> DataFrame:
    return O.boss_kpi(projects(spark, d).withColumn("probability", (F.col("id") % 10) / 10), F.lit("2001-01-01").cast("date"))
