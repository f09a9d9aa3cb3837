"""Registered queries of the project lifecycle operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.operators import lifecycle as L
from tenderspark.operators import merge as M
from tenderspark.plans.base import bids, projects, query, table

STATUSES = ("evaluation_ready", "generating_documents", "awaiting_pricing", "awaiting_review", "approved_by_specialist", "rejected_by_specialist", "completed", "uploaded", "terminated_by_boss", "discarded", "parsed")
STATE = "state AS (SELECT id, (['" + "','".join(STATUSES) + "'])[CAST(id % 11 + 1 AS INTEGER)] AS status, id % 5 = 0 AS related, region, owner_unit, deleted FROM project)"


def _state(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("id") % 11 + 1).cast("int"))
    return projects(spark, d).select("id", status.alias("status"), (F.col("id") % 5 == 0).alias("related"), "region", "owner_unit", "deleted")


@query("SELECT id, status FROM project WHERE NOT deleted AND status IN ('awaiting_pricing', 'awaiting_review', 'completed')")
def g1_list_projects(spark: SparkSession, d: str) -> DataFrame:
    return L.list_projects(projects(spark, d), "finance").select("id", "status")


@query(f"""WITH {STATE} SELECT count(*) FILTER (WHERE status = 'uploaded') AS pending,
count(*) FILTER (WHERE status IN ('evaluation_ready', 'generating_documents', 'awaiting_pricing', 'awaiting_review', 'approved_by_specialist', 'parsed')) AS in_progress, count(*) FILTER (WHERE status = 'completed') AS completed FROM state WHERE NOT deleted""")
def g2_status_tabs(spark: SparkSession, d: str) -> DataFrame:
    return L.status_tabs(_state(spark, d))


@query("""WITH new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand || p_size END AS plan_code, CASE WHEN p_partkey % 2 = 0 THEN p_type || p_brand END AS agency_code, p_name AS name FROM part),
k AS (SELECT id, 0 AS o, 'plan_code' AS kind, plan_code AS key FROM new UNION ALL SELECT id, 1, 'agency_code', agency_code FROM new UNION ALL SELECT id, 2, 'name', name FROM new),
h AS (SELECT a.id, a.kind, b.id AS match, row_number() OVER (PARTITION BY a.id ORDER BY a.o, b.id) AS n FROM k a JOIN k b ON a.o = b.o AND a.key = b.key AND a.id <> b.id
WHERE a.key <> '' AND a.id % 5 <> 0 AND b.id % 10 <> 0 AND b.id % 7 > 1) SELECT id, kind, match FROM h WHERE n = 1""")
def g3_find_duplicates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k.alias("id"), F.when(k % 3 == 0, F.concat("p_brand", "p_size")).alias("plan_code"), F.when(k % 2 == 0, F.concat("p_type", "p_brand")).alias("agency_code"),
        F.col("p_name").alias("name"), (k % 10 == 0).alias("deleted"), F.when(k % 7 == 0, "terminated_by_boss").when(k % 7 == 1, "discarded").otherwise("evaluating").alias("status"), (k % 5 == 0).alias("force"),
    )
    return L.find_duplicates(rows, rows)


@query("SELECT id, deleted OR id IN (SELECT user_id FROM events) AS deleted FROM project")
def g4_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select(F.col("user_id").alias("id"))
    return L.soft_delete(projects(spark, d), ids).select("id", "deleted")


@query("""SELECT 'bids' AS "table", count(*) AS removed FROM bid JOIN project ON id = project WHERE deleted
UNION ALL SELECT 'actions', count(*) FROM events JOIN project ON id = user_id WHERE deleted""")
def g5_purge(spark: SparkSession, d: str) -> DataFrame:
    children = {"bids": bids(spark, d), "actions": table(spark, d, "events").select(F.col("user_id").alias("project"), "event_id")}
    return M.purge(projects(spark, d), children)[2]


CLONES = """named AS (SELECT *, CASE id % 3 WHEN 0 THEN owner_unit WHEN 1 THEN owner_unit || ' - 重投' ELSE owner_unit || ' - 重投 (' || (2 + id % 5) || ')' END AS name FROM project),
asked AS (SELECT id, name || ' - 重投' AS base, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM named WHERE status = 'completed'),
tries AS (SELECT base, i, CASE WHEN i = 1 THEN base ELSE base || ' (' || i || ')' END AS name FROM (SELECT base, unnest(generate_series(1, max(k) + 8)) AS i FROM asked GROUP BY 1)),
free AS (SELECT base, name, row_number() OVER (PARTITION BY base ORDER BY i) AS k FROM tries t WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.name = t.name AND NOT deleted)),
clone AS (SELECT id AS source_id, free.name, id AS parent_id FROM asked JOIN free ON free.base = asked.base AND free.k = asked.k)"""


def _clones(spark: SparkSession, d: str) -> DataFrame:
    k, owner = F.col("id"), F.col("owner_unit")
    again = F.concat(owner, F.lit(" - 重投"))
    name = F.when(k % 3 == 0, owner).when(k % 3 == 1, again).otherwise(F.concat(again, F.lit(" ("), 2 + k % 5, F.lit(")")))
    named = projects(spark, d).withColumn("name", name)
    return L.clone_projects(named.where("status = 'completed'"), named.where("not deleted"), "rebid")


@query(f"WITH {CLONES} SELECT *, 'uploaded' AS status, true AS is_retender FROM clone")
def g6_clone_projects(spark: SparkSession, d: str) -> DataFrame:
    return _clones(spark, d).select("source_id", "name", "parent_id", "status", "is_retender")


@query(f"WITH {CLONES} SELECT source_id, clone.name AS clone, role AS name, md5(text) AS content FROM clone JOIN conversations ON conv_id = source_id")
def g6_cloned_sections(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "conversations").select(F.col("conv_id").alias("project"), F.col("role").alias("name"), F.md5("text").alias("content"))
    return L.cloned_sections(_clones(spark, d), sections)


_ACTIONS = "act AS (SELECT user_id AS project, event_id, CASE WHEN event_id % 2 = 0 THEN 'boss' ELSE 'specialist' END AS role, CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' WHEN 'error' THEN 'terminate' WHEN 'signup' THEN 'submit_to_boss' ELSE 'archive' END AS action, repeat('x', event_id % 20) AS reason, CASE WHEN event_id % 3 = 0 THEN 'AUTO' ELSE 'GUIDED' END AS mode, ts FROM events)"
_MOVES = """moves AS (SELECT role, action, CASE action WHEN 'submit_to_boss' THEN 'pending_boss_approval' WHEN 'terminate' THEN 'discarded'
WHEN 'approve' THEN CASE role WHEN 'boss' THEN 'generating_documents' ELSE 'approved_by_specialist' END
WHEN 'reject' THEN CASE role WHEN 'boss' THEN 'terminated_by_boss' ELSE 'rejected_by_specialist' END END AS new_status,
CASE action WHEN 'submit_to_boss' THEN 'specialist_worthy' WHEN 'terminate' THEN 'specialist_terminate'
WHEN 'approve' THEN CASE role WHEN 'boss' THEN 'boss_confirm_specialist' ELSE 'specialist_worthy' END
WHEN 'reject' THEN CASE role WHEN 'boss' THEN 'boss_override_terminate' ELSE 'specialist_unworthy' END END AS audit
FROM (VALUES ('boss'), ('specialist')) r(role), (VALUES ('approve'), ('reject'), ('terminate'), ('submit_to_boss')) a(action))"""


def _actions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    action = F.when(t == "click", "approve").when(t == "view", "reject").when(t == "error", "terminate").when(t == "signup", "submit_to_boss").otherwise("archive")
    return table(spark, d, "events").select(
        F.col("user_id").alias("project"), "event_id", F.when(F.col("event_id") % 2 == 0, "boss").otherwise("specialist").alias("role"),
        action.alias("action"), F.repeat(F.lit("x"), (F.col("event_id") % 20).cast("int")).alias("reason"), F.when(F.col("event_id") % 3 == 0, "AUTO").otherwise("GUIDED").alias("mode"), F.col("ts").alias("at"),
    )


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).select("id", "status", F.when(F.col("id") % 6 == 0, "expired").otherwise("normal").alias("level"), (F.col("id") % 4).alias("fatal"))


_JUDGED = f"""{STATE}, {_ACTIONS}, {_MOVES}, j AS (SELECT a.project, a.role, a.action, s.status AS original_status, m.new_status, m.audit, reason, CASE WHEN a.action = 'approve' THEN lower(mode) END AS generation_mode,
CASE WHEN s.status IS NULL THEN 'no_project' WHEN m.new_status IS NULL THEN 'no_transition' WHEN a.project % 6 = 0 AND a.action <> 'terminate' THEN 'expired'
WHEN a.action = 'approve' AND a.project % 4 > 0 AND length(reason) < 10 THEN 'reason_needed' END AS why
FROM act a LEFT JOIN state s ON s.id = a.project LEFT JOIN moves m ON m.role = a.role AND m.action = a.action)"""


@query(f"WITH {_JUDGED} SELECT * EXCLUDE (why) FROM j WHERE why IS NULL")
def g7_apply_approvals(spark: SparkSession, d: str) -> DataFrame:
    return L.apply_approvals(_judged(spark, d), _actions(spark, d))[0]


@query(f"WITH {_JUDGED} SELECT project, role, action, why FROM j WHERE why IS NOT NULL")
def g7_rejected_approvals(spark: SparkSession, d: str) -> DataFrame:
    return L.apply_approvals(_judged(spark, d), _actions(spark, d))[1]


@query(f"""WITH {_JUDGED} SELECT project, audit AS action_type, role AS actor_role, reason AS reason_text, original_status, new_status FROM j WHERE why IS NULL""")
def g7_approval_log(spark: SparkSession, d: str) -> DataFrame:
    return L.approval_log(L.apply_approvals(_judged(spark, d), _actions(spark, d))[0])


@query(f"""WITH {_JUDGED} SELECT project, 'specialist' AS discarded_by, CASE WHEN reason = '' THEN '专员直接终止' ELSE reason END AS discard_reason, 'specialist_terminated' AS discard_stage, false AS can_be_revived
FROM j WHERE why IS NULL AND action = 'terminate'
UNION ALL SELECT project, 'boss', CASE WHEN reason = '' THEN '老板否决' ELSE reason END, 'boss_rejected', true FROM j WHERE why IS NULL AND action = 'reject' AND role = 'boss'""")
def g7_discards(spark: SparkSession, d: str) -> DataFrame:
    return L.discards(L.apply_approvals(_judged(spark, d), _actions(spark, d))[0])


_OVERRIDES = f"""{STATE}, o AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'terminate' ELSE 'revive' END AS action, CASE WHEN id % 3 = 0 THEN 'AUTO' END AS mode, 'because ' || id AS reason FROM state),
k AS (SELECT *, (action = 'terminate' AND status = 'approved_by_specialist') OR (action = 'revive' AND status = 'rejected_by_specialist') AS ok FROM o)"""


def _overridden(spark: SparkSession, d: str) -> DataFrame:
    rows = _state(spark, d)
    k = F.col("id")
    asked = rows.select(
        "id", F.when(k % 2 == 0, "terminate").otherwise("revive").alias("action"), F.when(k % 3 == 0, "AUTO").alias("mode"), F.concat(F.lit("because "), k).alias("reason")
    )
    return L.apply_overrides(rows, asked)


@query(f"""WITH {_OVERRIDES} SELECT id, action, status AS original_status, CASE WHEN NOT ok THEN status WHEN action = 'terminate' THEN 'terminated_by_boss' ELSE 'approved_by_specialist' END AS new_status,
CASE WHEN ok AND action = 'revive' THEN CASE WHEN id % 3 = 0 THEN 'auto' ELSE 'guided' END END AS generation_mode, CASE WHEN ok THEN 'boss_override_' || action END AS audit, reason, ok FROM k""")
def g8_apply_overrides(spark: SparkSession, d: str) -> DataFrame:
    return _overridden(spark, d)


@query(f"""WITH {_OVERRIDES}, r AS (SELECT id FROM k WHERE ok AND action = 'revive')
SELECT id AS project, 'specialist' AS discarded_by, 'old' AS discard_reason, 'specialist_rejected' AS discard_stage, true AS can_be_revived,
CASE WHEN id IN (SELECT id FROM r) THEN DATE '2001-01-01' END AS revived_at, CASE WHEN id IN (SELECT id FROM r) THEN 'boss' END AS revived_by FROM project WHERE id % 5 = 0
UNION ALL SELECT id, 'boss', reason, 'specialist_approved', true, NULL, NULL FROM k WHERE ok AND action = 'terminate'
UNION ALL SELECT id, 'specialist', 'Initial rejection', 'specialist_rejected', true, DATE '2001-01-01', 'boss' FROM r WHERE id % 5 <> 0""")
def g8_overridden_discards(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    old = projects(spark, d).where("id % 5 = 0").select(
        F.col("id").alias("project"), F.lit("specialist").alias("discarded_by"), F.lit("old").alias("discard_reason"), F.lit("specialist_rejected").alias("discard_stage"),
        F.lit(True).alias("can_be_revived"), none.cast("date").alias("revived_at"), none.cast("string").alias("revived_by"),
    )
    return L.overridden_discards(old, _overridden(spark, d), "boss", F.lit("2001-01-01").cast("date"))


_RELATED = f"""{STATE}, c AS (SELECT *, id % 3 = 0 AS "to", CASE WHEN id % 4 = 0 THEN 'call' END AS guidance, CASE WHEN id % 2 = 0 THEN 'auto' ELSE 'guided' END AS mode FROM state), k AS (SELECT *, NOT "to" OR guidance IS NOT NULL AS ok FROM c),
b AS (SELECT *, ok AND "to" <> related AND status IN ('generating_documents', 'awaiting_pricing', 'awaiting_review', 'completed') AS back FROM k)"""


def _related(spark: SparkSession, d: str) -> DataFrame:
    rows = _state(spark, d).withColumn("generation_mode", F.when(F.col("id") % 2 == 0, "auto").otherwise("guided"))
    return L.apply_relationship_changes(rows, rows.select("id", (F.col("id") % 3 == 0).alias("related"), F.when(F.col("id") % 4 == 0, "call").alias("guidance")))


@query(f"""WITH {_RELATED} SELECT id, related AS was_related, CASE WHEN ok THEN "to" ELSE related END AS related, status AS original_status,
CASE WHEN back THEN 'evaluation_ready' ELSE status END AS new_status, CASE WHEN NOT back THEN mode END AS generation_mode, back AS rolled_back, ok FROM b""")
def g9_apply_relationship_changes(spark: SparkSession, d: str) -> DataFrame:
    return _related(spark, d)


@query(f"""WITH {_RELATED} SELECT id AS project, 'specialist_terminate' AS action_type, 'specialist' AS actor_role,
'关系标识变更触发强制回滚: ' || CASE WHEN related THEN 'True→False' ELSE 'False→True' END || '，技术标/定价数据已清空' AS reason_text, status AS original_status, 'evaluation_ready' AS new_status FROM b WHERE back""")
def g9_relationship_log(spark: SparkSession, d: str) -> DataFrame:
    return L.relationship_log(_related(spark, d))


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("user_id").alias("project"), "event_id", F.col("ts").alias("at"), F.col("event_type").alias("new_status"),
        F.when(k % 2 == 0, "view").otherwise("click").alias("original_status"),
    )


@query("SELECT user_id AS project, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY 1")
def g10_replay_audit(spark: SparkSession, d: str) -> DataFrame:
    return L.current_status(audit_log(spark, d))


@query("""WITH l AS (SELECT user_id AS project, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN 'view' ELSE 'click' END AS original_status FROM events) SELECT * FROM l WHERE before <> original_status""")
def g10_audit_gaps(spark: SparkSession, d: str) -> DataFrame:
    return L.audit_gaps(audit_log(spark, d))


@query("""WITH t AS (SELECT conv_id AS project, max(turn) AS task_id FROM conversations GROUP BY 1)
SELECT project, task_id, CASE WHEN project % 3 = 0 THEN 'open' WHEN project % 2 = 0 THEN 'archived_due_to_mode_switch' ELSE 'discarded_due_to_mode_switch' END AS task_status FROM t""")
def g11_switch_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("project"), F.col("turn").alias("task_id"), F.lit("open").alias("task_status"))
    auto = F.col("project") % 2 == 0
    mode = F.when(auto, "auto").otherwise("guided")
    other = F.when(auto, "guided").otherwise("auto")
    switches = rows.select("project").distinct().select("project", mode.alias("mode"), F.when(F.col("project") % 3 == 0, mode).otherwise(other).alias("new_mode"))
    return L.switch_mode(rows, switches)


@query(f"""WITH {STATE} SELECT id, CASE status WHEN 'generating_documents' THEN 'awaiting_pricing' ELSE 'completed' END AS new_status FROM state
WHERE status = 'generating_documents' OR (status = 'awaiting_review' AND id NOT IN (SELECT user_id FROM events WHERE event_type = 'error'))""")
def g12_advance(spark: SparkSession, d: str) -> DataFrame:
    fatal = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("project"))
    return L.advance(_state(spark, d), fatal)


@query("""WITH t AS (SELECT conv_id, turn, role, text FROM conversations), have AS (SELECT DISTINCT conv_id FROM t WHERE conv_id % 2 = 0),
last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t WHERE conv_id % 2 <> 0)
SELECT conv_id AS project, role AS name, md5(text) AS content FROM t WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, role, md5(text) FROM last WHERE n = 1""")
def g13_resolve_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    sections = rows.where("conv_id % 2 = 0").select(F.col("conv_id").alias("project"), F.col("role").alias("name"), F.md5("text").alias("content"))
    name = F.when(F.col("conv_id") % 8 == 1, F.struct(F.col("role").alias("section_name"), F.lit(None).cast("string").alias("title"), F.md5("text").alias("content"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("section_name"), F.col("role").alias("title"), F.md5("text").alias("content"))
    )
    listed = F.to_json(F.struct(F.array(name).alias("sections")))
    mapped = F.to_json(F.create_map("role", F.struct(F.md5("text").alias("content"))))
    tasks = rows.select(F.col("conv_id").alias("project"), F.col("turn").alias("task_id"), F.when(F.col("conv_id") % 4 == 1, listed).otherwise(mapped).alias("json"))
    return L.resolve_sections(sections, tasks)


@query("""SELECT a.user_id AS person, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id
AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 86399999999 AND (b.ts > a.ts OR b.event_id > a.event_id)
WHERE a.event_type = 'signup' AND b.event_type = 'signup'""")
def j4_workload_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("person"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return L.workload_conflicts(rows)


@query("""SELECT owner_unit AS person, count(*) AS active FROM project WHERE status <> 'completed' AND bid_open_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1 HAVING count(*) > 3""")
def j4_workload_overload(spark: SparkSession, d: str) -> DataFrame:
    rows = projects(spark, d).where("bid_open_date between date '1995-01-01' and date '1996-12-31'").withColumnRenamed("owner_unit", "person")
    return L.workload_overload(rows)
