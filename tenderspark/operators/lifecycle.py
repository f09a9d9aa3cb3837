"""The life of projects as table operators: listing, duplicates, clones, approvals, audit replay and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Statuses by view, and transitions by role and action: role, action, new status, audit action.
FINANCE_SEES = ("awaiting_pricing", "awaiting_review", "completed")
PENDING = ("created", "uploaded", "parsing")
IN_PROGRESS = (
    "parsed", "evaluating", "evaluation_ready", "pending_boss_approval", "approved_by_specialist",
    "generating_documents", "awaiting_pricing", "awaiting_review",
)
DISCARDED = ("discarded", "terminated_by_boss")
COMPLETED = ("completed",)
ACTIVE = (
    "uploaded", "parsing", "parsed", "evaluating", "evaluation_ready", "pending_boss_approval", "approved_by_specialist", "rejected_by_specialist",
    "generating_documents", "awaiting_pricing", "awaiting_review", "completed",
)
TRANSITIONS = (
    ("specialist", "submit_to_boss", "pending_boss_approval", "specialist_worthy"),
    ("specialist", "direct_execute", "generating_documents", "specialist_direct_execute"),
    ("specialist", "terminate", "discarded", "specialist_terminate"),
    ("specialist", "approve", "approved_by_specialist", "specialist_worthy"),
    ("specialist", "reject", "rejected_by_specialist", "specialist_unworthy"),
    ("boss", "submit_to_boss", "pending_boss_approval", "specialist_worthy"),
    ("boss", "direct_execute", "generating_documents", "specialist_direct_execute"),
    ("boss", "terminate", "discarded", "specialist_terminate"),
    ("boss", "approve", "generating_documents", "boss_confirm_specialist"),
    ("boss", "reject", "terminated_by_boss", "boss_override_terminate"),
)


def list_projects(projects: DataFrame, role: str, user: str | None = None) -> DataFrame:
    """What a role sees of the projects that are not deleted, newest first: finance three statuses, a specialist the own
    ones, all if there is no user."""
    rows = projects.where(~F.col("deleted"))
    if role == "finance":
        rows = rows.where(F.col("status").isin(*FINANCE_SEES))
    if role == "specialist" and user is not None:
        rows = rows.where(F.col("owner_unit") == user)
    return rows.orderBy(F.desc("id"))


def status_tabs(projects: DataFrame) -> DataFrame:
    """Counts of pending, running and completed projects, discarded ones left out."""
    live = projects.where(~F.col("deleted") & ~F.col("status").isin(*DISCARDED))
    return live.agg(*(F.count_if(F.col("status").isin(*s)).alias(n) for n, s in (("pending", PENDING), ("in_progress", IN_PROGRESS), ("completed", COMPLETED))))


def find_duplicates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, kind, match): each new project's first duplicate, by plan code, then agency code, then name.

    Only active rows that are not deleted count; rows with `force` are not asked for. A key's two smallest projects are
    enough: the first of them that is not the one that asks is its match, so no pair is listed."""
    live = existing.where(~F.col("deleted") & F.col("status").isin(*ACTIVE))
    asked = new.where(~F.col("force"))
    kinds = ("plan_code", "agency_code", "name")
    keys = lambda df, id_name: df.select(
        F.col("id").alias(id_name), F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.lit(k).alias("kind"), F.col(k).alias("key")) for i, k in enumerate(kinds)))).alias("a")
    ).select(id_name, "a.*").where(F.col("key").isNotNull() & (F.col("key") != ""))
    rank = F.dense_rank().over(W.partitionBy("o", "kind", "key").orderBy("match"))
    two = keys(live, "match").withColumn("rank", rank).where("rank <= 2").groupBy("o", "kind", "key").agg(F.min("match").alias("least"), F.max("match").alias("next"))
    hits = keys(asked, "id").join(two, ["o", "kind", "key"]).withColumn("match", F.when(F.col("id") != F.col("least"), F.col("least")).otherwise(F.col("next"))).where("id <> match")
    return hits.groupBy("id").agg(F.min(F.struct("o", "match", "kind")).alias("first")).select("id", "first.kind", "first.match")


def soft_delete(projects: DataFrame, ids: DataFrame, restore: bool = False) -> DataFrame:
    """Projects with the flag set, or cleared, for the given ids; rows already in that state are untouched."""
    asked = ids.select("id").distinct().withColumn("_asked", F.lit(True))
    flag = F.when(F.col("_asked").isNotNull(), F.lit(not restore)).otherwise(F.col("deleted"))
    return projects.join(asked, "id", "left").withColumn("deleted", flag).drop("_asked")


# What follows a source's name in its copy's.
CLONE_SUFFIX = {"rebid": " - 重投", "annual_renewal": " - 新一期"}


def clone_projects(sources: DataFrame, names: DataFrame, kind: str, year: int | None = None) -> DataFrame:
    """A copy of each source (id, name, ...): its columns with source_id, a new name, parent_id, status and retender flag.

    The name is the source's with the kind's suffix (the year for a renewal of a given one), then with the first unused
    ` (n)`, n from 2; `names` are those in use. Copies of sources with one name get successive numbers, by id. Only a rebid
    keeps the link to its parent. Further columns, such as owner and budget, are inherited."""
    suffix = f" - {year}" if kind == "annual_renewal" and year else CLONE_SUFFIX[kind]
    asked = sources.withColumn("base", F.concat("name", F.lit(suffix)))
    asked = asked.withColumn("k", F.row_number().over(W.partitionBy("base").orderBy("id")))
    numbered = r"^(.*) \(([1-9]\d*)\)$"
    n = F.regexp_extract("name", numbered, 2).try_cast("int")
    used = names.select(F.col("name").alias("base"), F.lit(1).alias("n")).unionByName(
        names.where(n >= 2).select(F.regexp_extract("name", numbered, 1).alias("base"), n.alias("n"))
    ).distinct().join(asked.select("base").distinct(), "base", "left_semi")
    # the n-th used number has n - (used up to it) free ones before it; a copy goes behind those with fewer than k
    gap = F.col("n") - F.row_number().over(W.partitionBy("base").orderBy("n"))
    marks = used.select("base", gap.alias("at"), F.lit(0).alias("copy"), F.lit(None).cast(sources.schema["id"].dataType).alias("id"))
    marks = marks.unionByName(asked.select("base", (F.col("k") - 1).alias("at"), F.lit(1).alias("copy"), "id"))
    before = F.sum(1 - F.col("copy")).over(W.partitionBy("base").orderBy("at", "copy").rowsBetween(W.unboundedPreceding, 0))
    number = marks.withColumn("n", F.col("at") + 1 + before).where("copy = 1").select("id", "n")
    name = F.when(F.col("n") == 1, F.col("base")).otherwise(F.format_string("%s (%d)", "base", "n"))
    parent = F.col("id") if kind == "rebid" else F.lit(None).cast(sources.schema["id"].dataType)
    return asked.drop("k").join(number, "id").withColumns(
        {"name": name, "parent_id": parent, "status": F.lit("uploaded"), "is_retender": F.lit(kind == "rebid")}
    ).withColumnRenamed("id", "source_id").drop("base", "n")


def cloned_sections(clones: DataFrame, sections: DataFrame) -> DataFrame:
    """(source_id, clone, name, content): the sections (project, name, content) of each source for its copy."""
    rows = clones.select("source_id", F.col("name").alias("clone"))
    return rows.join(sections.select(F.col("project").alias("source_id"), "name", "content"), "source_id")


def _mode(asked: Column) -> Column:
    """What is not AUTO is guided."""
    return F.when(asked == "AUTO", "auto").otherwise("guided")


def apply_approvals(projects: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, rejected) of actions (project, role, action, reason, mode) on projects (id, status, level, fatal).

    After the deadline only terminate is allowed; approving against fatal risks needs a reason of ten characters;
    role and action must have a transition. Applied rows hold the new status, the audit action and the generation mode,
    null where that stays as it is. `approval_log` and `discards` make the side tables' rows."""
    spark = projects.sparkSession
    moves = spark.createDataFrame(list(TRANSITIONS), "role string, action string, new_status string, audit string")
    rows = actions.join(projects.select(F.col("id").alias("project"), "status", "level", "fatal"), "project", "left")
    rows = rows.join(F.broadcast(moves), ["role", "action"], "left")
    why = (
        F.when(F.col("status").isNull(), "no_project")
        .when(F.col("new_status").isNull(), "no_transition")
        .when((F.col("level") == "expired") & (F.col("action") != "terminate"), "expired")
        .when((F.col("action") == "approve") & (F.col("fatal") > 0) & (F.length(F.coalesce("reason", F.lit(""))) < 10), "reason_needed")
    )
    mode = F.when(F.col("action").isin("approve", "direct_execute"), _mode(F.col("mode")))
    rows = rows.withColumns({"why": why, "generation_mode": mode})
    applied = rows.where("why is null").select("project", "role", "action", F.col("status").alias("original_status"), "new_status", "audit", "reason", "generation_mode")
    return applied, rows.where("why is not null").select("project", "role", "action", "why")


def approval_log(applied: DataFrame) -> DataFrame:
    """Audit rows of applied approvals, in the name of the role that acted."""
    return applied.select(
        "project", F.col("audit").alias("action_type"), F.col("role").alias("actor_role"), F.col("reason").alias("reason_text"), "original_status", "new_status"
    )


def discards(applied: DataFrame) -> DataFrame:
    """(project, discarded_by, discard_reason, discard_stage, can_be_revived) of terminated and of the boss's rejected projects."""
    gone = applied.where("action = 'terminate' or (role = 'boss' and action = 'reject')")
    boss = F.col("action") == "reject"
    return gone.select(
        "project", F.when(boss, "boss").otherwise("specialist").alias("discarded_by"),
        F.coalesce(F.nullif("reason", F.lit("")), F.when(boss, "老板否决").otherwise("专员直接终止")).alias("discard_reason"),
        F.when(boss, "boss_rejected").otherwise("specialist_terminated").alias("discard_stage"), boss.alias("can_be_revived"),
    )


def apply_overrides(projects: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides (id, action, mode, reason) on projects (id, status): terminate only what is approved, revive only what
    was rejected. Gives (id, action, original_status, new_status, generation_mode, audit, reason, ok); the mode is null
    where it stays, the audit action where nothing happened."""
    rows = projects.select("id", F.col("status").alias("original_status")).join(overrides, "id")
    kill = (F.col("action") == "terminate") & (F.col("original_status") == "approved_by_specialist")
    revive = (F.col("action") == "revive") & (F.col("original_status") == "rejected_by_specialist")
    to = F.when(kill, "terminated_by_boss").when(revive, "approved_by_specialist").otherwise(F.col("original_status"))
    audit = F.when(kill, "boss_override_terminate").when(revive, "boss_override_revive")
    return rows.select(
        "id", "action", "original_status", to.alias("new_status"), F.when(revive, _mode(F.col("mode"))).alias("generation_mode"), audit.alias("audit"), "reason", (kill | revive).alias("ok")
    )


def overridden_discards(discarded: DataFrame, applied: DataFrame, by: str, now: Column) -> DataFrame:
    """The discard table (project, discarded_by, discard_reason, discard_stage, can_be_revived, revived_at, revived_by)
    after applied overrides: terminated projects are added, revived ones marked, or added as marked if they had no row."""
    ok = applied.where("ok")
    revived = ok.where("action = 'revive'").select(F.col("id").alias("project")).distinct().withColumn("_revived", F.lit(True))
    hit = F.col("_revived").isNotNull()
    old = discarded.join(revived, "project", "left").withColumns(
        {"revived_at": F.when(hit, now).otherwise(F.col("revived_at")), "revived_by": F.when(hit, F.lit(by)).otherwise(F.col("revived_by"))}
    ).drop("_revived")

    def row(df: DataFrame, who: str, reason: Column, stage: str, at: Column, by_whom: Column) -> DataFrame:
        return df.select(
            "project", F.lit(who).alias("discarded_by"), reason.alias("discard_reason"), F.lit(stage).alias("discard_stage"),
            F.lit(True).alias("can_be_revived"), at.cast(discarded.schema["revived_at"].dataType).alias("revived_at"), by_whom.cast("string").alias("revived_by"),
        )

    none = F.lit(None)
    killed = ok.where("action = 'terminate'").withColumnRenamed("id", "project")
    lost = revived.join(discarded, "project", "left_anti")
    return old.unionByName(row(killed, "boss", F.col("reason"), "specialist_approved", none, none)).unionByName(
        row(lost, "specialist", F.lit("Initial rejection"), "specialist_rejected", now, F.lit(by))
    )


# Statuses in which a changed relationship takes a project back.
LATE = ("generating_documents", "awaiting_pricing", "awaiting_review", "completed")


def apply_relationship_changes(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (id, related, guidance) on projects (id, status, related, generation_mode): setting the flag needs guidance;
    a flip in a late status takes the project back to evaluation_ready and clears its mode.

    Gives (id, was_related, related, original_status, new_status, generation_mode, rolled_back, ok)."""
    rows = projects.join(changes.select("id", F.col("related").alias("to"), "guidance"), "id")
    ok = ~F.col("to") | (F.length(F.coalesce("guidance", F.lit(""))) > 0)
    back = ok & (F.col("to") != F.col("related")) & F.col("status").isin(*LATE)
    return rows.select(
        "id", F.col("related").alias("was_related"), F.when(ok, F.col("to")).otherwise(F.col("related")).alias("related"),
        F.col("status").alias("original_status"), F.when(back, "evaluation_ready").otherwise(F.col("status")).alias("new_status"),
        F.when(~back, F.col("generation_mode")).alias("generation_mode"), back.alias("rolled_back"), ok.alias("ok"),
    )


def relationship_log(changed: DataFrame) -> DataFrame:
    """Audit rows of the projects that a changed relationship took back."""
    said = lambda c: F.initcap(F.col(c).cast("string"))
    text = F.concat(F.lit("关系标识变更触发强制回滚: "), said("was_related"), F.lit("→"), said("related"), F.lit("，技术标/定价数据已清空"))
    return changed.where("rolled_back").select(
        F.col("id").alias("project"), F.lit("specialist_terminate").alias("action_type"), F.lit("specialist").alias("actor_role"),
        text.alias("reason_text"), "original_status", "new_status",
    )


def current_status(log: DataFrame) -> DataFrame:
    """(project, status, n): the last new status of each project in the audit log (project, new_status, at, event_id)."""
    order = F.struct("at", "event_id")
    return log.groupBy("project").agg(F.max_by("new_status", order).alias("status"), F.count("*").alias("n"))


def audit_gaps(log: DataFrame) -> DataFrame:
    """Log rows whose original status is not the new status of the row before."""
    before = F.lag("new_status").over(W.partitionBy("project").orderBy("at", "event_id"))
    return log.withColumn("before", before).where("before is not null and before <> original_status").select("project", "event_id", "before", "original_status")


def switch_mode(tasks: DataFrame, switches: DataFrame) -> DataFrame:
    """(project, task_id, task_status): the latest task of a project is archived or discarded when the mode changes."""
    newest = F.row_number().over(W.partitionBy("project").orderBy(F.desc("task_id")))
    rows = tasks.withColumn("n", newest).where("n = 1").join(switches, "project")
    to = F.when(F.col("mode") == F.col("new_mode"), F.col("task_status")).when(
        (F.col("mode") == "auto") & (F.col("new_mode") == "guided"), "archived_due_to_mode_switch"
    ).when((F.col("mode") == "guided") & (F.col("new_mode") == "auto"), "discarded_due_to_mode_switch").otherwise(F.col("task_status"))
    return rows.select("project", "task_id", to.alias("task_status"))


def advance(projects: DataFrame, pending_fatal: DataFrame) -> DataFrame:
    """(id, new_status): documents done go to pricing; reviewed ones are complete unless a fatal item is pending."""
    bad = pending_fatal.select(F.col("project").alias("id")).distinct().withColumn("bad", F.lit(True))
    rows = projects.join(bad, "id", "left")
    to = F.when(F.col("status") == "generating_documents", "awaiting_pricing").when(
        (F.col("status") == "awaiting_review") & F.col("bad").isNull(), "completed"
    )
    return rows.withColumn("new_status", to).where("new_status is not null").select("id", "new_status")


def resolve_sections(sections: DataFrame, tasks: DataFrame) -> DataFrame:
    """(project, name, content): the section table's rows; for projects without any, those of the newest task's JSON,
    {"sections": [{section_name or title, content}]} or {name: {content}}."""
    have = sections.select("project").distinct()
    newest = F.row_number().over(W.partitionBy("project").orderBy(F.desc("task_id")))
    last = tasks.withColumn("n", newest).where("n = 1").join(have, "project", "left_anti")
    last = last.select("project", "json", F.from_json("json", "sections array<struct<section_name:string,title:string,content:string>>")["sections"].alias("items"))
    listed = last.where("items is not null").select("project", F.inline("items")).select(
        "project", F.coalesce("section_name", "title", F.lit("")).alias("name"), F.coalesce("content", F.lit("")).alias("content")
    )
    mapped = last.where("items is null").select("project", F.explode(F.from_json("json", "map<string,struct<content:string>>")).alias("name", "x"))
    mapped = mapped.select("project", "name", F.coalesce("x.content", F.lit("")).alias("content"))
    return sections.select("project", "name", "content").unionByName(listed).unionByName(mapped)


def workload_conflicts(reviews: DataFrame) -> DataFrame:
    """Pairs of reviews (person, id, at) of one person less than a day apart.

    Range join on days: each review meets those of its own and of the next day only."""
    left = reviews.select("person", F.col("id").alias("a"), F.col("at").alias("at_a"), F.explode(F.array(F.to_date("at"), F.date_add(F.to_date("at"), 1))).alias("day"))
    right = reviews.select("person", F.col("id").alias("b"), F.col("at").alias("at_b"), F.to_date("at").alias("day"))
    close = (F.unix_micros(F.col("at_b").cast("timestamp")) - F.unix_micros(F.col("at_a").cast("timestamp"))).between(0, 86_399_999_999)
    after = (F.col("at_b") > F.col("at_a")) | (F.col("b") > F.col("a"))
    return left.join(right, ["person", "day"]).where(close & after).select("person", "a", "b")


def workload_overload(projects: DataFrame, most: int = 3) -> DataFrame:
    """(person, active) of those with more than `most` projects (person, status) that are neither abandoned nor completed."""
    live = projects.where(~F.col("status").isin("abandoned", "completed"))
    return live.groupBy("person").agg(F.count("*").alias("active")).where(F.col("active") > most)
