"""Registered queries that write a table to the shared folder and read it again: books, chunk tables, streaming jobs."""

from __future__ import annotations

import io
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.operators import snapshots
from tenderspark.plans.base import bids, chunks, projects, query, table
from tenderspark.plans.lifecycle import audit_log
from tenderspark.sources import outcome_book as B
from tenderspark.sources.files import spread, write_files
from tenderspark.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names for checkpoints, on one machine below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("""SELECT CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey END AS historical_tender_id, 'h' || o_orderkey AS tender_file_hash, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus || ', "' || o_orderkey || '"' END AS tender_file_name,
CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_totalprice AS DECIMAL(15,2)) END AS our_bid_price, CASE WHEN o_orderkey % 7 <> 3 THEN CAST(o_orderdate AS DATE) END AS submission_date,
CASE WHEN o_orderkey % 3 = 0 THEN 'a,b' ELSE '' END AS tags, CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' ELSE 'neutral' END AS win_signal,
CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'lost' ELSE '?' END AS our_bid_status, CASE WHEN o_orderkey % 2 = 0 THEN 'price,2' ELSE '' END AS factors, CASE WHEN o_orderkey % 9 < 8 THEN (o_orderkey % 9) / 2.0::DOUBLE END AS score,
CASE WHEN o_orderkey % 5 = 1 THEN 'secret' ELSE 'internal' END AS confidential_level, CASE WHEN o_orderkey % 4 = 2 THEN 'said ' || o_orderkey END AS expert_feedback_text FROM orders WHERE o_orderkey % 11 <> 0""")
def a1_read_outcome_book(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a CSV ledger: quoted names, three forms of dates, numbers and lists that cannot be read, an id that is none."""
    k, day = F.col("o_orderkey"), lambda p: F.date_format("o_orderdate", p)
    date = F.when(k % 7 == 0, day("yyyy/M/d")).when(k % 7 == 1, day("yyyyMMdd")).when(k % 7 == 3, "soon").otherwise(day("yyyy-MM-dd"))
    book = table(spark, d, "orders").select(
        F.when(k % 11 == 0, "x1").when(k % 4 != 1, k.cast("string")).alias("historical_tender_id"),
        F.concat(F.lit(" h"), k, F.lit(" ")).alias("tender_file_hash"),
        F.when(k % 5 != 0, F.concat("o_orderstatus", F.lit(', "'), k, F.lit('"'))).alias("tender_file_name "),
        F.when(F.col("o_orderstatus") == "F", " Won ").when(F.col("o_orderstatus") == "O", "lost").otherwise("?").alias("our_bid_status"),
        F.when(k % 6 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(15,2)").cast("string")).alias("our_bid_price"),
        date.alias("submission_date"), F.when(k % 3 == 0, '["a","b"]').when(k % 3 == 1, "oops").alias("loss_root_cause_tags"),
        F.when(k % 2 == 0, '["price", 2]').alias("key_win_factors"), F.when(k % 9 == 8, "-").otherwise((k % 9 / 2).cast("string")).alias("technical_score"),
        F.when(k % 5 == 1, "\u3000secret ").when(k % 5 == 2, " ").alias("confidential_level"), F.when(k % 4 == 2, F.concat(F.lit("said "), k)).alias("expert_feedback_text"),
    )
    path = _folder(spark, "book")
    book.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = B.read_outcome_book(spark, path)
    return rows.select("historical_tender_id", "tender_file_hash", "tender_file_name", "our_bid_price", "submission_date", F.array_join("loss_root_cause_tags", ",").alias("tags"), "win_signal",
        "our_bid_status", F.array_join("key_win_factors", ",").alias("factors"), F.col("technical_score").cast("double").alias("score"), "confidential_level", "expert_feedback_text")


@query("SELECT page_id, sha256(html || chr(10)) AS hash, octet_length(encode(html)) + 1 AS length FROM pages")
def a5_scan_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a text file of its own in one of many folders, found again with its hash."""
    path = _folder(spark, "files")
    # an id that repeats has as many files
    copy = F.row_number().over(W.partitionBy("page_id").orderBy("html"))
    name = F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), copy)
    pages = table(spark, d, "pages").select(F.concat(name, F.lit(".txt")).alias("name"), F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).cast("binary").alias("content"))
    write_files(pages.withColumn("name", spread(F.col("name"))), path)
    page = F.regexp_extract("path", r"/(-?[0-9]+)-[0-9]+\.txt$", 1).try_cast("long")
    # small rows of many small tasks, together again
    return B.scan_documents(spark, path, ("txt",)).select(page.alias("page_id"), "hash", "length").repartition("page_id")


@query("SELECT chunk_id, md5(content) AS content, win_signal FROM chunk")
def a14_write_chunks(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "chunks")
    B.write_chunks(chunks(spark, d).select("chunk_id", "content", "vector", "region_tags", "win_signal"), path)
    return spark.read.parquet(path).select("chunk_id", F.md5("content").alias("content"), "win_signal")


@query("""WITH u AS (SELECT user_id AS id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS n FROM events)
SELECT coalesce(p.id, u.id) AS id, coalesce(u.status, p.status) AS status, p.region FROM project p FULL JOIN (SELECT * FROM u WHERE n = 1) u ON u.id = p.id""")
def a6_merge_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The upsert as two versions of a stored table."""
    root = _folder(spark, "snapshot")
    snapshots.commit(spark, root, {"project": (projects(spark, d).select("id", "status", "region"), ["id"])})
    updates = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), "ts")
    snapshots.commit(spark, root, {"project": (updates, ["id"])}, {"project": "ts"})
    return snapshots.read_table(spark, root, "project")


@query("""SELECT b.project AS id, p.region, count(*) AS bids, CAST(min(b.price) AS DOUBLE) AS price, (SELECT count(*) FROM chunk) AS chunks FROM bid b JOIN project p ON p.id = b.project GROUP BY 1, 2""")
def a14_atomic_import(spark: SparkSession, d: str) -> DataFrame:
    """Tenders, bids and chunks, published as one version."""
    root = _folder(spark, "import")
    b = bids(spark, d).select("project", "place", "price")
    snapshots.commit(spark, root, {"tenders": (projects(spark, d).select("id", "region"), ["id"]), "bids": (b, ["project", "place"]), "chunks": (chunks(spark, d).select("chunk_id", "content"), ["chunk_id"])})
    read = lambda name: snapshots.read_table(spark, root, name)
    n = read("chunks").agg(F.count("*").alias("chunks"))
    rows = read("bids").join(read("tenders"), F.col("project") == F.col("id")).groupBy("id", "region").agg(F.count("*").alias("bids"), F.min("price").cast("double").alias("price"))
    return rows.crossJoin(n)  # a single row


def _parquet(rows: pa.Table) -> pa.Table:
    """(name, content) of the file that holds a conversation."""
    out = io.BytesIO()
    pq.write_table(rows.select(["content"]), out)
    return pa.table({"name": rows["name"].slice(0, 1), "content": pa.array([out.getvalue()], pa.binary())})


def _ingested(spark: SparkSession, d: str) -> str:
    """The conversations as files of contents, one file for each, every seventh turn without content, and a broken file;
    taken in twice, the second time with a copy of each file."""
    base = _folder(spark, "ingest")
    rows = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 7 != 6, F.col("text")).alias("content"))
    rows.limit(1).select(F.lit("no such format")).write.text(f"{base}/source/conv_id=broken")
    # paths have the order of the ids as text; those of no id come last
    name = spread(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    files = rows.select(F.concat(name, F.lit(".parquet")).alias("name"), "content").groupBy("name").applyInArrow(_parquet, "name string, content binary")
    for copy in range(2):
        write_files(files, f"{base}/source/{copy}")
        jobs.ingest_chunks(spark, f"{base}/source", f"{base}/target", f"{base}/ledger", f"{base}/checkpoint", most_files=100_000)
    return base


@query("SELECT DISTINCT md5(text) AS content FROM conversations WHERE turn % 7 <> 6 AND text IS NOT NULL")
def s2_ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(f"{_ingested(spark, d)}/target").select(F.md5("content").alias("content"))


@query("""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS file, CASE WHEN turn % 7 <> 6 THEN text END AS content FROM conversations),
won AS (SELECT file, count(*) AS chunks FROM (SELECT content, min(file) AS file FROM c WHERE content IS NOT NULL GROUP BY 1) GROUP BY 1),
f AS (SELECT c.file, count(*) FILTER (WHERE content IS NULL) AS nulls, coalesce(max(chunks), 0) AS chunks FROM c LEFT JOIN won ON won.file = c.file GROUP BY 1),
s AS (SELECT CASE WHEN chunks > 0 THEN 'processed' WHEN nulls > 0 THEN 'error' ELSE 'skipped' END AS state, chunks, nulls FROM f
UNION ALL SELECT CASE WHEN nulls > 0 THEN 'error' ELSE 'skipped' END, 0, nulls FROM f UNION ALL SELECT 'unreadable', 0, 0)
SELECT state, count(*) AS files, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(nulls) AS BIGINT) AS nulls FROM s GROUP BY 1""")
def a10_import_totals(spark: SparkSession, d: str) -> DataFrame:
    base = _ingested(spark, d)
    return jobs.import_totals(spark, f"{base}/target", f"{base}/ledger")


@query("SELECT user_id AS project, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY 1")
def s1_running_state(spark: SparkSession, d: str) -> DataFrame:
    base = _folder(spark, "state")
    log = audit_log(spark, d)
    log.write.parquet(f"{base}/log")
    jobs.keep_state(spark.readStream.schema(log.schema).parquet(f"{base}/log"), f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return jobs.kept_state(spark, f"{base}/state")


@query("""WITH l AS (SELECT user_id AS project, event_id, ts, event_type AS new_status, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN 'view' ELSE 'click' END AS original_status FROM events)
SELECT *, lag(new_status) OVER w AS before, row_number() OVER w AS n, coalesce(lag(new_status) OVER w <> original_status, false) AS gap FROM l WINDOW w AS (PARTITION BY project ORDER BY ts, event_id)""")
def s1_ordered_replay(spark: SparkSession, d: str) -> DataFrame:
    """The audit log as files in no order; a last row, of no project, moves the watermark past all others."""
    base = _folder(spark, "replay")
    log = audit_log(spark, d)
    log.repartition(4, "event_id").write.parquet(f"{base}/log")
    last = log.agg(F.max("at").alias("at")).select(F.lit(-1).cast("long").alias("project"), F.lit(-1).cast("long").alias("event_id"), (F.col("at") + F.expr("INTERVAL 100 DAYS")).alias("at"), F.lit("end").alias("new_status"), F.lit("end").alias("original_status"))
    for _ in range(2):
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/log")
        jobs.keep_replay(stream, "60 days", f"{base}/rows", f"{base}/checkpoint").awaitTermination()
        last.write.mode("append").parquet(f"{base}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{base}/log")
    jobs.keep_replay(stream, "60 days", f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{base}/rows").where("project <> -1")
    return rows.select("project", "event_id", F.col("at").cast("timestamp_ntz").alias("ts"), "new_status", "original_status", "before", "n", "gap")
