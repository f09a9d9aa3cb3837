"""Registration of queries, and the domain views that they and their SQL start from."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query (spark, sf_dir) -> DataFrame with the SQL that checks it; the SQL may use the views below."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (PRELUDE + ", " + sql[5:]) if sql.lstrip().startswith("WITH ") and not sql.startswith("WITH RECURSIVE") else sql if sql.startswith("WITH RECURSIVE") else PRELUDE + " " + sql
        return f

    return add


def half_even(scaled: str, unit: int | str) -> str:
    """SQL: the integer expression `scaled` divided by `unit`, halves to the even neighbour (for values >= 0)."""
    q, r = f"(({scaled}) // {unit})", f"(({scaled}) % {unit})"
    return f"({q} + CASE WHEN 2 * {r} > {unit} OR (2 * {r} = {unit} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


MONEY = "decimal(15,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_name").alias("owner_unit"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("project_type"),
        F.col("o_totalprice").cast(MONEY).alias("budget"),
        F.col("o_orderdate").alias("bid_open_date"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "awaiting_pricing")
        .otherwise("evaluating").alias("status"),
        (F.col("o_orderkey") % 10 == 0).alias("deleted"),
    )


def line_price() -> Column:
    """Discounted price to the cent, halves up, in steps that every engine takes alike."""
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5)
    return (cents.cast("decimal(15,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def bids(spark: SparkSession, d: str) -> DataFrame:
    own = W.partitionBy("l_orderkey")
    order = own.orderBy("price", "l_suppkey", "l_partkey", "l_linenumber", "l_shipdate")
    return table(spark, d, "lineitem").withColumn("price", line_price()).select(
        F.col("l_orderkey").alias("project"),
        F.col("l_suppkey").alias("bidder"),
        "price",
        F.row_number().over(order).alias("place"),
        F.count("*").over(own).alias("bidders"),
    )


def tenders(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min(line_price()).alias("winning_price"), F.count("*").alias("bidders")
    )
    return projects(spark, d).join(best, "id").select(
        "id", "region", "project_type", "budget", "winning_price", "bidders",
        (F.col("status") == "completed").alias("closed"), (F.col("id") % 4 != 0).alias("revealed"),
    )


def our_bids(spark: SparkSession, d: str) -> DataFrame:
    return bids(spark, d).where(F.col("place") == F.least(1 + F.col("project") % 3, F.col("bidders"))).select(
        "project", "bidder", "price", "bidders", (F.col("place") == 1).alias("won")
    )


def price_history(spark: SparkSession, d: str) -> DataFrame:
    p = projects(spark, d)
    cost = F.bround(F.col("budget") * F.lit("0.75").cast("decimal(3,2)"), 2).cast(MONEY)
    return our_bids(spark, d).join(p, F.col("project") == F.col("id")).select(
        "id", "region", "project_type", "budget", cost.alias("cost"), F.col("price").alias("final_price"), "won", "bid_open_date", "owner_unit"
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").join(vectors, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("content"),
        "vector",
        F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").otherwise("neutral").alias("win_signal"),
        F.array("lang").alias("region_tags"),
        F.when(F.col("doc_id") % 3 == 0, F.array()).otherwise(F.array(F.lit("dim"), "source")).cast("array<string>").alias("dimension_tags"),
        F.array(F.when(F.col("doc_id") % 2 == 0, "goods").otherwise("service")).alias("project_type_tags"),
        F.when(F.col("doc_id") % 5 == 0, "project_upload").when(F.col("doc_id") % 5 == 1, "internal_postmortem").otherwise("historical_tender").alias("source_type"),
        F.when(F.col("doc_id") % 8 != 0, F.col("source")).alias("source_label"),
        F.when(F.col("doc_id") % 4 == 0, "commercial").when(F.col("doc_id") % 16 != 1, "technical").alias("chunk_type"),
        (F.col("doc_id") % 7).cast("int").alias("chunk_index"),
        (F.col("doc_id") % 10).cast("int").alias("project"),
        (F.col("doc_id") % 17 == 0).alias("is_deprecated"),
    )


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("project")
    )


PRELUDE = f"""WITH project AS (
  SELECT o_orderkey AS id, c_name AS owner_unit, r_name AS region, c_mktsegment AS project_type,
         CAST(o_totalprice AS DECIMAL(15,2)) AS budget, o_orderdate AS bid_open_date,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'awaiting_pricing' ELSE 'evaluating' END AS status,
         o_orderkey % 10 = 0 AS deleted
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
bid0 AS (SELECT l_orderkey AS project, l_suppkey AS bidder, l_partkey, l_linenumber, l_shipdate,
                CAST(CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) * 0.01::DECIMAL(3,2) AS DECIMAL(15,2)) AS price FROM lineitem),
bid AS (
  SELECT project, bidder, price,
         row_number() OVER (PARTITION BY project ORDER BY price, bidder, l_partkey, l_linenumber, l_shipdate) AS place,
         count(*) OVER (PARTITION BY project) AS bidders FROM bid0),
tender AS (
  SELECT p.id, p.region, p.project_type, p.budget, b.winning_price, b.bidders, p.status = 'completed' AS closed,
         p.id % 4 <> 0 AS revealed
  FROM project p JOIN (SELECT project, min(price) AS winning_price, count(*) AS bidders FROM bid0 GROUP BY 1) b
       ON b.project = p.id),
our_bid AS (SELECT project, bidder, price, bidders, place = 1 AS won FROM bid WHERE place = least(1 + project % 3, bidders)),
price_history AS (
  SELECT p.id, region, project_type, budget,
         CAST({half_even("CAST(budget * 100 AS BIGINT) * 75", 100)} AS DOUBLE) / 100 AS cost,
         price AS final_price, won, bid_open_date, owner_unit
  FROM our_bid JOIN project p ON p.id = project),
chunk AS (
  SELECT d.doc_id AS chunk_id, d.text AS content, e.embedding AS vector,
         CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'neutral' END AS win_signal,
         d.lang AS region_tag, CASE WHEN d.doc_id % 3 = 0 THEN [] ELSE ['dim', d.source] END AS dims, CASE WHEN d.doc_id % 2 = 0 THEN 'goods' ELSE 'service' END AS ptype,
         CASE d.doc_id % 5 WHEN 0 THEN 'project_upload' WHEN 1 THEN 'internal_postmortem' ELSE 'historical_tender' END AS source_type, CASE WHEN d.doc_id % 8 <> 0 THEN d.source END AS source_label, CASE WHEN d.doc_id % 4 = 0 THEN 'commercial' WHEN d.doc_id % 16 <> 1 THEN 'technical' END AS chunk_type, CAST(d.doc_id % 7 AS INTEGER) AS chunk_index, CAST(d.doc_id % 10 AS INTEGER) AS project,
         d.doc_id % 17 = 0 AS is_deprecated
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
query_vec AS (SELECT vec_id AS query_id, embedding AS query_vector, label AS project FROM embeddings WHERE vec_id % 50 = 0)"""
