"""Registered queries of the extraction functions, on texts that are made from rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.functions import extract as X
from tenderspark.functions import text as T
from tenderspark.operators import segments as S
from tenderspark.plans.base import query, table
from tenderspark.sources import outcome_book as B


@query("""SELECT event_id, CASE WHEN event_id % 12 IN (0, 1, 2, 6) THEN CAST(ts AS DATE) WHEN event_id % 12 = 3 THEN last_day(CAST(ts AS DATE))
WHEN event_id % 12 = 4 THEN make_date(year(ts), 12, 31) WHEN event_id % 12 = 7 THEN DATE '2099-12-31' ELSE NULL END AS parsed FROM events""")
def b2_parse_loose_date(spark: SparkSession, d: str) -> DataFrame:
    k, f = F.col("event_id") % 12, lambda p: F.date_format("ts", p)
    said = F.when(k == 0, F.translate(f("yyyy-MM-dd"), "01", "Ol")).when(k == 1, f("yyyy/M/d")).when(k == 2, f("yyyy'年'M'月'd'日'")).when(
        k == 3, f("yyyy'年'M'月'")).when(k == 4, f("yyyy'年'")).when(k == 5, "soon")
    said = said.when(k == 6, F.translate(f("yyyy'5年'M'月'd'日'"), "02", "o2")).when(k == 7, F.concat(F.lit("　长期有效 "), f("yyyy"))).when(k == 8, f("yyyyMMdd")).when(
        k == 9, f("yyyy'年'M'月'd")).when(k == 10, f("yyyy.M/d"))
    return table(spark, d, "events").select("event_id", T.parse_loose_date(said).alias("parsed"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS day, CAST(floor(o_totalprice) AS BIGINT) AS money, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT k AS doc, 'owner_unit' AS field, c_name AS value, 0.95::DOUBLE AS confidence FROM o WHERE k % 4 <> 3 OR k % 5 = 0
UNION ALL SELECT k, 'project_name', '第' || k || '号餐饮服务', 0.95::DOUBLE FROM o WHERE k % 3 = 0
UNION ALL SELECT k, 'budget_amount', CAST(money AS VARCHAR), 0.9::DOUBLE FROM o WHERE k % 2 = 0
UNION ALL SELECT k, 'region', CASE WHEN k % 5 < 2 THEN '广东省惠州市' ELSE '南昌红谷滩' END, 0.8::DOUBLE FROM o WHERE k % 5 < 4
UNION ALL SELECT k, 'plan_code', (100000 + k) || '-' || year(day) || '-' || (50000 + k % 1000), 0.95::DOUBLE FROM o WHERE k % 7 < 3
UNION ALL SELECT k, 'project_type', CASE WHEN k % 3 = 0 THEN 'service' ELSE 'engineering' END, CASE WHEN k % 3 = 0 THEN 0.85 ELSE 0.8 END::DOUBLE FROM o WHERE k % 3 < 2
UNION ALL SELECT k, 'bid_open_date', CAST(CAST(day AS DATE) AS VARCHAR), 0.75::DOUBLE FROM o WHERE k % 6 < 4""")
def b3_extract_labelled_fields(spark: SparkSession, d: str) -> DataFrame:
    """Pages with every field in several shapes: on the label's line or the next one, by several labels, or missing."""
    nations = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "orders").join(nations, F.col("o_custkey") == F.col("c_custkey"))
    k, day = F.col("o_orderkey"), lambda p: F.date_format("o_orderdate", p)
    said = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    owner = F.when(k % 4 == 0, said("采购人：\n  ", F.col("c_name"), "\n")).when(k % 4 == 1, said("招标人： ", F.col("c_name"), "\n")).when(
        k % 4 == 2, said("采购人：甲\n业主单位：", F.col("c_name"), "\n")).when(k % 5 == 0, said("采购人：采购人：", F.col("c_name"), "\n")).otherwise("采购人：\n联系方式：123\n")
    name = F.when(k % 3 == 0, said("项目名称： 第 ", k.cast("string"), " 号 餐饮服务\n")).when(k % 3 == 1, said("项目名称：施工\n")).otherwise("")
    cash = F.floor("o_totalprice")
    money = F.when(k % 4 == 0, said("预算金额：", F.format_number(cash, 0), "元\n")).when(k % 2 == 0, said("采购预算：\n人民币", cash.cast("string"), ".50元\n")).otherwise("预算金额：面议\n")
    place = F.when(k % 5 == 0, "地址：广东省惠州市某路 12 号\n").when(k % 5 == 1, "地址：\n中国广东省惠州市\n").when(k % 5 == 2, "地址：南昌红谷滩 0791-8765432\n").when(k % 5 == 3, "地址：南昌红谷滩\n").otherwise("地址：某路\n")
    code = [(100000 + k).cast("string"), day("yyyy"), (50000 + k % 1000).cast("string")]
    plan = F.when(k % 7 == 0, said("采购计划编号：", F.concat_ws("-", *code), "\n")).when(k % 7 < 3, said("采购计划编号: ", F.concat_ws(" - ", *code), "\n")).otherwise("项目编号：1234567\n")
    opens = F.when(k % 6 == 0, said("开标时间：", day("yyyy-MM-dd"))).when(k % 6 == 1, said("截标日期：\n", day("yyyy年M月d日"))).when(
        k % 6 == 2, said("投标截止时间（北京时间）： ", day("yyyy/M/d"))).when(k % 6 == 3, said("开标日期：", F.translate(day("yyyy-MM-dd"), "0", "O"))).when(
        k % 6 == 4, said("开标日期：", day("yyyyMMdd"))).otherwise("开标时间：待定")
    pages = rows.select(k.alias("doc"), F.lit(1).alias("page"), F.concat(name, owner, money, place, plan, opens).alias("text"))
    return X.extract_labelled_fields(pages).drop("page")


@query("""SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 < 2 THEN (100000 + o_orderkey) || '-' || year(o_orderdate) || '-' || (50000 + o_orderkey % 1000) END AS plan_code FROM orders""")
def b4_extract_plan_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    parts = [(100000 + k).cast("string"), F.date_format("o_orderdate", "yyyy"), (50000 + k % 1000).cast("string")]
    text = F.when(k % 3 == 0, F.concat(F.lit("采购计划编号："), F.concat_ws("-", *parts))).when(k % 3 == 1, F.concat(F.lit("采购计划编号: "), F.concat_ws(" - ", *parts))).otherwise(F.lit("无"))
    return table(spark, d, "orders").select(k.alias("doc"), X.extract_plan_codes(text)["plan_code"].alias("plan_code"))


@query("SELECT p_partkey AS id, 'cert_number' AS field, 'CERT' || (1000000 + p_partkey) AS value, 0.85::DOUBLE AS confidence FROM part")
def b6_extract_license_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    fields = X.extract_license_fields(F.concat(F.lit("证号: CERT"), 1000000 + k), F.lit("cert"))
    return table(spark, d, "part").select(k.alias("id"), F.inline(fields))


@query("""SELECT p_partkey AS project, CASE WHEN contains(p_type, 'STEEL') THEN 'FOOD_OPERATION_LICENSE' ELSE 'OTHER_CERT' END AS cert_code FROM part""")
def b9_normalise_requirements(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.contains("p_type", F.lit("STEEL")), F.concat(F.lit("食品"), F.col("p_type"))).otherwise(F.col("p_type"))
    doc = F.to_json(F.struct(F.array(F.struct(title.alias("title"), F.col("p_brand").alias("type"))).alias("qualifications")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("project"), doc.alias("json"))
    return X.normalise_requirements(rows).select("project", "cert_code")


@query("SELECT o_orderkey AS id, o_orderkey % 3 < 2 AS mark FROM orders")
def b10_flag_navigation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("服务方案 "), 1000 + k)).when(k % 3 == 1, F.concat(F.lit("第"), k % 9 + 1, F.lit("章 总则 "), k)).otherwise(F.concat(F.lit("共"), k, F.lit("元")))
    return table(spark, d, "orders").select(k.alias("id"), T.flag_navigation(text).alias("mark"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size * 30 > p_retailprice AND p_size * 30 > 800 THEN 'business_license' WHEN p_size * 30 > p_retailprice AND p_size * 30 > 400 THEN 'certification' ELSE 'other' END AS kind FROM part""")
def b22_classify_image(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.classify_image(F.col("p_size") * 30, F.col("p_retailprice")).alias("kind"))


@query("""SELECT p_partkey AS id, 'closed' AS status, p_partkey % 2 = 0 AS price_revealed, CASE WHEN p_partkey % 3 = 0 THEN '未命名' ELSE p_name END AS name FROM part""")
def a7_tender_defaults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k.alias("id"), F.lit(None).cast("string").alias("status"), F.when(k % 2 == 0, F.col("p_retailprice")).alias("winning_price"),
        F.when(k % 3 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("name"),
    )
    return B.tender_defaults(rows).select("id", "status", "price_revealed", "name")


@query("""SELECT c.doc, md5('| ' || c.role || ' | ' || c.turn || ' |' || chr(10) || '| --- | --- |' || coalesce(chr(10) || r.body, '')) AS markdown
FROM (SELECT conv_id AS doc, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) c
LEFT JOIN (SELECT conv_id AS doc, string_agg('| ' || role || ' | ' || turn || ' |', chr(10) ORDER BY turn) AS body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 1 GROUP BY 1) r ON r.doc = c.doc
WHERE c.n = 1 AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.doc AND length(x.role) >= 5)""")
def a12_table_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("row"), F.array("role", F.col("turn").cast("string")).alias("cells"))
    return S.table_to_markdown(rows).select("doc", F.md5("markdown").alias("markdown"))


B15_NAMES = ("and", "der", "que", "los")


@query(f"""WITH RECURSIVE cut AS (SELECT doc_id, string_split(regexp_replace(text, '(^|[\n\r\t （(])({"|".join(B15_NAMES)})', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM documents),
part AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS p, len(parts) AS n FROM cut),
named AS (SELECT doc_id, CASE WHEN n > 1 THEN (SELECT count(*) FROM cut c WHERE c.doc_id = part.doc_id AND c.parts[1] <> '') + i - 1 ELSE 0 END AS seg, CASE WHEN n > 1 THEN left(p, 3) END AS dimension,
CASE WHEN n > 1 THEN regexp_replace(substr(p, 4), '^[\\s\u3000]+|[\\s\u3000]+$', '', 'g') ELSE p END AS text FROM part WHERE n = 1 OR i > 0),
d AS (SELECT *, length(text) AS n FROM named WHERE trim(translate(text, chr(10) || chr(9) || chr(13), '   ')) <> ''),
c AS (SELECT doc_id, seg, dimension, text, n, 0 AS k, 0 AS a, least(n, 600) AS e FROM (SELECT * FROM d)
UNION ALL SELECT doc_id, seg, dimension, text, n, k + 1, s, least(n, s + 600) FROM (SELECT *, greatest(a + m - 80, a + 1) AS s FROM (SELECT *, {{cut}} AS m FROM c) WHERE a + 600 < n))
SELECT doc_id AS doc, CAST(seg AS INTEGER) AS seg, dimension, k, md5(substr(text, a + 1, {{cut}})) AS body FROM c""".replace("{cut}", "CASE WHEN a + 600 >= n THEN n - a WHEN length(regexp_replace(substr(text, a + 1, 600), '[^\n。！？.!?]*$', '')) > 480 THEN length(regexp_replace(substr(text, a + 1, 600), '[^\n。！？.!?]*$', '')) ELSE 600 END"))
def b15_chunk_by_dimensions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return X.chunk_by_dimensions(docs, B15_NAMES).withColumn("body", F.md5("body"))
