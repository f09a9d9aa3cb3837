"""Registered queries of the text and segment operators, with dictionaries of words that occur in the given prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.functions import text as T
from tenderspark.operators import long_texts
from tenderspark.operators import segments as S
from tenderspark.plans.base import query, table

DIMS = {"english": ("the", "tion"), "french": ("eau", "que"), "german": ("sch", "ung"), "spanish": ("ción",)}
TYPES = (("service", ("ción", "eau"), 0.85), ("goods", ("sch",), 0.80), ("engineering", ("the",), 0.80))
PRICE = ("token", "tion of")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


@query(f"SELECT doc_id AS doc, regexp_replace(trim(text, '{T.BLANKS}'), ' +', ' ', 'g') AS text FROM documents")
def b1_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc", T.normalize_text(F.col("text")).alias("text"))


@query("""SELECT doc_id AS doc, CASE WHEN contains(text, 'ción') OR contains(text, 'eau') THEN 'service' WHEN contains(text, 'sch') THEN 'goods'
WHEN contains(text, 'the') THEN 'engineering' END AS type,
CASE WHEN contains(text, 'ción') OR contains(text, 'eau') THEN 0.85::DOUBLE WHEN contains(text, 'sch') OR contains(text, 'the') THEN 0.8::DOUBLE END AS confidence FROM documents""")
def b5_classify_project_type(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc", T.classify_project_type(F.col("text"), TYPES).alias("t")).select("doc", "t.type", "t.confidence")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def b8_salvage_json(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("<think>so {1}</think> here: "), F.col("props"), F.lit(" done"))
    rows = table(spark, d, "events").select("event_id", T.salvage_json(said).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"))


BLANKS = "'" + T.BLANKS + "'"
LINES = "lines AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"""WITH {LINES} SELECT doc, pos, length(line) AS n FROM lines WHERE trim(line, {BLANKS}) <> '' AND length(trim(line, {BLANKS})) >= 30
AND (contains(line, 'tion') OR NOT contains(line, 'the'))""")
def b11_filter_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    blocks = _docs(spark, d).select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "content")).withColumn("block_type", F.lit("paragraph"))
    return S.filter_boilerplate(blocks, ("tion",), ("the",)).select("doc", "pos", F.length("content").alias("n"))


TAGGED = ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(title, {w!r})' for w in words)} OR {' + '.join(f'(length(body) - length(replace(body, {w!r}, {chr(39) * 2}))) // {len(w)}' for w in words)} >= 2 THEN '{k}' END"
    for k, words in DIMS.items()
)
SEGMENTS = f"""{LINES}, marked AS (SELECT *, length(line) < 60 AND trim(line, {BLANKS}) <> '' AS head FROM lines),
numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc ORDER BY pos) AS seg FROM marked),
segments AS (SELECT doc, seg, coalesce(max(trim(line, {BLANKS})) FILTER (WHERE head), '') AS title,
trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT head), ''), {BLANKS}) AS body FROM numbered GROUP BY 1, 2 HAVING body <> ''),
tagged AS (SELECT *, list_sort(list_filter([{TAGGED}], lambda x: x IS NOT NULL)) AS tags FROM segments)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return S.segment_by_header(_docs(spark, d), F.length("line") < 60, DIMS)


@query(f"WITH {SEGMENTS} SELECT doc, CAST(seg AS BIGINT) AS seg, title, md5(body) AS body, array_to_string(tags, ',') AS tags FROM tagged")
def b12_segment_by_header(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).withColumn("body", F.md5("body")).withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH {SEGMENTS}, k AS (SELECT *, length(body) >= 500 OR row_number() OVER (PARTITION BY doc ORDER BY seg) = 1 AS kept FROM tagged),
g AS (SELECT *, sum(kept::INT) OVER (PARTITION BY doc ORDER BY seg) AS grp FROM k)
SELECT doc, CAST(grp AS BIGINT) AS "into", max(title) FILTER (WHERE kept) AS title, md5(string_agg(body, chr(10) ORDER BY seg)) AS body,
array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, count(*) AS parts FROM g GROUP BY doc, grp""")
def b13_merge_short_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_short_segments(_segments(spark, d)).withColumn("body", F.md5("body")).withColumn("tags", F.array_join("tags", ","))


@query("""WITH RECURSIVE d AS (SELECT doc_id AS doc, text, length(text) AS n FROM documents WHERE trim(translate(text, chr(10) || chr(9) || chr(13), '   ')) <> ''),
c AS (SELECT doc, 0 AS k, 0 AS a, CASE WHEN 500 >= n THEN n ELSE CASE WHEN length(regexp_replace(substr(text, 1, 500), '[^\n。！？.!?]*$', '')) > 400 THEN length(regexp_replace(substr(text, 1, 500), '[^\n。！？.!?]*$', '')) ELSE 500 END END AS m FROM d
UNION ALL SELECT doc, k + 1, s, CASE WHEN s + 500 >= n THEN n - s ELSE CASE WHEN length(regexp_replace(substr(text, s + 1, 500), '[^\n。！？.!?]*$', '')) > 400 THEN length(regexp_replace(substr(text, s + 1, 500), '[^\n。！？.!?]*$', '')) ELSE 500 END END
FROM (SELECT c.doc, c.k, greatest(c.a + c.m - 50, c.a + 1) AS s, d.text, d.n FROM c JOIN d ON d.doc = c.doc WHERE c.a + 500 < d.n))
SELECT c.doc, k, md5(substr(d.text, a + 1, m)) AS chunk FROM c JOIN d ON d.doc = c.doc""")
def b14_sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    return long_texts.chunk_documents(_docs(spark, d).select("doc", "text")).withColumn("chunk", F.md5("chunk"))


_HITS = ", ".join(
    f"{' + '.join(f'(length(text) - length(replace(text, {w!r}, {chr(39) * 2}))) // {len(w)}' for w in words)} AS {k}" for k, words in DIMS.items()
)


@query(f"""WITH h AS (SELECT doc_id AS doc, {_HITS} FROM documents),
u AS ({" UNION ALL ".join(f"SELECT doc, {i} AS i, '{k}' AS dim, {k} AS n FROM h WHERE {k} >= 2" for i, k in enumerate(DIMS))})
SELECT d.doc_id AS doc, coalesce(string_agg(dim, ',' ORDER BY n DESC, i), '') AS tags FROM documents d LEFT JOIN u ON u.doc = d.doc_id GROUP BY 1""")
def b16_tag_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc", F.array_join(T.tag_dimensions(F.col("text"), DIMS), ",").alias("tags"))


_ANY = {k: "(" + " OR ".join(f"contains(title, '{w}')" for w in words) + ")" for k, words in DIMS.items()}


@query("SELECT doc, concat_ws(',', " + ", ".join(f"CASE WHEN {_ANY[k]} THEN '{k}' END" for k in sorted(DIMS)) + ") AS tags FROM (SELECT doc_id AS doc, string_split(text, chr(10))[1] AS title FROM documents)")
def b17_tag_from_header(spark: SparkSession, d: str) -> DataFrame:
    title = F.split("text", "\n")[0]
    return _docs(spark, d).select("doc", F.array_join(T.tag_from_header(title, DIMS), ",").alias("tags"))


@query("SELECT doc_id AS doc, CAST(length(text) * 4 // 10 AS BIGINT) AS tokens FROM documents")
def b18_estimate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id AS doc, contains(text, 'token') OR contains(text, 'tion of') AS price_sensitive FROM documents")
def b19_flag_price_sensitive(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc", T.price_sensitive(F.col("text"), PRICE).alias("price_sensitive"))


@query("""WITH w AS (SELECT doc, unnest(l) AS keyword, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id AS doc, regexp_extract_all(text, '[a-z]{6,}') AS l FROM documents)),
c AS (SELECT doc, keyword, count(*) AS n, min(pos) AS first FROM w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) AS rank FROM c) SELECT doc, CAST(rank AS INTEGER) AS rank, keyword, n FROM r WHERE rank <= 5""")
def b20_top_keywords(spark: SparkSession, d: str) -> DataFrame:
    return S.top_keywords(_docs(spark, d), 5, "[a-z]{6,}")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "text")


@query("""WITH p AS (SELECT conv_id AS doc, turn AS ord, greatest(length(coalesce(text, '')) // 600, 1) AS pages FROM conversations),
s AS (SELECT *, 3 + coalesce(sum(pages) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_page FROM p)
SELECT doc, ord, CAST(pages AS BIGINT) AS pages, CAST(start_page AS BIGINT) AS start_page, CAST(start_page + pages - 1 AS BIGINT) AS end_page FROM s""")
def b21_page_index(spark: SparkSession, d: str) -> DataFrame:
    return S.page_index(_sections(spark, d))


@query("""SELECT doc_id AS chunk_id, length(text) AS n FROM documents WHERE doc_id % 17 <> 0 AND length(text) >= 40 AND NOT contains(text, 'tion')
ORDER BY length(text) DESC, doc_id LIMIT 25""")
def b23_untagged_chunks(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.contains(F.col("text"), F.lit("tion")), F.array(F.lit("x"))).otherwise(F.array())
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), tags.alias("tags"), (F.col("doc_id") % 17 == 0).alias("is_deprecated")
    )
    return S.untagged_chunks(rows, 25).select("chunk_id", F.length("content").alias("n"))


PAGES = "pg AS (SELECT doc, pos + 1 AS page, line AS text, count(*) OVER (PARTITION BY doc) AS n FROM lines)"


@query(f"""WITH {LINES}, {PAGES}, m AS (SELECT *, page > 3 AND page <= n - 2 AND contains(text, 'tion of') AS middle FROM pg),
s AS (SELECT *, sum(middle::INT) OVER (PARTITION BY doc ORDER BY page) AS seen FROM m)
SELECT doc, page FROM s WHERE n <= 8 OR page <= 3 OR page > n - 2 OR (middle AND seen <= 4)""")
def a11_downsample_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _docs(spark, d).select("doc", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return S.downsample_pages(pages, ("tion of",), 8, 3, 2, 4).select("doc", "page")


@query(f"""WITH {LINES} SELECT doc, pos AS ord, 'paragraph' AS block_type, length(line) AS n FROM lines WHERE trim(line, {BLANKS}) <> ''
UNION ALL SELECT conv_id, turn, 'table', length(text) FROM conversations WHERE trim(text, {BLANKS}) <> ''""")
def a13_to_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = _docs(spark, d).select("doc", F.posexplode(F.split("text", "\n")).alias("ord", "text")).withColumn("ord", F.col("ord").cast("long"))
    return S.to_blocks(pages, _sections(spark, d)).select("doc", "ord", "block_type", F.length("content").alias("n"))
