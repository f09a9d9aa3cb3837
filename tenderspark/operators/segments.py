"""Blocks and lines of documents: boilerplate, segments by header, keywords and page indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.functions.text import DIMENSIONS, has_any, strip, tag_dimensions, tag_from_header

# Header patterns (chapter, section, subsection, numbered), and lines that are a heading by themselves.
HEADERS = (
    r"^第[一二三四五六七八九十百0-9]+章[ \t　]*",
    r"^[一二三四五六七八九十]+、[ \t　]*",
    r"^（[一二三四五六七八九十]+）[ \t　]*",
    r"^\d+(\.\d+)*[.、　]+",
)
HEADINGS = (
    "评分标准", "评标标准", "评分细则", "评标办法", "服务方案", "技术方案", "实施方案", "配送方案", "技术要求", "服务要求", "质量要求", "规格要求",
    "报价文件", "投标报价", "商务报价", "报价方案", "企业资质", "业绩要求", "成功案例", "卫生保障", "食品安全", "冷链管理", "食材溯源", "合同条款", "履约保证", "验收标准",
)


def to_blocks(pages: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, ord, block_type, content) of pages (doc, ord, text) and table texts (doc, ord, text); blanks dropped."""
    each = lambda df, kind: df.select("doc", "ord", F.lit(kind).alias("block_type"), F.col("text").alias("content"))
    return each(pages, "paragraph").unionByName(each(cells, "table")).where(strip(F.col("content")) != "")


def filter_boilerplate(
    blocks: DataFrame, generative: tuple[str, ...], boilerplate: tuple[str, ...], least: int = 30, least_table: int = 20
) -> DataFrame:
    """Blocks (content, block_type) that carry content: tables of `least_table` characters, whatever they say, and
    paragraphs of `least` characters without the blanks around them, unless their first line has a boilerplate keyword
    and no line a generative one. Null and blank blocks go."""
    bare = strip(F.col("content"))
    first = F.substring_index("content", "\n", 1)
    says = has_any(F.col("content"), generative) | ~has_any(first, boilerplate)
    table = F.col("block_type") == "table"
    return blocks.where((bare != "") & F.when(table, F.length("content") >= least_table).otherwise((F.length(bare) >= least) & says))


def is_header(line: Column, patterns: tuple[str, ...] = HEADERS, headings: tuple[str, ...] = HEADINGS) -> Column:
    whole = r"^(?:" + "|".join(headings) + r")[ \t　：:]*$"
    found = line.rlike(whole) if headings else F.lit(False)
    for p in patterns:
        found = found | line.rlike(p)
    return found


def segment_by_header(docs: DataFrame, header: Column | None = None, dimensions: dict = DIMENSIONS) -> DataFrame:
    """(doc, seg, title, body, tags): a header line starts a segment; lines up to the next are its body.

    Lines are tested without the white space around them, blank ones are no headers, and empty bodies are dropped. Tags
    are the dimensions named in the title and those with two hits in the body, sorted. `docs` is (doc, text); `header` is
    a test on the column `line`."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    test = is_header(strip(F.col("line"))) if header is None else header
    lines = lines.withColumn("head", test & (strip(F.col("line")) != ""))
    lines = lines.withColumn("seg", F.sum(F.col("head").cast("int")).over(W.partitionBy("doc").orderBy("pos")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    parts = lines.groupBy("doc", "seg").agg(F.max(F.when(F.col("head"), strip(F.col("line")))).alias("title"), strip(body).alias("body"))
    parts = parts.where(F.col("body") != "").select("doc", "seg", F.coalesce("title", F.lit("")).alias("title"), "body")
    tags = F.array_union(tag_from_header(F.col("title"), dimensions), tag_dimensions(F.col("body"), dimensions))
    return parts.withColumn("tags", F.array_sort(tags))


def merge_short_segments(segments: DataFrame, least: int = 500) -> DataFrame:
    """Segments shorter than `least` join the one kept before them, with their tags; the first of a document stays."""
    order = W.partitionBy("doc").orderBy("seg")
    kept = (F.length("body") >= least) | (F.row_number().over(order) == 1)
    grouped = segments.withColumn("kept", kept).withColumn("into", F.sum(F.col("kept").cast("int")).over(order))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "body"))), lambda x: x["body"]), "\n")
    return grouped.groupBy("doc", "into").agg(
        F.max(F.when(F.col("kept"), F.col("title"))).alias("title"), texts.alias("body"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.count("*").alias("parts"),
    )


def top_keywords(docs: DataFrame, k: int = 5, pattern: str = r"[一-龥]{2,}") -> DataFrame:
    """(doc, rank, keyword, n): a text's most frequent runs, of equal ones the first seen."""
    words = docs.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("pos", "keyword"))
    counts = words.groupBy("doc", "keyword").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select("doc", "rank", "keyword", "n")


def page_index(sections: DataFrame, per_page: int = 600, first: int = 3) -> DataFrame:
    """Sections (doc, ord, text) with start and end pages: a page holds 600 characters, the first starts on page 3."""
    pages = F.greatest(F.floor(F.length(F.coalesce("text", F.lit(""))) / per_page), F.lit(1)).cast("long")
    before = W.partitionBy("doc").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    rows = sections.withColumn("pages", pages).withColumn("start_page", F.lit(first) + F.coalesce(F.sum("pages").over(before), F.lit(0)))
    return rows.select("doc", "ord", "pages", "start_page", (F.col("start_page") + F.col("pages") - 1).alias("end_page"))


def downsample_pages(pages: DataFrame, keywords: tuple[str, ...], most: int = 100, front: int = 10, back: int = 5, hits: int = 10) -> DataFrame:
    """Pages (doc, page from 1, text) of long documents: the first and last ones, and the first middle ones with a keyword."""
    n = F.count("*").over(W.partitionBy("doc"))
    rows = pages.withColumn("n", n).withColumn(
        "middle", (F.col("page") > front) & (F.col("page") <= F.col("n") - back) & has_any(F.col("text"), keywords)
    )
    seen = F.sum(F.col("middle").cast("int")).over(W.partitionBy("doc").orderBy("page"))
    keep = (F.col("n") <= most) | (F.col("page") <= front) | (F.col("page") > F.col("n") - back) | (F.col("middle") & (F.col("seen") <= hits))
    return rows.withColumn("seen", seen).where(keep).select(*pages.columns)


def untagged_chunks(chunks: DataFrame, limit: int, least: int = 40) -> DataFrame:
    """The longest chunks that are in use, have no tags and at least `least` characters (a report of `limit` rows)."""
    open_ = chunks.where(~F.col("is_deprecated") & (F.size("tags") == 0) & (F.length("content") >= least))
    return open_.orderBy(F.desc(F.length("content")), "chunk_id").limit(limit)


def keep_known_tags(proposed: Column, vocabulary: tuple[str, ...]) -> Column:
    """Proposed tags that the vocabulary has."""
    return F.array_intersect(proposed, F.array(*map(F.lit, vocabulary)))


def table_to_markdown(cells: DataFrame) -> DataFrame:
    """(doc, markdown) of tables given as rows (doc, row, cells array): a header, a rule, then the non-empty rows.

    Rows are padded to the widest; tables without a cell of five characters are dropped."""
    real = cells.where((F.col("row") == 0) | F.exists("cells", lambda c: strip(c) != ""))
    wide = real.groupBy("doc").agg(
        F.max(F.size("cells")).alias("w"), F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"),
        F.max(F.array_max(F.transform("cells", lambda c: F.length(strip(c))))).alias("longest"),
    ).where("longest >= 5")
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    padded = F.transform(
        "rows", lambda r: line(F.concat(r["cells"], F.array_repeat(F.lit(""), (F.col("w") - F.size(r["cells"])).cast("int"))))
    )
    rule = line(F.array_repeat(F.lit("---"), F.col("w").cast("int")))
    return wide.select("doc", F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, F.lit(2), F.size(padded))), "\n").alias("markdown"))
