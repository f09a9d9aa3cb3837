"""Column functions on text: normalising, tagging, parsing of loose dates and JSON."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for a, b in (("０", "９"), ("Ａ", "Ｚ"), ("ａ", "ｚ")) for c in range(ord(a), ord(b) + 1))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)

# Keyword groups of project types with their confidences, and price keywords.
PROJECT_TYPES = (
    ("service", ("服务", "餐饮", "配送"), 0.85),
    ("goods", ("货物", "设备", "材料"), 0.80),
    ("engineering", ("工程", "施工", "建设"), 0.80),
)
PRICE_KEYWORDS = ("报价", "价格", "预算", "成本", "优惠", "折扣", "元/", "元\\")

# Scoring dimensions and their keywords, in dictionary order.
DIMENSIONS = {
    "食材溯源": ("食材", "溯源", "来源", "产地证明", "检疫", "合格证明", "原材料"),
    "冷链管理": ("冷链", "冷藏", "冷冻", "温度控制", "冷库", "冷链车", "全程冷链"),
    "卫生保障": ("卫生", "消毒", "清洁", "食品安全", "健康管理", "卫生许可证"),
    "配送能力": ("配送", "运输", "送货车", "物流", "时效", "配送车辆", "运输能力"),
    "报价合理性": ("报价", "价格", "预算", "成本", "性价比", "总价", "单价", "优惠"),
    "服务方案": ("服务", "方案", "承诺", "计划", "措施", "服务承诺", "质量保障"),
    "企业资质": ("资质", "认证", "证书", "ISO", "执照", "营业执照", "体系认证"),
    "历史业绩": ("业绩", "案例", "项目经验", "成功案例", "类似项目", "既往业绩"),
    "技术方案": ("技术", "方案", "措施", "技术措施", "工艺", "施工方案"),
    "评分标准": ("评分", "评标", "权重", "得分", "分值", "技术分", "商务分"),
}

# Suffixes of document names.
DOC_SUFFIXES = ("_投标文件", "_招标文件", "_价格文件", "_资格证明文件", "_投标书")


#: What Python's strip() takes away: blanks, tabs and line ends, and the wide ones of other scripts.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """The text without any white space around it, that of other scripts included."""
    return F.btrim(text, F.lit(BLANKS))


def normalize_text(text: Column) -> Column:
    """Full-width digits, letters and blanks to ASCII, trimmed, runs of blanks as one; null becomes empty."""
    narrow = F.translate(F.coalesce(text, F.lit("")), _WIDE + "　", _NARROW + " ")
    return F.regexp_replace(strip(narrow), " +", " ")


def has_any(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether any keyword occurs."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords], F.lit(False))


def classify_project_type(text: Column, groups: tuple = PROJECT_TYPES) -> Column:
    """(type, confidence) of the first group with a keyword in the text; null if none has."""
    out = F.lit(None).cast("struct<type:string,confidence:double>")
    for name, words, sure in reversed(groups):
        out = F.when(has_any(text, words), F.struct(F.lit(name).alias("type"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def price_sensitive(text: Column, keywords: tuple[str, ...] = PRICE_KEYWORDS) -> Column:
    return has_any(text, keywords)


def occurrences(text: Column, keyword: str) -> Column:
    """How often the keyword occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(keyword), F.lit("")))) / len(keyword)).cast("int")


def tag_dimensions(text: Column, dimensions: dict = DIMENSIONS, least: int = 2) -> Column:
    """Dimensions whose keywords occur `least` times in all, most hits first, then in dictionary order."""
    hits = F.array(*(
        F.struct((-sum((occurrences(text, k) for k in words[1:]), occurrences(text, words[0]))).alias("n"), F.lit(i).alias("i"), F.lit(d).alias("d"))
        for i, (d, words) in enumerate(dimensions.items())
    ))
    return F.transform(F.array_sort(F.filter(hits, lambda h: h["n"] <= -least)), lambda h: h["d"])


def tag_from_header(title: Column, dimensions: dict = DIMENSIONS) -> Column:
    """Dimensions of which any keyword occurs in a title, sorted."""
    found = F.array(*(F.when(has_any(title, words), F.lit(d)) for d, words in dimensions.items()))
    return F.array_sort(F.array_compact(found))


def estimate_tokens(text: Column) -> Column:
    """Four tenths of the characters, rounded down."""
    return F.floor(F.length(text) * 4 / F.lit(10).cast("decimal(3,0)")).cast("long")


def strip_doc_suffix(name: Column) -> Column:
    """A document's name without one of the known suffixes, else without a trailing package number."""
    plain = F.regexp_replace(name, "(" + "|".join(DOC_SUFFIXES) + ")$", "")
    return F.when(plain != name, plain).otherwise(F.regexp_replace(name, r"_采购包\s*\d+$", ""))


def salvage_json(text: Column) -> Column:
    """JSON left in a model's answer: thoughts removed; as it is if valid, else from the first brace to the last."""
    bare = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    valid = F.try_parse_json(bare).isNotNull()
    return F.when(valid, bare).otherwise(F.when(inner != "", inner))


def parse_loose_date(text: Column) -> Column:
    """Date in any of the loose forms: open-ended words, misread digits, one of - . / between all parts, or the
    characters of year, month and day (of a year of five digits the first four count).

    A year and month give the month's last day, a year alone its last day; anything else is null."""
    s = strip(text)
    digits = F.translate(s, "OoIlB", "00118")
    part = lambda p, k: F.regexp_extract(digits, p, k)
    day = lambda *parts: F.try_to_date(F.concat_ws("-", *parts), "yyyy-M-d")
    forms = [(rf"^(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})$") for sep in ("-", r"\.", "/")] + [r"^(\d{4})\d?年(\d{1,2})月(\d{1,2})日$"]
    whole = [F.when(digits.rlike(p), day(part(p, 1), part(p, 2), part(p, 3))) for p in forms]
    months, years = r"^(\d{4})\d?年(\d{1,2})月$", r"^(\d{4})\d?年$"
    month = F.when(digits.rlike(months), F.last_day(day(part(months, 1), part(months, 2), F.lit("1"))))
    year = F.when(digits.rlike(years), day(part(years, 1), F.lit("12"), F.lit("31")))
    open_ended = F.contains(s, F.lit("长期")) | F.contains(s, F.lit("永久"))
    return F.when(open_ended, F.lit("2099-12-31").cast("date")).otherwise(F.coalesce(*whole, month, year))


#: Forms of page marks (numbered heading, name, chapter; each followed by a page number).
PAGE_MARKS = (
    r"^\d{1,2}\.\d{1,2}\.\d{1,2}[\s　]+[一-龥【】]+[ \t　]+\d{3,5}$",
    r"^[一-龥]+[ \t　]+\d{4,}$",
    r"^第[一二三四五六七八九十百\d]+章[ \t　]+[一-龥]+[ \t　]+\d+$",
)


def flag_navigation(text: Column) -> Column:
    """A page mark of at most 100 characters."""
    s = strip(text)
    return F.coalesce((F.length(s) <= 100) & reduce(lambda a, b: a | b, (s.rlike(m) for m in PAGE_MARKS)), F.lit(False))


#: What ends a sentence.
SENTENCE_ENDS = "\n。！？.!?"


def next_cut(text: str, at: int, size: int, overlap: int, most: float) -> tuple[int, int | None]:
    """End of the window that starts at `at`, and where the next one starts; None if this is the last."""
    end = at + size
    if end >= len(text):
        return len(text), None
    last = max(text.rfind(c, at + int(size * 0.8), end) for c in SENTENCE_ENDS)
    end = last + 1 if last >= 0 else end
    return end, max(end - min(overlap, int(size * most)), at + 1)


def cut_points(text: str, size: int, overlap: int, most: float) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text: one pass from left to right that looks at each window's final fifth."""
    out, at = [], None if not text or text.isspace() else 0
    while at is not None:
        end, after = next_cut(text, at, size, overlap, most)
        out.append((at, end))
        at = after
    return out


def sliding_chunks(text: Column, size: int = 500, overlap: int = 50, most: float = 0.3) -> Column:
    """Array of overlapping chunks: windows of `size` characters, cut after the last sentence end in their final fifth.

    The next window starts min(overlap, size * most) before the end of the last, and at least one character later.
    Short texts are one chunk, null and blank ones none. Where a window ends depends on all before it, so a text is cut
    by a loop over its windows, in Arrow batches; its work and memory grow with the length. For tables with very long
    texts see `operators.long_texts.chunk_documents`."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[t[a:b] for a, b in cut_points(t, size, overlap, most)] for t in texts], dtype=object)

    return cut(F.coalesce(text, F.lit("")))
