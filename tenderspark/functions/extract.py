"""Column functions that read labelled fields, codes and certificates out of recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.functions import text as T
from tenderspark.functions.text import strip

FIELD = "struct<field:string,value:string,confidence:double>"

# Labels of each field in order of preference, prefixes that recognition leaves in values, what marks the
# next line as another label, and the confidence of each field.
LABELS = {
    "project_name": ("项目名称：",),
    "owner_unit": ("采购人：", "招标人：", "业主单位："),
    "budget_amount": ("预算金额：", "采购预算："),
    "region": ("地址：",),
    "bid_open_date": (
        "提交投标文件截止时间和开标时间：", "开标时间：", "投标截止时间：", "开标日期：", "投标截止日期：", "提交投标文件截止时间：",
        "递交投标文件截止时间：", "投标文件递交截止时间：", "截标时间：", "截标日期：", "投标文件提交截止时间：", "开标时间（北京时间）：",
        "投标截止时间（北京时间）：", "提交投标文件的截止时间：", "投标文件递交截止时间（北京时间）：",
    ),
}
PREFIXES = ("项目名称：", "采购人：", "招标人：", "业主单位：", "采购计划编号：", "采购项目编号：", "采购代理机构：", "预算金额：", "采购预算：", "地址：", "联系方式：")
OTHER_LABEL = ("信息", "名称", "编号", "方式", "金额", "地址", "电话", "联系人")
CONFIDENCE = {"project_name": 0.95, "owner_unit": 0.95, "budget_amount": 0.90, "region": 0.80, "plan_code": 0.95, "agency_project_code": 0.90, "bid_open_date": 0.75}


def _nonempty(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def labelled_value(text: Column, label: Column) -> Column:
    """What follows a label on its line, else on the next line, without blanks and without a label of its own; null
    without either, or if the next line begins like another label."""
    rest = F.substring_index(F.substring(text, F.instr(text, label) + F.length(label), F.length(text)), "\n", 2)
    lines = F.split(rest, "\n")
    here, below = strip(lines[0]), F.replace(strip(F.coalesce(F.get(lines, 1), F.lit(""))), F.lit(" "), F.lit(""))
    start = F.substring(below, 1, 4)
    foreign = (start != F.substring(label, 1, 4)) & start.rlike("|".join(OTHER_LABEL))
    value = F.when(here != "", F.replace(here, F.lit(" "), F.lit(""))).when(~foreign, below)
    value = F.regexp_replace(value, "^(" + "|".join(PREFIXES) + ")", "")
    return F.when(F.instr(text, label) > 0, F.nullif(strip(value), F.lit("")))


def extract_labelled_fields(pages: DataFrame, labels: dict = LABELS) -> DataFrame:
    """(doc, page, field, value, confidence) of pages (doc, page, text): labelled fields, codes and the project type.

    The project name only from page 1, of five characters at least; owners have two, budgets are whole numbers above zero,
    regions end at their city or before a telephone number, and dates are read in any loose form."""
    t = F.col("text")
    said = F.struct(*(F.transform(F.array(*map(F.lit, words)), lambda x: labelled_value(t, x)).alias(f) for f, words in labels.items()))
    first = lambda f, n=1: F.get(F.filter(f"_said.{f}", lambda v: F.length(v) >= n), 0)
    # each step is a projection of its own, so that later ones read what the first has found
    rows = pages.withColumn("_said", said).withColumns({
        "_number": F.replace(F.regexp_extract(first("budget_amount"), "([0-9][0-9,.]{2,20})", 1), F.lit(","), F.lit("")),
        "_where": F.when(F.length(first("region")) >= 4, first("region")), "_day": first("bid_open_date"),
        "_codes": extract_plan_codes(t), "_kind": T.classify_project_type(t),
    })
    city = _nonempty(F.regexp_extract("_where", r"(广东省[^\s\d\-A-Za-z]{0,15}市)", 1))
    rows = rows.withColumn("_place", F.coalesce(city, strip(F.regexp_replace("_where", r"[\d\-\sA-Za-z]{4,}$", ""))))
    number, name = F.col("_number"), first("project_name")
    values = {
        "project_name": F.when((F.col("page") == 1) & (F.length(name) >= 5), name),
        "owner_unit": first("owner_unit", 2),
        "budget_amount": F.when(number.try_cast("double") > 0, F.floor(number.try_cast("decimal(38,6)")).cast("string")),
        "region": F.when((F.length("_place") >= 4) & ~F.startswith(F.col("_place"), F.lit("采购")), F.col("_place")),
        "plan_code": F.col("_codes.plan_code"),
        "agency_project_code": F.col("_codes.project_code"),
        "bid_open_date": T.parse_loose_date(F.col("_day")).cast("string"),
    }
    found = [F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(CONFIDENCE[f]).alias("confidence")) for f, v in values.items()]
    found.append(F.struct(F.lit("project_type").alias("field"), F.col("_kind.type").alias("value"), F.col("_kind.confidence").alias("confidence")))
    return rows.select("doc", "page", F.inline(F.array(*found))).where("value is not null")


# A plan's code in one piece and in three, the codes of a project by their label, what is no code.
PLAN_CODE = r"采购计划编号[：:\s]*([A-Z0-9]{4,}-[0-9]{4}-[0-9]{5,})"
PLAN_CODE_IN_PARTS = r"采购计划编号[：:\s]*([0-9]{4,})\s*[-－]\s*([0-9]{4})\s*[-－]\s*([0-9]{5,})"
PROJECT_CODES = (
    r"采购项目编号[：:\s]*([A-Z]{2,}[-_]?[A-Z0-9]+[-_]?[0-9]{4,}号?)",
    r"(?<!采购)项目编号[：:\s]*([A-Z0-9]{4,}[-_]?[0-9]{3,}号?)",
)
ONLY_DIGITS = r"^[0-9]{6,}$"

# Field, pattern and confidence of what a business licence and a certificate hold.
LICENSE_FIELDS = (
    ("credit_code", "([0-9A-Z]{18})", 0.95),
    ("company_name", r"([^\n]+?有限公司)", 0.85),
    ("registered_capital", r"注册[资金本]*\s*([0-9,.]+)\s*(?:万?元)?", 0.80),
    ("address", r"(?:地址|住所)\s*[:：]?\s*([^\n]+)", 0.75),
)
CERT_FIELDS = (
    ("cert_name", r"(食品经营许可证|营业执照|ISO\d+.*认证|证书)", 0.80),
    ("cert_number", r"(?:证书编号|证号|编号)\s*[:：]?\s*([A-Z0-9]{10,})", 0.85),
)


def extract_plan_codes(text: Column) -> Column:
    """(plan_code, project_code): a code in one piece or in three parts; codes of digits only are none."""
    s = F.regexp_replace(text, " (?=[一-鿿])", "")
    first = lambda p: _nonempty(F.regexp_extract(s, p, 1))
    parts = F.when(s.rlike(PLAN_CODE_IN_PARTS), F.concat_ws("-", *(F.regexp_extract(s, PLAN_CODE_IN_PARTS, k) for k in (1, 2, 3))))
    usable = lambda c: F.when(~c.rlike(ONLY_DIGITS), c)
    return F.struct(F.coalesce(first(PLAN_CODE), parts).alias("plan_code"), F.coalesce(*(usable(first(p)) for p in PROJECT_CODES)).alias("project_code"))


def extract_license_fields(text: Column, image_type: Column) -> Column:
    """Array of (field, value, confidence) of a business licence or a certificate; what is not found is left out."""
    def row(name: str, pattern: str, sure: float) -> Column:
        value = _nonempty(F.regexp_extract(text, pattern, 1))
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("field"), value.alias("value"), F.lit(sure).alias("confidence")))

    licence, cert = (F.array(*(row(*f) for f in fields)) for fields in (LICENSE_FIELDS, CERT_FIELDS))
    return F.array_compact(F.when(image_type == "license", licence).when(image_type == "cert", cert).otherwise(F.array().cast(f"array<{FIELD}>")))


# In order, keywords of the requirement's type or title and the code they give.
REQUIREMENT_CODES = (
    ("type", ("军采", "外资", "保密"), "MILITARY_SPECIAL"),
    ("type", ("实质性",), "SUBSTANTIAL_CLAUSE"),
    ("title", ("★",), "SUBSTANTIAL_CLAUSE"),
    ("title", ("食品", "卫生"), "FOOD_OPERATION_LICENSE"),
    ("title", ("营业",), "BUSINESS_LICENSE"),
    ("title", ("质量", "iso"), "ISO_9001"),
)


def normalise_requirements(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """(project, cert_code, cert_name, is_mandatory) of the requirement objects in a JSON list; other items are skipped.

    A missing title falls back to cert_name; the code follows from type and title; all are mandatory."""
    item = "array<struct<title:string,cert_name:string,type:string>>"
    items = F.from_json(F.get_json_object(json_col, "$.qualifications"), item)
    each = rows.select("project", F.explode(items).alias("q")).where("q is not null and (q.title is not null or q.cert_name is not null or q.type is not null)")
    title = F.coalesce(F.nullif("q.title", F.lit("")), "q.cert_name", F.lit(""))
    kind = F.coalesce(strip(F.col("q.type")), F.lit("通用法定资质"))
    code = F.lit("OTHER_CERT")
    for where, words, name in reversed(REQUIREMENT_CODES):
        source = kind if where == "type" else F.lower(title)
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(source, F.lit(w))
        code = F.when(hit, name).otherwise(code)
    return each.select("project", code.alias("cert_code"), title.alias("cert_name"), F.lit(True).alias("is_mandatory"))


def classify_image(width: Column, height: Column) -> Column:
    """Landscape over 800 wide is a licence, over 400 a certificate, all else other."""
    wide = width > height
    return F.when(wide & (width > 800), "business_license").when(wide & (width > 400), "certification").otherwise("other")


def chunk_by_dimensions(docs: DataFrame, names: tuple[str, ...], size: int = 600, overlap: int = 80) -> DataFrame:
    """(doc, seg, k, dimension, body): overlapping chunks of what follows each dimension name up to the next one.

    A name counts at the start and behind a blank, a line end or an opening bracket; of several at one place the last
    listed. What stands before the first name is left out; a text without any is one segment of no dimension."""
    any_name = "|".join(reversed(names))
    pattern = rf"(?<=^|[\n\r\t （(])(?=(?:{any_name}))"
    name = lambda part: _nonempty(F.regexp_extract(part, f"^({any_name})", 1))
    # a text is looked at once: tested beside its parts, it would be read again for each of them
    named = F.transform(F.split("text", pattern), lambda part, seg: F.struct(seg.alias("seg"), F.lit(True).alias("hit"), name(part).alias("dimension"), part.alias("part")))
    whole = F.array(F.struct(F.lit(0).alias("seg"), F.lit(False).alias("hit"), F.lit(None).cast("string").alias("dimension"), F.col("text").alias("part")))
    parts = docs.select("doc", F.inline(F.when(F.col("text").rlike(pattern), named).otherwise(whole)))
    parts = parts.where("not hit or dimension is not null")
    inner = strip(F.substring(F.col("part"), F.length("dimension") + 1, F.length("part")))
    body = F.when(F.col("hit"), inner).otherwise(F.col("part"))
    return parts.select("doc", "seg", "dimension", F.posexplode(T.sliding_chunks(body, size, overlap)).alias("k", "body"))
