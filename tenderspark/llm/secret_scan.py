"""Secret scan with multipart credential linking.

A scan finds strong secrets (assignments, access keys, long hex runs) and the weak parts of multipart credentials:
identifiers, high-entropy secrets and endpoints. An interval join inside each text then links parts that lie within
one scope, and a weak part is reported only where its complements co-occur."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import packed, stored, unpacked, with_text_columns

#: Base kinds in the order in which spans that start together are listed, then the kinds that linking adds.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")

WEAK_ID = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})|(?:AKIA[A-Z0-9]{8,15}|ASIA[A-Z0-9]{8,})(?![A-Za-z0-9]))""",
    re.ASCII,
)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
WEAK_ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}""")

PART = "struct<kind:string,start:long,end:long>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong spans (kind, start, end) in code points, by start and then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _mixed(token: str) -> bool:
    """Digits, capitals and small letters together: what keys look like and words do not."""
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that count only with their complements; none overlaps a base span.

    An endpoint ends before a base span in it; the value of an identifier is not its own secret."""
    found = []
    if "=" in text or ":" in text or "AKIA" in text or "ASIA" in text:
        found += [("weak_id", *m.span()) for m in WEAK_ID.finditer(text)]
    if "://" in text:
        found += [("weak_endpoint", *m.span()) for m in WEAK_ENDPOINT.finditer(text)]
    if any(c in text for c in "0123456789"):
        found += [("weak_secret", *m.span()) for m in WEAK_SECRET.finditer(text) if _mixed(m[0])]
    ends, at, clear, named = base, 0, [], 0
    # at equal starts identifiers come first, as found
    for kind, a, b in sorted(found, key=lambda s: s[1]):
        while at < len(ends) and ends[at][2] <= a:
            at += 1
        if kind == "weak_id":
            named = b
        if kind == "weak_endpoint" and at < len(ends) and a < ends[at][1] < b:
            cut = WEAK_ENDPOINT.match(text, a, ends[at][1])
            b = cut.end() if cut else b
        if not any(x < b and a < y for _, x, y in ends[at : at + 4]) and not (kind == "weak_secret" and a < named):
            clear.append((kind, a, b))
    return clear


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(texts: list) -> list[list]:
    base, digests, weak = [], [], []
    for text in texts:
        own = base_spans(text or "")
        base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
        digests.append(hashlib.sha256(_listed(own).encode()).hexdigest())
        weak.append([{"kind": k, "start": a, "end": b} for k, a, b in weak_parts(text or "", own)])
    return [base, digests, weak]


def _linked(scanned: DataFrame, scope: int) -> DataFrame:
    """(row, linked): per row that has any, the weak parts whose complements start within `scope` code points.

    Interval join on bins of the scope's width: partners are first reduced to the smallest and largest start of each
    side (identifier, secret, endpoint) per bin, which decides exactly whether one lies within reach, so a text with
    very many parts yields three rows per part and no pairs."""
    side = (
        F.when(F.col("p.kind").isin("access", "weak_id"), "id")
        .when(F.col("p.kind") == "weak_endpoint", "endpoint")
        .otherwise("secret")
    )
    parts = (
        scanned.where(F.size("weak") > 0)
        .select("row", F.explode(F.concat("base", "weak")).alias("p"))
        .select("row", "p", side.alias("side"), F.floor(F.col("p.start") / scope).alias("bin"))
    )
    bins = parts.groupBy("row", "bin", "side").agg(F.min("p.start").alias("lo"), F.max("p.start").alias("hi"))
    asked = parts.where(F.col("p.kind").startswith("weak_")).withColumn(
        "bin", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1))
    )
    near = lambda s: F.max(F.coalesce(F.col("b.side") == s, F.lit(False)))
    met = (
        asked.alias("a")
        .join(bins.alias("b"), (F.col("a.row") == F.col("b.row")) & (F.col("a.bin") == F.col("b.bin")))
        .where((F.col("b.hi") >= F.col("a.p.start") - scope) & (F.col("b.lo") <= F.col("a.p.start") + scope))
        .groupBy(F.col("a.row").alias("row"), F.col("a.p").alias("p"))
        .agg(near("id").alias("id"), near("secret").alias("secret"), near("endpoint").alias("endpoint"))
    )
    needed = {
        "weak_id": F.col("secret"),
        "weak_secret": F.col("id"),
        "weak_endpoint": F.col("id") & F.col("secret"),
    }
    counts = reduce(lambda c, k: c.when(F.col("p.kind") == k, needed[k]), needed, F.when(F.lit(False), F.lit(False)))
    return met.where(counts).groupBy("row").agg(F.collect_list("p").alias("linked"))


def find_secrets(
    docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", scope: int = 200
) -> DataFrame:
    """One row per input row: the columns `keep`, then base and linked spans.

    base: array of (kind, start, end), strong spans; base_sha256; linked: the weak parts reported because
    complementary parts start within `scope` code points of them (an identifier needs a secret, a secret needs an
    identifier, an endpoint needs both). Null and empty texts have no spans; repeated rows are repeated; nulls in
    kept columns stay; other columns are ignored, whatever their names."""
    keep = ["doc_id"] if keep is None else keep
    scanned = with_text_columns(
        docs, keep, text_col, f"base array<{PART}>, base_sha256 string, weak array<{PART}>", lambda: _scan
    )
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()))
    return scanned.join(_linked(scanned, scope), "row", "left").select(
        *keep, "base", "base_sha256", F.coalesce("linked", F.expr(f"cast(array() as array<{PART}>)")).alias("linked")
    )


def all_spans():
    """Base and linked spans in one array, by start and then kind as listed."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(
        F.concat("base", "linked"),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["end"].alias("end")),
    )
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(F.element_at(order, s["at"].cast("int")).alias("kind"), s["start"], s["end"])
    )


def listed(spans):
    """Spans as kind:start:end joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def _mask(text: str | None, spans: list[tuple[int, int]], mark: str) -> str | None:
    if not spans or text is None:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", scope: int = 200, mark: str = "[secret]") -> DataFrame:
    """`docs` with every reported span replaced by `mark`; all other columns and all rows stay."""
    # the documents go along, so that nothing has to be joined back to them; only texts with spans are sent to be masked
    found = find_secrets(packed(docs), ["_doc"], f"_doc.{text_col}", scope).withColumn("_spans", all_spans())

    @F.pandas_udf("string")
    def mask(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_mask(t, list(zip(a, b, strict=True)), mark) for t, a, b in zip(texts, starts, ends, strict=True)])

    text = F.col("_doc").getField(text_col)
    hit = F.size("_spans") > 0
    masked = F.when(hit, mask(F.when(hit, text), F.col("_spans.start"), F.col("_spans.end"))).otherwise(text)
    return unpacked(found, docs.columns, **{text_col: masked})
