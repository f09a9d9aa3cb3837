"""Filter interaction audit: what every filter of a cascade removes, in every order, and its Shapley value.

A document is the set of filters it fails. For each subset of filters that may already have run (a state of the subset
lattice) and each filter that may run next (an edge), the audit counts what that edge removes. Counting the orders that
reach a state and those that leave its successor weights the edges for the Shapley value; the steps of each order are
read from the same edges."""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import stored, with_text_columns

#: The filters in the order of their bits. A to D look at a text alone, E at the whole table.
FILTERS = "ABCDE"
SPECIAL = b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Tasks over which rows without an id are spread; they join with nothing.
SPREAD = 997


def text_failures(text: str | None) -> int:
    """Bits 1, 2, 4, 8 of the filters A to D that a whole text fails; a null text counts as empty.

    A: under 200 words. B: distinct words are under half of the words. C: capital letters A-Z are over 3 % of the code
    points. D: one of ``#$%&*|`` occurs. Words are runs without blanks and the control characters 9 to 13."""
    text = text or ""
    data = text.encode()
    words = data.split()
    few, same = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return few | same << 1 | (100 * capitals > 3 * len(text)) << 2 | any(c in data for c in SPECIAL) << 3


def _look(texts: list) -> list[list]:
    return [[text_failures(t) for t in texts], [hashlib.sha256((t or "").encode()).digest() for t in texts]]


def failures(
    docs: DataFrame,
    labels: DataFrame,
    part: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    good_col: str = "quality",
    toxic_col: str = "toxic",
) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of each part fail exactly the filters of `mask`.

    E fails a text that equals, byte for byte by SHA-256, the text of a document with a smaller id, whether or not
    another filter removes that one. Null and empty texts are equal; a row without an id neither fails E nor makes
    another fail it, and has no label; rows that repeat count each time; of several labels of one id any 1 counts.
    Whole texts of any length are read, other columns are ignored, and an empty table gives no rows.

    Texts never leave the scan: ids, digests and masks do. The smallest id of each digest is joined back by digest and
    id together, so a text with very many copies is no hot key; neither are rows without an id."""
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), F.col(text_col).alias("t"))
    rows = with_text_columns(rows, ["id", "part"], "t", "mask int, digest binary", lambda: _look)
    rows = stored(rows.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    first = rows.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.coalesce(F.col(good_col) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(toxic_col) == 1, F.lit(False))).alias("toxic"))
        .withColumn("spread", F.lit(0))
    )
    apart = F.when(F.col("id").isNull(), F.pmod(F.hash("digest"), F.lit(SPREAD))).otherwise(0)
    joined = rows.withColumn("spread", apart).join(known, ["id", "spread"], "left").join(first, ["digest", "id"], "left")
    repeated = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int") * 16
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return joined.groupBy("part", F.col("mask").bitwiseOR(repeated).alias("mask"), flag("good"), flag("toxic")).agg(F.sum("n").alias("n"))


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """For each state (a set of filters as bits): how many orders reach it from none, and leave it to all."""
    full = (1 << filters) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(1, full + 1):
        reach[state] = sum(reach[state & ~(1 << f)] for f in range(filters) if state >> f & 1)
    for state in range(full - 1, -1, -1):
        leave[state] = sum(leave[state | 1 << f] for f in range(filters) if not state >> f & 1)
    return reach, leave


def edges(counted: DataFrame, filters: int) -> DataFrame:
    """(part, state, bit, weight, and the counts): one row for each edge of the subset lattice in each part.

    `weight` is the number of orders that take the edge. A part has at most 4 rows for each mask and filters * 2 **
    (filters - 1) edges, whatever the number of documents."""
    reach, leave = path_counts(filters)
    steps = [(s, 1 << f, reach[s] * leave[s | 1 << f]) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]
    lattice = counted.sparkSession.createDataFrame(steps, "state int, bit int, weight long")
    pairs = counted.join(F.broadcast(lattice), F.lit(True))  # each mask with each of the at most 192 edges
    hits = lambda c: F.col("mask").bitwiseAND(F.col(c)) != 0
    total = lambda rule, name: F.sum(F.when(rule, F.col("n")).otherwise(0)).alias(name)
    lost = hits("bit") & ~hits("state")
    return pairs.groupBy("part", "state", "bit", "weight").agg(
        total(~hits("bit") & ~hits("state"), "kept"),
        total(lost, "removed"),
        total(hits("bit") & hits("state"), "redundant"),
        total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(lost & F.col("good"), "good_lost"),
        total(lost & F.col("toxic"), "toxic_lost"),
    )


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order.

    `counted` holds (part, mask, good, toxic, n) with bit k of `mask` for failing ``filters[k]``, as `failures` gives
    it; zeros are listed too. At most six filters, so that a part has at most 4,320 rows. An empty table gives none."""
    if not 1 <= len(filters) <= 6:
        raise ValueError("between one and six filters")
    edge = edges(counted, len(filters))
    shapley = edge.groupBy("part", "bit").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    bit = {f: 1 << k for k, f in enumerate(filters)}
    orders = ["".join(o) for o in permutations(filters)]
    assert len(orders) == factorial(len(filters))
    walks = [(o, k + 1, sum(bit[f] for f in o[:k]), bit[f]) for o in orders for k, f in enumerate(o)]
    walk = counted.sparkSession.createDataFrame(walks, "filter_order string, step int, state int, bit int")
    found = edge.join(shapley, ["part", "bit"]).join(F.broadcast(walk), ["state", "bit"])
    return found.select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in (*COUNTS, "shapley")))
