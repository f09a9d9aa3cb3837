"""Exact set-similarity join with DataFrame functions only: prefix, positional and length filters, then Jaccard.

Sets are arrays of 64-bit tokens. Tokens are put in one global order, rare before common (by the number of sets that
hold them, then by value); two sets that reach the threshold share one of the first tokens of each. Tokens of one set
only come first and are not indexed: they take places of the prefix, and so keep sets that have many of them apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_length(n: Column, threshold: float) -> Column:
    """So many of its rarest tokens a set must share one of, to reach the threshold with any other."""
    return (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int")


def least_shared(na: Column, nb: Column, threshold: float) -> Column:
    """So many tokens two sets of these sizes have to share."""
    return (na + nb) * (threshold / (1 + threshold)) - 1e-9


def of_like_length(na: Column, nb: Column, threshold: float) -> Column:
    """Length filter."""
    return (nb >= na * threshold - 1e-9) & (na >= nb * threshold - 1e-9)


def can_match(a: str, b: str, threshold: float) -> Column:
    """Length and positional filter on two postings with the same token."""
    return may_match(*({c: F.col(f"{s}.{c}") for c in ("n", "pos")} for s in (a, b)), threshold)


def may_match(a: Column | dict[str, Column], b: Column | dict[str, Column], threshold: float) -> Column:
    """The same on the columns n and pos of two structs."""
    most = F.least(a["n"] - a["pos"], b["n"] - b["pos"])
    return of_like_length(a["n"], b["n"], threshold) & (most >= least_shared(a["n"], b["n"], threshold))


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(token, c): the tokens that several sets hold, and how many do."""
    return sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1")


def postings(sets: DataFrame, keys: list[str], threshold: float, counts: DataFrame | None = None) -> DataFrame:
    """(keys, n, pos, token, c, before): the indexed part of each set's prefix in the order by rarity; pos counts from 0.

    c is the number of sets that hold the token, before the set's shared tokens that precede it in the order.
    `counts` are the sets' `shared_tokens`, if they are stored. `sets` (keys, tokens) is read twice. Counts are
    aggregated before they meet a token, so a token of very many sets is one row that Spark's join may split; what is
    gathered in one place is one set's tokens."""
    each = sets.select(*keys, F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = shared_tokens(sets) if counts is None else counts
    held = each.join(counts, "token").groupBy(*keys).agg(
        F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "token"))).alias("held")
    )
    alone = F.col("n") - F.size("held")
    held = held.select(*keys, "n", alone.alias("alone"), "held").where(prefix_length(F.col("n"), threshold) > F.col("alone"))
    prefix = F.slice("held", F.lit(1), prefix_length(F.col("n"), threshold) - F.col("alone"))
    return held.select(*keys, "n", "alone", prefix.alias("prefix")).select("*", F.posexplode("prefix").alias("i", "x")).select(
        *keys, "n", (F.col("alone") + F.col("i")).alias("pos"), F.col("x.token").alias("token"), F.col("x.c").alias("c"),
        F.slice("prefix.token", F.lit(1), F.col("i")).alias("before"),
    )


def meet_first(a: Column, b: Column) -> Column:
    """Whether the token of two postings is the first that their sets share, in the order by rarity.

    Sets that reach the threshold have that token in both prefixes, so each such pair meets first in just one list."""
    return ~F.arrays_overlap(a["before"], b["before"])


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def similar_pairs(sets: DataFrame, key: str, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) for every two different keys, a < b, whose sets reach the threshold. Empty sets match nothing."""
    posts = postings(sets, [key], threshold)
    pairs = (
        posts.alias("a").join(posts.alias("b"), "token")
        .where((F.col(f"a.{key}") < F.col(f"b.{key}")) & can_match("a", "b", threshold))
        .select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))
    )
    return verified_pairs(pairs, sets, key, threshold)


def verified_pairs(pairs: DataFrame, sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, likeness) of the different candidate pairs that reach the threshold."""
    left = sets.select(F.col(key).alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col(key).alias("b"), F.col("tokens").alias("tb"))
    found = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", likeness(F.col("ta"), F.col("tb")).alias("likeness"))
    return found.where(F.col("likeness") >= threshold - 1e-9)
