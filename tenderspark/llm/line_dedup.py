"""Line deduplication by exact set-similarity join, with DataFrame functions only.

A line's tokens are its shingles of five words. Lines with equal words are one class. A first index holds the prefixes
of all classes in the order of the tokens' hashes, which needs no counts; only tokens that several classes share there
matter, and only classes that hold enough of them. Where few classes meet in a token, these are compared. Classes that meet in a long list are indexed once more,
by the rarity of all their tokens among them, which keeps variants of one text apart that differ in enough places.
Candidates pass length and positional filters and are verified by Jaccard similarity; a line that matches an earlier
one, in order of document id and position, is removed. A line of fewer than five words has no shingle: with `short` it
goes if it equals an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.llm import set_join
from tenderspark.llm.common import forget, packed, stored, unpacked

CLASS = ["c1", "c2"]
#: Tokens that two similar sets share in the prefixes of the first index, where they have so many.
MET = 3
#: Classes that may meet in a token of the first index; longer lists are ordered by rarity. Changes the work, not the result.
LONG = 16


def shingles(words: str, size: int) -> Column:
    """Different 64-bit hashes of every `size` words in a row of the array column `words`; of all words, if there are fewer.

    Each word is hashed once; a shingle's hash is that of its words' hashes, which are bound for the inner function by an
    array of one element."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    hashes = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    at = lambda h: F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
    return F.array_distinct(F.get(F.transform(hashes, at), 0))


def normalised(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with the text column lower-cased and runs of blanks in it as one."""
    docs = docs.withColumn(text_col, F.lower(text_col))
    odd = F.lit(False)
    for blank in ("  ", "\t", "\r", "\f", "\x0b"):
        odd = odd | F.contains(F.col(text_col), F.lit(blank))
    return docs.withColumn(text_col, F.when(odd, F.regexp_replace(text_col, r"[ \t\r\f\x0b]+", " ")).otherwise(F.col(text_col)))


def _met(n: Column, threshold: float) -> Column:
    return F.least(F.lit(MET), F.ceil(n * F.lit(threshold) - 1e-9)).cast("int")


def _head_length(n: Column, threshold: float) -> Column:
    """Prefixes so long that similar sets share MET tokens in them, not one; most lines that share one go by that."""
    return set_join.prefix_length(n, threshold) - 1 + _met(n, threshold)


def _class() -> list[Column]:
    """Two hashes that name the class of equal lines."""
    return [F.xxhash64("line").alias("c1"), F.hash("line").alias("c2")]


def _place() -> Column:
    """Orders lines as id (null last), row, position."""
    return F.struct(F.col("id").isNull().alias("z"), "id", "row", "pos")


def _pair(*sides: str) -> list[Column]:
    return [F.col(f"{s}.{c}").alias(f"{s}{c}") for s in sides for c in CLASS]


def _few_meet(posts: DataFrame, crowded: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs that meet in short lists, but for those of two crowded classes.

    All tokens up to the smaller of both last ones are in both prefixes, so those of that side that are not shared are
    known, and with them the most that the whole sets can share."""
    few = posts.where(F.col("k") <= LONG).join(crowded.withColumn("crowded", F.lit(True)), CLASS, "left")
    a, b = F.struct("a.c1", "a.c2"), F.struct("b.c1", "b.c2")
    met = few.alias("a").join(few.alias("b"), "token").where(
        (a < b) & (F.col("a.crowded").isNull() | F.col("b.crowded").isNull()) & set_join.of_like_length(F.col("a.n"), F.col("b.n"), threshold)
    )
    pairs = met.select(*_pair("a", "b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.last").alias("la"), F.col("b.last").alias("lb"))
    pairs = pairs.groupBy(*(c for c in pairs.columns)).agg(F.count("*").alias("m"))
    bound = lambda n: n - _head_length(n, threshold) + F.col("m")
    most = F.least("na", "nb", F.when(F.col("la") <= F.col("lb"), bound(F.col("na"))).otherwise(bound(F.col("nb"))))
    return pairs.where(most >= set_join.least_shared(F.col("na"), F.col("nb"), threshold)).select("ac1", "ac2", "bc1", "bc2")


def removed_lines(
    docs: DataFrame, id_col: str, text_col: str = "text", threshold: float = 0.8, size: int = 5, short: bool = False
) -> DataFrame:
    """(row, pos) of each line of `docs` (with a unique long `row`) that matches an earlier line.

    Earlier: smaller id (null last), then smaller row, then smaller position. Lines of fewer than `size` words go with
    `short` if they equal an earlier one, else they are left alone; blank ones always are. `docs` must give the same
    rows whenever it is read (files or a stored table)."""
    own = docs.select("row", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = normalised(own, "text").select("row", "id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("row", "id", "pos", F.trim("line").alias("line")).where("line <> ''")
    lines = lines.select("row", "id", "pos", *_class(), F.split("line", " ").alias("w"))
    lines = lines if short else lines.where(F.size("w") >= size)
    heads = lines.select("row", "id", "pos", *CLASS, F.when(F.size("w") >= size, shingles("w", size)).alias("t"))
    heads = heads.select("row", "id", "pos", *CLASS, F.size("t").alias("n"), F.sort_array("t").alias("t"))
    heads = stored(heads.select("row", "id", "pos", *CLASS, "n", F.slice("t", F.lit(1), _head_length(F.col("n"), threshold)).alias("p")))

    # most tokens are in one class only; both sides of a join on tokens read one shuffle, and what is left of them is hashed, not sorted
    each = heads.select("c1", F.explode("p").alias("token")).repartition("token")
    shared = each.groupBy("token").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo <> hi").select("token")
    loose = stored(each.join(shared.hint("shuffle_hash"), "token").select("c1", "token").distinct())
    # the smaller of two similar sets, n * threshold at least, sets how many tokens they share here
    held = loose.groupBy("c1").agg(F.count("*").alias("held"))
    ends = heads.where("n > 0").select(*CLASS, "n", F.element_at("p", -1).alias("last"), _place().alias("at")).join(held.hint("shuffle_hash"), "c1")
    ends = ends.where(F.col("held") >= _met(F.ceil(F.col("n") * F.lit(threshold) - 1e-9), threshold))
    classes = stored(ends.groupBy(*CLASS).agg(F.min("n").alias("n"), F.min("last").alias("last"), F.min("at").alias("at")))
    every = loose.join(classes.drop("at").hint("shuffle_hash"), "c1").repartition("token")
    met = every.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    posts = stored(every.join(met.hint("shuffle_hash"), "token"))
    crowded = stored(posts.where(F.col("k") > LONG).select(*CLASS).distinct())
    pairs = stored(_few_meet(posts, crowded, threshold))
    forget(loose, posts)

    # a class stands at its first line; the tokens of those that may match are made once more, from the texts
    sides = [pairs.select(*(F.col(f"{s}{c}").alias(c) for c in CLASS)) for s in "ab"]
    asked = stored(crowded.union(sides[0]).union(sides[1]).distinct())
    first = stored(classes.join(asked, CLASS).select(*CLASS, "at"))
    by_row = stored(first.groupBy(F.col("at.row").alias("row")).agg(F.collect_list("at.pos").alias("at")))
    texts = normalised(own.join(by_row.hint("shuffle_hash"), "row"), "text").select("row", "id", F.split("text", "\n").alias("lines"), F.explode("at").alias("pos"))
    texts = texts.select(_place().alias("at"), F.trim(F.get("lines", "pos")).alias("line")).select("at", *_class(), F.split("line", " ").alias("w"))
    sets = stored(texts.select(*CLASS, "at", shingles("w", size).alias("tokens")))

    def verified(pairs: DataFrame) -> DataFrame:
        """The later class of each pair that reaches the threshold."""
        side = lambda s: sets.select(*(F.col(c).alias(f"{s}{c}") for c in CLASS), F.col("at").alias(f"at_{s}"), F.col("tokens").alias(f"tokens_{s}"))
        both = pairs.join(side("a"), ["ac1", "ac2"]).join(side("b"), ["bc1", "bc2"])
        hit = both.where(set_join.likeness(F.col("tokens_a"), F.col("tokens_b")) >= threshold - 1e-9)
        later = F.when(F.col("at_a") > F.col("at_b"), F.struct(F.col("ac1").alias("c1"), F.col("ac2").alias("c2"))).otherwise(
            F.struct(F.col("bc1").alias("c1"), F.col("bc2").alias("c2"))
        )
        return hit.select(later.alias("x")).select("x.c1", "x.c2").distinct()

    # Most members of a large group match the first line of one of their lists: one candidate for each posting. Only
    # lines that do not are compared with all earlier lines of their lists.
    ranked = set_join.postings(sets.join(crowded, CLASS, "left_semi"), CLASS, threshold).drop("c", "before")
    ranked = stored(ranked.join(first, CLASS))
    leads = ranked.groupBy("token").agg(F.min(F.struct("at", *CLASS, "n", "pos")).alias("l")).select("token", "l.*")
    earlier = (F.col("b.at") < F.col("a.at")) & set_join.can_match("a", "b", threshold)
    quick = stored(verified(ranked.alias("a").join(leads.alias("b"), "token").where(earlier).select(*_pair("a", "b")).distinct()))
    rest = ranked.join(quick, CLASS, "left_anti")
    slow = verified(rest.alias("a").join(ranked.alias("b"), "token").where(earlier).select(*_pair("a", "b")).distinct())
    near = stored(verified(pairs).union(quick).union(slow).distinct())
    forget(classes, pairs, asked, by_row, sets, ranked, quick, crowded)

    # a line goes if it is not its class's first, or if the class matches an earlier one
    repeated = heads.groupBy(*CLASS).agg(F.min(_place()).alias("start"), F.count("*").alias("k")).where("k > 1").select(*CLASS, "start")
    later = heads.select(*CLASS, "row", "pos", _place().alias("at")).join(repeated.hint("merge"), CLASS).where("at <> start")
    gone = stored(later.select("row", "pos").union(first.join(near, CLASS, "left_semi").select("at.row", "at.pos")))
    forget(heads, first, near)
    return gone


def report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, short: bool = False
) -> DataFrame:
    """(id_col, n_lines, n_removed, removed): for each row, how many lines its text has and which go (from 0).

    A null text has no lines, an empty one has one; repeated rows are judged like any other, so only the first keeps
    its lines; other columns are ignored, whatever their names."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    gone = removed_lines(own, "id", "text", threshold, size, short).groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("removed"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    found = own.select("id", "row", n_lines.alias("n_lines")).join(gone, "row", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select(F.col("id").alias(id_col), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_later_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, short: bool = False
) -> DataFrame:
    """`docs` with the later of matching lines removed from the texts; rows that lose lines and have none but blank ones left are dropped.

    Rows that lose nothing, null texts among them, stay as they are."""
    own = packed(docs).withColumn("_row", F.monotonically_increasing_id())
    text = F.col("_doc").getField(text_col)
    keyed = own.select(F.col("_doc").getField(id_col).alias("id"), text.alias("text"), F.col("_row").alias("row"))
    gone = removed_lines(keyed, "id", "text", threshold, size, short).groupBy("row").agg(F.collect_set("pos").alias("_gone"))
    both = own.join(gone.withColumnRenamed("row", "_row"), "_row", "left")
    left = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("_gone", i))
    both = both.withColumn("_left", F.when(F.col("_gone").isNotNull(), left))
    kept = both.where(F.col("_left").isNull() | F.exists("_left", lambda line: line.rlike(r"[^ \t\r\f\x0b]")))
    new = F.when(F.col("_left").isNull(), text).otherwise(F.array_join("_left", "\n"))
    return unpacked(kept, docs.columns, **{text_col: new})
