"""Document fingerprints by spot signatures, with DataFrame functions only.

A signature is an anchor (a common word, or the start of the text) with the chain of the next content words; other
anchors in between are skipped, however many there are. A document is the set of its signatures. Sets are compared by
Jaccard similarity, pruned by their lengths: partitions by set length are so wide that two sets which reach the
threshold lie in the same or in neighbouring ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.llm import set_join
from tenderspark.llm.common import forget, let, stored

#: Common words of English, French, German and Spanish.
ANCHORS = tuple(
    "the of and to in is that for it as was with be on by are this at or an a from he "
    "le la les de des du et un une que qui dans est pas par sur au en pour elle "
    "der die das und den von zu mit sich dem im ist nicht ein eine auf als auch "
    "el los las del se con una su al lo como por no".split()
)

#: Sets that may hold a signature whose list is joined set by set; longer lists are compared in blocks. Like the sizes of
#: blocks this changes the work, not the result.
LONG = 32
#: Sets and tokens of a block: bounds of a row.
BLOCK, BLOCK_TOKENS = 256, 1 << 17


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = 2) -> Column:
    """Sorted array of the different 64-bit signatures of a text; empty for null and for texts without letters or digits.

    A text without anchors still has the signature of its start. Words are runs of letters and digits, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    mark = lambda w: F.when(w.isin(*anchors), F.concat(F.lit("\n"), w, F.lit("\r"))).otherwise(w)
    # one group a line: anchors in a row, joined by tabs and closed by a return (none in the first group), then the
    # content words up to the next anchor, each after a blank
    marked = F.replace(F.array_join(F.transform(words, mark), " "), F.lit("\r \n"), F.lit("\t"))
    groups = F.split(marked, " ?\n")
    none = F.array().cast("array<bigint>")
    return let(groups, lambda g: F.when((F.size(g) == 1) & (g[0] == ""), none).otherwise(_of_groups(g, chain)))


def _of_groups(groups: Column, chain: int) -> Column:
    tail = lambda g: F.substring(g, F.locate("\r", g) + 1, F.length(g))
    rest = F.transform(groups, lambda g, i: F.when(g == "", g).when(i == 0, F.concat(F.lit(" "), g)).otherwise(tail(g)))
    both = F.struct(groups.alias("groups"), rest.alias("rest"))

    def each(x: Column) -> Column:
        def one(g: Column, i: Column) -> Column:
            # every group but the first and the last has a content word, so these hold the next `chain` of them
            after = F.concat(*(F.coalesce(F.get(x["rest"], i + k), F.lit("")) for k in range(chain + 1)))
            words = F.substring_index(after, " ", chain + 1)
            heads = F.when(i == 0, F.array(F.lit(""))).otherwise(F.split(F.substring_index(g, "\r", 1), "\t"))
            return let(words, lambda w: F.transform(heads, lambda a: F.xxhash64(a, w)))

        return F.sort_array(F.array_distinct(F.flatten(F.transform(x["groups"], one))))

    return let(both, each)


def as_text(signatures: Column) -> Column:
    """A fingerprint: the signatures in hexadecimal, joined by blanks."""
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.hex(s))), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets, 0 to 1; two empty sets are equal. Without overlap of their lengths nothing is intersected."""
    shared = F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.size(F.array_intersect(a, b)))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / F.greatest(union, F.lit(1))).cast("double")


def length_partition(size: Column, threshold: float) -> Column:
    """Partition of a set's length: bounds grow by 1 / threshold, so that similar sets lie at most one partition apart."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / math.log(1 / threshold)).cast("int")


def class_of(signatures: Column) -> Column:
    """The class of texts with equal sets of signatures."""
    return F.xxhash64(signatures)


def with_next(docs: DataFrame, id_col: str, text_col: str, made: list[Column], linked: DataFrame) -> DataFrame:
    """`docs` (id_col, text_col) with the columns `made` from them, and _next_<name> of text and made columns.

    The first of `made` is the set of signatures, `s`; of it come class_id, and n_links from the row of `linked`
    (id_col, class_id, n_links) with the same id and class, 0 where there is none. These few short rows go to the range
    of their id with the texts, so that texts are shuffled once.

    Next is the next row in descending order of the ids (nulls last, equal ids in the order of a hash of the text); the
    last one's next is the first. Rows are dealt to ranges of ids between quantiles, in each of which a window looks one
    row ahead; the first row of every range is copied to the end of the range above, and the very first to the end."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col), F.col(text_col), order.alias("_o"))
    cuts = rows.agg(F.percentile_approx("_o", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    ranged = lambda o: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < o)) if cuts else F.lit(0)
    # at most one row for each range
    heads = sorted(rows.groupBy(ranged(F.col("_o")).alias("r")).agg(F.max("_o").alias("m")).collect())
    ghosts = [(m, above) for (_, m), (above, _) in zip(heads, heads[1:])]
    if heads:
        ghosts.append((heads[-1]["m"], heads[0]["r"]))
    top = heads[-1]["m"] if heads else 0
    lowest = heads[0]["r"] if heads else 0
    extra = spark.createDataFrame(
        [(m, [above for k, above in ghosts if k == m]) for m in {k for k, _ in ghosts}], "_o long, _also array<int>"
    )
    rows = rows.join(F.broadcast(extra), "_o", "left").withColumn("_r", ranged(F.col("_o")))
    rows = rows.withColumn(
        "_to",
        F.explode(
            F.concat(
                F.array(F.struct(F.col("_r").alias("r"), F.lit(False).alias("ghost"))),
                F.coalesce(F.transform("_also", lambda a: F.struct(a.alias("r"), F.lit(True).alias("ghost"))), F.array()),
            )
        ),
    ).select(id_col, text_col, "_o", "_to.r", "_to.ghost", F.lit(None).cast("long").alias("_c"), F.lit(None).cast("long").alias("_n"))
    notes = linked.select(
        id_col, F.lit(None).cast("string").alias(text_col), order.alias("_o"), ranged(order).alias("r"), F.lit(False).alias("ghost"), F.col("class_id").alias("_c"), F.col("n_links").alias("_n")
    )
    rows = rows.union(notes).repartition(parts, "r").select("*", *made)
    rows = rows.withColumn("class_id", F.coalesce("_c", class_of(F.col("s"))))
    # a null id is no other id, though both may have the same place
    same = W.partitionBy("r", "_o", F.col(id_col).isNull(), "class_id")
    rows = rows.withColumn("n_links", F.coalesce(F.max("_n").over(same), F.lit(0))).where(F.col("_c").isNull()).drop("_c", "_n")
    ahead = W.partitionBy("r").orderBy("ghost", F.desc("_o"), F.xxhash64(text_col))
    names = [c for c in rows.columns if c not in (id_col, "_o", "r", "ghost", "class_id", "n_links")]
    return (
        rows.select("*", *(F.lead(c).over(ahead).alias(f"_next_{c}") for c in names))
        .where(~F.col("ghost"))
        .drop("_o", "r", "ghost")
    )


def edited_against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = 2, threshold: float = 0.8) -> DataFrame:
    """Per row: fingerprints of the text and of its edited text (the last third replaced by the start of the next one's
    text), the likeness of the first to the second and to the next document's; the class of texts with this
    fingerprint (class_id) and the number of other classes of the table whose likeness to it reaches the threshold
    (n_links; the pairs themselves are those of `links`).

    Null texts are empty; empty texts have the empty fingerprint, one class without links. One row per input row,
    repeated rows too; rows that share an id keep their own classes; other columns are ignored, whatever their names."""
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    linked = link_counts(texts, id_col, "t", threshold, chain)
    rows = with_next(texts, id_col, "t", [signatures(F.col("t"), chain=chain).alias("s")], linked)
    n = F.length("t").cast("long")
    cut = F.floor(n / 3)
    edited = F.concat(F.substring(F.col("t"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("_next_t"), F.lit(1), cut.cast("int")))
    rows = rows.select(id_col, n.alias("n_chars"), edited.alias("e"), "s", "_next_s", "class_id", "n_links")
    rows = rows.withColumn("es", signatures(F.col("e"), chain=chain))
    return rows.select(
        id_col,
        "n_chars",
        F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("es")).alias("edited_fingerprint"),
        jaccard(F.col("s"), F.col("es")).alias("near_edited"),
        jaccard(F.col("s"), F.col("_next_s")).alias("near_next"),
        "class_id",
        "n_links",
    )


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = 2) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of each row (id_col, set_id), and the pairs (a, b, likeness) of classes that reach
    the threshold. Texts with equal signature sets are one class. The list of pairs grows with the square of a group of
    near copies; `link_counts` does not make it."""
    members, pairs, met = _linked(docs, id_col, text_col, threshold, chain)
    of_blocks = met.select("a", F.explode("found").alias("f")).select("a", F.col("f.b").alias("b"), F.col("f.likeness").alias("likeness")).where("a < b")
    found = stored(pairs.union(of_blocks))
    forget(pairs, *met.blocks)
    return members, found


def _linked(docs: DataFrame, id_col: str, text_col: str, threshold: float, chain: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, pairs, met): the class of each row (id_col, set_id), stored; the pairs (a, b, likeness) of classes, a < b,
    that reach the threshold and share a signature of at most LONG classes, stored; of all other such pairs (a, found), where
    found holds some of the b and their likeness, in several rows for each a and for both ends of a pair.

    Sets are indexed by their rarest signatures within their length partition; a set meets those of its own and of the
    next partition that share one, and pairs that pass the length and positional filters are verified exactly. Two sets
    meet in the list of the first signature they share. Short lists are joined set by set, long ones block by block."""
    tokens = docs.select(F.col(id_col), signatures(F.col(text_col), chain=chain).alias("tokens"))
    keyed = tokens.select(id_col, class_of(F.col("tokens")).alias("set_id"), "tokens")
    # texts are read once; every step is stored, so that one step's shuffle files are gone before the next one's
    keyed = stored(keyed)
    sets = stored(keyed.groupBy("set_id").agg(F.any_value("tokens").alias("tokens")))
    members = stored(keyed.drop("tokens"))
    forget(keyed)
    counts = stored(set_join.shared_tokens(sets))
    posts = set_join.postings(sets, ["set_id"], threshold, counts)
    posts = stored(posts.withColumn("part", length_partition(F.col("n"), threshold)))
    forget(counts)
    short, long = posts.where(F.col("c") <= LONG), posts.where(F.col("c") > LONG)
    shorter = short.withColumn("slot", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    longer = short.withColumn("slot", F.col("part"))
    a, b = F.struct("a.n", "a.set_id"), F.struct("b.n", "b.set_id")
    first = set_join.meet_first({"before": F.col("a.before")}, {"before": F.col("b.before")})
    met = shorter.alias("a").join(longer.alias("b"), ["slot", "token"]).where((a < b) & set_join.can_match("a", "b", threshold) & first)
    pairs = stored(met.select(F.least("a.set_id", "b.set_id").alias("a"), F.greatest("a.set_id", "b.set_id").alias("b")))
    asked = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(long.select("set_id")).distinct()
    few = stored(sets.join(asked, "set_id", "left_semi"))
    forget(sets)
    found = stored(set_join.verified_pairs(pairs, few, "set_id", threshold))
    met = _block_matches(long, few, threshold)
    forget(posts, pairs, few)
    return members, found, met


def _block_matches(long: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, found): sets of the postings `long` with those (b, likeness) that they meet first in a token's list and match.

    A list of one token and length partition is dealt into blocks of about BLOCK sets and at most some BLOCK_TOKENS
    tokens, a row each. Every two blocks of a list, or of it and its neighbours, are one row, so rows grow with the blocks and
    a task holds two of them at a time; what is compared within them, set by set, still grows with the square of a list."""
    parts = stored(
        long.groupBy("token", "part").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    )
    member = F.struct("set_id", "n", "pos", "before", "tokens").alias("member")
    dealt = long.join(parts, ["token", "part"]).join(sets, "set_id")
    dealt = dealt.select("token", "part", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("block"), member)
    blocks = stored(dealt.groupBy("token", "part", "block").agg(F.collect_list("member").alias("members")))
    near = blocks.select("token", F.col("members").alias("own"), F.explode(F.array(*(F.col("part") + d for d in (-1, 0, 1)))).alias("part"))
    near = near.join(parts, ["token", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = near.join(blocks.hint("merge"), ["token", "part", "block"]).select("own", "members")

    def of_one(x: Column) -> Column:
        may = lambda y: (x["set_id"] != y["set_id"]) & set_join.may_match(x, y, threshold) & set_join.meet_first(x, y)
        like = lambda y: F.struct(y["set_id"].alias("b"), set_join.likeness(x["tokens"], y["tokens"]).alias("likeness"))
        found = F.filter(F.transform(F.filter("members", may), like), lambda m: m["likeness"] >= threshold - 1e-9)
        return F.struct(x["set_id"].alias("a"), found.alias("found"))

    matches = both.select(F.explode(F.filter(F.transform("own", of_one), lambda m: F.size(m["found"]) > 0)).alias("m")).select("m.a", "m.found")
    matches.blocks = (parts, blocks)
    return matches


def link_counts(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, chain: int = 2) -> DataFrame:
    """(id_col, class_id, n_links), stored: the rows of `docs` whose class is linked to others, each id and class once."""
    members, pairs, met = _linked(docs, id_col, text_col, threshold, chain)
    ends = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).withColumn("k", F.lit(1))
    ends = ends.union(met.select("a", F.size("found")))
    counts = ends.groupBy("set_id").agg(F.sum("k").alias("n_links"))
    counted = stored(members.distinct().join(counts, "set_id").select(id_col, F.col("set_id").alias("class_id"), "n_links"))
    forget(members, pairs, *met.blocks)
    return counted
