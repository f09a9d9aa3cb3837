"""The outcome book: a CSV ledger of past bids, and the cascade that finds a tender's outcome in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.functions.text import strip, strip_doc_suffix
from tenderspark.operators.names import first_related
from tenderspark.operators.steps import forget, stored

MONEY = "decimal(15,2)"
IDENTIFIERS = ("historical_tender_id", "tender_file_hash", "tender_file_name", "project_name")


SIGNALS = ("positive", "negative", "neutral")


def derive_win_signal(status: Column) -> Column:
    """won is positive, lost and failed negative, all else neutral."""
    s = F.lower(strip(status))
    return F.when(s == "won", "positive").when(s.isin("lost", "failed"), "negative").otherwise("neutral")


#: The ledger's columns by what they hold.
LISTS = ("loss_root_cause_tags", "win_breakthrough_tags", "key_win_factors", "key_loss_factors")
SCORES = ("score_received", "score_max", "technical_score", "price_score")
NOTES = ("expert_feedback_text", "bid_file_path", "notes")


def read_outcome_book(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of the ledger. Names and values are trimmed, empty is null; numbers, dates and lists that cannot be
    read are null or empty; rows without an identifier, or with an id that is no number, are dropped.

    Statuses are in small letters; a row that names no confidential level is `internal`; columns that the file lacks
    are null, empty lists or that default."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, quote='"', escape='"')
    raw = raw.toDF(*(c.replace("\ufeff", "").strip() for c in raw.columns))
    raw = raw.select(*(F.nullif(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns))
    numbers = ("our_bid_price", "winning_price", "total_bidders_count", "win_rank", "submission_date")
    for c in (*IDENTIFIERS, "our_bid_status", *numbers, *LISTS, *SCORES, *NOTES, "confidential_level"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    any_id = F.coalesce(*IDENTIFIERS).isNotNull()
    id_ok = F.col("historical_tender_id").isNull() | F.col("historical_tender_id").try_cast("long").isNotNull()
    date = F.coalesce(*(F.try_to_date("submission_date", f) for f in ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd")))
    as_list = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")).alias(c)
    typed = lambda c, kind: F.col(c).try_cast(kind).alias(c)
    return raw.where(any_id & id_ok).select(
        typed("historical_tender_id", "long"), "tender_file_hash", "tender_file_name", "project_name",
        F.lower("our_bid_status").alias("our_bid_status"), typed("our_bid_price", MONEY), typed("winning_price", MONEY),
        typed("total_bidders_count", "int"), typed("win_rank", "int"), date.alias("submission_date"),
        *map(as_list, LISTS), *(typed(c, "decimal(10,4)") for c in SCORES), *NOTES,
        F.coalesce("confidential_level", F.lit("internal")).alias("confidential_level"),
        derive_win_signal(F.col("our_bid_status")).alias("win_signal"),
    )


def hash_from_files(book: DataFrame, files: DataFrame) -> DataFrame:
    """`book` in which rows with a file name and no hash have the hash of the file of that name among `files` (path,
    hash), of several the one of the first path; a name that no file has keeps its null."""
    named = files.groupBy(F.element_at(F.split("path", "/"), -1).alias("tender_file_name")).agg(F.min_by("hash", "path").alias("_hash"))
    rows = book.join(named, "tender_file_name", "left")
    return rows.select(*(F.coalesce(c, "_hash").alias(c) if c == "tender_file_hash" else c for c in book.columns))


def resolve_outcome(tenders: DataFrame, book: DataFrame) -> DataFrame:
    """(id, level, win_signal) of each tender (id, hash, name) from the book (tender_id, hash, name, status, line).

    By id, then by hash, then by name as it is or without suffix, then by names of which one contains the other; of
    book rows with equal keys the last line counts; a tender found nowhere is neutral (level null). The first levels are
    equi-joins. Containment is tried only for tenders that they leave: of the book's names, as they are and without
    suffix, the one that came up first counts; no pair is listed.

    Both sides grow with the input and take much more memory than their shuffle files, by whose size Spark would choose
    a broadcast: the joins are merges. Each step is stored, so that only the shuffle files of one are on the disks."""
    signals = F.array(*map(F.lit, SIGNALS))  # known by their numbers from 1
    book = book.withColumn("signal", F.array_position(signals, derive_win_signal(F.col("status"))).cast("int")).withColumn("name", strip(F.col("name")))
    signal = F.max_by("signal", "line").alias("signal")

    def last(key: str) -> DataFrame:
        return book.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(signal)

    def hits(o: int, keys: Column, known: DataFrame) -> DataFrame:
        """(id, hit) of the tenders of which a key is in the book: the number `o` of that key, and the signal."""
        rows = asked.select("id", F.explode(keys).alias("key")).where("key is not null").join(known.hint("merge"), "key")
        return stored(rows.select("id", (F.lit(o * 4) + F.coalesce("signal", F.lit(0))).alias("hit")))

    # a key's place in the book: its first line, the name as it is before the one without suffix; and its signal behind that
    bare = F.nullif(strip_doc_suffix(F.col("name")), F.lit(""))
    forms = book.select("signal", "line", F.posexplode(F.array("name", bare)).alias("form", "key")).where("key is not null")
    since = [F.when(F.count_if(f) > 0, F.struct(F.min(F.when(f, F.col("line"))).alias("since"), F.lit(k).alias("form"))) for k, f in enumerate([F.col("form") == 0, F.col("form") == 1])]
    names = forms.groupBy("key").agg(signal, F.array_min(F.array(*since)).alias("place"))
    place = (F.col("place.since") * 2 + F.col("place.form")) * len(SIGNALS) + F.col("signal") - 1
    names = stored(names.select("key", "signal", place.cast("long").alias("place")))
    asked = tenders.withColumn("name", strip(F.col("name")))
    own, known = F.array("name"), names.select("key", "signal")
    plain = F.array_except(F.array(strip_doc_suffix(F.col("name"))), own)  # an equal one finds nothing else
    found_by = [hits(0, F.array(F.col("id").cast("string")), last("tender_id")), hits(1, F.array(F.col("hash").cast("string")), last("hash")), hits(2, own, known), hits(3, plain, known)]
    best = reduce(DataFrame.unionByName, found_by).groupBy("id").agg(F.min("hit").alias("hit"))
    level, number = F.least(F.floor(F.col("hit") / 4) + 1, F.lit(3)).cast("int"), F.col("hit") % 4
    found = stored(best.select("id", level.alias("level"), F.when(number > 0, signals[number - 1]).alias("signal")))
    forget(*found_by)
    left = stored(asked.where("length(name) > 0").join(found.hint("merge"), "id", "left_anti").select("id", "name"))
    first = first_related(left.select("name"), names.select("key", "place"))
    forget(names)
    close = left.join(first.hint("merge"), "name").select("id", F.lit(4).alias("level"), signals[F.pmod("place", F.lit(len(SIGNALS))).cast("int")].alias("signal"))
    every = found.unionByName(close)
    return tenders.select("id").join(every.hint("merge"), "id", "left").select("id", "level", F.coalesce("signal", F.lit("neutral")).alias("win_signal"))


def scan_documents(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("pdf", "docx")) -> DataFrame:
    """(path, length, hash) of all files of some kinds, PDF and Word, below a folder; the hash is SHA-256 of the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lower("path").rlike(rf"\.({'|'.join(kinds)})$")
    return files.where(wanted).select("path", "length", F.sha2("content", 256).alias("hash"))


def tender_defaults(rows: DataFrame) -> DataFrame:
    """Imported tenders are closed; a known price is revealed; names are cut to 500 characters, blank ones replaced."""
    name = F.nullif(strip(F.coalesce("name", F.lit(""))), F.lit(""))
    return rows.withColumns({
        "status": F.coalesce("status", F.lit("closed")),
        "price_revealed": F.col("winning_price").isNotNull(),
        "name": F.substring(F.coalesce(name, F.lit("未命名")), 1, 500),
    })


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks, partitioned by outcome; a job appends all of its rows or none."""
    chunks.write.mode("append").partitionBy("win_signal").parquet(path)
