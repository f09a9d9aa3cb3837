"""Insert-or-replace on snapshots, and deduplication against a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """The new snapshot: rows of `updates` replace those of `target` with equal keys; of several the largest `newest`.

    Columns that `updates` lacks keep the target's values. Plain files have no row-level merge, so the caller writes
    the result as the next snapshot."""
    last = updates
    if newest:
        order = W.partitionBy(*keys).orderBy(F.desc(newest), *[F.desc(c) for c in updates.columns if c not in keys])
        last = updates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    given = [c for c in last.columns if c in target.columns and c not in keys]
    fresh = last.select(*keys, F.struct(*given).alias("_new"))
    both = target.join(fresh, keys, "full_outer")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in given else F.col(c)
    return both.select(*(pick(c).alias(c) for c in target.columns))


def new_by_content(files: DataFrame, ledger: DataFrame, key: str = "hash", order: str = "path") -> DataFrame:
    """Files whose content hash is neither in the ledger nor that of an earlier file."""
    fresh = files.join(ledger.select(key), key, "left_anti")
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    return fresh.withColumn("_n", rank).where("_n = 1").drop("_n")


def dedup_images(images: DataFrame) -> DataFrame:
    """Images (doc, page, idx, content): equal contents within a document once, on their first page."""
    rank = F.row_number().over(W.partitionBy("doc", "hash").orderBy("page", "idx"))
    return images.withColumn("hash", F.md5("content")).withColumn("_n", rank).where("_n = 1").select("doc", "page", "idx", "hash")


def purge(parents: DataFrame, children: dict[str, DataFrame], key: str = "project") -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(kept parents, kept children, counts): soft-deleted parents go, and with them their rows in every child table."""
    gone = parents.where("deleted").select(F.col("id").alias(key))
    kept = {name: df.join(gone, key, "left_anti") for name, df in children.items()}
    counts = None
    for name, df in children.items():
        n = df.join(gone, key, "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("table"), "removed")
        counts = n if counts is None else counts.unionByName(n)
    return parents.where(~F.col("deleted")), kept, counts
