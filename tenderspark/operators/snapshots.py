"""Tables as versions of bucketed Parquet files: merges that rewrite only what changed, imports that show all or nothing.

A table's rows lie in buckets by a hash of its keys, each bucket in a folder of its own. A version is a small file that
names the folder of every bucket of every table; it is put in its place last, by a rename. So a reader sees whole
versions only, buckets that a commit does not touch are shared between versions, and what a failed commit has written
is never named."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.operators.merge import upsert


def _files(spark: SparkSession, path: str):
    """(file system, path) of a Hadoop path, so that any store that Spark reads will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that were committed, oldest first."""
    fs, at = _files(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _version(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/{number:09d}.json", wholetext=True).first()[0])


def read_table(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the newest if none is named; KeyError without such a table."""
    known = versions(spark, root)
    if not known:
        raise KeyError(table)
    return _read(spark, _version(spark, root, known[-1] if version is None else version)[table])


def _read(spark: SparkSession, held: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = spark.createDataFrame([], held["schema"]).schema
    folders = [held["folders"][b] for b in (held["folders"] if buckets is None else buckets) if b in held["folders"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def commit(spark: SparkSession, root: str, changes: dict[str, tuple[DataFrame, list[str]]], newest: dict[str, str] | None = None, buckets: int = 64) -> int:
    """Merges changes (rows, keys) into their tables, all of them in one new version; its number.

    Rows replace those of equal keys (of several the one of the largest `newest` column of the table, which is not
    stored); other rows are added. Only buckets that hold a changed key are read and written. A new table takes its
    columns from its first rows and `buckets` buckets for good; later rows may have fewer columns, the others keep their
    values. Null keys equal nothing. A table without changed rows stays as it is, a new one without rows is empty.

    If a commit fails, or another one takes the number first (FileExistsError), the version before stays the newest."""
    known = versions(spark, root)
    now = _version(spark, root, known[-1]) if known else {}
    number, run = (known[-1] + 1 if known else 0), uuid.uuid4().hex
    for table, (rows, keys) in changes.items():
        order = (newest or {}).get(table)
        held = now.get(table)
        if held is None:
            stored = rows.drop(order) if order else rows
            held = {"keys": keys, "buckets": buckets, "folders": {}, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)}
        if keys != held["keys"]:
            raise ValueError(f"{table} has the keys {held['keys']}")
        own = bucket_of(keys, held["buckets"])
        touched = [str(r[0]) for r in rows.select(own.alias("b")).distinct().collect()]  # a number for each bucket, at most
        folder = f"{root}/data/{table}/{run}"
        old = _read(spark, held, touched)
        merged = upsert(old, rows.select(*(F.col(c).alias(c) for c in rows.columns)), keys, order).withColumn("_bucket", own)
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        # a bucket keeps its rows, so each one that was touched has a folder
        now[table] = held | {"folders": held["folders"] | {b: f"{folder}/_bucket={b}" for b in touched}}
    fs, at = _files(spark, f"{root}/versions/{number:09d}.json")
    _, draft = _files(spark, f"{root}/versions/.{run}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(now).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(str(at))
    return number
