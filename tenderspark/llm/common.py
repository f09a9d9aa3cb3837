"""What several operators of this subpackage share: stored intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder.

    Where neither is set, a session on one machine (tests) gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: Removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again.

    Cuts the lineage, computes an expensive step once, and makes random or order-dependent columns stable when an
    executor is lost. The shuffle files of the step go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def id_bucket(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text modulo `parts`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row; inside lambdas a plain expression is computed per element."""
    return F.transform(F.array(value), body)[0]


def packed(docs: DataFrame) -> DataFrame:
    """`docs` as one struct column `_doc`, so that its columns' names clash with nothing."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that were packed, some of them replaced."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col("_doc").getField(c).alias(c) for c in columns))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected `edges` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps. A star's centre may be adjacent to very many nodes, so minima come
    from partial aggregates and are joined back (a join Spark can split), never from a window over the group.
    Loops are ignored; an empty input gives an empty result."""
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m"))
        now, old = stored(small.distinct()), now
        forget(old)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


#: Bytes of texts that are Python strings at a time (one text, if it is longer): bounds memory, not what is read.
SLICE = 4 << 20


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of at most SLICE bytes, or of one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, done + SLICE, "right")))
        yield at, end - at
        at, done = end, int(size[end - 1])


def with_text_columns(
    docs: DataFrame, keep: list[str], text_col: str, added: str, start: Callable[[], Callable[[list], list[list]]]
) -> DataFrame:
    """The columns `keep` as they are, and those of the schema `added`, made from each whole text in Arrow batches.

    `start` runs once per task; what it returns maps a run of texts (None where null) to one list per added column.
    `text_col` may be a field of a kept struct, which then travels once. Other columns are ignored, whatever their
    names. No shuffle."""
    root, _, inner = text_col.partition(".")
    inside = bool(inner) and root in keep
    picked = docs.select(*(F.col(c) for c in keep), *([] if inside else [F.col(text_col).alias("_the_text")]))
    new = StructType.fromDDL(added)
    kinds = to_arrow_schema(new)
    kept = picked.schema.fields[: len(keep)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            texts = batch.column(keep.index(root)).field(inner) if inside else batch.column(len(keep))
            for at, n in _slices(texts):
                made = f(texts.slice(at, n).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, n) for c in batch.columns[: len(keep)]), *(pa.array(c, k.type) for c, k in zip(made, kinds, strict=True))],
                    names=[*keep, *kinds.names],
                )

    return picked.mapInArrow(work, StructType([*kept, *new.fields]))
