"""Incremental ingest of chunk files without duplicates, and running project state from the approval log."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tenderspark.operators.lifecycle import current_status

FILES = "path string, modificationTime timestamp, length long, content binary"


def parquet_contents(data: bytes) -> list[str | None]:
    """The column `content` of a Parquet file."""
    return pq.ParquetFile(io.BytesIO(data)).read(["content"], use_threads=False)["content"].to_pylist()


def parsed_files(files: DataFrame, parse: Callable[[bytes], list[str | None]], most_bytes: int) -> DataFrame:
    """(path, at, content, error): the contents of each of `files` (path, length, content), at their place in it.

    Each file is read by itself: one that `parse` cannot read, or of more than `most_bytes`, gives a single row with what
    went wrong, and a file without contents a single row without either."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    if not data.is_valid:
                        raise ValueError(f"over {most_bytes} bytes")
                    found, error = parse(data.as_py()), None
                except Exception as e:  # whatever a reader raises on a broken file: it goes to the ledger
                    found, error = [], f"{type(e).__name__}: {e}"[:500]
                rows = [(path, k, c, None) for k, c in enumerate(found)] or [(path, -1, None, error)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "at", "content", "error"])

    small = files.select("path", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))
    return small.mapInArrow(work, "path string, at long, content string, error string")


@contextmanager
def listed_by_few_tasks(spark: SparkSession) -> Iterator[None]:
    """A file source lists each file of a batch as a path of its own, up to 10,000 with a task for each; here by as many
    tasks as keep the cluster busy."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ingest_chunks(
    spark: SparkSession,
    source: str,
    target: str,
    ledger: str,
    checkpoint: str,
    parse: Callable[[bytes], list[str | None]] = parquet_contents,
    most_files: int = 1000,
    most_bytes: int = 256 << 20,
    stop_on_error: bool = False,
) -> None:
    """Take in the new files below `source`: their contents to `target`, each content once, over all runs.

    The first stream lists new files, at most `most_files` a batch, reads each by itself, keeps one row of a content for
    each batch (of the smallest path and place) and writes these to `ledger`/staged and a row for every file to
    `ledger`/files: rows, contents that are null, and why it could not be read. With `stop_on_error` such a file is
    fatal: its batch is recorded and the job stops; the next run takes the batch up again. The second stream drops the
    contents that any earlier batch had, by a state keyed with the content's hash, and appends the rest to `target`; so
    a batch looks up the hashes that it holds and reads no ledger, however long that has become.

    Both streams keep their place below `checkpoint`: a run after a failure repeats the unfinished batch into the same
    folders. Which of two batches' paths a repeated content has follows the order of batches."""

    def stage(batch: DataFrame, batch_id: int) -> None:
        rows = parsed_files(batch, parse, most_bytes).withColumn("hash", F.sha2("content", 256)).persist()
        try:
            fatal = F.max("error").isNotNull() & F.lit(stop_on_error)
            files = rows.groupBy("path").agg(
                F.count_if(F.col("at") >= 0).alias("rows"), F.count_if((F.col("at") >= 0) & F.col("content").isNull()).alias("nulls"), F.max("error").alias("error"), fatal.alias("fatal")
            )
            files.write.mode("overwrite").parquet(f"{ledger}/files/batch={batch_id}")
            once = rows.where("hash is not null").groupBy("hash").agg(F.min(F.struct("path", "at")).alias("first"), F.min("content").alias("content"))
            once.select("hash", "first.path", "content").write.mode("overwrite").parquet(f"{ledger}/staged/batch={batch_id}")
            bad = rows.where("error is not null").first() if stop_on_error else None
        finally:
            rows.unpersist()
        if bad:
            raise RuntimeError(f"{bad['path']}: {bad['error']}")

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    with listed_by_few_tasks(spark):
        listed = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files).load(source)
        once = listed.writeStream.foreachBatch(stage).option("checkpointLocation", f"{checkpoint}/files").trigger(availableNow=True).start()
        once.awaitTermination()
    # the folder of each batch is written over if the batch is run again, so only whole batches are read
    staged = spark.readStream.schema("hash string, path string, content string").option("recursiveFileLookup", True).parquet(f"{ledger}/staged")
    fresh = staged.dropDuplicates(["hash"]).select("path", "content", "hash")
    fresh.writeStream.foreachBatch(add).option("checkpointLocation", f"{checkpoint}/contents").trigger(availableNow=True).start().awaitTermination()


def file_states(spark: SparkSession, target: str, ledger: str) -> DataFrame:
    """(path, state, chunks, nulls, error, fatal) of all files that were ever listed: unreadable with its error, processed
    if a content of it is in `target`, error if it has none and some of its contents were null, else skipped."""
    shape = "path string, rows long, nulls long, error string, fatal boolean"
    files = spark.read.schema(shape).option("recursiveFileLookup", True).parquet(f"{ledger}/files")
    new = spark.read.schema("path string").option("recursiveFileLookup", True).parquet(target).groupBy("path").agg(F.count("*").alias("chunks"))
    state = F.when(F.col("error").isNotNull(), "unreadable").when(F.col("chunks") > 0, "processed").when(F.col("nulls") > 0, "error").otherwise("skipped")
    return files.join(new, "path", "left").select("path", state.alias("state"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "nulls", "error", "fatal")


def import_totals(spark: SparkSession, target: str, ledger: str) -> DataFrame:
    """(state, files, chunks, nulls) over all batches of an ingest."""
    return file_states(spark, target, ledger).groupBy("state").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.sum("nulls").alias("nulls"))


def running_state(log: DataFrame) -> DataFrame:
    """The audit replay on a stream of log rows: its update mode gives each project's state as it changes."""
    return current_status(log)


def keep_state(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run `running_state` over what is there; every batch writes the states that it changed to `target`."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return running_state(log).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_state(spark: SparkSession, target: str) -> DataFrame:
    """(project, status, n): the newest state of each project in `target`."""
    return spark.read.parquet(target).groupBy("project").agg(F.max_by("status", "n").alias("status"), F.max("n").alias("n"))


REPLAYED = "project long, event_id long, us long, before string, original_status string, new_status string, n long, gap boolean"
_KEPT = ["project", "us", "event_id", "original_status", "new_status"]
_WAITING = "known array<long>, n array<long>, last array<string>, " + ", ".join(f"{c} array<{t}>" for c, t in zip(_KEPT, ("long", "long", "long", "string", "string")))


def replay(log: DataFrame, lateness: str, buckets: int = 256) -> DataFrame:
    """A stream of log rows (project, event_id, at, original_status, new_status) as each project's history in order.

    Every row comes out once, when the watermark (`lateness` behind the newest row) has passed it: with its number in the
    project, the status `before` it and `gap`, that its original status is not that one. Rows may arrive in any order;
    until then they wait in the state, and event-time timeouts wake what gets no more rows. Rows later
    than `lateness` are dropped, as are rows without project or time. Equal times go by event_id. A null original status
    is no gap; the first row of a project has none.

    The state has a row for each bucket of projects, which one call takes together; `buckets` stays as it is for the life of
    a checkpoint, and a larger number suits projects or waiting rows by the hundred million."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, n, last, *kept = state.get if state.exists else [[]] * 8
        waiting = pd.DataFrame({c: pd.Series(v, dtype="object" if c.endswith("status") else "int64") for c, v in zip(_KEPT, kept)})
        if not state.hasTimedOut:
            waiting = pd.concat([waiting, *(rows[_KEPT] for rows in batches)], ignore_index=True)
        mark = state.getCurrentWatermarkMs()
        ready = waiting["us"] < mark * 1000
        out, waiting = waiting[ready].sort_values(["project", "us", "event_id"], kind="stable"), waiting[~ready]
        text = lambda c: [None if pd.isna(x) else x for x in c]
        if len(out):
            # the last status and number of each project before these rows
            past = pd.DataFrame({"n": pd.Series(n, known, dtype="int64"), "last": pd.Series(last, known, dtype="object")})
            groups = out.groupby("project", sort=False)
            k = groups.cumcount()
            before = groups["new_status"].shift().where(k > 0, out["project"].map(past["last"]))
            number = out["project"].map(past["n"]).fillna(0).astype("int64") + k + 1
            gap = before.notna() & out["original_status"].notna() & (before != out["original_status"])
            out = out.assign(before=text(before), original_status=text(out["original_status"]), new_status=text(out["new_status"]), n=number, gap=gap)
            newest = out.drop_duplicates("project", keep="last").set_index("project")[["n", "new_status"]].set_axis(["n", "last"], axis=1)
            past = pd.concat([past[~past.index.isin(newest.index)], newest])
            known, n, last = past.index.tolist(), past["n"].tolist(), text(past["last"])
        state.update((known, n, last, *(text(waiting[c]) if c.endswith("status") else waiting[c].tolist() for c in _KEPT)))
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting["us"].min()) // 1000, mark) + 1)
        if len(out):
            yield out[["project", "event_id", "us", "before", "original_status", "new_status", "n", "gap"]]

    at = F.col("at").cast("timestamp")
    rows = log.select("project", "event_id", at.alias("at"), F.unix_micros(at).alias("us"), "original_status", "new_status").where("project is not null and at is not null")
    marked = rows.withColumn("bucket", F.pmod(F.xxhash64("project"), F.lit(buckets))).withWatermark("at", lateness)
    out = marked.groupBy("bucket").applyInPandasWithState(one, REPLAYED, _WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*(F.timestamp_micros("us").alias("at") if c == "us" else c for c in out.columns))


def keep_replay(log: DataFrame, lateness: str, target: str, checkpoint: str) -> StreamingQuery:
    """Run `replay` over what is there, its rows to `target`; a batch that is run again replaces its own folder."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return replay(log, lateness).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
