"""Overlapping chunks of texts of any length, long ones cut by several tasks.

Where a window starts depends on all windows before it. A long text is dealt into blocks; each block says, for every
place its first window may start at, where the first window of the next block starts and how many windows lie between.
These small tables are followed from block to block, and every block is then cut from where its first window starts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.functions.text import next_cut, sliding_chunks, strip

#: Characters of a block. Changes how the work spreads, never the chunks.
BLOCK = 1 << 24


def _deal(block: int, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, key, text = (batch.column(c).slice(i, 1) for c in range(3))
                whole = text[0].as_py()
                for b, at in enumerate(range(0, len(whole), block)):
                    part = pa.array([whole[at : at + block + size]], pa.string())
                    yield pa.RecordBatch.from_arrays([doc, key, pa.array([b], pa.int32()), part], names=["doc", "key", "b", "part"])

    return work


def ways(part: str, first: bool, block: int, size: int, overlap: int, most: float) -> tuple[list[int], list[int]]:
    """For each start of a block's first window: that of the next block's (-1 if the text ends here), and the windows here.

    Paths that meet go on together, so each place of the block is left once."""
    known: dict[int, tuple[int, int]] = {}
    for start in range(1 if first else min(size, len(part))):
        path, at = [], start
        while at not in known:
            path.append(at)
            _, after = next_cut(part, at, size, overlap, most)
            if after is None or after >= block:
                known[at] = (-1 if after is None else after - block, 1)
                path.pop()
                break
            at = after
        leave, n = known[at]
        for at in reversed(path):
            n += 1
            known[at] = (leave, n)
    starts = range(1 if first else min(size, len(part)))
    return [known[s][0] for s in starts], [known[s][1] for s in starts]


def _follow(blocks: Column) -> Column:
    """(b, start, k) of each block that has windows: where its first starts and its number in the text."""

    @F.pandas_udf("array<struct<b:int,start:int,k:int>>")
    def work(tables: pd.Series) -> pd.Series:
        out = []
        for table in tables:
            start, k, found = 0, 0, []
            for row in sorted(table, key=lambda r: r["b"]):
                if start < 0:
                    break
                found.append({"b": row["b"], "start": start, "k": k})
                start, k = int(row["leave"][start]), k + int(row["n"][start])
            out.append(found)
        return pd.Series(out, dtype=object)

    return work(blocks)


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 50, most: float = 0.3, block: int = BLOCK) -> DataFrame:
    """(doc, k, chunk) of `docs` (doc, text): the chunks that `sliding_chunks` makes, k from 0.

    Texts of more than `block` characters are cut by blocks, in as many tasks; `block` must be at least `size`. Null and
    blank texts have no chunk; repeated rows and ids have their chunks as often; other columns are ignored."""
    if block < size:
        raise ValueError("a block must hold a window")
    rows = docs.select("doc", "text")
    long = F.coalesce(F.length("text") > block, F.lit(False))
    short = rows.where(~long).select("doc", F.posexplode(sliding_chunks(F.col("text"), size, overlap, most)).alias("k", "chunk"))

    kind = docs.select("doc").schema["doc"].dataType.simpleString()
    # equal texts share one key and one table
    dealt = rows.where(long & (strip(F.col("text")) != "")).select("doc", F.sha2("text", 256).alias("key"), "text")
    dealt = dealt.mapInArrow(_deal(block, size), f"doc {kind}, key string, b int, part string").repartition("key", "b")

    @F.pandas_udf("leave array<int>, n array<int>")
    def table(part: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [ways(p, k == 0, block, size, overlap, most) for p, k in zip(part, b, strict=True)]
        return pd.DataFrame({"leave": [f[0] for f in found], "n": [f[1] for f in found]})

    tables = dealt.dropDuplicates(["key", "b"]).select("key", "b", table("part", "b").alias("t"))
    tables = tables.groupBy("key").agg(F.collect_list(F.struct("b", "t.leave", "t.n")).alias("blocks"))
    starts = tables.select("key", F.inline(_follow(F.col("blocks")))).withColumnRenamed("k", "first")

    @F.pandas_udf("array<string>")
    def cut(part: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for text, at in zip(part, start, strict=True):
            found = []
            while at is not None and at < block:
                end, after = next_cut(text, at, size, overlap, most)
                found.append(text[at:end])
                at = after
            out.append(found)
        return pd.Series(out, dtype=object)

    found = dealt.join(starts, ["key", "b"]).select("doc", "first", F.posexplode(cut("part", "start")).alias("i", "chunk"))
    return short.unionByName(found.select("doc", (F.col("first") + F.col("i")).alias("k"), "chunk"))
