"""Importance resampling towards a target distribution over hashed word n-grams.

Documents are weighted by how much likelier their n-grams are in a target corpus than in their own, and the highest
weights plus Gumbel noise are drawn, which samples without replacement in proportion to the weights. The n-grams of a
batch are interned in an open-addressed NumPy table, so that each different n-gram is hashed to its bucket once."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import _slices, stored, with_text_columns

#: Bytes between words: all of ASCII but digits and small letters (capitals are lowered first).
_BLANK = np.ones(256, bool)
_BLANK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

# The five 64-bit primes of XXH64: fixed values of the public hash.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def hash_runs(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of data[at : at + size] for each run; `data` has eight spare bytes at its end.

    Runs under 32 bytes are hashed together, eight, four and one byte at a time; longer ones one by one."""
    out = np.empty(len(at), np.uint64)
    long = np.flatnonzero(size >= 32)
    raw = data.data
    for k in long:
        out[k] = xxhash.xxh64_intdigest(raw[at[k] : at[k] + size[k]])
    short = np.flatnonzero(size < 32)
    eight = np.ndarray((len(data) - 7,), "<u8", raw, 0, (1,))
    pos, left = at[short].copy(), size[short].copy()
    h = P5 + left.astype(np.uint64)
    on = np.flatnonzero(left >= 8)
    while len(on):
        lane = _turn(eight[pos[on]] * P2, 31) * P1
        h[on] = _turn(h[on] ^ lane, 27) * P1 + P4
        pos[on] += 8
        left[on] -= 8
        on = on[left[on] >= 8]
    on = np.flatnonzero(left >= 4)
    h[on] = _turn(h[on] ^ (eight[pos[on]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    pos[on] += 4
    left[on] -= 4
    on = np.flatnonzero(left > 0)
    while len(on):
        h[on] = _turn(h[on] ^ data[pos[on]].astype(np.uint64) * P5, 11) * P1
        pos[on] += 1
        left[on] -= 1
        on = on[left[on] > 0]
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    out[short] = h ^ h >> np.uint64(32)
    return out


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] equals data[b : b + size], for each pair."""
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))
    same, done = np.ones(len(a), bool), 0
    on = np.flatnonzero(size > 0)
    while len(on):
        left = np.minimum(size[on] - done, 8).astype(np.uint64)
        unlike = (eight[a[on] + done] ^ eight[b[on] + done]) << (np.uint64(64) - left * np.uint64(8))
        same[on] = unlike == 0
        done += 8
        on = on[(unlike == 0) & (size[on] > done)]
    return same


#: The CRC-32 of each byte, without the final inversion: what a step of one byte looks up.
_STEP = np.array([zlib.crc32(bytes([b])) ^ 0xFFFFFFFF ^ 0x00FFFFFF for b in range(256)], np.uint32)
_STEP = _STEP[np.arange(256) ^ 0xFF]


def crc32_runs(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of data[at : at + size] for each run: longest first, so that those with bytes left are the first ones.

    Runs of 64 bytes and more are taken one by one."""
    out = np.empty(len(at), np.int64)
    order = np.argsort(-np.minimum(size, 64).astype(np.int8), kind="stable")
    long = int(np.searchsorted(-size[order], -63))
    raw = data.data
    for k in order[:long].tolist():
        out[k] = zlib.crc32(raw[at[k] : at[k] + size[k]])
    order = order[long:]
    pos, left = at[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k))  # those with more than k bytes
        crc[:n] = crc[:n] >> np.uint32(8) ^ _STEP[(crc[:n] ^ data[pos[:n] + k]) & np.uint32(0xFF)]
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@dataclass
class Interned:
    """An open-addressed table of different runs of bytes: per slot its run, and how often it occurred."""

    slot: np.ndarray  # of each occurrence
    at: np.ndarray  # of each slot's run; -1 where the slot is free
    size: np.ndarray
    count: np.ndarray

    def buckets(self, data: np.ndarray, buckets: int) -> np.ndarray:
        """crc32 modulo `buckets` of each slot's run, computed once for each different run."""
        out = np.zeros(len(self.at), np.int64)
        used = np.flatnonzero(self.at >= 0)
        out[used] = crc32_runs(data, self.at[used], self.size[used]) % buckets
        return out


def intern(data: np.ndarray, at: np.ndarray, size: np.ndarray, keys: np.ndarray | None = None) -> Interned:
    """Gives equal runs of bytes the same slot. Keys are XXH64 hashes; runs of equal keys are told apart by their bytes.

    Linear probing, all occurrences at once: those that meet a free slot write themselves into it and the last one to
    do so holds it; those that find an equal run there are done; the others go on to the next slot."""
    keys = hash_runs(data, at, size) if keys is None else keys
    room = 1 << max(4, int(2 * len(at)).bit_length())  # at least twice the occurrences, so probing ends
    holder = np.full(room, -1, np.int32)
    slot = (keys & np.uint64(room - 1)).astype(np.int32)
    on = np.arange(len(at), dtype=np.int32)
    while len(on):
        free = on[holder[slot[on]] < 0]
        holder[slot[free]] = free
        found = holder[slot[on]]
        like = (keys[found] == keys[on]) & (size[found] == size[on])
        like[like] = _same_bytes(data, at[found[like]], at[on[like]], size[on[like]])
        on = on[~like]
        slot[on] = (slot[on] + 1) & (room - 1)
    held = holder >= 0
    starts, sizes = np.full(room, -1, np.int64), np.zeros(room, np.int64)
    starts[held], sizes[held] = at[holder[held]], size[holder[held]]
    return Interned(slot, starts, sizes, np.bincount(slot, minlength=room))


@dataclass
class Runs:
    """The word n-grams of some texts as runs of one buffer in which one space stands between words."""

    data: np.ndarray
    at: np.ndarray
    size: np.ndarray
    text: np.ndarray  # number of the text each run is of
    words: np.ndarray  # words of each text


def word_runs(texts: list, longest: int = 2) -> Runs:
    """All runs of 1 to `longest` consecutive words of whole texts, repeats included; null texts have none."""
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    text_end = np.cumsum([len(r) + 1 for r in raw])
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]
    owner = np.searchsorted(text_end, start, "right")
    # the buffer keeps the words' bytes and the first blank after each
    keep = ~blank
    keep[end] = True
    place = np.cumsum(keep) - 1
    tight = np.append(np.where(blank, np.uint8(0x20), data)[keep], np.zeros(8, np.uint8))
    start, end = place[start], place[end]
    at, size, text = [start], [end - start], [owner]
    for n in range(2, longest + 1):
        if len(start) < n:
            break
        one = owner[: 1 - n] == owner[n - 1 :]
        at.append(start[: 1 - n][one])
        size.append((end[n - 1 :] - start[: 1 - n])[one])
        text.append(owner[: 1 - n][one])
    return Runs(tight, *(np.concatenate(x) for x in (at, size, text)), np.bincount(owner, minlength=len(texts)))


#: Characters of the texts whose n-grams are interned together (one text, if it is longer): keeps a table in the cache.
TOGETHER = 1 << 19


def _groups(texts: list) -> Iterator[list]:
    group, held = [], 0
    for t in texts:
        if group and held + len(t or "") > TOGETHER:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t or "")
    if group:
        yield group


def bucket_counts(table: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How many n-grams of all whole texts fall into each bucket. One row for each bucket and task is summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for at, n in _slices(texts):
                for group in _groups(texts.slice(at, n).to_pylist()):
                    runs = word_runs(group, longest)
                    found = intern(runs.data, runs.at, runs.size)
                    total += np.bincount(found.buckets(runs.data, buckets), found.count, buckets).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    made = table.select(F.col(text_col).alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = made.toArrow()  # a row for each bucket, at most
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed likelihood ratio, target to own) of each bucket."""
    b, s, t = float(len(own)), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(own.astype(float), target.astype(float), strict=True)], np.int64)


def noise(doc_id, seed: int) -> int:
    """Gumbel noise in thousandths that depends on the id and the seed alone; a null id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, keep: list[str], text_col: str = "text", longest: int = 2) -> DataFrame:
    """The columns `keep` with n_words, n_features and weight, the floored mean of the gains of each text's n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket, whatever the corpus

    def start():
        table = shared.value

        def work(texts: list) -> list[list]:
            words, features, weights = [], [], []
            for group in _groups(texts):
                runs = word_runs(group, longest)
                found = intern(runs.data, runs.at, runs.size)
                worth = table[found.buckets(runs.data, len(table))][found.slot]
                n = np.bincount(runs.text, minlength=len(group))
                total = np.bincount(runs.text, worth, len(group)).astype(np.int64)  # whole numbers, far below 2 ** 53
                words += runs.words.tolist()
                features += n.tolist()
                weights += np.where(n > 0, total // np.maximum(n, 1), 0).tolist()
            return [words, features, weights]

        return work

    return with_text_columns(docs, keep, text_col, "n_words long, n_features long, weight long", start)


def ranked(scored: DataFrame, by: list, take: int) -> DataFrame:
    """`scored` with a column `rank` from 1 for its first `take` rows in the order `by`, null for the others.

    Rows are dealt by ranges of the order and numbered within each; the counts of the ranges (one number each) give
    where a range starts. No task sees more than its range, and equal rows do not end up in one: the last of `by` must
    tell rows apart."""
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = scored.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    columns = scored.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at + 1, at + 1 + len(batch)))], names=[*columns, "within"])
            at += len(batch)

    kept = dealt.mapInArrow(number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema) + ", within long")
    kept = stored(kept.withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offset = kept.sparkSession.createDataFrame(starts or [(0, 0)], "part int, before long")
    rank = F.col("before") + F.col("within")
    return kept.join(F.broadcast(offset), "part").select(*columns, F.when(rank <= take, rank).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = 10000,
    longest: int = 2,
    min_words: int = 20,
    percent: int = 25,
    seed: int = 7,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row: rank numbers the drawn rows, null for the others.

    Features are runs of 1 to `longest` words of whole texts; their gains compare bucket counts of all of `target` with
    those of all of `docs`. score is weight plus Gumbel noise of the id; of the rows with at least `min_words` words,
    `percent` of a hundred are drawn, highest scores first, ties to smaller ids (null ids first, equal ids in any
    order). Null and empty texts have no features, weight 0 and are never drawn; repeated rows are scored and drawn one
    by one; other columns are ignored, whatever their names; an empty table gives no rows, an empty target leaves the
    gains to smoothing. Texts are held in slices of a few MB (one text, if it is longer)."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    luck = F.udf(lambda i: noise(i, seed), "long")
    weighed = stored(weigh(rows, gain, ["id"], "t", longest).withColumn("row", F.monotonically_increasing_id()))
    scored = weighed.withColumn("score", F.col("weight") + luck("id"))
    enough = F.col("n_words") >= min_words
    wide = stored(scored.select("id", "n_features", "weight", "score", "row", enough.alias("enough")))
    take = wide.where("enough").count() * percent // 100
    drawn = ranked(wide.where("enough").drop("enough"), [F.col("score").desc(), F.col("id"), F.col("row")], take)
    rest = wide.where("not enough").select("id", "n_features", "weight", "score", "row", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
