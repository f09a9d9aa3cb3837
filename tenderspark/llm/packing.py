"""Best-fit packing by exact-complement hashing.

Only how often each length occurs matters for the plan, and there are at most `capacity` lengths, so the plan is made
on the driver from a histogram of fixed size: the sums of two and three lengths are indexed once; for the longest length
left, its gap is looked up there and among the single lengths, and combinations that fill it exactly are consumed as
often as their counts allow; what finds no exact complement is packed best-fit. Spark counts the lengths and places every piece by its rank among
the pieces of its length."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderspark.llm.common import stored, with_text_columns

#: Words a worker remembers; later ones are encoded each time they occur. Bounds its memory, never the result.
REMEMBERED = 400_000
#: Latin letters and then marks other than apostrophes: the tokenizer lower-cases the first and splits before the second.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """Ids of blank-separated words as little-endian bytes, remembered for as long as the worker lives.

    The tokenizer drops white space and never looks across it, so the ids of a text are those of its words. Words of a
    plain form are cut into pieces here, which are words themselves and remembered with them; only new pieces are given
    to the tokenizer's model. All other words go through the whole tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {"": b""}
        # byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256 and up
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = dict(zip([b for b in range(256) if b not in own], range(256, 512)))

    def _remember(self, word: str, ids: bytes) -> bytes:
        if len(self.known) < REMEMBERED and len(word) <= 64:
            self.known[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            # letters and marks of ASCII stand for themselves
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
            found = [t.id for t in self.tokenize(text)]
            ids = self._remember(piece, struct.pack(f"<{len(found)}I", *found))
        return ids

    def word(self, word: str) -> bytes:
        if m := _PLAIN.fullmatch(word):
            letters = m[1].lower()
            if letters == word:
                return self._piece(word)
            ids = self._piece(letters) + self._piece(m[2])
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        return self._remember(word, ids)

    def text(self, text: str | None) -> bytes:
        known, word = self.known, self.word
        words = (text or "").replace("\n", " ").split(" ")
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            return b"".join([known[w] if w in known else word(w) for w in words])


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pieces(path: str, capacity: int, closing: int):
    """Cuts each text's ids, closed by one more id, into pieces of at most `capacity`."""

    def start():
        encoder, end, step = _encoder(path), closing.to_bytes(4, "little"), 4 * capacity

        def cut(texts: list) -> list[list]:
            out = []
            for text in texts:
                ids = encoder.text(text) + end
                parts = [ids[a : a + step] for a in range(0, len(ids), step)]
                out.append([
                    {"piece": k, "start": k * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)}
                    for k, p in enumerate(parts)
                ])
            return [out]

        return cut

    return start


def _pair_sums(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """For each sum up to `capacity`, the larger lengths of the pairs that make it, longest first."""
    have = np.zeros(capacity + 1, bool)
    have[lengths[lengths <= capacity]] = True
    sums = []
    for total in range(capacity + 1):
        larger = np.arange(total, (total - 1) // 2, -1)
        sums.append(larger[have[larger] & have[total - larger]].tolist())
    return sums


def _triple_sums(lengths: np.ndarray, pairs: list[list[int]], capacity: int) -> list[list[int]]:
    """For each sum up to `capacity`, the largest lengths of the triples that make it, longest first."""
    made = np.zeros(capacity + 1, int)  # the smallest larger length of a pair, by its sum
    for total, larger in enumerate(pairs):
        made[total] = larger[-1] if larger else capacity + 1
    sums = []
    for total in range(capacity + 1):
        largest = lengths[(lengths < total) & (lengths * 3 >= total)][::-1]
        # the other two make the rest, the larger of them no longer than the largest
        sums.append(largest[made[total - largest] <= largest].tolist())
    return sums


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Sequences as (lengths, times): how to pack `counts` pieces of each length into sequences of `capacity`.

    Exact complements of one, two or three lengths first, from the longest length down; then best fit."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    done: list[tuple[list[int], int]] = []

    def take(lengths: list[int]) -> bool:
        need = Counter(lengths)
        times = min(left[n] // k for n, k in need.items())
        if times:
            done.append((lengths, times))
            for n, k in need.items():
                left[n] -= times * k
                if not left[n]:
                    del left[n]
        return times > 0

    lengths = np.array(sorted(left), int)
    pairs = _pair_sums(lengths, capacity)
    triples = _triple_sums(lengths, pairs, capacity)

    def complements(gap: int):
        """Combinations of available lengths that sum to the gap, fewest pieces first, longest pieces first."""
        if left[gap]:
            yield [gap]
        for a in pairs[gap]:
            if left[a] and left[gap - a]:
                yield [a, gap - a]
        for a in triples[gap]:
            for b in pairs[gap - a] if left[a] else ():
                if b <= a and left[a] and left[b] and left[gap - a - b]:
                    yield [a, b, gap - a - b]

    residual: Counter = Counter()
    for n in sorted(left, reverse=True):
        if n >= capacity:
            take([n])
            continue
        for rest in complements(capacity - n):
            take([n, *rest])
            if not left[n]:
                break
        if left[n]:
            residual[n] = left.pop(n)
    left.update(residual)

    lengths = np.array(sorted(left))
    while left:
        lengths = lengths[[left[n] > 0 for n in lengths.tolist()]]
        row, gap, used = [], capacity, Counter()
        while True:
            at = int(np.searchsorted(lengths, gap, "right")) - 1
            while at >= 0 and used[int(lengths[at])] >= left[int(lengths[at])]:
                at -= 1
            if at < 0:
                break
            n = int(lengths[at])
            row.append(n)
            used[n] += 1
            gap -= n
        take(row)
    return done


def cut_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, closing_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32) for each piece of at most `capacity` ids."""
    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
    cut = with_text_columns(docs, [id_col], text_col, f"_pieces {kind}", _pieces(tokenizer_path, capacity, closing_id))
    return cut.select(id_col, F.inline("_pieces"))


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id", spread: int = 256) -> DataFrame:
    """`pieces` (with `length` from 1 to `capacity`) with sequence_id and offset.

    Every input row gets one place; repeated rows and null ids are pieces of their own; an empty table gives an empty
    result. Ranks within a length are made per (length, salt), so that a length which very many pieces share is dealt
    over `spread` times as many groups."""
    keys = ["length", "_salt"]
    pieces = stored(pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(spread)).cast("int")))
    groups = pieces.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows

    slots, first, base = [], 0, Counter()
    for lengths, times in plan(counts, capacity):
        offset = 0
        for n in lengths:
            slots.append((n, base[n], base[n] + times, first - base[n], offset))
            base[n] += times
            offset += n
        first += times
    spark = pieces.sparkSession
    # The plan has at most a few slots for each length that occurs, whatever the number of pieces.
    slots = spark.createDataFrame(slots, "length long, _from long, _to long, _shift long, offset long")
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(id_col, "piece")) - 1)
    ranked = ranked.join(groups, keys).withColumn("_rank", F.col("_at") + F.col("_before"))
    placed = ranked.join(
        F.broadcast(slots), (ranked["length"] == slots["length"]) & F.col("_rank").between(F.col("_from"), F.col("_to") - 1)
    )
    return placed.select(
        *(ranked[c] for c in pieces.columns if c != "_salt"), (F.col("_rank") + F.col("_shift")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, closing_id: int = 0) -> DataFrame:
    """Pieces of all documents, each with its sequence and its place there.

    Null and empty texts are one piece holding the closing id; texts longer than `capacity` are cut, no others."""
    return pack(cut_documents(docs, tokenizer_path, capacity, closing_id), capacity)
