"""SimHash near-duplicates by anchor points of a covering code.

The anchors are the words of a code that covers all 64-bit fingerprints: the product of two Golay codes (23 bits,
radius 3), a Hamming code (15 bits, radius 1) and a repetition code (3 bits, radius 1). Each of them is perfect, so
every fingerprint has one home anchor within the covering radius. Every fingerprint is also copied to all anchors
within the radius plus the threshold, block by block; two fingerprints within the threshold therefore meet at the home
of either, and only there are they compared."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import connected_components, forget, packed, stored, unpacked, with_text_columns

SEED = 42
#: Hashes are unpacked to bits in blocks of so many: bounds memory, not what is read.
BLOCK = 255 * 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the shingles' hashes, as an unsigned number; 0 without words. Blanks are ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(ends), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            votes += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        votes += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(ends), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns `keep` with `fp`, the fingerprint as a signed long. Null texts count as empty."""

    def start():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64)]

    return with_text_columns(docs, keep, text_col, "fp long", start)


class _Block:
    """One perfect code on `width` bits from `shift` on: error patterns by syndrome and by excess over the radius."""

    def __init__(self, shift: int, width: int, radius: int, syndromes: list[int], threshold: int):
        self.shift, self.mask, self.syndromes = shift, (1 << width) - 1, syndromes
        found: list[dict[int, list[int]]] = [{} for _ in range(threshold + 1)]
        for weight in range(min(width, radius + threshold) + 1):
            for bits in combinations(range(width), weight):
                s = 0
                for b in bits:
                    s ^= syndromes[b]
                found[max(0, weight - radius)].setdefault(s, []).append(sum(1 << b for b in bits))
        size = 1 + max(max(f, default=0) for f in found)
        #: by excess: patterns (syndromes x most patterns, shifted into place) and how many of them count
        self.levels = []
        for f in found:
            table = np.zeros((size, max(map(len, f.values()), default=0)), np.uint64)
            for s, patterns in f.items():
                table[s, : len(patterns)] = np.array(patterns, np.uint64) << np.uint64(shift)
            self.levels.append((table, np.array([len(f.get(s, ())) for s in range(size)])))

    def syndrome(self, fp: np.ndarray) -> np.ndarray:
        own = (fp >> np.uint64(self.shift)) & np.uint64(self.mask)
        out = np.zeros(len(fp), np.int64)
        for b, s in enumerate(self.syndromes):
            out ^= np.where((own >> np.uint64(b)) & np.uint64(1), s, 0)
        return out


def _powers(width: int, polynomial: int, degree: int) -> list[int]:
    """Syndromes of single bits in a cyclic code: powers of x modulo its generator."""
    out, x = [], 1
    for _ in range(width):
        out.append(x)
        x <<= 1
        if x >> degree:
            x ^= polynomial
    return out


class Anchors:
    """All anchors of fingerprints, for one threshold."""

    def __init__(self, threshold: int):
        golay = _powers(23, 0b101011100011, 11)  # fixed value: the Golay code's generator polynomial
        self.threshold = threshold
        self.blocks = [
            _Block(0, 23, 3, golay, threshold),
            _Block(23, 23, 3, golay, threshold),
            _Block(46, 15, 1, _powers(15, 0b10011, 4), threshold),  # fixed value: x^4 + x + 1
            _Block(61, 3, 1, [1, 2, 3], threshold),
        ]

    def of(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(row, anchor, home) in pieces: every anchor of every row's fingerprint once, its home among them."""
        syndromes = [b.syndrome(fp) for b in self.blocks]
        for excess in product(range(self.threshold + 1), repeat=len(self.blocks)):
            if sum(excess) > self.threshold:
                continue
            anchor, valid = fp[:, None], np.ones((len(fp), 1), bool)
            for block, s, e in zip(self.blocks, syndromes, excess, strict=True):
                table, n = block.levels[e]
                anchor = (anchor[:, :, None] ^ table[s][:, None, :]).reshape(len(fp), -1)
                valid = (valid[:, :, None] & (np.arange(table.shape[1]) < n[s][:, None])[:, None, :]).reshape(len(fp), -1)
            yield np.nonzero(valid)[0], anchor[valid], not any(excess)


def anchored(fps: DataFrame, threshold: int, home_only: bool) -> DataFrame:
    """(anchor, fp) for each distinct `fp`: its home anchor, or all anchors within radius plus threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(0 if home_only else threshold)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 2000):
                fp = every[at : at + 2000]
                for row, anchor, _ in anchors.of(fp.astype(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(fp[row])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(work, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b) for every two distinct fingerprints, a < b as signed longs, that differ in `threshold` bits or fewer."""
    home = anchored(fps, threshold, True).withColumnRenamed("fp", "a")
    copies = anchored(fps, threshold, False).withColumnRenamed("fp", "b")
    met = copies.join(home.hint("shuffle_hash"), "anchor")
    return met.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def group(fingerprinted: DataFrame, id_col: str, threshold: int = 2) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint: the smallest id of a document reachable over links.

    Equal fingerprints are one class and are linked once, however many documents share them."""
    classes = stored(fingerprinted.groupBy("fp").agg(F.min(id_col).alias("least")))
    parts = connected_components(links(classes, threshold))
    rooted = classes.join(parts, classes["fp"] == parts["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per input row.

    Null and empty texts have fingerprint zero and are linked like any other; null ids stay and never name a component
    unless a component has no other; other columns are ignored, whatever their names."""
    own = stored(with_fingerprints(docs, [id_col], text_col, shingle))
    return own.join(group(own, id_col, threshold), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id (nulls last), one of them if ids repeat.

    Components all of whose ids are null keep all their rows; null and empty texts have fingerprint zero; texts of any
    length are read whole. `docs` must give the same rows whenever it is read (files or a stored table): only row numbers
    and fingerprints are stored."""
    own = packed(docs).withColumn("_row", F.monotonically_increasing_id())
    keyed = own.select("_row", F.col("_doc").getField(id_col).alias("_id"), F.col("_doc").getField(text_col).alias("_text"))
    keyed = stored(with_fingerprints(keyed, ["_row", "_id"], "_text", shingle))
    ids = keyed.join(group(keyed.select("fp", "_id"), "_id", threshold), "fp")
    # a component's rows are those of several fingerprints; its smallest id names it
    first = ids.where(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("_row").alias("_row"))
    if id_col in docs.columns and docs.schema[id_col].nullable:
        # components without any id: one row of each root would do, but they have no name to group by, so all stay
        first = first.where("component_id is not null").select("_row").union(ids.where("component_id is null").select("_row"))
    first = stored(first.select("_row"))
    forget(keyed)
    return unpacked(own.join(first, "_row", "left_semi"), docs.columns)
