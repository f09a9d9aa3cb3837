"""Names against names: which of two contains the other, and the best certificate for a name.

Containment is found in the sorted suffixes of both sides, dealt into blocks of a bounded size that need no other one. For
certificates both sides are dealt into blocks of a bounded number of different names; every two blocks meet in one task, which
builds an index of one and looks up the other. A task gives one row for each name asked, never a row for each pair."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable
from difflib import SequenceMatcher
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.operators.steps import forget, stored

#: Different names of a block of certificates, whose index also holds single characters.
BLOCK = 20_000
#: For containment: rows of a block of suffixes, different beginnings of names that each task knows, and characters that it
#: gives out at once. None changes what is found.
ROWS, HEADS, SLICE = 50_000, 50_000, 1 << 22


def block_pairs(left: DataFrame, right: DataFrame, key: str, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, size: int = BLOCK, most: tuple[int, int] | None = None) -> DataFrame:
    """`f` of every two blocks of `left` and `right`, which are dealt by a hash of the column `key`.

    `most` says how many rows the sides have at most, where that is cheaper to know than to count.

    Work and shuffle grow with blocks times rows: a side of n rows is copied for each `size` rows of the other one."""
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both may be made of the same columns
    blocks = [max(1, -(-n // size)) for n in most or (left.count(), right.count())]
    own = [F.pmod(F.xxhash64(key), F.lit(n)).cast("int") for n in blocks]
    other = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in blocks]
    a = left.withColumn("_l", own[0]).withColumn("_r", other[1]).groupBy("_l", "_r")
    b = right.withColumn("_r", own[1]).withColumn("_l", other[0]).groupBy("_l", "_r")
    return a.cogroup(b).applyInArrow(f, schema)


def automaton(words: Iterable[tuple[str, int]]) -> ahocorasick.Automaton | None:
    """Finds all the given words, with their numbers, in one pass over a text; None without words."""
    found: dict[str, list[int]] = defaultdict(list)
    for word, k in words:
        if word:
            found[word].append(k)
    if not found:
        return None
    out = ahocorasick.Automaton()
    for word, ks in found.items():
        out.add_word(word, ks)
    out.make_automaton()
    return out


def within(index: ahocorasick.Automaton | None, text: str) -> Iterable[int]:
    """Numbers of the words that occur in a text, repeats included."""
    if index is not None:
        for _, ks in index.iter(text):
            yield from ks


def beginnings(texts: DataFrame, most: int = HEADS) -> dict[bool, list[str]]:
    """Of the names (place is null: True) and of the keys (False) the different beginnings, of as many characters as give
    about `most` of them; a shorter text is its own beginning. Empty text, which all begin with, if single ones give more."""
    name, sizes = F.col("place").isNull(), (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32)
    start = lambda n: F.substring("text", 1, n)
    counts = texts.agg(*(F.approx_count_distinct(F.when(name == side, start(n))).alias(f"{side}{n}") for side in (True, False) for n in sizes)).first()
    cut = {side: max((n for n in sizes if counts[f"{side}{n}"] <= most), default=0) for side in (True, False)}
    heads = texts.select(name.alias("side"), F.when(name, start(cut[True])).otherwise(start(cut[False])).alias("head")).distinct().collect()
    return {side: [r["head"] for r in heads if r["side"] == side] for side in (True, False)}


def starter(heads: list[str]) -> Callable[[str], Iterable[int]]:
    """Gives the places of a text, its first apart, at which it goes on like one of the heads."""
    if "" in heads:
        return lambda text: range(1, len(text))
    index = automaton((h, len(h)) for h in heads)
    return lambda text: {end - n + 1 for end, (n,) in index.iter(text)} - {0} if index else ()


def related(rows: Iterable[tuple[str, int, int | None]]) -> dict[str, int]:
    """Of rows (text, at, place): for each name the smallest place of the keys here that contain it or that it contains.

    Names have no place. At 0 a text is looked for in others and others in it, at -1 it is only looked for, at any other
    character it is only what others are looked for in, from that character on. In the order of the strings all that go on
    from a text follow it, so one pass suffices: the texts that the present string begins with are on a stack."""
    none = float("inf")
    keys: dict[str, int] = {}
    names: set[str] = set()
    held: dict[str, float] = {}
    asking: dict[str, list[str]] = defaultdict(list)
    for text, at, place in rows:
        if at <= 0 and place is None:
            names.add(text)
        elif at <= 0:
            keys[text] = min(place, keys.get(text, place))
        if at >= 0 and place is None:
            asking[text[at:]].append(text)
        elif at >= 0:
            held[text[at:]] = min(place, held.get(text[at:], none))
    best: dict[str, float] = {}
    stack: list[list] = []  # a text, the smallest place of the keys down to it, and that of the keys that go on from it

    def close() -> None:
        text, _, low = stack.pop()
        if low < none:
            if text in names:
                best[text] = min(low, best.get(text, none))
            if stack:
                stack[-1][2] = min(low, stack[-1][2])

    for s in sorted({*keys, *names, *held, *asking}):
        while stack and not s.startswith(stack[-1][0]):
            close()
        within = min(stack[-1][1] if stack else none, keys.get(s, none))
        if within < none:
            for text in asking.get(s, ()):
                best[text] = min(within, best.get(text, none))
        if s in keys or s in names:
            stack.append([s, within, held.get(s, none)])
        elif stack:
            stack[-1][2] = min(stack[-1][2], held.get(s, none))
    while stack:
        close()
    return best


def first_related(names: DataFrame, keys: DataFrame, rows: int = ROWS, heads: int = HEADS) -> DataFrame:
    """(name, place): for each different name the smallest `place` of the keys (key, place) that contain it or that it
    contains; names that no key is related to are left out, and so are null and empty names and keys.

    A text holds another if one of its suffixes begins with that. Suffixes that begin like none of the other side's texts
    are dropped at once; what is left is dealt in the order of the strings into blocks of about `rows` rows, equal
    suffixes too, by limits from a sample. A text that goes on beyond a limit begins that limit: it is copied to the
    blocks that it reaches. So rows and work grow with the texts (times their suffixes), and no pair is made."""
    asked = names.where("length(name) > 0").select(F.col("name").alias("text"), F.lit(None).cast("long").alias("place"))
    known = keys.where("length(key) > 0 and place is not null").select(F.col("key").alias("text"), F.col("place").cast("long").alias("place"))
    texts = stored(asked.unionByName(known).groupBy("text", F.col("place").isNull().alias("name")).agg(F.min("place").alias("place")).select("text", "place"))
    begin, count = beginnings(texts, heads), texts.count()

    def places() -> Callable[[str, int | None], Iterable[tuple[int, str, int]]]:
        after = {side: starter(begin[side]) for side in (True, False)}

        def of(text: str, place: int | None) -> Iterable[tuple[int, str, int]]:
            tie = crc32(text.encode())
            yield 0, text, tie
            for at in after[place is not None](text):
                yield at, text[at:], tie

        return of

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        of = places()
        for batch in batches:
            some = [(s, tie) for text, place in zip(*(c.to_pylist() for c in batch.columns)) for _, s, tie in of(text, place)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.string()), pa.array([t for _, t in some], pa.int64())], names=["s", "tie"])

    every = max(1, min(rows // 30, count // 10_000))  # of so many texts one is in the sample
    seen = sorted((r["s"], r["tie"]) for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(sample, "s string, tie long").collect())
    blocks = max(1, -(-len(seen) * every // rows), sum(len(s) for s, _ in seen) * every // (32 * rows))
    limits = sorted({seen[len(seen) * k // blocks] for k in range(1, blocks) if seen})

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        of, kinds = places(), {"b": pa.int32(), "text": pa.string(), "at": pa.int32(), "place": pa.int64()}
        for batch in batches:
            out: list[tuple[int, str, int, int | None]] = []
            size = 0
            for text, place in zip(*(c.to_pylist() for c in batch.columns)):
                for at, s, tie in of(text, place):
                    own = bisect_right(limits, (s, tie))
                    if at:
                        out.append((own, text, at, place))
                    else:
                        b = bisect_right(limits, (text, -1))
                        out.append((b, text, 0 if b == own else -1, place))
                        while b < len(limits) and limits[b][0].startswith(text):
                            b += 1
                            out.append((b, text, 0 if b == own else -1, place))
                    size += len(text)
                    if size > SLICE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.values())], names=list(kinds))
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.values())], names=list(kinds))

    def meet(block: pa.Table) -> pa.Table:
        best = related(zip(*(block[c].to_pylist() for c in ("text", "at", "place"))))
        return pa.table({"name": pa.array(list(best), pa.string()), "place": pa.array(list(best.values()), pa.int64())})

    dealt = texts.mapInArrow(deal, "b int, text string, at int, place long")
    first = stored(dealt.groupBy("b").applyInArrow(meet, "name string, place long").groupBy("name").agg(F.min("place").alias("place")))
    forget(texts)
    return first


class SharedCharacters:
    """For a text, the words that may match it by more than a given ratio.

    The matching blocks of two strings hold no character oftener than both strings do, so twice the characters they
    share, by their total length, is never under their ratio. Shared characters are counted through an inverted index of
    (character, how often before)."""

    def __init__(self, words: list[str]):
        lists: dict[tuple[str, int], list[int]] = defaultdict(list)
        for k, word in enumerate(words):
            for feature in self._features(word):
                lists[feature].append(k)
        self.lists = {f: np.array(ks, np.int64) for f, ks in lists.items()}
        self.length = np.array([len(w) for w in words], np.int64)

    @staticmethod
    def _features(text: str) -> Iterable[tuple[str, int]]:
        seen: dict[str, int] = defaultdict(int)
        for c in text:
            yield c, seen[c]
            seen[c] += 1

    def over(self, text: str, ratio: float) -> list[int]:
        met = [self.lists[f] for f in self._features(text) if f in self.lists]
        if not met:
            return []
        shared = np.bincount(np.concatenate(met), minlength=len(self.length))
        return np.flatnonzero(2 * shared > ratio * (self.length + len(text)) - 1e-9).tolist()


def best_certificates(texts: list[str], certs: list[dict]) -> list[tuple[int, float] | None]:
    """For each text (number of the certificate, score) of the first one of highest score, None where none scores.

    A certificate scores 1 for its full name, 0.95 for an alias, 0.9 where text and full name contain one another or
    for the short name as it is written, 0.8 where short name or an alias and the text do; aliases count in their
    order, the first equal or contained one ends them, and only a text that no name decided is compared by ratio:
    seven tenths of a ratio over 0.6, as long as the score is under 0.6. Required keywords give 0.5 to a score under
    that. Excluded keywords rule a certificate out."""
    low = [t.lower() for t in texts]
    full = [(c["cert_full_name"] or "") for c in certs]
    short = [(c["cert_short_name"] or "") for c in certs]
    alias = [(k, n, a.lower()) for k, c in enumerate(certs) for n, a in enumerate(c["aliases"] or []) if a]
    names = [f.lower() for f in full] + [s.lower() for s in short] + [a for *_, a in alias]
    count = len(certs)
    keywords = lambda column: automaton((w.lower(), k) for k, c in enumerate(certs) for w in c[column] or [] if w)
    anyway = lambda column: {k for k, c in enumerate(certs) if "" in (c[column] or [])}
    out_of, out_anyway = keywords("exclude_keywords"), anyway("exclude_keywords")
    needs, needs_anyway = keywords("required_keywords"), anyway("required_keywords")
    names_in = automaton(zip(names, range(len(names))))
    around: list[list[int]] = [[] for _ in texts]
    texts_in = automaton(zip(low, range(len(low))))
    for n, name in enumerate(names):
        for t in set(within(texts_in, name)):
            around[t].append(n)
    likely = SharedCharacters([a for *_, a in alias])
    out: list[tuple[int, float] | None] = []
    for t, (text, lower) in enumerate(zip(texts, low)):
        barred = out_anyway | set(within(out_of, lower))
        score: dict[int, float] = defaultdict(float)
        first: dict[int, tuple[int, str]] = {}
        for n in {*within(names_in, lower), *around[t]}:
            if n < count:
                score[n] = max(score[n], 1.0 if text == full[n] else 0.9)
            elif n < 2 * count:
                score[n - count] = max(score[n - count], 0.9 if text == short[n - count] else 0.8)
            else:
                k, place, a = alias[n - 2 * count]
                first[k] = min(first.get(k, (place, a)), (place, a))
        for k, (_, a) in first.items():
            if score[k] < 1.0:
                score[k] = 0.95 if a == lower else max(score[k], 0.8)
        for n in likely.over(lower, 0.6):  # in the order of a certificate's aliases
            k, _, a = alias[n]
            if k not in barred and k not in first and score[k] < 0.6:
                ratio = SequenceMatcher(None, lower, a).ratio()
                if ratio > 0.6:
                    score[k] = max(score[k], ratio * 0.7)
        for k in needs_anyway | set(within(needs, lower)):
            score[k] = max(score[k], 0.5)
        best = min(((-s, k) for k, s in score.items() if s > 0 and k not in barred), default=None)
        out.append((best[1], -best[0]) if best else None)
    return out
