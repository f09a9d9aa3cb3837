"""Language-model scoring with Brown classes.

Words are counted over all training texts. Exchange clustering assigns them to classes: first the most frequent words
and groups of all others by their ending, on the counts of their bigrams; then, in rounds, each of the tens of thousands
of words that have a class of their own moves to the best class for the classes that stand before and after it, which
Spark counts over all training texts with the classes of the round before. A text's probability is the product of
smoothed class transitions and of the words' probabilities within their classes."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import stored, with_text_columns

#: A worker hands on its counts whenever it holds so many different words: bounds its memory, never the result.
HELD = 1_000_000
#: Longer words are never broadcast; they are looked up by a join like other infrequent words.
BROADCAST_BYTES = 64


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


@dataclass
class Units:
    """What is clustered: unit 0 is the end of a text, then the most frequent words, then the groups by ending."""

    words: list[bytes]
    groups: int
    of_word: dict[bytes, int] = field(init=False)
    of_ending: dict[bytes, int] = field(init=False)

    def __post_init__(self):
        self.of_word = {w: 1 + k for k, w in enumerate(self.words)}
        self.of_ending = {}

    @property
    def size(self) -> int:
        return 1 + len(self.words) + self.groups

    def ending(self, word: bytes) -> int:
        end = word[-3:]
        unit = self.of_ending.get(end)
        if unit is None:
            unit = self.of_ending[end] = 1 + len(self.words) + zlib.crc32(end) % self.groups
        return unit

    def of(self, word: bytes) -> int:
        return self.of_word.get(word) or self.ending(word)


def _count_words():
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            keys = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([learned[w] for w in keys], pa.int64()), pa.array(seen.values(), pa.int64())],
                names=["word", "n", "n_all"],
            )

        seen, learned = Counter(), Counter()
        for batch in batches:
            for text, is_train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                seen.update(words)
                if is_train:
                    learned.update(words)
                if len(seen) > HELD:
                    yield rows()
                    seen, learned = Counter(), Counter()
        yield rows()

    return work


def _count_bigrams(units: Units):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = units.size
        total = np.zeros(n * n, np.int64)
        one, other = units.of_word.get, units.ending
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = np.array([0, *(one(w) or other(w) for w in words_of(text)), 0])
                np.add.at(total, own[:-1] * n + own[1:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    return work


def _count_contexts(units: Units, class_of: np.ndarray, classes: int):
    """Rows (code, n) of (unit, class after) and (unit, class before) counts of each text, codes of the second behind the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = units.size * classes
        total = np.zeros(2 * n, np.int64)
        one, other = units.of_word.get, units.ending
        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = np.array([0, *(one(w) or other(w) for w in words_of(text)), 0])
                c = class_of[own]
                held += [own[:-1] * classes + c[1:], n + own[1:] * classes + c[:-1]]
                waiting += 2 * len(own)
                if waiting > HELD:
                    total += np.bincount(np.concatenate(held), minlength=2 * n)
                    held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=2 * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    return work


def exchange_round(after: np.ndarray, before: np.ndarray, own: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """Classes after one pass over the units `movable`, in that order: each goes to the class that raises the likelihood
    most. `after` and `before` (units x classes) count the classes around each unit, as they were when counted."""
    own, classes = own.copy(), after.shape[1]
    f = lambda x: x * np.log(np.maximum(x, 1))
    table = np.stack([after[own == c].sum(0) for c in range(classes)]).astype(float)
    size = table.sum(1)
    for w in movable:
        a, out, into = own[w], after[w].astype(float), before[w].astype(float)
        count = out.sum()
        if not count:
            continue
        table[a] -= out
        table[:, a] -= into
        np.maximum(table, 0, out=table)
        size[a] -= count
        gain = (f(table + out) - f(table)).sum(1) + (f(table.T + into) - f(table.T)).sum(1)
        gain -= 2 * (f(size + count) - f(size))
        gain[0] = -np.inf
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-9:
            b = a
        table[b] += out
        table[:, b] += into
        size[b] += count
        own[w] = b
    return own


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Class of each unit. Unit 0 stays alone in class 0; every other moves to the class that raises the likelihood of
    the class bigrams most, until none moves or `rounds` are over. Starts from frequency order dealt round robin."""
    n = len(bigrams)
    f = lambda x: x * np.log(np.maximum(x, 1))
    own = np.zeros(n, int)
    order = 1 + np.argsort(-(bigrams.sum(0) + bigrams.sum(1))[1:], kind="stable")
    own[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.eye(classes)[own]
    table = member.T @ bigrams @ member
    size = table.sum(1)
    for _ in range(rounds):
        moved = 0
        for w in order:
            a = own[w]
            out, into, loop = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            count = bigrams[w].sum()
            if not count and not into.sum():
                continue
            out[a] -= loop
            into[a] -= loop
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= loop
            size[a] -= count
            gain = (f(table + out) - f(table)).sum(1) + (f(table.T + into) - f(table.T)).sum(1)
            inner = np.diag(table)
            gain += f(inner + out + into + loop) - f(inner + out) - f(inner + into) + f(inner)
            gain -= 2 * (f(size + count) - f(size))
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += loop
            size[b] += count
            if b != a:
                member[w, a], member[w, b], own[w] = 0, 1, b
                moved += 1
        if not moved:
            break
    return own


@dataclass
class Model:
    units: Units
    class_of: np.ndarray  # of each unit
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 of what a word's count + 1 is divided by, of each class; 0 for the end's
    tokens: int  # N: training tokens, ends included
    types: int  # V
    ends: int  # training texts
    vocabulary: DataFrame  # word, n (in training), n_all


def fit(
    docs: DataFrame,
    train: Column,
    text_col: str = "text",
    classes: int = 48,
    top_words: int = 600,
    endings: int = 200,
    prior: float = 20.0,
    clustered: int = 30_000,
    rounds: int = 1,
    least_seen: int = 8,
) -> Model:
    """Learn from the rows where `train` holds; null texts are empty texts.

    Word, bigram and context counts cover every training token. The `clustered` most frequent words are assigned to
    classes one by one: `top_words` of them by exchange on their whole bigram table, then all in `rounds` of exchange on
    class contexts. Words beyond these, words seen fewer than `least_seen` times, whose contexts say too little, and words
    that training texts lack have the class of their ending's group, which is clustered by exchange as well, so every
    word has a class."""
    rows = docs.select(F.col(text_col).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    counted = rows.mapInArrow(_count_words(), "word binary, n long, n_all long")
    vocabulary = stored(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")))
    top = vocabulary.where((F.col("n") > 0) & (F.length("word") <= BROADCAST_BYTES)).orderBy(F.desc("n"), "word").limit(clustered)
    found = top.select("word", "n").toArrow().to_pylist()
    words = [bytes(r["word"]) for k, r in enumerate(found) if k < top_words or r["n"] >= least_seen]
    texts = rows.where("train").select("t")

    seeds = Units(words[:top_words], endings)
    size = seeds.size
    # a row for each pair of units, at most
    got = texts.mapInArrow(_count_bigrams(seeds), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(size * size)
    bigrams[got["code"].to_numpy()] = got["n"].to_numpy()
    bigrams = bigrams.reshape(size, size)
    seeded = exchange(bigrams, classes)
    ends = int(bigrams[:, 0].sum())

    units = Units(words, endings)
    class_of = np.concatenate([
        seeded[: 1 + len(seeds.words)], seeded[[seeds.ending(w) for w in words[top_words:]]].astype(int), seeded[size - endings :]
    ]) if len(words) > top_words else seeded

    def contexts() -> np.ndarray:
        # two rows for each unit and class, at most
        found = texts.mapInArrow(_count_contexts(units, class_of, classes), "code long, n long")
        found = found.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(2 * units.size * classes, np.int64)
        total[found["code"].to_numpy()] = found["n"].to_numpy()
        return total.reshape(2, units.size, classes)

    around = contexts()
    for _ in range(rounds):
        class_of = exchange_round(around[0], around[1], class_of, np.arange(1, 1 + len(words)))
        around = contexts()

    table = np.stack([around[0][class_of == c].sum(0) for c in range(classes)]).astype(float)
    share = (table.sum(0) + 1) / (table.sum() + classes)
    transition = np.log10((table + prior * share) / (table.sum(1, keepdims=True) + prior))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for batch in batches:
            own = class_of[[units.of(w) for w in batch.column(0).to_pylist()]] if batch.num_rows else np.zeros(0, int)
            n += np.bincount(own, batch.column(1).to_numpy(), classes).astype(np.int64)
            types += np.bincount(own, minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(range(classes)), pa.array(n), pa.array(types)], names=["c", "n", "types"])

    sums = (
        vocabulary.where("n > 0").select("word", "n").mapInArrow(by_class, "c long, n long, types long")
        .groupBy("c").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).toPandas()
    )
    n, types = np.zeros(classes), np.zeros(classes)
    n[sums["c"].to_numpy(int)], types[sums["c"].to_numpy(int)] = sums["n"].to_numpy(float), sums["types"].to_numpy(float)
    emission = np.log10(n + types + 1)
    emission[0] = 0.0
    return Model(units, class_of, transition, emission, int(n.sum()) + ends, int(types.sum()) + bool(ends), ends, vocabulary)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", frequent: int = 100_000) -> DataFrame:
    """The columns `keep` with n_tokens, n_known, train_tokens, base_score and score, one row per input row.

    base_score: add-one unigram log10 probability; score: that of the class model. Tokens are the words and one end, so
    null and empty texts score their end alone. Counts of the `frequent` most frequent words are broadcast (a bound on
    their number and length); those of all other words are joined, one row per text and word. Repeated rows are
    repeated; other columns are ignored, whatever their names."""
    known = (
        model.vocabulary.where(F.length("word") <= BROADCAST_BYTES).orderBy(F.desc("n_all"), "word").limit(frequent).toArrow()
    )
    spark = docs.sparkSession
    units, class_of, transition, emission, ends = model.units, model.class_of, model.transition, model.emission, model.ends
    shared = spark.sparkContext.broadcast((known["word"].to_pylist(), known["n"].to_numpy()))

    def start():
        words, counts = shared.value
        at_of = {bytes(w): k for k, w in enumerate(words)}
        class_at = class_of[[units.of(w) for w in at_of]] if words else np.zeros(0, int)
        logs, seen = np.log10(counts + 1.0), counts > 0

        def local(texts: list) -> list[list]:
            tokens, found, plain, rest, rare = [], [], [], [], []
            for text in texts:
                own = words_of(text)
                at = np.array([at_of.get(w, -1) for w in own], int)
                here = at >= 0
                others = [own[k] for k in np.flatnonzero(~here)]
                c = np.zeros(len(own) + 2, int)
                c[1:-1][here] = class_at[at[here]]
                c[1:-1][~here] = class_of[[units.ending(w) for w in others]] if others else 0
                tokens.append(len(own) + 1)
                found.append(int(seen[at[here]].sum()) + (ends > 0))
                plain.append(float(logs[at[here]].sum()) + np.log10(ends + 1.0))
                # the end is alone in its class: its count cancels out of the class model
                rest.append(float(transition[c[:-1], c[1:]].sum() - emission[c].sum()) - np.log10(ends + 1.0))
                rare.append([{"word": w, "k": k} for w, k in Counter(others).items()])
            return [tokens, found, plain, rest, rare]

        return local

    kind = "n_tokens long, _found long, _plain double, _rest double, _rare array<struct<word:binary,k:long>>"
    rows = stored(with_text_columns(docs, keep, text_col, kind, start).withColumn("_row", F.monotonically_increasing_id()))
    rare = rows.select("_row", F.inline("_rare"))
    looked_up = (
        rare.join(model.vocabulary.where("n > 0").select("word", "n"), "word")
        .groupBy("_row")
        .agg(F.sum(F.log10(F.col("n") + 1.0) * F.col("k")).alias("_more"), F.sum("k").alias("_also"))
    )
    more = F.coalesce("_more", F.lit(0.0))
    return rows.drop("_rare").join(looked_up, "_row", "left").select(
        *keep,
        "n_tokens",
        (F.col("_found") + F.coalesce("_also", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_plain") + more - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.types + 1)))).alias("base_score"),
        (F.col("_plain") + more + F.col("_rest")).alias("score"),
    )
