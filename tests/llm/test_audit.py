from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tenderspark.llm import filter_audit, importance, queries
from tests.compare import database, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def walked(docs, labels):
    """Every order applied to every document, one filter after the other."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((lang or "", {f for f in fails if fails[f]}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                after = [r for r in left if f not in r[1]]
                fail = sum(f in r[1] for r in mine)
                out[part, order, k + 1] = [
                    len(after), len(gone), fail - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)
                ]
                left = after
    share = {}
    for (part, order, k), v in out.items():
        share[part, order[k - 1]] = share.get((part, order[k - 1]), 0) + v[1]
    return {key: (*v, share[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audited(docs, labels):
    got = filter_audit.audit(filter_audit.failures(docs, labels, F.coalesce("lang", F.lit(""))))
    rows = got.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_is_every_order_walked(spark, make, odd):
    r = random.Random(3)
    text = lambda: " ".join(r.choice(["a", "b", "Cc", "DD", "e#", "été", "f\ng"]) for _ in range(r.choice([0, 3, 150, 230]))) + r.choice(["", " #", " many different words"])
    pool = [text() for _ in range(25)] + [" ".join(map(str, range(260))), None, ""]
    docs = [(r.choice([None, *range(60)]), r.choice(pool), r.choice(["en", "de", None, ""])) for _ in range(90)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(50)] + [(None, 1, 1), (3, 1, 0), (3, 0, 1)]
    assert audited(make(docs), spark.createDataFrame(labels, LABELS)) == walked(docs, labels)
    some = [(x["doc_id"], x["text"], x["lang"]) for x in odd.collect()]
    assert audited(odd, spark.createDataFrame([], LABELS)) == walked(some, [])
    assert audited(odd.limit(0), spark.createDataFrame(labels, LABELS)) == {}


def test_audit_and_its_sql(spark):
    assert spark_rows(queries.op11_filter_audit(spark, SF)) == duck_rows(database(SF), queries.ORACLES["op11_filter_audit"])


def test_paths():
    reach, leave = filter_audit.path_counts(5)
    assert reach[31] == leave[0] == 120 and all(reach[s] * leave[s] == math.factorial(s.bit_count()) * math.factorial(5 - s.bit_count()) for s in range(32))
    with pytest.raises(ValueError):
        filter_audit.audit(None, "ABCDEFG")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def drawn(docs, target):
    """The whole resampling as plain loops over all texts."""
    def counts(texts):
        n = [0] * 10000
        for t in texts:
            for f in features(t)[1]:
                n[zlib.crc32(f.encode()) % 10000] += 1
        return n

    s, t = counts([x for _, x in docs]), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        words, found = features(x)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * 25 // 100])}
    return sorted(map(str, ((*r[:4], rank.get(id(r))) for r in rows)))


def test_resampling_is_that_of_plain_loops(spark, odd):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    goal = [r["text"] for r in target.collect()]
    for table in (docs, odd, odd.limit(0)):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        assert sorted(str(tuple(r)) for r in importance.resample(table, target).collect()) == drawn(rows, goal)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(str(tuple(r)) for r in importance.resample(odd, target.limit(0)).collect()) == drawn(rows, [])


def test_ties_and_repeated_ids_are_ranked_once_each(spark):
    rows = [(k % 7, k, 5 * (k % 3)) for k in range(100)]
    t = spark.createDataFrame(rows, "id long, row long, score long")
    got = importance.ranked(t, [F.col("score").desc(), F.col("id"), F.col("row")], 40).collect()
    want = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:40]
    assert [(r["id"], r["row"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == want and len(got) == 100


def test_table_of_runs():
    r = random.Random(1)
    texts = [None, "", *("".join(r.choice("abcZ09 \n.,é𝒳-\x00{") for _ in range(r.randint(0, 60))) for _ in range(300)), "x" * 100 + " " + "y" * 40]
    runs = importance.word_runs(texts)
    held = [bytes(runs.data[a : a + n]) for a, n in zip(runs.at, runs.size)]
    for k, t in enumerate(texts):
        assert sorted(h.decode() for h, of in zip(held, runs.text) if of == k) == sorted(features(t)[1])
    assert importance.hash_runs(runs.data, runs.at, runs.size).tolist() == [xxhash.xxh64_intdigest(h) for h in held]
    assert importance.crc32_runs(runs.data, runs.at, runs.size).tolist() == [zlib.crc32(h) for h in held]
    # with all keys equal only the bytes tell runs apart
    for keys in (None, np.full(len(held), 5, np.uint64)):
        found = importance.intern(runs.data, runs.at, runs.size, keys)
        assert (found.at >= 0).sum() == len(set(held)) and found.count.sum() == len(held)
        assert [bytes(runs.data[found.at[s] : found.at[s] + found.size[s]]) for s in found.slot] == held
