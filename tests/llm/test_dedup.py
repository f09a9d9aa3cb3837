from __future__ import annotations

import hashlib
import random
import re

import xxhash

from tenderspark.llm import line_dedup, queries, set_join, simhash, spotsigs
from tenderspark.llm.common import connected_components


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 199)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 199
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_all_close_pairs(spark):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:30]:
        for _ in range(4):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and len(want) > 100


def test_near_duplicates_and_first(spark, odd, make):
    for r in simhash.near_duplicates(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["fingerprint"] == f"{_fingerprint(r['text']):016x}"
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert got[2] == got[3] == got[7] == 2 and got[6] == 6
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 4, 5, 6, 8]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.keep_first(odd.limit(0)).count() == 0


def _removed(docs):
    seen, out = [], {}
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            if len(w) < 5:
                continue
            s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            if any(len(s & o) / len(s | o) >= 0.8 - 1e-9 for o in seen):
                out.setdefault(i, []).append(p)
            seen.append(s)
    return out


def test_line_dedup_equals_brute_force(spark, make):
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(r.choices(words, k=r.randint(3, 70))) for _ in range(40)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(4):
            w = r.choice(base).split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(words)
            lines.append(" ".join(w).upper() if r.random() < 0.2 else "  ".join(w))
        docs.append((i, "\n".join(lines)))
    got = {x["doc_id"]: list(x["removed"]) for x in line_dedup.report(make(docs)).collect() if x["n_removed"]}
    want = _removed(docs)
    assert got == want and sum(map(len, want.values())) > 40
    texts = {x["doc_id"]: x["text"] for x in line_dedup.without_later_lines(make(docs)).collect()}
    for i, t in docs:
        left = [line for p, line in enumerate(t.split("\n")) if p not in want.get(i, [])]
        assert texts.get(i) == ("\n".join(left) if left else None)


def test_line_dedup_of_a_large_group_of_variants(spark, make):
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    base, docs = r.choices(words, k=90), []
    for i in range(160):
        w = list(base)
        for k in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{i}_{k}"
        docs.append((i, " ".join(w) + "\n" + " ".join(r.choices(words, k=20))))
    want = _removed(docs)
    got = {x["doc_id"]: list(x["removed"]) for x in line_dedup.report(make(docs)).collect() if x["n_removed"]}
    assert got == want and 20 < len(want) < 150


def test_line_dedup_shuffles_prefixes_once(spark, make, monkeypatch):
    plans, store = [], line_dedup.stored

    def seen(df):
        kept = store(df)
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept

    monkeypatch.setattr(line_dedup, "stored", seen)
    r = random.Random(5)
    base = [[f"w{r.randrange(200)}" for _ in range(40)] for _ in range(8)]
    docs = [(i, " ".join(base[i % 8][: 40 - i // 8])) for i in range(40)]
    got = {x["doc_id"]: list(x["removed"]) for x in line_dedup.report(make(docs)).collect() if x["n_removed"]}
    assert got == _removed(docs) and got
    of_prefixes = [p for p in plans if "explode(p#" in p]
    assert len(of_prefixes) == 1 and "ReusedExchange" in of_prefixes[0]


def test_line_dedup_odd_rows(spark, odd):
    got = line_dedup.report(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append((x["n_lines"], x["n_removed"]))
    assert by[2] == [(0, 0)] and by[3] == [(1, 0)] and sorted(by[6]) == [(1, 0), (1, 1)] and by[1] == [(2, 0)]
    kept = line_dedup.without_later_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert line_dedup.report(odd.limit(0)).count() == 0


def test_short_lines_that_repeat_go(spark, make):
    a = "Note well.\nThe cat sat on the mat and it was good\nMent que."
    docs = make([(1, a), (2, a), (3, " note  WELL.\nand more\n"), (4, "\n\n"), (5, "Ment que?"), (6, "Note well.\n\nMent que."), (None, "and more")])
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.report(docs, short=True).collect()}
    assert got == {1: [], 2: [0, 1, 2], 3: [0], 4: [], 5: [], 6: [0, 2], None: [0]}
    left = {r["doc_id"]: r["text"] for r in line_dedup.without_later_lines(docs, short=True).collect()}
    assert left == {1: a, 3: "and more\n", 4: "\n\n", 5: "Ment que?"}


def test_query_removes_short_lines(spark, make, tmp_path):
    make([(1, "Ment que.\nand"), (2, "Ment que.\nand")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: list(r["removed"]) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 1]}


def test_similar_pairs_equal_brute_force(spark):
    r = random.Random(9)
    sets = {i: sorted(set(r.choices(range(40), k=r.randint(0, 12)))) for i in range(150)}
    df = spark.createDataFrame(list(sets.items()), "k long, tokens array<bigint>")
    got = {(x["a"], x["b"]) for x in set_join.similar_pairs(df, "k", 0.6).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.6 - 1e-9}
    assert got == want and want


def _signatures(text):
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    runs = [[]]
    for w in words:
        if w in spotsigs.ANCHORS:
            runs.append([w])
        else:
            runs[-1].append(w)
    out = set()
    for k, run in enumerate(runs):
        tail = [w for j, x in enumerate(runs[k:]) for w in (x if k + j == 0 else x[1:])]
        out.add((run[0] if k else "", *tail[:2]))
    return out if words else set()


def test_spot_signatures(spark, make, odd):
    docs = [(1, "The cat of the house is on a red mat"), (2, "cat"), (3, ""), (5, "THE CAT of the house is on a red mat!"), (9, None), (4, "la maison de la rue est grande et belle"), (6, "the of to in the cat the of to in is dog"), (7, "a the of to in bird fish"), (8, "the of"), (10, "the of to in cat dog the of to in bird fish is")]
    got = {r["doc_id"]: r for r in spotsigs.edited_against_next(make(docs)).collect()}
    order = sorted(docs, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + (after[1] or "")[:cut]
        own, other, changed = _signatures(t), _signatures(after[1] or ""), _signatures(edited)
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(got[i]["fingerprint"].split()) == len(own)
        assert abs(got[i]["near_next"] - like(own, other)) < 1e-9 and abs(got[i]["near_edited"] - like(own, changed)) < 1e-9
    assert got[1]["fingerprint"] == got[5]["fingerprint"] != got[2]["fingerprint"]
    assert spotsigs.edited_against_next(odd).count() == odd.count() and spotsigs.edited_against_next(odd.limit(0)).count() == 0


def test_spot_links_equal_brute_force(spark, make):
    r = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["the", "of", "is"] * 8
    docs = []
    for i in range(60):
        w = r.choices(words, k=r.randint(5, 60)) if i % 3 == 0 else docs[-1][1].split()
        if i % 3:
            w[r.randrange(len(w))] = "new"
        docs.append((i, " ".join(w)))
    members, links = spotsigs.links(make(docs))
    of = {x["doc_id"]: x["set_id"] for x in members.collect()}
    sets = {of[i]: _signatures(t) for i, t in docs}
    got = {(x["a"], x["b"]) for x in links.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 - 1e-9}
    assert got == want and want
    # the query's columns: equal sets are one class, repeated and null ids keep the links of their own text
    docs += [(70, docs[1][1]), (70, docs[4][1]), (None, docs[7][1]), (-(1 << 63), docs[2][1]), (71, ""), (None, None)]
    sets = {frozenset(_signatures(t or "")) for _, t in docs}
    n_links = lambda s: sum(o != s and len(s & o) / len(s | o) >= 0.8 - 1e-9 for o in sets)
    rows = spotsigs.edited_against_next(make(docs)).collect()
    expected = sorted((str(i), len(t or ""), n_links(frozenset(_signatures(t or "")))) for i, t in docs)
    assert sorted((str(x["doc_id"]), x["n_chars"], x["n_links"]) for x in rows) == expected and any(x[2] for x in expected)
    assert len({x["class_id"] for x in rows}) == len(sets) == len({x["fingerprint"] for x in rows})


def test_spot_links_of_near_copies_make_no_row_a_pair(spark, make, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK", 16, raising=False)
    rows, store = [], spotsigs.stored

    def counted(df):
        rows.append((kept := store(df)).count())
        return kept

    monkeypatch.setattr(spotsigs, "stored", counted)
    r = random.Random(3)
    base = [f"{r.choice(['the', 'of', 'is'])} w{k} v{r.randrange(9)}" for k in range(40)]
    docs = []
    for i in range(150):
        w = list(base)
        for k in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"the x{i} y{k}"
        docs.append((i, " ".join(w[: r.randint(33, 40)])))
    sets = [frozenset(_signatures(t)) for _, t in docs]
    linked = {s: sum(o != s and len(s & o) / len(s | o) >= 0.8 - 1e-9 for o in set(sets)) for s in set(sets)}
    want = {i: linked[s] for i, s in enumerate(sets) if linked[s]}
    got = {x["doc_id"]: x["n_links"] for x in spotsigs.link_counts(make(docs), "doc_id", "text").collect()}
    assert got == want and sum(want.values()) > 8_000 and max(rows) < 3_000
    pairs = [(x["a"], x["b"]) for x in spotsigs.links(make(docs))[1].collect()]
    assert len(pairs) == len(set(pairs)) == sum(linked.values()) / 2
