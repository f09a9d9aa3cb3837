from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tenderspark.llm import pii

SF = "/root/testdata/sf0.01"


def by_the_rules(text):
    """The four patterns as they are written, each match tested."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def tagger(docs):
    return pii.fit(docs, sample=150, passes=8)


def test_rules_are_the_patterns():
    r = random.Random(5)
    for chars in ("a1.@-% +é", "0123.. ", "0145 -", "+12() .-x", "4111 1111"):
        for _ in range(3000):
            t = "".join(r.choice(chars) for _ in range(r.randint(0, 40)))
            assert pii.rule_spans(t) == by_the_rules(t), t
    assert pii.rule_spans("x 4111 1111 1111 1111, +1 (212) 555-0147, a@b.c.d, 256.1.1.1 10.0.0.1") == [
        ("card", 2, 21), ("phone", 23, 40), ("email", 42, 49), ("ip", 61, 69)
    ]
    # long runs take no time that grows with their square
    assert pii.rule_spans("x" * 400_000 + "@ " + "1" * 400_000 + "." + "+1(" * 1000) == []


def test_gradients_are_those_of_small_steps():
    tagger = pii.Tagger.fresh(4, 5, 1)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, pii.SYMBOLS, (7, 3)), np.zeros((7, 3), int)
    y[1], y[2], y[4, 1], y[5, 1] = 1, 2, 5, 6
    _, grads = tagger.gradients(x, y)
    for name, p in tagger.p.items():
        for _ in range(4):
            at = {"e": (x[1, 0], 1), "t": (0, 1), "s": (0,)}.get(name) or tuple(r.integers(0, n) for n in p.shape)
            old, loss = p[at], []
            for step in (1e-5, -1e-5):
                p[at] = old + step
                loss.append(tagger.gradients(x, y)[0])
            p[at] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - grads[name][at]) < 1e-6, (name, at)


def test_decoding_is_the_best_of_all_taggings():
    from itertools import product

    tagger = pii.Tagger.fresh(4, 5, 3)
    x = np.random.default_rng(1).integers(0, pii.SYMBOLS, (4, 2))
    tags, share = tagger.tags(x)
    emit, _ = tagger._emit(x)
    move, start = tagger._scores()
    for row in range(2):
        score = {way: start[way[0]] + sum(emit[t, row, k] for t, k in enumerate(way)) + sum(move[a, b] for a, b in zip(way, way[1:])) for way in product(range(pii.TAGS), repeat=4)}
        best = max(score, key=score.get)
        assert tuple(tags[:, row]) == best
        total = sum(np.exp(float(s)) for s in score.values())
        for t in range(4):
            assert abs(sum(np.exp(float(s)) for way, s in score.items() if way[t] == best[t]) / total - share[t, row]) < 1e-4


def test_base_spans_of_the_table(docs, tagger):
    rows = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    clean = 0
    for r in pii.find(docs, tagger, ["doc_id"]).collect():
        text, base = rows[r["doc_id"]], [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        want = by_the_rules(text)
        assert base == want and r["base_sha256"] == hashlib.sha256(pii.listed(want).encode()).hexdigest()
        added = [(s["kind"], s["start"], s["end"]) for s in r["added"]]
        assert r["spans"] == pii.listed(sorted([*base, *added], key=lambda s: (s[1], pii.KINDS.index(s[0]))))
        assert not any(a < y and x < b for _, a, b in added for _, x, y in base)
        clean += not want and bool(added)
    assert clean <= 1  # texts without personal data are left alone


def test_other_forms_are_found_on_texts_not_learned_from(spark, tagger, make):
    """Spans of made-up sentences of another seed, rewritten so that no rule finds them."""
    r = random.Random(77)
    texts, want = [], []
    for sentence in pii.made_up(991, 400):
        spans = pii.rule_spans(sentence)
        if len(spans) != 1 or spans[0][0] == "card":
            continue
        kind, a, b = spans[0]
        form = pii.rewritten(kind, sentence[a:b], r)
        text = f"{'plain words of it ' * 10}{sentence[:a]}{form}{sentence[b:]}"
        if not pii.rule_spans(text) and pii.plausible(kind, form):
            texts.append(text)
            want.append((kind, 180 + a, 180 + a + len(form)))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii.find(make(list(enumerate(texts))), tagger, ["doc_id"]).collect()}
    near = sum(any(k == kind and abs(x - a) <= 1 and abs(y - b) <= 1 for k, x, y in got[i]) for i, (kind, a, b) in enumerate(want))
    assert len(want) > 80 and near / len(want) > 0.7, near / len(want)


def test_windows_cover_every_trigger_and_one_answer_comes_of_them(tagger):
    text = "word " * 40 + "anna.b [at] firm [dot] org" + " word" * 40
    for shift in range(0, 130, 13):
        t = "é" * shift + text
        starts = pii.windows(t)
        signs = [m.start() for m in re.finditer(r"[0-9@]|[(\[](?:at|dot)[)\]]", t)]
        assert all({k for k in range(0, len(t), pii.STRIDE) if k <= s < k + pii.WINDOW} <= set(starts) for s in signs)
        tags, share = tagger.tags(np.array([pii._filled(pii.symbols(t), at) for at in starts]).T)
        got = pii.reconcile(t, [(at, tags[:, k], share[:, k]) for k, at in enumerate(starts)], [], 0.8)
        assert len(got) <= 1
    one = np.array([0, 1, 2, 2, 0, 0, 0, 0])
    sure = np.ones(8)
    assert pii.reconcile("aa(at)b.cc.de", [(0, np.array([1, *[2] * 12]), np.ones(13))], [("ip", 3, 5)], 0.8) == []
    assert pii.reconcile("0" * 8, [(0, one, sure)], [], 0.8) == []  # not plausible


def test_odd_rows(spark, odd, docs, tagger):
    got = pii.find(odd, tagger, ["doc_id"])
    assert got.count() == odd.count() and pii.find(odd.limit(0), tagger, ["doc_id"]).count() == 0
    assert all(r["base"] == [] and r["added"] == [] and r["spans"] == "" for r in got.collect())
    alone = pii.fit(odd.limit(0), sample=5, passes=1)
    assert pii.find(odd, alone, ["doc_id"]).count() == odd.count()
