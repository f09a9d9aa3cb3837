"""Whole tables of queries against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash

from tenderspark.llm import queries, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def plain_spans(text):
    """The three patterns as they are written, failing matches dropped."""
    out = [("assign", *m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets_of_a_table(spark, texts):
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    rows = queries.op2_secret_scan(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        assert {*listed(want).split(",")} <= {*r["spans"].split(",")} | {""}
    r = random.Random(3)
    parts = ["token", "API_KEY", "apikey", "Secret", '"', "'", " ", "=", ":", "abc", "A1b2", "AKIA", "Z9" * 9, "0a" * 12, "é", "\n", "passwd"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert secret_scan.base_spans(t) == plain_spans(t), t


def test_links_reach_as_far_as_every_pair_of_parts(spark, make):
    """A weak part is reported exactly if its complements start within the scope, tried for every pair."""
    r = random.Random(9)
    key = lambda: "".join(r.choice("aB3") for _ in range(20)) + "aB3"
    docs = []
    for i in range(120):
        bits = [r.choice([f"login=bob{r.randint(100, 999)}", key(), "https://db.host/x", "password=hunter22", "plain words"]) + " " + "w " * r.choice([0, 5, 60, 99]) for _ in range(r.randint(0, 8))]
        docs.append((i, "".join(bits)))
    side = {"access": "id", "weak_id": "id", "weak_endpoint": "endpoint"}
    for x in secret_scan.find_secrets(make(docs)).collect():
        text = docs[x["doc_id"]][1]
        base = secret_scan.base_spans(text)
        parts = base + secret_scan.weak_parts(text, base)
        near = lambda a, kind: any(side.get(k, "secret") == kind and abs(b - a) <= 200 for k, b, _ in parts)
        needs = {"weak_id": ["secret"], "weak_secret": ["id"], "weak_endpoint": ["id", "secret"]}
        want = {(k, a, b) for k, a, b in parts if k in needs and all(near(a, s) for s in needs[k])}
        assert {(s["kind"], s["start"], s["end"]) for s in x["linked"]} == want


def test_components_of_a_table(spark, texts):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = {i: fingerprint(t) for i, t in texts.items()}
    least = {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for i in marks:
            for j in marks:
                if (marks[i] ^ marks[j]).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{marks[i]:016x}", least[i]) for i in marks}


def test_edited_texts_of_a_table(spark, texts):
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in queries.op10_spot_signatures(spark, SF).collect()}
    assert sorted(rows) == sorted(texts)
    for i, after in zip(order, [*order[1:], order[0]]):
        text, cut = texts[i], len(texts[i]) // 3
        edited = text[: len(text) - cut] + texts[after][:cut]
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
        if texts[i] == texts[after]:
            assert rows[i]["near_next"] == 1 and rows[i]["fingerprint"] == rows[after]["fingerprint"]
