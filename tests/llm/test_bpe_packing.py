from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
import zlib
from tokenizers import Tokenizer

from tenderspark.llm import byte_bpe, packing

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def _library():
    with open(RANKS, "rb") as f:
        ranks = byte_bpe.parse_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_prefix_encoder_equals_library():
    ranks, library = _library()
    encoder, split = byte_bpe.PrefixEncoder(ranks), byte_bpe.splitter(P.PATTERN)
    r = random.Random(5)
    texts = ["".join(r.choice("abcdeinorst thé ,.\n\t0") for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += ["a\x1cb \x85d e   \n\n  x", "aaaa" * 200, "don't I'll 12345 ½ 日本語 🎉"]
    for t in texts:
        ids = [i for p in split.findall(t) for i in encoder.encode(p.encode())]
        assert ids == library.encode_ordinary(t) and encoder.decode(ids) == t.encode()


def test_append_and_edit_reuse_prefixes():
    ranks, _ = _library()
    e = byte_bpe.PrefixEncoder(ranks)
    last = e.prefixes(b"tender")
    assert e.append(b"tender", last, b"ing") == e.prefixes(b"tendering")
    assert e.edit(b"tenors", last, 3) == e.prefixes(b"tenors")


def test_encode_decode_rows(spark, odd):
    _, library = _library()
    got = byte_bpe.encode_decode(odd, RANKS, P.PATTERN).collect()
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    assert byte_bpe.encode_decode(odd.limit(0), RANKS, P.PATTERN).count() == 0


def test_plan_uses_every_piece_once():
    r = random.Random(1)
    for counts in ({}, {5: 3}, {8: 1}, {3: 4, 5: 4}, {n: r.randint(0, 9) for n in range(1, 65)}, {1: 10_000_000, 33: 4}):
        plan, used = packing.plan(counts, 64 if max(counts, default=0) > 8 else 8), Counter()
        for lengths, times in plan:
            assert sum(lengths) <= (64 if max(counts, default=0) > 8 else 8)
            for n in lengths:
                used[n] += times
        assert used == Counter({n: c for n, c in counts.items() if c})
    assert sum(t for _, t in packing.plan({3: 4, 5: 4}, 8)) == 4  # exact complements


def test_pack_documents(spark, odd):
    got = packing.pack_documents(odd, WORDS).toPandas()
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in odd.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for a in range(0, len(ids), 2048):
            want[r["doc_id"], a // 2048, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    rows = Counter((None if x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples())
    assert rows == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1
    assert packing.pack_documents(odd.limit(0), WORDS).count() == 0
