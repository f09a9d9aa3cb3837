"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece exactly one token can come last in its BPE encoding. Storing that token per prefix
gives the whole encoding by walking back, lets bytes be appended without looking at earlier ones again, and lets an
edit re-encode from the edited byte on. Which token is valid follows from one test on adjacent tokens: undoing the
merges along their junction must never meet a merge that would have come first."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from tenderspark.llm.common import with_text_columns

#: Entries each worker remembers before it starts afresh: bounds its memory, never the result.
REMEMBERED = 400_000


class PrefixEncoder:
    """Encoder for one table of ranks (token bytes -> id, lower ids merge first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.halves: dict[int, tuple[int, int]] = {}
        self.fitting: dict[tuple[int, int], bool] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for a single byte."""
        whole = self.bytes_of[token]
        if len(whole) == 1:
            return None
        if token not in self.halves:
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = self.ranks[parts[0]], self.ranks[parts[1]]
        return self.halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves `left` and `right` beside each other as they are."""
        known = self.fitting.get((left, right))
        if known is None:
            if len(self.fitting) > REMEMBERED:
                self.fitting.clear()
            known = self.fitting[left, right] = self._fits(left, right)
        return known

    def _fits(self, x: int, y: int) -> bool:
        undone = 1 << 60
        while True:
            if self.ranks.get(self.bytes_of[x] + self.bytes_of[y], undone) < undone:
                return False
            xs, ys = self._halves(x), self._halves(y)
            if xs is None and ys is None:
                return True
            if ys is None or (xs is not None and x > y):
                undone, x = x, xs[1]
            else:  # at equal rank the left pair merges first
                undone, y = y + 1, ys[0]

    def prefixes(self, piece: bytes, kept: list[int] | None = None) -> list[int]:
        """The last token of each non-empty prefix. `kept`: those of the leading bytes that have not changed."""
        last = list(kept or ())
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.ranks.get(piece[start:end])
                if token is not None and (start == 0 or self.fits(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the rank table lacks a byte")
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding of the bytes that `last` covers."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens(self.prefixes(piece))

    def append(self, piece: bytes, last: list[int], more: bytes) -> list[int]:
        """Prefix table of `piece` + `more`, from that of `piece`."""
        return self.prefixes(piece + more, last)

    def edit(self, edited: bytes, last: list[int], at: int) -> list[int]:
        """Prefix table of a piece whose first `at` bytes are as before."""
        return self.prefixes(edited, last[:at])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


def parse_ranks(table: bytes) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, then its id, on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line.strip())}


@lru_cache(maxsize=2)
def _encoder(path: str) -> PrefixEncoder:
    with open(path, "rb") as f:
        return PrefixEncoder(parse_ranks(f.read()))


@lru_cache(maxsize=2)
def splitter(pattern: str) -> regex.Pattern:
    r"""`pattern` with \s read as Unicode white space only, as the rank file's library reads it."""
    space = r"\t-\r \x85\xa0  -     　"
    return regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and digest both.

    Returns id_col, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256, one row per input row.
    Null and empty texts have no tokens (digests of empty bytes); a null id stays null; repeated rows are repeated;
    other columns are ignored, whatever their names. `ranks_path` must be readable on every worker. No shuffle."""

    def start():
        encoder, pieces = _encoder(ranks_path), splitter(pattern)
        table = {str(i): b for i, b in encoder.bytes_of.items()}
        known: dict[str, str] = {}

        def joined(text: str) -> str:
            out = []
            for piece in pieces.findall(text):
                ids = known.get(piece)
                if ids is None:
                    if len(known) > REMEMBERED:
                        known.clear()
                    ids = " ".join(map(str, encoder.encode(piece.encode())))
                    if len(piece) <= 64:
                        known[piece] = ids
                out.append(ids)
            return " ".join(out)

        def digests(texts: list) -> list[list]:
            counts, ids_sha, back_sha = [], [], []
            for text in texts:
                ids = joined(text or "")
                parts = ids.split(" ") if ids else []
                counts.append(len(parts))
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                back_sha.append(hashlib.sha256(b"".join(map(table.__getitem__, parts))).hexdigest())
            return [counts, ids_sha, back_sha]

        return digests

    return with_text_columns(docs, [id_col], text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", start)
