from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, _doc string, length int, tokens int, id int, t string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text[, lang]) with extra columns whose names the operators use themselves."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", "x", "x", 1, 1, 1, "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Null ids and texts, empty and very long texts, repeated rows."""
    return make([
        (1, "The cat sat on the mat and it was good for all of us\nand that line is here for you to see"), (2, None), (3, ""), (None, "a word of the text"), (None, None), (4, "x" * 300_000),
        (5, "word of " * 40_000), (6, "same text of the kind that is here"), (6, "same text of the kind that is here"), (7, "   \n\t "), (8, "été çà et là\x00\x1c 𝒳"),
    ])
