import pytest
from pyspark.sql import Row

from vitalshare.llm.queries import tokenizer

WORDS = "the quick brown fox jumps over the lazy dog while seven small birds sing in a tree".split()


@pytest.fixture(scope="session")
def word_bpe():
    return tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_bpe():
    return tokenizer("byte_bpe_50k.json")


#: Nulls, empty, odd and very long texts, repeated rows.
TEXTS = [
    None,
    "",
    " ",
    "\n\t ",
    "a",
    "The The THE the.",
    "naïve café — 日本語, it's <|endoftext|> ok <|STARTOFTEXT|>",
    "word " * 30_000,
    "x" * 20_000,
    "line one\nline two\r\n  spaced   out \x0b end",
    " ".join(WORDS),
    " ".join(WORDS),
    "12,345.67 3.14 e.g., U.S.A. 'tis o'clock.",
    "﻿bom \x1c odd \x85 spaces   here",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every oddity, a null id, a repeated row and clashing extra columns."""
    rows = [Row(doc_id=i, text=t, uid="u", key=1, score=2.0, part=3, label="l", lang="en") for i, t in enumerate(TEXTS)]
    rows.append(Row(doc_id=None, text="no id", uid="u", key=1, score=2.0, part=3, label="l", lang=None))
    rows.append(rows[4])
    return spark.createDataFrame(
        rows, "doc_id long, text string, uid string, key int, score double, part int, label string, lang string"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
