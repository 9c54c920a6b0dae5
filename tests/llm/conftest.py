from __future__ import annotations

import re

import pytest

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, columns with clashing names."""
    long_ = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, long_, "a"), (5, long_ + " end", "b"), (6, "one two three", "b"), (6, "one two three", "b"), (7, "ONE two  three", None),
        (None, "one two three", "c"), (None, None, None), (8, "x" * 300_000, "c"), (9, "\u00a0 \u2028 caf\u00e9 \U0001f600 n\u0303", "c"), (10, "a b c d e f g h " * 30, "d"), (11, long_, "a"), (12, "\x00 null byte", "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = "cast(null as string) AS lang, 7L AS n_chars, 1 AS id, 'x' AS n, 2 AS size, 3 AS cls, 'y' AS html, 4 AS rank, 5 AS piece, 6 AS kept, 'h' AS host, array(1) AS segments, 8 AS shard, 'r' AS row"
    return df.selectExpr("*", *extra.split(", "))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
