"""The table function gives the blocks of the DataFrame form, from texts and from tables of lines."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from qaloom.functions import table_functions
from qaloom.operators import segment

TEXT = "lost\n# Top\n## One \n- a\n  - b\npara  x\n\n| h | k |\n|---|:-:|\n| 1 | 2 |\n||\n### Two\n| - |\n-no\n-  c\r\nlast ## Three"


@pytest.fixture(scope="module")
def docs(spark):
    table_functions.register(spark)
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (4, "## only"), (5, "| a |\n\n| b |")], "doc long, body string")
    df.createOrReplaceTempView("docs_of_blocks")
    return df


def rows(df):
    return sorted((tuple(r[c] for c in ("doc", "block", "kind", "level", "text", "items", "header", "rows")) for r in df.collect()), key=str)


def test_lateral_texts(spark, docs):
    got = spark.sql("SELECT d.doc, b.* FROM docs_of_blocks d, LATERAL markdown_blocks(d.body) b")
    assert rows(got) == rows(segment.blocks_of(docs, "doc"))


def test_partitioned_lines_with_other_columns(spark, docs):
    lines = docs.where("body is not null").select("doc", F.lit(1.5).alias("weight"), F.posexplode(F.split("body", r"\R")).alias("line_no", "line"))
    lines.repartition(5).createOrReplaceTempView("lines_of_blocks")
    got = spark.sql("SELECT * FROM markdown_blocks(TABLE(lines_of_blocks) PARTITION BY doc ORDER BY line_no)")
    assert got.columns[:2] == ["doc", "weight"] and rows(got) == rows(segment.blocks_of(docs, "doc"))
    assert {r["weight"] for r in got.collect()} == {1.5}


def test_wrong_arguments(spark, docs):
    with pytest.raises(AnalysisException, match="line_no and line"):
        spark.sql("SELECT * FROM markdown_blocks(TABLE(docs_of_blocks) PARTITION BY doc)").collect()
    with pytest.raises(AnalysisException, match="a text or a table"):
        spark.sql("SELECT * FROM markdown_blocks(1)").collect()
