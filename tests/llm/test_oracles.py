from __future__ import annotations

import duckdb
import pytest

from qaloom.llm import queries
from tests.llm.conftest import DIR
from tests.test_catalogue import TABLES, canonical


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    said = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in said.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(said.fetchall(), columns)


def test_mix_sql_where_sources_reach_their_limit(spark, tmp_path):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "b"), (3, "c"), (400, "d"), (0, "e"), (5, None), (9, "d"), (7, "c")])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.mixed_words(spark, str(tmp_path))
    said = c.execute(queries.oracle_sql()["mixed_words"])
    assert canonical(df.collect(), df.columns) == canonical(said.fetchall(), [x[0] for x in said.description])
