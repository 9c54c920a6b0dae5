"""Every query with SQL gives what DuckDB gives on the small tables."""

from __future__ import annotations

import duckdb
import pytest

from qaloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: "null" if x is None else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    said = duck.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in said.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(said.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in catalogue.oracle_sql()])
def test_query_without_sql(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bm25_rrf_fuses_whole_rankings(spark, tmp_path):
    n = 150  # all share one term; the later, the shorter and so the better by BM25
    spark.createDataFrame([(1, "alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, "alpha" + " x" * (n - k)) for k in range(n)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in catalogue.queries()["bm25_rrf"](spark, str(tmp_path)).collect()}
    want = {k: 1 / (60 + n - k) + 1 / (61 + k) for k in range(n)}
    assert got == pytest.approx({k: want[k] for k in [*range(5), *range(n - 5, n)]})


@pytest.mark.parametrize("name", ["sql_blocks", "block_kinds"])
def test_blank_lines_and_other_breaks(spark, tmp_path, name):
    """Empty lines and lines of spaces are blank, and only line feeds end a line, as in the SQL."""
    long = "a line of more than forty characters, in all forty-nine"
    texts = ["", "\n\n\n", f"{long}\n\n{long}x", f"   \n{long}", " " * 45 + f"\n{long}", f"{long}\x0b{long}\n{long} x", f"{long}\r\nshort\r\n\r{long}", f"a | {long}\x85\n\nb | {long}"]
    spark.createDataFrame([(k, x, "web") for k, x in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    said = c.execute(catalogue.oracle_sql()[name])
    assert canonical(df.collect(), df.columns) == canonical(said.fetchall(), [x[0] for x in said.description])
