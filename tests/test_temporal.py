"""Joins by time against DuckDB's, with ties, nulls, hot buckets and very long spans."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qaloom.operators.temporal import asof_join, overlap_join


def tables(spark, seed, n=200):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    left = [(i, key(), rng.choice([None, *range(-50, 400)])) for i in range(n)]
    right = [(key(), rng.randrange(-80, 300), rng.randrange(5), rng.choice([None, rng.randrange(100)])) for _ in range(n // 2)]
    return spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, since long, nth int, price int"), left, right


def plain(left, right, strict, within):
    out = []
    for i, k, t in left:
        fit = [r for r in right if k is not None and t is not None and r[0] == k and (r[1] < t if strict else r[1] <= t)]
        best = max(fit, key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0), default=None)
        if best and within is not None and t - best[1] > within:
            best = None
        out.append((i, k, t, best and best[3], best and best[1]))
    return sorted(out)


@pytest.mark.parametrize(("bucket", "hot", "strict", "within"), [(1000, 10**6, False, None), (20, 3, False, None), (7, 2, True, None), (1, 1, False, 30), (50, 4, True, 5)])
def test_asof(spark, bucket, hot, strict, within):
    l, r, left, right = tables(spark, bucket)
    got = asof_join(l, r, ["k"], "t", "since", ["price", "since"], bucket, ["nth", "price"], strict, within, hot)
    assert got.columns == ["id", "k", "t", "price", "since"]
    key = lambda x: x[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(left, right, strict, within), key=key)


def test_asof_of_timestamps_equals_duckdb(spark):
    rng = random.Random(4)
    when = lambda: pd.Timestamp("2024-03-01") + pd.Timedelta(microseconds=rng.randrange(10**12))
    left = pd.DataFrame({"id": range(300), "k": [rng.choice("xy") for _ in range(300)], "t": [when() for _ in range(300)]})
    right = pd.DataFrame({"k": [rng.choice("xyz") for _ in range(80)], "since": [when() for _ in range(80)], "price": range(80)})
    want = _duck(left, right).execute("SELECT id, price FROM uses u ASOF LEFT JOIN prices p ON u.k = p.k AND u.t >= p.since ORDER BY id").fetchall()
    for kind in ("timestamp", "timestamp_ntz"):
        l = spark.createDataFrame(left).withColumn("t", F.col("t").cast(kind))
        r = spark.createDataFrame(right).withColumn("since", F.col("since").cast(kind))
        got = asof_join(l, r, ["k"], "t", "since", ["price"], 3_600_000_000).select("id", "price").orderBy("id").collect()
        assert [tuple(x) for x in got] == want


def _duck(left, right):
    c = duckdb.connect()
    c.register("uses", left)
    c.register("prices", right)
    return c


def test_asof_without_rows_and_with_clashing_names(spark):
    l, r, _, _ = tables(spark, 1, 20)
    assert asof_join(l.where("false"), r, ["k"], "t", "since", ["price"], 10).count() == 0
    assert asof_join(l, r.where("false"), ["k"], "t", "since", ["price"], 10).where("price IS NULL").count() == 20
    odd = l.selectExpr("*", "1 AS _b", "2 AS _row", "3 AS _salt", "4 AS count")
    assert asof_join(odd, r, ["k"], "t", "since", ["price"], 10).count() == 20


@pytest.mark.parametrize(("width", "levels", "hot"), [(1, 6, 10**6), (4, 2, 3), (1000, 1, 2), (2, 12, 1)])
def test_overlaps(spark, width, levels, hot):
    rng = random.Random(width)

    def spans(n):
        out = []
        for i in range(n):
            lo = rng.randrange(-200, 400)
            out.append((i, rng.choice(["a", "a", "b", None]), lo, rng.choice([lo, lo - 3, lo + 1, lo + rng.randrange(20), lo + rng.randrange(500), None])))
        return out

    left, right = spans(90), spans(70)
    schema = "id int, k string, lo long, hi long"
    got = overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ("lo", "hi"), ("lo", "hi"), width, levels, hot)
    want = [(a[0], b[0]) for a in left for b in right if a[1] and a[1] == b[1] and a[3] is not None and b[3] is not None and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]]
    assert sorted((r["l"]["id"], r["r"]["id"]) for r in got.collect()) == sorted(want) and want


@pytest.mark.parametrize(("width", "levels", "hot"), [(1, 6, 10**6), (4, 2, 3), (2, 12, 1)])
def test_moments_lie_in_spans(spark, width, levels, hot):
    rng = random.Random(width)
    spans = lambda n: [(i, rng.choice(["a", "b", None]), lo := rng.randrange(-60, 90), rng.choice([lo, lo, lo - 3, lo + 1, lo + rng.randrange(20), lo + rng.randrange(150), None])) for i in range(n)]
    left, right = spans(120), spans(120)
    schema = "id int, k string, lo long, hi long"
    got = overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ("lo", "hi"), ("lo", "hi"), width, levels, hot, moments=True)
    want = [(a[0], b[0]) for a in left for b in right if a[1] and a[1] == b[1] and a[3] is not None and b[3] is not None and a[2] < b[3] and b[2] < a[3]]
    assert sorted((r["l"]["id"], r["r"]["id"]) for r in got.collect()) == sorted(want)
    assert any(left[i][2] >= left[i][3] for i, _ in want) and any(right[j][2] >= right[j][3] for _, j in want)


def test_outages_and_runs_of_no_time_equal_duckdb(spark, tmp_path):
    from qaloom.plans import streams

    at = lambda minute: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)
    rows = [(5, at(0), 3, "view", 60.0), (10, at(9), 3, "error", 0.0), (15, at(0), 3, "error", 0.01), (20, at(8), 3, "view", 0.0), (25, at(7), 3, "error", 2.0), (30, at(9), 3, "view", 0.0)]
    c = duckdb.connect()
    c.register("made", pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"]))
    c.execute(f"COPY (SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM made) TO '{tmp_path}/events.parquet'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(c.execute(streams.R.sql["overlapping_outages"]).fetchall())
    assert sorted(map(tuple, streams.overlapping_outages(spark, str(tmp_path)).collect())) == want and [r[:3] for r in want] == [(5, 2, 10), (20, 1, 25)]


def test_no_join_compares_all_pairs(spark):
    l, r, _, _ = tables(spark, 1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    both = plan(asof_join(l, r, ["k"], "t", "since", ["price"], 10)) + plan(overlap_join(l.withColumn("u", F.col("t") + 5), r.withColumn("u", F.col("since") + 5), ["k"], ("t", "u"), ("since", "u"), 4))
    assert "CartesianProduct" not in both and "NestedLoop" not in both
