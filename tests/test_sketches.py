"""Stored sketches: merged ones against one scan, and both against exact numbers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from qaloom.operators import sketches
from qaloom.sources.snapshots import SnapshotTable


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = [(rng.choice("ab"), rng.randrange(5), rng.randrange(3000), rng.random() ** 2, rng.choice(["m0"] * 5 + ["m1"] * 3 + [f"x{rng.randrange(900)}"])) for _ in range(8000)]
    return spark.createDataFrame(made + [("a", 0, None, None, None)], "producer string, day int, question long, latency double, model string").cache()


def test_stored_sketches_merge_to_those_of_one_scan(spark, rows, tmp_path):
    held = SnapshotTable(spark, str(tmp_path / "sketches"))
    of = lambda df: sketches.sketched(df, ["producer", "day"], "question", "latency", "model")
    held.create(of(rows).schema)
    for day in range(5):
        held.append(of(rows.where(F.col("day") == day)))
    read = lambda df: {r["producer"]: r for r in df.select("producer", "n", sketches.distinct_of(F.col("distinct_sketch")).alias("d"), sketches.quantile_of(F.col("quantile_sketch"), 0.5).alias("q"), sketches.frequent(F.col("item_sketch"), 2).alias("top")).collect()}
    merged, once = read(sketches.merged(held.read(), ["producer"])), read(sketches.sketched(rows, ["producer"], "question", "latency", "model"))
    exact = {r["producer"]: r for r in rows.groupBy("producer").agg(F.count("*").alias("n"), F.count_distinct("question").alias("d"), F.sort_array(F.collect_list("latency")).alias("all")).collect()}
    for p, want in exact.items():
        assert merged[p]["n"] == once[p]["n"] == want["n"]
        assert abs(merged[p]["d"] - once[p]["d"]) <= sketches.DISTINCT_ERROR * want["d"]
        for got in (merged[p], once[p]):
            assert abs(got["d"] - want["d"]) <= sketches.DISTINCT_ERROR * want["d"]
            assert abs(sum(x <= got["q"] for x in want["all"]) / len(want["all"]) - 0.5) <= 2 * sketches.RANK_ERROR
            assert [x["item"] for x in got["top"]] == ["m0", "m1"]


def test_empty(rows):
    assert sketches.merged(sketches.sketched(rows.where("false"), ["producer", "day"], "question", "latency", "model"), ["producer"]).count() == 0
