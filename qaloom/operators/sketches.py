"""Sketches of answers that are stored and merged: distinct questions, latency quantiles, frequent models.

A day's answers become one row of sketches for each group; any span of days is a merge of these rows,
without the answers.  Sketches are Spark's own aggregates, so they are combined map-side, and a
group with most of the answers moves a few kilobytes for each task.

Errors, with the sizes used here: distinct counts within 3 standard errors of 1.04 / sqrt(2**LG_K), 2.5%;
quantiles within 1.33% of rank; a frequent item's count is too low by n / COUNTERS at most, so none above that
share is missed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
QUANTILES_K = 200
COUNTERS = 1024
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.0133


def sketched(rows: DataFrame, by: Sequence[str], distinct: str, number: str, item: str) -> DataFrame:
    """(by, n, distinct_sketch, quantile_sketch, item_sketch) of each group; nulls count in n alone."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct), LG_K).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(number).cast("double"), F.lit(QUANTILES_K)).alias("quantile_sketch"),
        F.call_function("approx_top_k_accumulate", F.col(item), F.lit(COUNTERS)).alias("item_sketch"),
    )


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored sketches of finer groups as those of coarser ones."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.call_function("approx_top_k_combine", F.col("item_sketch"), F.lit(COUNTERS)).alias("item_sketch"),
    )


def distinct_of(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_of(sketch: Column, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(rank))


def frequent(sketch: Column, k: int) -> Column:
    """array<struct<item, count>>, most frequent first."""
    return F.call_function("approx_top_k_estimate", sketch, F.lit(k))
