"""Running sums within a key, however many rows the key has.

Rows of a key are dealt to buckets by a hash; a bucket's rows are ordered in one window partition
of bounded size, and the buckets' totals, one row each, are summed up before them: of one key they
go through one task, a row for 4,096 of the key's rows.  The order is by bucket, then by the given
columns: deterministic, whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4096


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, value: str | None = None, to: str = "before", key_rows: str | None = None, place: Column | None = None) -> DataFrame:
    """``df`` and the column ``to``: the sum of ``value`` (1 each, if none) over the earlier rows of the same keys.

    ``rows`` is the number of rows of ``df``, which sizes the buckets; where most keys are small,
    ``key_rows`` names a column with the rows of each key, which then sizes its own.  ``place``, a long, deals rows to
    buckets; a hash of ``order``, if none.  Rows that are equal in
    ``order`` come in any order among themselves.  Null keys are keys like others.
    """
    many = max(1, -(-rows // BUCKET_ROWS))
    each: Column = F.col(value) if value else F.lit(1).cast("long")
    deal = F.ceil(F.col(key_rows) / BUCKET_ROWS) if key_rows else F.lit(many)
    bucket = F.pmod(F.xxhash64(*order) if place is None else place, deal).cast("int")
    dealt = df.withColumns({"_key": _named(keys), "_bucket": bucket, "_each": each})
    inside = Window.partitionBy("_key", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt_sums = dealt.withColumn("_inside", F.coalesce(F.sum("_each").over(inside), F.lit(0)).cast("long"))
    if many == 1:
        return dealt_sums.withColumn(to, F.col("_inside")).drop("_key", "_bucket", "_each", "_inside")
    over = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_key", "_bucket").agg(F.sum("_each").alias("_sum")).withColumn("_earlier", F.coalesce(F.sum("_sum").over(over), F.lit(0)))
    # The rows are dealt by these two columns already, so the join moves none of them again.
    joined = dealt_sums.join(totals.select("_key", "_bucket", "_earlier"), ["_key", "_bucket"])
    return joined.withColumn(to, (F.col("_earlier") + F.col("_inside")).cast("long")).drop("_key", "_bucket", "_each", "_inside", "_earlier")


def _named(keys: Sequence[str]) -> Column:
    """The keys as one string that is never null: different for different keys."""
    if len(keys) == 1:
        return F.coalesce(F.concat(F.lit("="), F.col(keys[0]).cast("string")), F.lit(""))
    return F.to_json(F.struct(*keys))
