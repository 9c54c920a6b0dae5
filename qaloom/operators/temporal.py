"""Joins by time: the last row at or before a moment, and intervals that overlap.

Neither compares all rows of a key.  Time is cut into buckets, so that rows of one key go to many
tasks; a bucket with more rows than HOT is split further by hash, its partners repeated for each
part.  Which buckets are hot is counted, and no more than rows / HOT of them can be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT = 100_000  # rows of one side in a bucket, from which on it is split
GROWTH = 4  # of bin widths, level by level


def _micros(time: Column, kind: str) -> Column:
    """Times as whole numbers: microseconds of timestamps, days of dates, numbers as they are."""
    if kind == "timestamp":
        return F.unix_micros(time)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_utc_timestamp(time.cast("timestamp"), F.current_timezone()))
    if kind == "date":
        return F.unix_date(time).cast("long")
    return time.cast("long")


def _time(df: DataFrame, name: str) -> Column:
    return _micros(F.col(f"`{name}`"), dict(df.dtypes)[name])


def _split(rows: DataFrame, by: Sequence[str], hot: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with _salt, and (by, _parts) of the places that have more than ``hot`` rows.

    Parts go by a hash of the whole row, so a task that runs again deals alike.
    """
    places = rows.groupBy(*by).count().where(F.col("count") > hot).select(*by, F.ceil(F.col("count") / hot).cast("int").alias("_parts"))
    places = F.broadcast(places)  # rows / hot of them at most
    dealt = rows.join(places, list(by), "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).cast("int"))
    return dealt.drop("_parts"), places


def _spread(rows: DataFrame, by: Sequence[str], places: DataFrame) -> DataFrame:
    """``rows`` once for each part of their place."""
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    return rows.join(places, list(by), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    bucket: int,
    ties: Sequence[str] = (),
    strict: bool = False,
    within: int | None = None,
    hot: int = HOT,
) -> DataFrame:
    """``left`` with the columns ``take`` of the last row of ``right`` of the same keys at or before its time.

    The two tables' rows of one key and time bucket are put in one order and the last right row is
    carried forward in it; what a bucket starts with is the last right row of the buckets before,
    found from one row for each bucket.  ``bucket`` is its width, in microseconds of timestamps, in
    days of dates, or in the numbers' own unit.

    Of right rows at one time the last by ``ties`` counts, nulls first.  ``strict``: before, not at.  ``within``: the
    oldest that a match may be.  Null keys or times match nothing; left rows without a match have nulls.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)]
    took = F.struct(_time(right, right_time).alias("t"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(take)])
    order = F.struct(_time(right, right_time).alias("t"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(ties)])
    whole = lambda t: F.expr(f"({t} div {bucket}) - if({t} % {bucket} < 0, 1, 0)")  # noqa: E731  exact for any long

    rows = left.select(*named, F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), _time(left, left_time).alias("_t"))
    sound = F.col("_t").isNotNull()
    for k in keys:
        sound &= F.col(k).isNotNull()
    found = right.select(*named, took.alias("_took"), order.alias("_by")).withColumn("_t", F.col("_took.t")).where(sound)
    # Of rows at one time only the last can be taken.
    found = found.groupBy(*keys, "_t").agg(F.max_by("_took", "_by").alias("_took")).withColumn("_b", whole("_t"))
    at = [*keys, "_b"]
    matched, places = _split(rows.where(sound).withColumn("_b", whole("_t")), at, hot)

    lasts = found.groupBy(*at).agg(F.max_by("_took", "_t").alias("_last"))
    asked = rows.where(sound).select(*keys, whole("_t").alias("_b")).distinct()
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    carried = lasts.join(asked.withColumn("_asked", F.lit(True)), at, "full").withColumn("_took", F.last("_last", ignorenulls=True).over(before)).where("_asked").select(*at, "_took")

    side = lambda df, n, t, took, row: df.select(*at, "_salt", F.lit(n).alias("_side"), t.alias("_t"), took.alias("_took"), row.alias("_row"))
    none_took, none_row = F.lit(None).cast(found.schema["_took"].dataType), F.lit(None).cast(rows.schema["_row"].dataType)
    first, then = (2, 1) if strict else (0, 1)
    both = (
        side(matched, then, F.col("_t"), none_took, F.col("_row"))
        .unionByName(side(_spread(found.join(asked, at, "left_semi"), at, places), first, F.col("_t"), F.col("_took"), none_row))
        .unionByName(side(_spread(carried.where("_took IS NOT NULL"), at, places), -1, F.lit(None).cast("long"), F.col("_took"), none_row))
    )
    line = Window.partitionBy(*at, "_salt").orderBy(F.asc_nulls_first("_t"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_found", F.last("_took", ignorenulls=True).over(line)).where("_row IS NOT NULL").select("_row", "_t", "_found")
    if within is not None:
        out = out.withColumn("_found", F.when(F.col("_t") - F.col("_found.t") <= within, F.col("_found")))
    out = out.select("_row", "_found").unionByName(rows.where(~F.coalesce(sound, F.lit(False))).select("_row", none_took.alias("_found")))
    return out.select("_row.*", *[F.col(f"_found.v{i}").alias(c) for i, c in enumerate(take)])


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bin_width: int,
    levels: int = 12,
    hot: int = HOT,
    moments: bool = False,
) -> DataFrame:
    """Pairs (l, r), two structs, of rows of the same keys whose half-open spans [from, to) overlap.

    Bins come in levels, each GROWTH times as wide; a span's own level is the first whose bins are
    no narrower than it, so it lies in two bins of that level at most, and of every wider one.  A pair
    meets at the wider one's level: a row goes once or twice to each level from its own on, levels that the
    other table doesn't have left out; and a pair that shares two bins counts in the first.  An empty
    or backward span, and null keys or ends, overlap nothing.  With ``moments`` ends are compared as they are, l.from < r.to
    and r.from < l.to: an empty or backward span then lies in every span that reaches beyond both its ends.
    """
    keys = [f"_k{i}" for i in range(len(on))]

    def spans(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        lo, hi = (_time(df, c) for c in span)
        rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), lo.alias("_lo"), hi.alias("_hi"))
        rows = rows.na.drop(subset=[*keys, "_lo", "_hi"]) if moments else rows.where(F.col("_lo") < F.col("_hi")).na.drop(subset=keys)
        own = F.lit(levels - 1)
        for n in reversed(range(levels - 1)):
            own = F.when(F.abs(F.col("_hi") - F.col("_lo")) <= bin_width * GROWTH**n, n).otherwise(own)
        return rows.withColumn("_own", own.cast("int"))

    def binned(rows: DataFrame, has: Sequence[int]) -> DataFrame:
        """Each row in its bins of its own level, and of those wider ones in ``has``, where the other side has rows of its own."""
        all_levels = F.array(*[F.lit(n) for n in range(levels)])
        own = F.col("_own")
        go = F.filter(all_levels, lambda n: (n == own) | ((n > own) & F.array_contains(F.array(*[F.lit(h) for h in has] or [F.lit(-1)]), n)))
        wide = F.element_at(F.array(*[F.lit(bin_width * GROWTH**n).cast("long") for n in range(levels)]), F.col("_level") + 1)
        out = rows.withColumn("_level", F.explode(go)).withColumn("_wide", wide)
        floor = lambda t: F.expr(f"({t} div _wide) - if({t} % _wide < 0, 1, 0)")
        out = out.withColumn("_first", floor("least(_lo, _hi)"))
        return out.withColumn("_bin", F.explode(F.sequence("_first", floor("greatest(_lo, _hi - 1)")))).drop("_wide")

    a, b = spans(left, left_span, "l"), spans(right, right_span, "r")
    levels_of = lambda df: [r["_own"] for r in df.select("_own").distinct().collect()]  # noqa: E731  `levels` at most
    have_a, have_b = levels_of(a), levels_of(b)
    at = [*keys, "_level", "_bin"]
    left_bins, places = _split(binned(a, have_b), at, hot)
    right_bins = _spread(binned(b, have_a), at, places)
    x = left_bins.select(*at, "_salt", "l", F.col("_lo").alias("_llo"), F.col("_hi").alias("_lhi"), F.col("_own").alias("_lown"), F.col("_first").alias("_lfirst"))
    y = right_bins.select(*at, "_salt", "r", "_lo", "_hi", "_own", "_first")
    meet = x.join(y, [*at, "_salt"]).where((F.col("_llo") < F.col("_hi")) & (F.col("_lo") < F.col("_lhi")))
    once = (F.col("_level") == F.greatest("_own", "_lown")) & (F.col("_bin") == F.greatest("_first", "_lfirst"))
    return meet.where(once).select("l", "r")
