"""Stratified splits: largest-remainder quotas, hashed order, round robin over types, leakage checks.

Order within a stratum is md5(seed:id): the same on any number of partitions and in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.operators.dedup import pairs_between, similar_classes, token_classes
from qaloom.sources.durable import Tables

MOST_BROADCAST = 100_000  # picked keys that are broadcast


def largest_remainder(sizes: DataFrame, k: int, stratum: str, size: str, order: str) -> DataFrame:
    """``sizes`` and quota: k places shared in proportion to size, in integers, none above its size.

    One row per stratum.  Equal remainders go by ``order``.
    """
    total = sizes.agg(F.sum(size).alias("total"))
    raw = sizes.crossJoin(F.broadcast(total)).withColumn("whole", F.call_function("div", F.col(size) * k, F.col("total"))).withColumn("rest", F.col(size) * k % F.col("total"))
    everything = Window.partitionBy()  # strata are few: one row each
    left = F.lit(k) - F.sum("whole").over(everything)
    nth = F.row_number().over(everything.orderBy(F.desc("rest"), order))
    out = raw.withColumn("quota", F.least(F.col("whole") + (nth <= left).cast("long"), F.col(size)).cast("long"))
    return out.drop("total", "whole", "rest")


def shuffled(key: Column, seed: int = 42) -> Column:
    """A place in a seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_split(df: DataFrame, key: str, stratum: str, kind: str, k: int, seed: int = 42) -> DataFrame:
    """``df`` and part: k rows are 'test', the rest 'train'; ``key`` is unique.

    Each stratum's quota is dealt over its kinds in turn, by hashed order; what quotas leave short
    is topped up from the rest, over all strata.  Only keys are ranked, and of each kind no more
    than k leave a task; the k keys picked are then looked up.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    quotas = F.broadcast(largest_remainder(sizes, k, stratum, "_size", stratum).select(F.col(stratum).alias("_stratum"), "quota"))
    keys = df.select(F.col(key).alias("_key"), F.col(stratum).alias("_of"), F.col(kind).alias("_kind"), shuffled(F.col(key), seed).alias("_at"))
    turn = F.row_number().over(Window.partitionBy("_of", "_kind").orderBy("_at", "_key"))
    first = keys.withColumn("_turn", turn).where(F.col("_turn") <= k)
    placed = first.withColumn("_nth", F.row_number().over(Window.partitionBy("_of").orderBy("_turn", "_kind", "_at", "_key"))).where(F.col("_nth") <= k)
    tables = Tables(df.sparkSession)
    picked = tables.save(placed.join(quotas, F.col("_of").eqNullSafe(F.col("_stratum"))).where("_nth <= quota").select("_key"), k)
    short = k - picked.count()
    if short > 0:
        extra = keys.join(picked, "_key", "left_anti").orderBy("_at", "_key").limit(short).select("_key")
        picked = tables.save(picked.unionByName(extra), k)
    marked = picked.withColumn("_in", F.lit(True))
    joined = df.join(F.broadcast(marked) if k <= MOST_BROADCAST else marked, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("part", F.when(F.col("_in"), "test").otherwise("train")).drop("_key", "_in")


def leaks(train: DataFrame, test: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(reason, a, b): ids in both parts, and facts of one part that the other repeats."""
    both = train.select(key).join(test.select(key), key, "left_semi").select(F.lit("same id").alias("reason"), F.col(key).alias("a"), F.col(key).alias("b"))
    of_part = lambda df, part: df.select(F.struct(F.col(key).alias("key"), F.lit(part).alias("part")).alias("_key"), *columns)
    classes = token_classes(of_part(train, 0).unionByName(of_part(test, 1)), "_key", columns)
    member = classes.select("id", "class")
    of = lambda part: member.where(F.col("id.part") == part).select(F.col("id.key").alias("id"), "class")
    linked = similar_classes(classes, sides=member.groupBy("class").agg(F.bit_or(F.col("id.part") + 1).alias("side")))
    pairs = pairs_between(of(0), of(1), linked).union(pairs_between(of(1), of(0), linked)).distinct()
    return both.unionByName(pairs.select(F.lit("same fact").alias("reason"), "a", "b"))


def working_set(pool: DataFrame, least: int, preview: bool) -> DataFrame:
    """The verified rows if there are any, else, in a preview, all of them; too few verified rows raise."""
    n = pool.where("verified").count()
    if not preview and n < least:
        raise ValueError(f"only {n} verified rows; {least} are needed")
    return pool.where("verified") if n else pool


def chat_messages(df: DataFrame, question: str, answer: str, system: str) -> DataFrame:
    """``df`` and messages: array<struct<role, content>> of system, user and assistant."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return df.withColumn("messages", F.array(say("system", F.lit(system)), say("user", F.col(question)), say("assistant", F.col(answer))))


def coverage(split: DataFrame, stratum: str) -> DataFrame:
    """(stratum, test, train): rows of each part."""
    of = lambda p: F.count_if(F.col("part") == p).alias(p)
    return split.groupBy(stratum).agg(of("test"), of("train"))


def require_no_leaks(train: DataFrame, test: DataFrame, key: str, columns: list[str]) -> None:
    """The gate before training: raise if an id or a fact is in both parts."""
    from qaloom.operators.checks import require_empty

    require_empty(leaks(train, test, key, columns), "leak")


def review_sheet(pool: DataFrame) -> DataFrame:
    """(doc_id, nth, line) of the sheet on which a reviewer ticks pairs: flagged ones first in each document."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("needs_attention"), "id")
    mark = F.when(F.col("needs_attention"), " (check)").otherwise("")
    line = F.concat(
        F.lit("- [ ] "), F.col("id"), mark, F.lit(" | "), F.col("section"), F.lit(" | "), F.col("answer_type"),
        F.lit("\n  - Q: "), F.col("question"), F.lit("\n  - A: "), F.col("answer"), F.lit("\n  - Evidence: "), F.col("evidence"),
    )
    return pool.select("doc_id", F.row_number().over(order).alias("nth"), line.alias("line"))
