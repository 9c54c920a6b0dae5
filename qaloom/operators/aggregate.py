"""The master table and the cuts through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.operators.checks import require_unique

MARKS = ("faithfulness", "accuracy", "completeness", "clarity")


def frames(scores: DataFrame, answers: DataFrame) -> DataFrame:
    """Scores with the good answers' latency and cost; a key that repeats on either side raises."""
    key = ["question_id", "producer"]
    good = answers.where(F.col("error").isNull()).select(*key, "latency_s", F.col("cost_usd").alias("answer_cost_usd"))
    require_unique(scores, key)
    require_unique(good, key)
    return scores.withColumnRenamed("cost_usd", "judge_cost_usd").join(good, key, "left")


def master_table(joined: DataFrame, producers: DataFrame, jobs: DataFrame, exact: bool = False) -> DataFrame:
    """One row per producer with scores: means, rates and costs, the best first.

    ``exact``: averages of integers and sums stay unrounded, so that they compare bit by bit.
    """
    r: object = (lambda c, n: c) if exact else F.round
    mean = lambda c, n: r(F.avg(c), n)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    table = joined.groupBy("producer").agg(
        F.count("*").alias("n"),
        *[mean(F.col(m), 3).alias(m) for m in MARKS],
        mean(F.col("weighted"), 3).alias("weighted"),
        mean(F.col("safety_flag").cast("int"), 3).alias("safety_flag_rate"),
        mean(F.col("latency_s"), 2).alias("mean_latency_s"),
        r(zero(F.sum("answer_cost_usd")), 4).alias("answer_cost_usd"),
        r(zero(F.sum("judge_cost_usd")), 4).alias("judge_cost_usd"),
    )
    dims = F.broadcast(producers.select("producer", "method", "model", "size", "ord"))
    costs = F.broadcast(jobs.select("producer", F.col("train_cost_usd")))
    out = table.join(dims, "producer").join(costs, "producer", "left").withColumn("train_cost_usd", zero(F.col("train_cost_usd")))
    out = out.withColumn("total_cost_usd", r(F.col("answer_cost_usd") + F.col("train_cost_usd"), 4))
    return out.orderBy(F.desc("weighted"), "ord").drop("ord")


def diagnosis(joined: DataFrame) -> DataFrame:
    """Means by producer and retrieval tier."""
    means = [F.avg(m).alias(m) for m in ("faithfulness", "accuracy", "weighted")]
    return joined.groupBy("producer", "tier").agg(F.count("*").alias("n"), *means)


def lift(master: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base, treated, weighted_lift, faithfulness_lift) of pairs of which both are in the table."""
    side = lambda who, p: master.select(F.col("producer").alias(who), F.col("weighted").alias(f"w{p}"), F.col("faithfulness").alias(f"f{p}"))
    both = F.broadcast(pairs).join(side("base", 0), "base").join(side("treated", 1), "treated")
    return both.select("base", "treated", (F.col("w1") - F.col("w0")).alias("weighted_lift"), (F.col("f1") - F.col("f0")).alias("faithfulness_lift"))


def members(master: DataFrame, group: DataFrame) -> DataFrame:
    """The rows of a cut's members (producer, leg, label), by leg."""
    return master.join(F.broadcast(group), "producer").orderBy("leg")


def safety_counts(scores: DataFrame) -> DataFrame:
    """Flagged answers of each producer, the most first."""
    return scores.where("safety_flag").groupBy("producer").agg(F.count("*").alias("flags")).orderBy(F.desc("flags"), "producer")


def spend(answers: DataFrame, cost: Column | None = None) -> DataFrame:
    """What each producer and all together have cost, errors included; a missing cost is none."""
    paid = F.coalesce(cost if cost is not None else F.col("cost_usd"), F.lit(0))
    return answers.rollup("producer").agg(F.sum(paid).alias("spent"), F.count("*").alias("answers"))


def status(producers: DataFrame, answers: DataFrame, expected: int, untrained: DataFrame | None = None) -> DataFrame:
    """(producer, good, errors, state): complete, partial, none, or not trained."""
    bad = F.coalesce("error", F.lit("")) != ""
    counts = answers.groupBy("producer").agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("errors"))
    out = producers.select("producer").join(counts, "producer", "left").na.fill(0, ["good", "errors"])
    state = F.when(F.col("good") >= expected, "complete").when(F.col("good") > 0, "partial")
    if untrained is not None:
        out = out.join(F.broadcast(untrained.select("producer").withColumn("_raw", F.lit(True))), "producer", "left")
        state = state.when(F.col("_raw"), "not trained")
    return out.withColumn("state", state.otherwise("none")).drop("_raw")
