"""Judging in batches: submit with a manifest, poll, collect by id; status, spend and completeness of scores."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators import worklist
from qaloom.sources.records import exists

KEY = worklist.KEY


class BatchClient(Protocol):
    """The seam to a batch service."""

    def create(self, requests: DataFrame) -> str:
        """Send (custom_id, prompt) rows; the batch's id."""

    def ended(self, batch_id: str) -> bool: ...

    def results(self, batch_id: str) -> DataFrame:
        """(custom_id, succeeded, verdict), in any order."""


def submit(work: DataFrame, client: BatchClient, path: str, judge_model: str, thinking: bool = False) -> str | None:
    """Send a work-list (custom_id, question_id, producer, prompt); the batch's id, None if nothing is left to send.

    The requests are written before the service sees them, and its id as soon as it gives one: a
    batch whose id was lost couldn't be collected.
    """
    spark = work.sparkSession
    work.select("custom_id", *KEY, "prompt").write.mode("overwrite").parquet(f"{path}/requests")
    kept = spark.read.parquet(f"{path}/requests")
    if first := worklist.bad_ids(kept).take(1):
        raise ValueError(f"a batch service would refuse the id {first[0]['custom_id']!r}")
    n = kept.count()
    if not n:
        return None
    batch = client.create(kept.select("custom_id", "prompt"))
    state = {"batch_id": batch, "judge_model": judge_model, "thinking": thinking, "submitted": n}
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
    return batch


def state(spark: SparkSession, path: str) -> dict | None:
    """What ``submit`` wrote; None before."""
    return json.loads(spark.read.text(f"{path}/state", wholetext=True).first()[0]) if exists(spark, f"{path}/state/_SUCCESS") else None


def collect(spark: SparkSession, client: BatchClient, path: str, scores: DataFrame) -> DataFrame | None:
    """The batch's results with keys, judge_model and status; None while it runs.  Scored keys are skipped, so it may be run again."""
    now = state(spark, path)
    if now is None:
        raise ValueError("no batch was submitted")
    if not client.ended(now["batch_id"]):
        return None
    manifest = spark.read.parquet(f"{path}/requests").select("custom_id", *KEY)
    return worklist.route(client.results(now["batch_id"]), manifest, scores).withColumn("judge_model", F.lit(now["judge_model"]))


def judge_status(producers: DataFrame, answers: DataFrame, scores: DataFrame, questions: int) -> DataFrame:
    """(producer, answered, scored, state) of each producer, and of all under a null producer."""
    good = answers.where(F.coalesce("error", F.lit("")) == "").groupBy("producer").agg(F.count("*").alias("answered"))
    done = scores.groupBy("producer").agg(F.count("*").alias("scored"))
    each = producers.select("producer").join(good, "producer", "left").join(done, "producer", "left").na.fill(0, ["answered", "scored"])
    both = each.rollup("producer").agg(F.sum("answered").alias("answered"), F.sum("scored").alias("scored"), F.count("*").alias("_of"))
    full = F.when(F.col("scored") == 0, "none").when(F.col("scored") == questions * F.col("_of"), "judged").otherwise("partial")
    return both.withColumn("state", full).drop("_of")


def next_step(status: DataFrame, has_master: bool) -> str:
    """What to do next, from ``judge_status``: estimate, collect, aggregate or report."""
    total = status.where("producer is null").first()
    if total is None or total["scored"] == 0:
        return "estimate"
    if total["state"] != "judged":
        return "collect"
    return "report" if has_master else "aggregate"


def judges_used(scores: DataFrame) -> DataFrame:
    """(judge_model, n, spent) of the judges that have scored."""
    return scores.groupBy("judge_model").agg(F.count("*").alias("n"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("spent"))


def violations(questions: DataFrame, producers: DataFrame, scores: DataFrame) -> DataFrame:
    """(check, producer, n) of what keeps scores from being complete; no rows if they are.

    judges: how many have scored, if several; count: a producer's scores, if not one a question;
    missing: its questions without a score; unknown: scores of producers that aren't listed.
    """
    n = questions.agg(F.count("*").alias("_want"))
    held = scores.groupBy("producer").agg(F.count("*").alias("_have"))
    none = F.lit(None).cast("string")
    judges = scores.agg(F.count_distinct("judge_model").alias("n")).where("n > 1").select(F.lit("judges").alias("check"), none.alias("producer"), "n")
    each = producers.select("producer").crossJoin(F.broadcast(n)).join(held, "producer", "left").na.fill(0, ["_have"])
    count = each.where("_have <> _want").select(F.lit("count").alias("check"), "producer", F.col("_have").alias("n"))
    grid = questions.select("question_id").crossJoin(F.broadcast(producers.select("producer")))
    missing = grid.join(scores.select(*KEY), KEY, "left_anti").groupBy("producer").agg(F.count("*").alias("n")).select(F.lit("missing").alias("check"), "producer", "n")
    unknown = held.join(producers.select("producer"), "producer", "left_anti").select(F.lit("unknown").alias("check"), "producer", F.col("_have").alias("n"))
    return judges.unionByName(count).unionByName(missing).unionByName(unknown)


def assert_complete(questions: DataFrame, producers: DataFrame, scores: DataFrame) -> None:
    """Raise unless one judge has scored each question of each producer once."""
    if found := violations(questions, producers, scores).take(3):
        raise ValueError("; ".join(f"{r['check']} {r['producer'] or ''} {r['n']}" for r in found))
