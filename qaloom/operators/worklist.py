"""Resumable collection: what is done, what is left, guards, judge work-lists and result routing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["question_id", "producer"]


def done(answers: DataFrame) -> DataFrame:
    """Keys with an answer: no error, or an empty one."""
    return answers.where(F.coalesce("error", F.lit("")) == "").select(*KEY).distinct()


def todo(questions: DataFrame, producers: DataFrame, answers: DataFrame) -> DataFrame:
    """Keys still to be answered."""
    return questions.select("question_id").crossJoin(F.broadcast(producers.select("producer"))).join(done(answers), KEY, "left_anti")


def model_mix(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(producer, model) of answers by another model than (producer, expected_model) says."""
    return answers.join(F.broadcast(expected), "producer").where(F.col("model") != F.col("expected_model")).select("producer", "model").distinct()


def doomed(producer: str | None = None, errors_only: bool = False) -> Column:
    """Whether a row is a producer's, or an error; without either all are."""
    which = F.lit(True)
    if producer is not None:
        which &= F.col("producer") == producer
    if errors_only:
        which &= F.coalesce("error", F.lit("")) != ""
    return F.coalesce(which, F.lit(False))


def drop_rows(answers: DataFrame, producer: str | None = None, errors_only: bool = False) -> DataFrame:
    """What stays when a producer's rows, or errors only, are deleted; without either all go."""
    return answers.where(~doomed(producer, errors_only))


def latest(answers: DataFrame, order: str = "ts") -> DataFrame:
    """The last good answer of each key."""
    last = Window.partitionBy(*KEY).orderBy(F.desc(order))
    return answers.where(F.coalesce("error", F.lit("")) == "").withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def judge_worklist(questions: DataFrame, producers: DataFrame, answers: DataFrame, scores: DataFrame, order: str = "ts") -> DataFrame:
    """(custom_id, question_id, producer, ...) of good answers without a score, question by question.

    producers: (producer, ord).  custom_id is the question's id, two hyphens, p and the two-digit ord.
    """
    grid = questions.crossJoin(F.broadcast(producers)).join(scores.select(*KEY), KEY, "left_anti").join(latest(answers, order), KEY)
    return grid.withColumn("custom_id", F.format_string("%s--p%02d", F.col("question_id").cast("string"), F.col("ord").cast("int")))


def blind_prompt(work: DataFrame, documents: DataFrame, template: str) -> DataFrame:
    """(custom_id, prompt) from (custom_id, clean_path, question, answer): nothing else can enter a prompt."""
    joined = work.select("custom_id", "clean_path", "question", "answer").join(documents.select("clean_path", F.trim("text").alias("document")), "clean_path")
    parts = re.split(r"\{(document|question|answer)\}", template)  # filled at once, so that no value is taken for a placeholder
    return joined.select("custom_id", F.concat(*[F.col(x) if k % 2 else F.lit(x) for k, x in enumerate(parts)]).alias("prompt"))


def route(results: DataFrame, manifest: DataFrame, scores: DataFrame) -> DataFrame:
    """``results`` (custom_id, succeeded, verdict) with keys and status: written, failed or skipped; unknown ids go."""
    known = results.join(manifest, "custom_id").join(scores.select(*KEY).distinct().withColumn("_scored", F.lit(True)), KEY, "left")
    status = F.when(F.col("_scored"), "skipped").when(~F.coalesce("succeeded", F.lit(False)) | F.col("verdict").isNull(), "failed").otherwise("written")
    return known.withColumn("status", status).drop("_scored")


def completeness(questions: DataFrame, producers: DataFrame, answers: DataFrame) -> DataFrame:
    """(producer, expected, good, errors, missing) of each producer."""
    grid = questions.select("question_id").crossJoin(F.broadcast(producers.select("producer")))
    bad = F.coalesce("error", F.lit("")) != ""
    state = answers.groupBy(*KEY).agg(F.count_if(~bad).alias("g"), F.count_if(bad).alias("e"))
    full = grid.join(state, KEY, "left")
    return full.groupBy("producer").agg(
        F.count("*").alias("expected"), F.count_if(F.col("g") > 0).alias("good"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.count_if(F.coalesce("g", F.lit(0)) == 0).alias("missing"),
    )


CUSTOM_ID = r"^[A-Za-z0-9_-]{1,64}$"


def bad_ids(work: DataFrame) -> DataFrame:
    """Rows whose custom_id a batch service would refuse."""
    return work.where(~F.col("custom_id").rlike(CUSTOM_ID))


def select_producers(producers: DataFrame, method: str | None = None, keys: list[str] | None = None, local_only: bool = False, limit: int | None = None) -> DataFrame:
    """Producers (producer, method, is_local, ord) of a run, in their order."""
    out = producers
    if method is not None:
        out = out.where(F.col("method") == method)
    if keys is not None:
        out = out.where(F.col("producer").isin(keys))
    if local_only:
        out = out.where("is_local")
    out = out.orderBy("ord")
    return out.limit(limit) if limit is not None else out


def resolve_models(producers: DataFrame, jobs: DataFrame) -> DataFrame:
    """``producers`` and called_model: what training made for tuned ones, the model itself for others.

    A tuned producer without a trained model has null there: see ``untrained``.
    """
    made = jobs.select("producer", "trained_model")
    called = F.when(F.col("method") == "finetuned", F.when(F.col("trained_model") != "", F.col("trained_model"))).otherwise(F.col("model"))
    return producers.join(made, "producer", "left").withColumn("called_model", called).drop("trained_model")


def untrained(resolved: DataFrame) -> DataFrame:
    """Producers that can't answer yet."""
    return resolved.where("called_model IS NULL").select("producer")


def latest_live_job(jobs: DataFrame) -> DataFrame:
    """(suffix, job_id) of each suffix's newest job that didn't fail; jobs: (job_id, suffix, status, created_at)."""
    return jobs.where(~F.lower("status").rlike("error|cancel|failed")).groupBy("suffix").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))
