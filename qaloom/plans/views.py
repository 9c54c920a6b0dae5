"""The driver's tables read as evaluation records.  Times are whole milliseconds and costs whole
micro-dollars, held as doubles, so that sums and means are exact in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators.verdict import weighted_tenths
from qaloom.sources.tables import table

PRODUCERS = 10

ANSWERS_SQL = """
answers AS (
  SELECT event_id AS question_id, 'p' || (user_id % 10) AS producer,
    CASE WHEN user_id % 7 = 0 AND event_type = 'view' THEN 'other' ELSE 'm' || (user_id % 10) END AS model,
    CAST(floor(value * 1000) AS DOUBLE) AS latency_s, CAST(floor(value * 100) AS DOUBLE) AS cost_usd,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN '' END AS error, ts
  FROM events)"""
SCORES_SQL = """
scores AS (
  SELECT question_id, producer, CAST(k % 5 + 1 AS INT) AS faithfulness, CAST((k // 5) % 5 + 1 AS INT) AS accuracy,
    CAST((k // 2) % 5 + 1 AS INT) AS completeness, CAST((k // 3) % 5 + 1 AS INT) AS clarity, k % 10 = 0 AS safety_flag, CAST(k AS DOUBLE) AS cost_usd,
    CAST(4 * (k % 5 + 1) + 3 * ((k // 5) % 5 + 1) + 2 * ((k // 2) % 5 + 1) + ((k // 3) % 5 + 1) AS INT) AS weighted
  FROM (SELECT event_id AS question_id, 'p' || (user_id % 10) AS producer, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type <> 'error'))"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    who = (F.col("user_id") % PRODUCERS).cast("string")
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("question_id"),
        F.concat(F.lit("p"), who).alias("producer"),
        F.when((F.col("user_id") % 7 == 0) & (kind == "view"), "other").otherwise(F.concat(F.lit("m"), who)).alias("model"),
        F.floor(F.col("value") * 1000).cast("double").alias("latency_s"),
        F.floor(F.col("value") * 100).cast("double").alias("cost_usd"),
        F.when(kind == "error", "failed").when(kind == "click", "").alias("error"),
        "ts",
    )


def scores(spark: SparkSession, d: str) -> DataFrame:
    mark = lambda by: ((F.floor(F.col("k") / by) % 5) + 1).cast("int")
    rows = table(spark, d, "events").where("event_type <> 'error'")
    rows = rows.select(F.col("event_id").alias("question_id"), F.concat(F.lit("p"), (F.col("user_id") % PRODUCERS).cast("string")).alias("producer"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    marked = rows.select(
        "question_id", "producer", mark(1).alias("faithfulness"), mark(5).alias("accuracy"), mark(2).alias("completeness"), mark(3).alias("clarity"),
        (F.col("k") % 10 == 0).alias("safety_flag"), F.col("k").cast("double").alias("cost_usd"),
    )
    return marked.withColumn("weighted", weighted_tenths())


def producers(spark: SparkSession) -> DataFrame:
    """Ten producers: the method goes by turns, the size by number."""
    method = F.element_at(F.array(*map(F.lit, ("prompting", "finetuned", "rag"))), (F.col("id") % 3 + 1).cast("int"))
    size = F.when(F.col("id") < 3, "small").when(F.col("id") < 6, "medium").otherwise("large")
    name = F.col("id").cast("string")
    return spark.range(PRODUCERS).select(F.concat(F.lit("p"), name).alias("producer"), method.alias("method"), F.concat(F.lit("m"), name).alias("model"), size.alias("size"), F.col("id").cast("int").alias("ord"))


PRODUCERS_SQL = """
producers AS (
  SELECT 'p' || id AS producer, CASE id % 3 WHEN 0 THEN 'prompting' WHEN 1 THEN 'finetuned' ELSE 'rag' END AS method, 'm' || id AS model,
    CASE WHEN id < 3 THEN 'small' WHEN id < 6 THEN 'medium' ELSE 'large' END AS size, CAST(id AS INT) AS ord FROM range(10) t(id))"""
