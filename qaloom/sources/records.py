"""Record schemas and readers: explicit schemas always; a missing file is an empty relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HIT = "struct<doc_id:string,section:string,score:double,is_distractor:boolean>"
SCHEMAS = {
    "pairs": "id string, question string, answer string, source_doc string, clean_path string, doc_id string, section string, evidence string, topic string, answer_type string, needs_attention boolean, verified boolean, verify_note string",
    "train": "messages array<struct<role:string,content:string>>, id string, source_doc string, topic string, answer_type string",
    "chunks": "doc_id string, section string, source_doc string, text string, is_distractor boolean, embedding array<float>",
    "answers": f"question_id string, producer string, method string, model string, answer string, latency_s double, prompt_tokens int, completion_tokens int, cost_usd double, size string, retrieved array<{HIT}>, error string, ts string",
    "scores": "question_id string, producer string, method string, faithfulness int, accuracy int, completeness int, clarity int, safety_flag boolean, weighted double, reason string, judge_model string, prompt_tokens int, completion_tokens int, cost_usd double, ts string",
    "manifest": "batch_id string, judge_model string, thinking boolean, submitted int, manifest map<string,struct<question_id:string,producer:string>>",
    "jobs": "producer string, backend string, base_model string, train_id string, size string, trained_model string, remote_job_id string, epochs int, train_seconds double, train_cost_usd double, trained_tokens long",
}


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, record: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[record])
    return spark.read.schema(SCHEMAS[record]).json(path)


def read_csv(spark: SparkSession, path: str, record: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[record])
    return spark.read.schema(SCHEMAS[record]).csv(path, header=True, quote='"', escape='"', multiLine=True)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(clean_path, text) of whole files, by name."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS clean_path", "value AS text")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, question_id, producer) of a batch."""
    return spark.read.schema(SCHEMAS["manifest"]).json(path, multiLine=True).selectExpr("explode(map_entries(manifest)) AS e").selectExpr("e.key AS custom_id", "e.value.*")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Training jobs from one JSON object, producer -> fields; a missing file is no jobs."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMAS["jobs"])
    fields = ", ".join(f"{f.split()[0]}:{f.split()[1]}" for f in SCHEMAS["jobs"].split(", ")[1:])
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{fields}>>").alias("jobs"))
    return whole.select(F.explode("jobs").alias("producer", "j")).select("producer", "j.*")
