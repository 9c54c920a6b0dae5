"""Sinks: overwrite, append, delete by swapping tables, upsert, reports and digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a Parquet log; a batch is added whole or not at all."""
    df.write.mode("append").parquet(path)


def swap(df: DataFrame, path: str) -> None:
    """Replace a table that ``df`` itself may read: write beside it, then rename both; the old one goes last.

    Between the two renames nothing is at ``path``; where readers mustn't see that, use a ``SnapshotTable``.
    """
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(aside)
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path)
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = jvm.org.apache.hadoop.fs.Path(f"{aside}.old")
    if not fs.rename(old, gone) or not fs.rename(new, old):
        raise OSError(f"could not swap {path}: its rows are at {aside}, and at {aside}.old before")
    fs.delete(gone, True)


def delete_rows(spark: SparkSession, path: str, schema: str, doomed: str) -> int:
    """Delete the rows of a Parquet table for which ``doomed`` holds; how many that were."""
    before = spark.read.schema(schema).parquet(path)
    n = before.where(doomed).count()
    if n:
        swap(before.where(~F.coalesce(F.expr(doomed), F.lit(False))), path)
    return n


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the fields of ``new`` that aren't null in their place, and its new keys."""
    fields = [c for c in old.columns if c != key]
    named = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in fields if c in new.columns])
    pick = lambda c: F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns else F.col(c)
    return old.join(named, key, "full").select(key, *[pick(c) for c in fields])


def write_report(df: DataFrame, path: str) -> None:
    """A small sorted table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def messages_only(train: DataFrame, path: str) -> None:
    """The column that a trainer reads."""
    write_jsonl(train.select("messages"), path)
