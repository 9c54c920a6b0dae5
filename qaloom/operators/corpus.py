"""The retrieval corpus: chunks of the ground truth and distractors, vectors, a flat index with a frozen configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators.retrieval import distractor_chunks
from qaloom.operators.segment import section_text

CHUNK = ["doc_id", "section", "source_doc", "text", "is_distractor"]
BATCH = 32  # texts embedded at once


def gold_chunks(sections: DataFrame) -> DataFrame:
    """CHUNK rows of sections (doc_id, source_doc, heading, content)."""
    text = section_text(F.col("heading"), F.col("content"))
    return sections.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("heading").alias("section"), "source_doc", text.alias("text"), F.lit(False).alias("is_distractor"))


def distractors(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 1200, least: int = 200) -> DataFrame:
    """CHUNK rows of fixed-width slices of other documents; no documents give none."""
    made = distractor_chunks(docs, key, text, width, least)
    name = F.col(key).cast("string")
    return made.select(name.alias("doc_id"), F.concat(F.lit("chunk "), F.col("chunk").cast("string")).alias("section"), name.alias("source_doc"), F.col("body").alias("text"), F.lit(True).alias("is_distractor"))


def union(gold: DataFrame, other: DataFrame) -> DataFrame:
    """The corpus, with a chunk_id that its place names: the same on every run."""
    rows = gold.select(*CHUNK).unionByName(other.select(*CHUNK))
    return rows.withColumn("chunk_id", F.xxhash64("doc_id", "section", "is_distractor", "text"))


def embed(df: DataFrame, embedder: Callable[[list[str]], Sequence[Sequence[float]]], text: str = "text", batch: int = BATCH, to: str = "embedding", double: bool = False) -> DataFrame:
    """``df`` and a unit vector of each text: ``embedder`` is a seam, called with at most ``batch`` texts.

    A null text is an empty one; a zero vector stays zero.  An index holds floats; ``double`` leaves the vectors as they were computed.
    """
    kind = "double" if double else "float"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            said = [t or "" for t in rows.column(rows.schema.get_field_index(text)).to_pylist()]
            found = [np.asarray(v, np.float64) for at in range(0, len(said), batch) for v in embedder(said[at : at + batch])]
            unit = [(v / n if (n := np.linalg.norm(v)) else v).astype(np.float64 if double else np.float32) for v in found]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(unit, pa.list_(pa.float64() if double else pa.float32()))], names=[*rows.schema.names, to])

    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return df.mapInArrow(work, f"{schema}, `{to}` array<{kind}>")


def build_index(chunks: DataFrame, path: str, model: str, top_k: int, template: str = "") -> dict:
    """Write the vectors, then the configuration that they are frozen with, which is returned."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/vectors")
    held = spark.read.parquet(f"{path}/vectors")
    one = held.agg(F.count("*").alias("n"), F.count_if("is_distractor").alias("far"), F.max(F.size("embedding")).alias("dim"), F.count_distinct(F.size("embedding")).alias("dims")).first()
    if one["dims"] > 1:
        raise ValueError("vectors of several dimensions")
    config = {
        "embed_model": model, "dim": one["dim"] or 0, "top_k": top_k, "index": "flat, exact inner product of unit vectors",
        "chunks_total": one["n"], "chunks_gold": one["n"] - one["far"], "chunks_distractor": one["far"], "prompt_template": template,
    }
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    return config


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/config", wholetext=True).first()[0])


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The chunks with their vectors and the frozen configuration; other vectors than it counted raise."""
    config, held = read_config(spark, path), spark.read.parquet(f"{path}/vectors")
    if held.count() != config["chunks_total"]:
        raise ValueError("the index doesn't hold the chunks that its configuration names")
    return held, config


def provenance(hits: Column) -> Column:
    """Where hits, array<struct<doc_id, section, score, is_distractor, ...>>, come from: all but their text, scores to four places."""
    kept = lambda h: F.struct(h["doc_id"].alias("doc_id"), h["section"].alias("section"), F.round(h["score"], 4).alias("score"), h["is_distractor"].alias("is_distractor"))
    return F.transform(hits, kept)


def row_chunks(blocks: DataFrame, key: str) -> DataFrame:
    """(key, block, nth, body): a chunk for each row of each table, its cells named by the header."""
    rows = blocks.where("kind = 'table'").select(key, "block", "header", F.posexplode("rows").alias("nth", "cells"))
    named = F.transform(F.arrays_zip("header", "cells"), lambda x: F.concat(F.coalesce(x["header"], F.lit("")), F.lit(": "), F.coalesce(x["cells"], F.lit(""))))
    return rows.select(key, "block", "nth", F.array_join(named, "; ").alias("body"))
