"""Reports: text tables, totals of an estimate, the manifest of a split, counts of a pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qaloom.sources import sinks

UNVERIFIED = "PRICES ARE UNVERIFIED: check each against its source before trusting these figures"


def text_table(df: DataFrame, columns: Sequence[str], order: Sequence[str], places: int = 4) -> DataFrame:
    """(line_no, line): a small table as lines of one width, a header first; numbers to the right, nulls as dashes.

    ``order`` should leave no ties.  A report, so its rows go through one task.
    """
    kinds = dict(df.dtypes)
    real = {c for c in columns if kinds[c] in ("double", "float") or kinds[c].startswith("decimal")}
    right = {c for c in columns if c in real or kinds[c] in ("int", "bigint", "smallint", "tinyint")}
    cell = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string(f"%.{places}f", F.col(c).cast("double")) if c in real else F.col(c).cast("string"))
    numbered = df.withColumn("line_no", F.row_number().over(Window.orderBy(*order))).select("line_no", *[cell(c).alias(c) for c in columns])
    width = numbered.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"_w{k}") for k, c in enumerate(columns)])
    head = numbered.sparkSession.range(1).select(F.lit(0).alias("line_no"), *[F.lit(c).alias(c) for c in columns])
    size = lambda k: F.coalesce(F.col(f"_w{k}"), F.lit(len(columns[k])))
    padded = [(F.lpad if c in right else F.rpad)(F.col(c), size(k), F.lit(" ")) for k, c in enumerate(columns)]
    return head.unionByName(numbered).crossJoin(F.broadcast(width)).select("line_no", F.rtrim(F.concat_ws("  ", *padded)).alias("line"))


def show(df: DataFrame, columns: Sequence[str], order: Sequence[str], title: str = "") -> str:
    """The lines of ``text_table`` as one text, for a terminal."""
    lines = [r["line"] for r in text_table(df, columns, order).orderBy("line_no").collect()]
    return "\n".join([*([title] if title else []), lines[0], "-" * max(map(len, lines)), *lines[1:]])


def estimate_totals(estimate: DataFrame, verified: bool) -> DataFrame:
    """Rows of ``cost.estimate`` with total_usd, a row of all under a null producer, and a note where prices are unverified."""
    sums = [F.sum(c).alias(c) for c in ("calls", "in_tokens", "out_tokens", "infer_usd", "train_usd")]
    rows = estimate.rollup("producer").agg(*sums).withColumn("total_usd", F.col("infer_usd") + F.col("train_usd"))
    return rows.withColumn("note", F.lit(None if verified else UNVERIFIED).cast("string"))


def split_counts(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(section, name, test, train): rows of each part by each of ``by``, and of all."""
    test, train = F.count_if(F.col("part") == "test").alias("test"), F.count_if(F.col("part") == "train").alias("train")
    rows = parts.agg(test, train).select(F.lit("all").alias("section"), F.lit("all").alias("name"), "test", "train")
    for c in by:
        rows = rows.unionByName(parts.groupBy(F.col(c).cast("string").alias("name")).agg(test, train).select(F.lit(c).alias("section"), "name", "test", "train"))
    return rows


def manifest(spark: SparkSession, parts: DataFrame, by: Sequence[str], files: dict[str, str], seed: int, dropped: int, preview: bool = False) -> str:
    """The record of a frozen split: sizes, seed, SHA-256 of its files by name, coverage."""
    rows = split_counts(parts, by).orderBy("section", "name").collect()
    whole = next(r for r in rows if r["section"] == "all")
    out = ["# Dataset manifest", "", "PREVIEW: not yet verified." if preview else "A frozen split of the verified pool.", "", f"- Seed: {seed}", f"- Near-duplicates dropped: {dropped}", f"- Train: {whole['train']}, test: {whole['test']}"]
    for name, path in files.items():
        out += [f"- sha256({name}, part {k}): {r['sha256']}" for k, r in enumerate(sinks.digests(spark, path).orderBy("path").collect())]
    for c in by:
        out += ["", f"## By {c}", "", f"| {c} | test | train |", "|---|---|---|", *[f"| {r['name']} | {r['test']} | {r['train']} |" for r in rows if r["section"] == c]]
    return "\n".join(out) + "\n"


def pool_counts(pool: DataFrame) -> DataFrame:
    """(doc_id, pairs, flagged) of each document of a pool, and of all under a null document."""
    return pool.rollup("doc_id").agg(F.count("*").alias("pairs"), F.count_if("needs_attention").alias("flagged"))
