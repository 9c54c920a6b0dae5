"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes what its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qaloom.sources.durable import Tables, give_back
from qaloom.llm.mixing import SHARDS, mix_sources
from qaloom.llm.ngram_join import ngram_components
from qaloom.llm.packing import pack
from qaloom.llm.quality import quality_rules
from qaloom.llm.secrets import masked, scan_secrets
from qaloom.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text has no words and goes; repeated rows are judged one by one; no rows give
    none; texts are read whole; other columns go.
    """
    ship(spark)
    give_back(spark)
    return quality_rules(docs, carry=COLUMNS).where(F.col("kept")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates; of equal rows, one.

    Rows without an id are kept, of those with equal texts one; a null text links with nothing.
    All texts of an id stay if one of them leads its group.
    """
    ship(spark)
    give_back(spark)
    kept = ngram_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"), F.lit(True).alias("_is")).distinct()
    same = docs.select(*COLUMNS).withColumn("_same", F.xxhash64("text"))
    same = same.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), F.col("_same").cast("string"))))
    found = same.join(kept.select(F.col("kept_id").cast("string").alias("_key"), "_is"), "_key", "left").where("_is or doc_id is null")
    once = Window.partitionBy("_key", "_same").orderBy("lang", "source")  # dealt by _key already: texts move once
    return found.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked.

    A null text stays null and a text without secrets stays as it is; repeated rows are scanned one
    by one; overlapping secrets get one mark; no rows give none; other columns go.
    """
    give_back(spark)
    found = scan_secrets(docs.select(*COLUMNS))
    some = F.size("secret_spans") > 0
    text = masked(F.col("text"), F.col("secret_spans"))
    out = found.withColumn("text", text)
    return out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by shard and in the order that the mix gives them there.

    The document that ends a source's quota is cut to its first words.  A null or wordless text is
    never taken; equal rows are taken like different ones; no rows give none; other columns go.
    """
    give_back(spark)
    mixed = mix_sources(docs, carry=COLUMNS)
    pieces = F.array_sort("segments")
    epochs = F.array_distinct(F.transform(pieces, lambda s: s["epoch"]))
    words = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, s: a + s["words"])
    taken = F.transform(
        F.transform(epochs, lambda e: F.filter(pieces, lambda s: s["epoch"] == e)),
        lambda of: F.struct(words(of).alias("_words"), of[0]["shard"].alias("_shard"), of[0]["place"].alias("_place")),
    )
    rows = mixed.select(*COLUMNS, "size", F.inline(taken))
    first = F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), 1, F.col("_words").cast("int"))
    cut = F.col("_words") < F.col("size")
    rows = rows.withColumn("text", F.when(cut, F.array_join(first, " ")).otherwise(F.col("text")))
    rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    # A shard's rows go to several tasks, as a shard of any size must not be one.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    dealt = rows.repartition("_shard", F.pmod("_place", F.lit(parts)))
    return dealt.sortWithinPartitions("_shard", "_place").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's ids goes.

    A null text is an empty one, which is the closing id alone; repeated rows get places of their
    own; no rows give none; other columns go.
    """
    ship(spark)
    give_back(spark)
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("source_mixing", mixture),
    ("best_fit_packing", packing),
]
ORACLE_SQL = None  # tokenizer ids and n-gram coverage are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out = tables.save(out)
            tables.drop(docs)
        docs = out
    return docs
