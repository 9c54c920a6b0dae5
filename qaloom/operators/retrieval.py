"""Exact retrieval: chunks, normalised vectors, cosine top-k, tiers of hits, prompts, BM25 and fusion."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import fixed_chunks


def distractor_chunks(docs: DataFrame, key: str, text: str, width: int = 1200, least: int = 200) -> DataFrame:
    """(key, chunk, body) of fixed-width slices."""
    return docs.select(key, F.explode(fixed_chunks(F.coalesce(F.col(text), F.lit("")), width, least)).alias("c")).select(key, "c.chunk", "c.body")


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(v.cast("array<double>"))


TILE = 8_192  # vectors of one side that meet as a matrix


def _tiles(rows: DataFrame, many: int) -> DataFrame:
    """``rows`` (id, v) and a tile number, by a hash of the id."""
    return rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int"))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of the commonest length, and these as a matrix of doubles."""
    vectors = rows.column("v").combine_chunks()
    length = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    holes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    width = int(length.max(initial=0))
    sound = (length == width) & (width > 0)
    flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    starts = np.cumsum(holes) - holes
    at = np.flatnonzero(sound)
    matrix = flat[starts[at][:, None] + np.arange(width)] if len(at) else np.zeros((0, width))
    sound[at] = ~np.isnan(matrix).any(1)
    return np.flatnonzero(sound), matrix[sound[at]]


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 3, tile: int = TILE) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best chunks of each query (query_id, query), (chunk_id, vector).

    An exact scan of all chunks.  Both sides are cut into tiles of about ``tile`` vectors; a tile of queries
    and one of chunks meet as matrices in one task, whose product says which chunks can be among the k best:
    those are scored again in order, in double precision, and only k of each query and tile leave the task.
    Equal scores go by chunk_id.  Vectors that are null or hold a null match nothing, like those of another length than
    the longest of their tile.
    """
    q = queries.select(F.col("query_id").alias("id"), F.col("query").alias("v"))
    c = corpus.select(F.col("chunk_id").alias("id"), F.col("vector").alias("v"))
    many_q, many_c = (max(1, -(-df.count() // tile)) for df in (q, c))
    kinds = [dict(df.dtypes)["id"] for df in (q, c)]
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _tiles(q, many_q).withColumnRenamed("tile", "a").withColumn("b", numbers(many_c))
    right = _tiles(c, many_c).withColumnRenamed("tile", "b").withColumn("a", numbers(many_q))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        at, qs = _matrix(x)
        to, cs = _matrix(y)
        ids = pd.Series(y.column("id").take(pa.array(to)).to_pandas())
        out: tuple[list, list, list] = ([], [], [])
        if len(at) and len(to) and qs.shape[1] == cs.shape[1]:
            product = qs @ cs.T
            slack = 4 * qs.shape[1] * np.finfo(float).eps * np.linalg.norm(qs, axis=1) * np.linalg.norm(cs, axis=1).max()
            least = np.partition(product, -min(k, len(to)), axis=1)[:, -min(k, len(to))] - 2 * slack
            for i, row in enumerate(product >= least[:, None]):
                near = np.flatnonzero(row)
                exact = np.cumsum(qs[i] * cs[near], axis=1)[:, -1]  # summed in order
                best = pd.DataFrame({"s": -exact, "id": ids.iloc[near].to_numpy(), "n": near}).sort_values(["s", "id"]).head(k)
                out[0].extend([at[i]] * len(best))
                out[1].extend(to[best["n"].to_numpy()])
                out[2].extend((-best["s"]).tolist())
        return pa.table({"query_id": x.column("id").take(pa.array(out[0], pa.int64())), "chunk_id": y.column("id").take(pa.array(out[1], pa.int64())), "score": pa.array(out[2], pa.float64())})

    scored = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def tier(hits: Column, doc: Column, section: Column) -> Column:
    """Whether the hits, array<struct<doc_id, section>>, hold the gold section, its document, or neither."""
    gold = F.exists(hits, lambda h: (h["doc_id"] == doc) & (h["section"] == section))
    same = F.exists(hits, lambda h: h["doc_id"] == doc)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(gold), "1. gold section").when(yes(same), "2. right doc").otherwise("3. neither")


def prompt(hits: DataFrame, template: str) -> DataFrame:
    """(query_id, prompt) from (query_id, question, rank, doc_id, section, body): excerpts by rank."""
    one = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(" · "), F.col("section").cast("string"), F.lit("]\n"), F.col("body"))
    grouped = hits.groupBy("query_id").agg(F.any_value("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", one.alias("body")))).alias("parts"))
    context = F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n")
    values = {"context": context, "question": F.col("question")}
    filled = re.split(r"\{(context|question)\}", template)  # at once, so that no value is taken for a placeholder
    return grouped.select("query_id", F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(filled)]).alias("prompt"))


def recall(ranks: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """recall@k, the mean reciprocal rank and the queries over (query_id, rank of the gold chunk or null), for each of ``by``."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}")
    return ranks.groupBy(*by).agg(*[hit(k) for k in at], F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("queries"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of documents sharing a term: (query_id, terms), (doc_id, terms)."""
    words = docs.select("doc_id", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    counts = words.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean"))
    freq = counts.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    found = asked.join(freq, "term").join(counts, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return found.groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))


def fuse(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, doc_id, rank)."""
    both = first.select("query_id", "doc_id", F.col("rank").alias("r1")).join(second.select("query_id", "doc_id", F.col("rank").alias("r2")), ["query_id", "doc_id"], "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.select("query_id", "doc_id", (part("r1") + part("r2")).alias("score"))
