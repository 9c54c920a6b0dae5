"""Exact best documents of a stated set of queries, by BM25 ranks fused with ranks by shared terms.

The queries are few and known, the documents many: so the queries' terms go to the tasks that read
documents, and no score leaves its task but those that can matter.

A fused score is 1 / (60 + r1) + 1 / (60 + r2).  Ten documents have r1 <= 10 and thus more than
1 / 70; one that stands below place R in both rankings has less than 2 / (61 + R).  With R = 79 it
can't be among the best ten.  So the first R of either ranking are the only candidates, whatever the
documents.  Three passes over the documents: how many hold each term; the first R of each task, and
of these the first R of all; and how many documents stand before each candidate, counted in each
task and added up, which is its exact place in both whole rankings.

Impacts of terms are whole billionths, so equal documents score alike and sums don't depend on order;
equal scores go by doc_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = 10**9
QUERIES = 1_000  # that one round of passes serves


def terms(text: Column) -> Column:
    """A text's lower-case terms of letters and digits, parted by single or more spaces."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " ")


class Vocabulary:
    """The terms of some queries, and which queries ask for each."""

    def __init__(self, queries: Sequence[tuple[int, str]]):
        self.ids = [q for q, _ in queries]
        sets = [set(t.split()) for _, t in queries]
        self.place = {t: k for k, t in enumerate(sorted(set().union(*sets)))} if sets else {}
        self.asks = np.zeros((len(self.place), len(queries)), np.int64)
        for q, found in enumerate(sets):
            self.asks[[self.place[t] for t in found], q] = 1

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(terms, how often each) of the vocabulary in a text, and its length in terms."""
        said = text.split()
        found = Counter(map(self.place.get, said))
        found.pop(None, None)
        return np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found)), len(said)


class Scorer:
    """Scores of documents by both measures for all queries."""

    def __init__(self, vocabulary: Vocabulary, n: int, words: int, df: np.ndarray, k1: float, b: float):
        self.vocabulary, self.k1, self.b = vocabulary, k1, b
        self.mean = words / n if n else 0.0
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """BM25 in billionths, and shared terms, of each text for each query."""
        asks = self.vocabulary.asks
        scores, shared = np.zeros((2, len(texts), asks.shape[1]), np.int64)
        for i, text in enumerate(texts):
            at, tf, length = self.vocabulary.counts(text.as_py())
            if len(at):
                weight = self.idf[at] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))
                rows = asks[at]
                scores[i] = np.rint(weight * UNIT).astype(np.int64) @ rows
                shared[i] = rows.sum(0)
        return scores, shared


def _first(ids: np.ndarray, by: np.ndarray, most: int) -> np.ndarray:
    """Which rows lead, of those with a score."""
    some = np.flatnonzero(by > 0)
    return some[np.lexsort((ids[some], -by[some]))[:most]]


def _ahead(ids: np.ndarray, by: np.ndarray, wanted: np.ndarray, score: np.ndarray) -> np.ndarray:
    """How many rows stand before each wanted (id, score)."""
    every, kind = np.concatenate([by, score]), np.concatenate([np.zeros(len(by), np.int64), np.ones(len(score), np.int64)])
    order = np.lexsort((kind, np.concatenate([ids, wanted]), -every))
    before = np.cumsum(1 - kind[order])
    out = np.empty(len(score), np.int64)
    mine = kind[order] == 1
    out[order[mine] - len(by)] = before[mine]
    return out - np.isin(wanted, ids)  # a candidate stands behind itself


def _fused_round(docs: DataFrame, queries: Sequence[tuple[int, str]], k: int, rrf: int, k1: float, b: float) -> DataFrame:
    spark, vocabulary = docs.sparkSession, Vocabulary(queries)
    most = max(k, 2 * (rrf + k) - rrf - 1)

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(len(vocabulary.place), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(1):
                at, _, length = vocabulary.counts(text.as_py())
                df[at] += 1
                n, words = n + 1, words + length
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, words, *df[at].tolist()], pa.int64())], names=["term", "n"])

    held = {r["term"]: r["n"] for r in docs.mapInArrow(document_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the queries' terms
    df = np.array([held.get(t, 0) for t in range(len(vocabulary.place))], float)
    scorer = Scorer(vocabulary, held.get(-2, 0), held.get(-1, 0), df, k1, b)

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 3), np.int64)
        best = {(q, m): none for q in range(len(vocabulary.ids)) for m in (0, 1)}
        for batch in batches:
            ids, both = np.asarray(batch.column(0)), scorer.batch(batch.column(1))
            for (q, m), have in best.items():
                at = _first(ids, both[m][:, q], most)
                rows = np.concatenate([have, np.stack([ids[at], both[0][at, q], both[1][at, q]], 1)])
                best[q, m] = rows[_first(rows[:, 0], rows[:, 1 + m], most)]
        cols = [(np.full(len(rows), q), np.full(len(rows), m), *rows.T) for (q, m), rows in best.items()]
        whole = [np.concatenate(c) for c in zip(*cols, strict=True)] if cols else [np.zeros(0, np.int64)] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in whole], names=["q", "measure", "doc_id", "s0", "s1"])

    led = docs.mapInArrow(leaders, "q long, measure long, doc_id long, s0 long, s1 long")
    by = Window.partitionBy("q", "measure").orderBy(F.when(F.col("measure") == 0, F.col("s0")).otherwise(F.col("s1")).desc(), "doc_id")
    top = led.withColumn("_nth", F.row_number().over(by)).where(F.col("_nth") <= most).select("q", "doc_id", "s0", "s1").distinct().collect()  # 2 * most for each query
    wanted: dict[int, np.ndarray] = {q: np.zeros((0, 3), np.int64) for q in range(len(vocabulary.ids))}
    for q in {r["q"] for r in top}:
        wanted[q] = np.array(sorted((r["doc_id"], r["s0"], r["s1"]) for r in top if r["q"] == q), np.int64)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = {q: np.zeros((len(rows), 2), np.int64) for q, rows in wanted.items()}
        for batch in batches:
            ids, both = np.asarray(batch.column(0)), scorer.batch(batch.column(1))
            for q, rows in wanted.items():
                for m in (0, 1):
                    ahead[q][:, m] += _ahead(ids, both[m][:, q], rows[:, 0], rows[:, 1 + m])
        cols = [(np.full(len(rows), vocabulary.ids[q]), rows[:, 0], *ahead[q].T) for q, rows in wanted.items()]
        whole = [np.concatenate(c) for c in zip(*cols, strict=True)] if cols else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in whole], names=["query_id", "doc_id", "a0", "a1"])

    counted = docs.mapInArrow(places, "query_id long, doc_id long, a0 long, a1 long") if queries else spark.createDataFrame([], "query_id long, doc_id long, a0 long, a1 long")
    sums = counted.groupBy("query_id", "doc_id").agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1"))
    part = lambda c: 1.0 / (rrf + 1 + F.col(c))
    fused = sums.select("query_id", "doc_id", (part("a0") + part("a1")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def fused_top(queries: DataFrame, docs: DataFrame, k: int = 10, rrf: int = 60, k1: float = 1.2, b: float = 0.75, at_once: int = QUERIES) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents of each query: (query_id, text), (doc_id, text), ids whole numbers.

    Only documents that share a term with a query are ranked.  Null texts have no terms; null ids are left out; an id is one row's.
    The queries come to the driver; ``at_once`` of them share the passes over the documents.
    """
    asked = [(r[0], r[1]) for r in queries.select(F.col("query_id").cast("long"), terms(F.coalesce("text", F.lit("")))).where("query_id IS NOT NULL").orderBy("query_id").collect()]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), terms(F.coalesce("text", F.lit(""))).alias("text")).where("doc_id IS NOT NULL")
    rounds = [_fused_round(read, asked[i : i + at_once], k, rrf, k1, b) for i in range(0, max(1, len(asked)), at_once)]
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out
