"""Connected components of a distributed edge list.

First each task replaces the edges it reads, some at a time, by a star for each component that they
form; that needs no shuffle and shortens long chains.  Then large-star and small-star steps
alternate until the edges are stars: each replaces edges by edges to smaller neighbours and keeps
components.  The edge list never leaves the executors.  A node with very many edges costs no more
than its edges: the least neighbour is an aggregate with map-side combining, and the join that
follows is one that Spark splits where a key is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.textblocks import release
from qaloom.sources.durable import Tables

EDGES_AT_ONCE = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node that isn't the least of its own."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    least = np.arange(len(nodes))
    while True:
        u, v = least[x], least[y]
        if np.array_equal(u, v):
            break
        low = np.minimum(u, v)
        np.minimum.at(least, u, low)
        np.minimum.at(least, v, low)
        while not np.array_equal(least, hop := least[least]):
            least = hop
    child = least != np.arange(len(nodes))
    return nodes[child], nodes[least[child]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def one() -> pa.RecordBatch:
        a, b = (np.concatenate([np.asarray(x.column(k)) for x in held]) for k in (0, 1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= EDGES_AT_ONCE:
            yield one()
    if held:
        yield one()
    release()


def components(edges: DataFrame, tables: Tables, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long) with another neighbour: component is the least node reachable.

    ``rows``: about how many edges there are, if known.  Nulls in an edge, self-loops and repeated edges
    don't matter; an empty edge list gives an empty result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = tables.save(pairs.mapInArrow(_contracted, "a long, b long").distinct(), rows)
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        rows, rough = ends.agg(F.sum("up"), F.count_if((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()
        if not rough:  # a node has one edge to a smaller one, or only edges from larger ones
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        step = tables.save(small.where("a <> b").distinct(), rows)
        tables.drop(now)
        now = step
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
