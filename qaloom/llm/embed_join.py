"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with cosine c or more are at most sqrt(2 - 2 c) apart.  After a fixed rotation the
coordinates are split into blocks of few dimensions; squared distances add up over blocks, so two
near vectors are within a proportional share of the squared distance in one block at least.  Each
block is range-joined on its own: a k-d tree cuts its space into leaves of bounded size, and each
vector, where it is read, finds the few later leaves that its radius reaches and visits them.
Inside a leaf the block's distance decides, and what passes is verified by the exact cosine in
double precision.  A pair counts in the first block that finds it, so no distinct is needed.

A leaf gives how many links each vector has there and a forest that spans them, not its pairs: a
group of near copies costs comparisons, but its links are never listed.  Equal vectors are one
class and meet others once.  No task holds more than GROUP_BYTES of residents and as much of
visitors: larger leaves are cut into parts that meet one another.

The trees are fitted on a hashed sample of at most about SAMPLE vectors, which is all that comes
to the driver; every vector is joined, and with leaves of any shape the result is the same.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components
link with nothing; vectors of different dimensions don't link; repeated rows link with each other;
rows without an id come back with their links but name no component.  No rows give none.  Extra
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.components import components, stars
from qaloom.sources.durable import Tables

COSINE = 0.9
BLOCK_DIMS = 8
GROUP_BYTES = 16 << 20  # of single-precision vectors that one side of a meeting is sized for
SAMPLE = 50_000  # vectors that the trees are fitted on, about
MOST_BROADCAST = 100_000  # leaves whose sizes are broadcast
SEED = 20240229
SLACK = 1e-4  # added to the budget, for single-precision block distances
CHUNK, TILE = 256, 4096  # rows of two slices compared at once


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, size: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    """Blocks of ``size`` coordinates; the last may be smaller."""
    return [(lo, min(dims, lo + size)) for lo in range(0, dims, size)]


def _usable(v: str = "embedding"):
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    col = F.col(v)
    good = col.isNotNull() & (F.size(col) > 0) & F.forall(col, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(col, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def kd_tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) of the inner nodes of a complete tree with ``leaves`` leaves or more: each cuts its points' widest axis in halves."""
    inner = (1 << max(0, leaves - 1).bit_length()) - 1
    axis, cut = np.zeros(inner, np.int64), np.zeros(inner)
    held = {0: points}
    for k in range(inner):
        own = held.pop(k)
        if len(own):
            axis[k] = own.std(0).argmax()
            cut[k] = np.median(own[:, axis[k]])
        right = own[:, axis[k]] > cut[k]
        held[2 * k + 1], held[2 * k + 2] = own[~right], own[right]
    return axis, cut


def visits(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, whether it is the row's own) of all leaves within the squared distance ``budget``."""
    axis, cut = tree
    row, node, own = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    gap = np.zeros((len(x), x.shape[1]))  # squared, to the node's cell, by axis
    while len(axis) and (node[:1] < len(axis)).all() and len(node):
        a = axis[node]
        off = x[row, a] - cut[node]
        far = gap.copy()
        far[np.arange(len(row)), a] = np.maximum(far[np.arange(len(row)), a], off * off)
        reach = far.sum(1) <= budget
        near = 2 * node + 1 + (off > 0)
        other = 2 * node + 2 - (off > 0)
        row, node = np.concatenate([row, row[reach]]), np.concatenate([near, other[reach]])
        own, gap = np.concatenate([own, np.zeros(int(reach.sum()), bool)]), np.concatenate([gap, far[reach]])
    return row, node - len(axis), own


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _budgets(dims: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * (hi - lo) / dims + SLACK for lo, hi in blocks_of(dims)]


def _meet(a: np.ndarray, b: np.ndarray, block: int, dims: int, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of two sets of unit vectors that this block is the first to find; once each, if both sets are one."""
    turn, cuts, budget = rotation(dims), blocks_of(dims), _budgets(dims, cosine)
    lo, hi = cuts[block]
    ra, rb = (a @ turn[:, lo:hi]).astype(np.float32), (b @ turn[:, lo:hi]).astype(np.float32)
    order = np.argsort(rb[:, 0])
    rb = rb[order]
    axis, radius = rb[:, 0], np.float32(budget[block] ** 0.5)
    # |x - y|^2 <= budget as one product: (-2 x, 1) . (y, |y|^2) <= budget - |x|^2
    rows = np.concatenate([-2 * ra, np.ones((len(ra), 1), np.float32)], 1)
    columns = np.ascontiguousarray(np.concatenate([rb, (rb * rb).sum(1)[:, None]], 1).T)
    limit = (budget[block] - (ra * ra).sum(1)).astype(np.float32)
    first = np.argsort(ra[:, 0])
    for i in range(0, len(ra), CHUNK):
        own = first[i : i + CHUNK]
        s, e = np.searchsorted(axis, ra[own[0], 0] - radius), np.searchsorted(axis, ra[own[-1], 0] + radius, "right")
        for at in range(s, e, TILE):
            near = rows[own] @ columns[:, at : min(e, at + TILE)] <= limit[own][:, None]
            flat = np.flatnonzero(near)
            p, q = own[flat // near.shape[1]], order[flat % near.shape[1] + at]
            if same:
                p, q = p[p < q], q[p < q]
            for c in range(0, len(p), 1 << 16):
                pp, qq = p[c : c + (1 << 16)], q[c : c + (1 << 16)]
                found = np.einsum("ij,ij->i", a[pp], b[qq]) >= cosine
                pp, qq = pp[found], qq[found]
                gap = ((a[pp] - b[qq]) @ turn) ** 2
                earlier = gap[:, lo:hi].sum(1) > budget[block] - SLACK / 2  # then another block has it
                for k in range(block):  # a block counts as finding only what it surely compares
                    lo_k, hi_k = cuts[k]
                    earlier |= gap[:, lo_k:hi_k].sum(1) <= budget[k] - SLACK / 2
                if not earlier.all():
                    yield pp[~earlier], qq[~earlier]


def linked(x: np.ndarray, cls: np.ndarray, size: np.ndarray, visitor: np.ndarray, block: int, dims: int, cosine: float, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, its links) and (a, b), a forest of the links, of what residents of a leaf share with visitors and, if ``within``, with each other."""
    x, here = _unit(x), np.flatnonzero(~visitor)
    more = np.zeros(len(x), np.int64)
    forest = [np.zeros((2, 0), np.int64)]
    sides = [(here, here, True)] * within + [(here, np.flatnonzero(visitor), False)]
    for left, right, same in sides:
        if len(left) and len(right):
            for p, q in _meet(x[left], x[right], block, dims, cosine, same):
                p, q = left[p], right[q]
                np.add.at(more, p, size[q])
                np.add.at(more, q, size[p])
                forest.append(np.stack([p, q]))
                if sum(f.shape[1] for f in forest) > 1 << 20:
                    forest = [np.stack(stars(*np.concatenate(forest, 1)))]
    a, b = stars(*np.concatenate(forest, 1))
    some = np.flatnonzero(more)
    return cls[some], more[some], cls[a], cls[b]


def _links(classes: DataFrame, dims: int, cosine: float, group_rows: int, tables: Tables) -> DataFrame | None:
    """(a, b, more) of one dimension's classes: b null and how many links a has, or an edge of a forest that spans the links."""
    turn, cuts, budget = rotation(dims), blocks_of(dims), _budgets(dims, cosine)
    many = classes.count()
    if many < 2:
        return None
    leaves = -(-many // group_rows)
    if leaves == 1:
        reached = classes.select("cls", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))).alias("block"), F.lit(0).cast("long").alias("leaf"), F.lit(True).alias("own"))
    else:
        drawn = classes.where(F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(-(-many // SAMPLE))) == 0).select("embedding").toArrow()
        points = _unit(_vectors(drawn.column(0).combine_chunks(), dims)) @ turn
        trees = [kd_tree(points[:, lo:hi], leaves) for lo, hi in cuts]

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), CHUNK):
                    part = batch.slice(at, CHUNK)
                    x, cls = _unit(_vectors(part.column(1), dims)) @ turn, np.asarray(part.column(0))
                    for block, (lo, hi) in enumerate(cuts):
                        row, leaf, own = visits(x[:, lo:hi], trees[block], budget[block])
                        home = np.zeros(len(x), np.int64)
                        home[row[own]] = leaf[own]
                        keep = own | (leaf > home[row])  # of two leaves that reach each other, one is visited
                        row, leaf, own = row[keep], leaf[keep], own[keep]
                        cols = [pa.array(cls[row]), pa.array(np.full(len(row), block, np.int32)), pa.array(leaf), pa.array(own)]
                        yield pa.RecordBatch.from_arrays(cols, names=["cls", "block", "leaf", "own"])

        reached = tables.save(classes.select("cls", "embedding").mapInArrow(reach, "cls long, block int, leaf long, own boolean"))
    # Leaves that hold too many are cut into parts of residents, and each of those meets its visitors in several turns.
    sizes = reached.groupBy("block", "leaf").agg(F.count_if("own").alias("residents"), F.count_if(~F.col("own")).alias("visitors"))
    sizes = sizes.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("residents") / group_rows)))
    coming = F.col("visitors") + F.when(F.col("parts") > 1, F.col("residents")).otherwise(0)
    sizes = sizes.select("block", "leaf", "parts", F.greatest(F.lit(1), F.ceil(coming / group_rows)).alias("turns"))
    small = F.broadcast if leaves * len(cuts) <= MOST_BROADCAST else (lambda x: x)
    placed = reached.join(small(sizes), ["block", "leaf"])
    placed = placed.withColumns({"part": F.pmod(F.xxhash64("cls", F.lit(1)), "parts"), "turn": F.pmod(F.xxhash64("cls", F.lit(2)), "turns")})
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    cell = lambda part, turn_, visitor: F.struct(part.alias("part"), turn_.alias("turn"), F.lit(visitor).alias("visitor"))
    home = F.transform(upto(F.col("turns")), lambda t: cell(F.col("part"), t, False))
    abroad = F.transform(F.filter(upto(F.col("parts")), lambda p: ~F.col("own") | (p > F.col("part"))), lambda p: cell(p, F.col("turn"), True))
    dealt = placed.select("cls", "block", "leaf", F.inline(F.when(F.col("own"), F.concat(home, abroad)).otherwise(abroad)))
    rows = dealt.join(classes.select("cls", "size", "embedding"), "cls")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        block, turn_ = key[0].as_py(), key[3].as_py()
        col = lambda n: table.column(n).combine_chunks()
        x, cls, size = _vectors(col("embedding"), dims), np.asarray(col("cls")), np.asarray(col("size"))
        who, more, a, b = linked(x, cls, size, np.asarray(col("visitor")), block, dims, cosine, turn_ == 0)
        ends = [pa.array(np.concatenate([who, a])), pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(b)]), pa.concat_arrays([pa.array(more), pa.nulls(len(b), pa.int64())])]
        return pa.table(ends, names=["a", "b", "more"])

    return rows.groupBy("block", "leaf", "part", "turn").applyInArrow(meet, "a long, b long, more long")


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per row: id, n_links (other rows linked directly), component_id, kept (id = component_id)."""
    tables = Tables(df.sparkSession)
    kind = "float" if dict(df.dtypes)[vector_col] == "array<float>" else "double"  # single-precision vectors move as such
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{kind}>").alias("embedding"))
    # -0.0 and 0.0 are one component value
    clean = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind))).withColumn("usable", _usable())
    key = F.when(F.col("usable"), F.sha2(F.to_json("embedding"), 256))
    signs = tables.save(clean.select("id", key.alias("key")))
    classes = clean.where("usable").groupBy(key.alias("key")).agg(F.min("id").alias("least"), F.count("*").alias("size"), F.any_value("embedding").alias("embedding"))
    classes = tables.save(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")))
    found = None
    for r in classes.groupBy("dims").count().collect():  # one row for each dimension that occurs
        links = _links(classes.where(F.col("dims") == r["dims"]), r["dims"], cosine, max(1, group_bytes // (4 * r["dims"])), tables)
        if links is not None:
            found = links if found is None else found.unionByName(links)
    names = classes.select("key", "cls", "least", "size")
    if found is None:
        named = names.select("key", (F.col("size") - 1).alias("n_links"), F.col("least").alias("component_id"))
    else:
        found = tables.save(found)
        label = components(found.where("b is not null").select("a", "b"), tables)
        more = found.where("b is null").groupBy("a").agg(F.sum("more").alias("more"))
        named = names.join(label, F.col("cls") == F.col("node"), "left").join(more, F.col("cls") == F.col("a"), "left").withColumn("comp", F.coalesce("component", "cls"))
        least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        named = named.join(least, "comp").select("key", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = signs.join(named, "key", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
