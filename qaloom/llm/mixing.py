"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's words form a line, its documents in hashed order.  The mix takes the line's first
``target`` words, round and round, in blocks of equal size: so each source has an exact quota of
blocks.  A binary tree over the output shards splits the quotas: at each node, how many blocks of
each source go left is a multivariate-hypergeometric draw.  A shard then takes its number of a
source's blocks, disjoint from all others' under a keyed permutation of the block numbers, and orders
what it got by a hash.  Draws follow the hypergeometric law at any size.

The plan has one row per source, which the driver makes and writes as a table, and needs one word count per document; these
move once, and so do columns that are to be carried along.  All of it is deterministic: a rerun, or
a retried task, gives the same mix.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Sequence
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm.ranks import running
from qaloom.sources.durable import Tables

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 1024
MOST_DRAWN = 10**9  # blocks of which numpy can draw
SHARDS = 8
MOST_TIMES = 3
MOST_BROADCAST = 10_000  # sources whose plan rows are broadcast; more are joined by a shuffle


def word_count(text: Column) -> Column:
    """Words of a text; none in a null."""
    space = r"[\x20\x09-\x0D]"
    parts = F.size(F.split(text, space + "+", -1)) - text.rlike("^" + space).cast("int") - text.rlike(space + r"\z").cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(parts).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int], most_times: int = MOST_TIMES) -> list[Fraction]:
    """Shares of the sizes' sum by weight; what exceeds ``most_times`` a size goes to the others by weight."""
    left, open_, out = Fraction(sum(sizes)), list(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        over = [i for i in open_ if share[i] > most_times * sizes[i]]
        for i in over or open_:
            out[i] = Fraction(most_times * sizes[i]) if over else share[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)] if over else []
    return out


_DIGITS = Context(prec=45)


def _log_factorial(n: int) -> Decimal:
    """To some thirty places: of a small number from the product, else by Stirling's series."""
    if n < 1000:
        return _DIGITS.ln(Decimal(math.factorial(n)))
    x, half_log_2pi = Decimal(n), Decimal("0.91893853320467274178032973640561763986139747")
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return _DIGITS.add(_DIGITS.multiply(x + Decimal("0.5"), _DIGITS.ln(x)), half_log_2pi - x + series)


def draw_wide(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many good ones a sample holds, whatever the numbers: few one by one, many by rejection.

    The ratio of uniforms (Stadlober's bounds for it) proposes, and the exact ratio of probabilities
    accepts, its logarithms to thirty places: so the law is the hypergeometric one itself.
    """
    pool = good + bad
    if 2 * sample > pool:
        return good - draw_wide(rng, good, bad, pool - sample)
    if 2 * good > pool:
        return sample - draw_wide(rng, bad, good, sample)
    if good < sample:  # the law is the same with the two subsets' parts exchanged
        return draw_wide(rng, sample, pool - sample, good)
    if sample <= 10:
        hits = 0
        for k in range(sample):
            hits += int(rng.integers(pool - k)) < good - hits
        return hits
    share = good / pool
    centre = sample * share + 0.5
    spread = math.sqrt((pool - sample) * sample * share * (1 - share) / (pool - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (sample + 1) * (good + 1) // (pool + 2)
    weight = lambda k: _log_factorial(k) + _log_factorial(good - k) + _log_factorial(sample - k) + _log_factorial(bad - sample + k)
    with localcontext(_DIGITS):
        top = weight(mode)
        while True:
            x, y = 1 - rng.random(), rng.random()
            k = math.floor(centre + width * (y - 0.5) / x)
            if 0 <= k <= min(good, sample) and 2 * Decimal(math.log(x)) <= top - weight(k):
                return k


def draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many good ones a sample holds."""
    if good < MOST_DRAWN and bad < MOST_DRAWN:
        return int(rng.hypergeometric(good, bad, sample))
    return draw_wide(rng, good, bad, sample)


def split_tree(quotas: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard, blocks of each source: exact in the sums of sources, even within one over shards."""
    out: list[list[int]] = [[] for _ in range(shards)]
    total = sum(quotas)
    room = [total * (k + 1) // shards - total * k // shards for k in range(shards)]

    def left_of(rng: np.random.Generator, have: list[int], sums: list[int], left: int) -> list[int]:
        """How many of each source are among ``left``: halves of the sources first, so that few draws are from many."""
        go, todo = [0] * len(have), [(0, len(have), left)]
        while todo:
            a, b, n = todo.pop()
            if b - a == 1:
                go[a] = n
            elif b > a and n:
                m = (a + b) // 2
                first = draw(rng, sums[m] - sums[a], sums[b] - sums[m], n)
                todo += [(m, b, n - first), (a, m, first)]
        return go

    def split(lo: int, hi: int, have: list[int]) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{lo}:{hi}".encode()).digest()[:8], "little"))
        go = left_of(rng, have, [0, *itertools.accumulate(have)], sum(room[lo:mid]))
        split(lo, mid, go)
        split(mid, hi, [n - g for n, g in zip(have, go, strict=True)])

    split(0, shards, list(map(int, quotas)))
    return out


def _whole(a: Column, b: Column) -> Column:
    """The quotient of two longs, exact beyond 2**53."""
    return F.call_function("div", a, b)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted(at: Column, n: Column, *key: Column) -> Column:
    """Where a keyed permutation of 0 to n - 1 takes ``at``; all longs.

    Four rounds of a Feistel network over a grid of rows and columns as near to a square as n allows.
    A grid holds n but for a rest shorter than its side, so the first n', the last n' and again the first n'
    numbers go through one each, the others staying: three bijections of 0 to n - 1.
    """
    side = F.floor(F.sqrt(n.cast("double"))).cast("long")
    width = _whole(n, side)
    held = side * width

    def grid(x: Column, salt: int) -> Column:
        def one(s: Column, nth: int) -> Column:
            moved = lambda value, by, size: F.pmod(value + F.pmod(F.xxhash64(*key, F.lit(4 * salt + nth).cast("long"), by), size), size)
            row, column = s["r"], s["c"]
            return F.struct(moved(row, column, side).alias("r"), column.alias("c")) if nth % 2 == 0 else F.struct(row.alias("r"), moved(column, row, width).alias("c"))

        start = F.struct(_whole(x, width).alias("r"), (x % width).alias("c"))
        turned = _bind(start, lambda s: _bind(one(s, 0), lambda s: _bind(one(s, 1), lambda s: _bind(one(s, 2), lambda s: one(s, 3)))))
        return _bind(turned, lambda s: s["r"] * width + s["c"])

    rest = n - held
    first = lambda x, salt: F.when(x < held, grid(x, salt)).otherwise(x)
    last = lambda x, salt: F.when(x >= rest, rest + grid(x - rest, salt)).otherwise(x)
    return _bind(at, lambda x: _bind(first(x, 0), lambda x: _bind(last(x, 1), lambda x: first(x, 2))))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
    weights: Sequence[int] = (1, 2, 3),
    shards: int = SHARDS,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``df``: id, ``carry``, size, source_size, target, taken and ``segments``.

    segments: array<struct<epoch, first, words, block, shard, place>>, the pieces of the document
    that the mix holds; ``place`` orders a shard's pieces.  Their words add up to ``taken``.
    Sources by code point, null last, weigh ``weights``, repeating.  Each source's taken words are
    its rounded target; no document is taken more than 3 times.  A null or wordless text has size
    0 and no segments.  Repeated rows count like different ones.  Without rows the result is empty.
    """
    spark = df.sparkSession
    base = df.select(
        *[F.col(f"`{c}`").alias(c) for c in dict.fromkeys([id_col, *carry])],
        F.col(f"`{source_col}`").cast("string").alias("_source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
    ).withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))))
    sums = base.groupBy("_source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    sums.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [r["size"] for r in sums]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sums))])
    want = [math.floor(t + Fraction(1, 2)) for t in goal]
    block = BLOCK_WORDS
    quotas = [-(-w // block) for w in want]
    got = split_tree(quotas, shards, seed)
    plan = [
        {
            "p_source": r["_source"], "nth": i, "rows": r["rows"], "source_size": r["size"], "target": float(goal[i]), "want": want[i], "blocks": max(1, quotas[i]),
            "ends": list(itertools.accumulate(g[i] for g in got)),
        }
        for i, r in enumerate(sums)
    ]
    plan_rows = Tables(spark).of_rows(plan, "p_source string, nth long, rows long, source_size long, target double, want long, blocks long, ends array<long>")
    if len(plan) <= MOST_BROADCAST:
        plan_rows = F.broadcast(plan_rows)
    line = base.join(plan_rows, F.col("_source").eqNullSafe(F.col("p_source")))
    line = running(line, ["_source"], ["_hash", id_col], sum(r["rows"] for r in sums), "size", "_start", "rows", F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long"))

    total, want_, start, size = F.col("source_size"), F.col("want"), F.col("_start"), F.col("size")
    rounds = F.when((size > 0) & (want_ > start), _whole(want_ - start - 1, F.greatest(total, F.lit(1)))).otherwise(-1)

    def pieces(epoch: Column) -> Column:
        at = epoch * total + start
        to = F.least(at + size, want_)
        blocks = F.sequence(_whole(at, F.lit(block)), _whole(to - 1, F.lit(block)))
        return F.transform(blocks, lambda b: piece(epoch, at, to, b))

    def piece(epoch: Column, at: Column, to: Column, b: Column) -> Column:
        lo, hi = F.greatest(at, b * block), F.least(to, (b + 1) * block)
        shard = _bind(permuted(b, F.col("blocks"), F.lit(seed).cast("long"), F.col("nth")), lambda turn: F.size(F.filter("ends", lambda e: e <= turn)))
        place = F.xxhash64(F.lit(seed), b, epoch, F.col("_hash"))
        return F.struct(epoch.alias("epoch"), (lo - at).alias("first"), (hi - lo).alias("words"), b.alias("block"), shard.alias("shard"), place.alias("place"))

    none = F.array().cast("array<struct<epoch:long,first:long,words:long,block:long,shard:int,place:long>>")
    parts = F.when(F.col("_rounds") >= 0, F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_rounds")), pieces))).otherwise(none)
    return line.withColumn("_rounds", rounds).withColumn("segments", parts).select(
        *[F.col(f"`{c}`") for c in dict.fromkeys([id_col, *carry])],
        "size", "source_size", "target",
        F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["words"]).alias("taken"),
        "segments",
    )


def listed(segments: Column) -> Column:
    """epoch:first:words:block:shard:place of each piece, by epoch and first, comma-joined."""
    parts = ("epoch", "first", "words", "block", "shard", "place")
    return F.array_join(F.transform(F.array_sort(segments), lambda s: F.concat_ws(":", *[s[p].cast("string") for p in parts])), ",")
