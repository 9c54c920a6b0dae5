"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set holds the hashes of its distinct 5-word shingles.  Equal sets form one class, and
classes are joined: with tokens ordered by frequency, two sets of similarity t or more share at
least l tokens among the first ``n - ceil(t n) + l`` of each, for every l.  Each set picks the l
that costs it least, by the length of its posting lists and the estimated number of candidates to
verify; a pair then needs min(l, l') shared prefix tokens before its exact overlap is computed.

What moves: packed blocks of tokens once, to learn which tokens occur in two classes or more.  Tokens
that crowd a block of texts, such as those of a common passage, are counted while texts are read, and
don't move for that.  The rest is counted as a stream that lets frequent tokens go: no task holds all
sets of one token.  Afterwards only such tokens, and only of sets of which at least ceil(t n) tokens are of that kind.
Components, not pairs, are the result, so a group of near copies isn't expanded: members are first
linked with its most typical member, and the prefix join then skips pairs that are already in one
component.  Sets that stay apart meet the others in chunks, not pair by pair.

Hashes have 64 bits.  Among 3e10 different sets about 25 pairs may be taken for equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm import textblocks as tb
from qaloom.llm.components import components, stars
from qaloom.sources.durable import Tables, give_back

WORDS = 5
SIMILARITY = (75, 100)  # a ratio of integers, so that no rounding decides
MOST_MATCHES = 16
VERIFY_COST = 0.05  # of one token of a candidate, in posting entries read
BLOCK_BYTES = 4 << 20  # text bytes gathered into one set of blocks
GROUP_TOKENS = 1_000_000  # tokens that one group of blocks is sized for
HOT_LEAST, HOT_SHARE = 16, 128  # a token is hot if so many sets of a block, and one in so many, hold it
MOST_HOT = 500_000  # hot tokens that every task knows: 8 MB
TOKENS_PER_ROW = 20  # as many tokens make a file as large as one row of ids
SHARED = "part long, cls binary, n binary, tokens binary, freq binary"
HELD_TOKENS = 4_000_000  # entries that a group's task holds before it lets frequent tokens go: 80 MB
MANY = 0xFFFFFFFF  # the frequency of tokens with too many entries to count
RUN = 0xFFFF  # tokens of a set in one run of a block
CHUNK_SETS = 128  # open sets that meet others together
MEETING_TOKENS = 1_000_000  # tokens that each side of a meeting is sized for
TILE_SETS = 2048  # of the other side that are compared with CHUNK_SETS at once


def token_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the distinct shingles of each row, by row and token."""
    hashes, rows, _, _ = tb.words(data, offsets, lower=True)
    grams, at = tb.grams(hashes, rows, n)
    owner = rows[at]
    count = np.bincount(rows, minlength=len(offsets) - 1)
    for k in range(1, n):  # fewer words: the whole sequence is the only shingle
        short = np.flatnonzero(count[rows] == k)
        if len(short):
            grams_k, at_k = tb.grams(hashes[short], rows[short], k)
            grams = np.concatenate([grams, tb.mix(grams_k + np.uint64(k))])
            owner = np.concatenate([owner, rows[short][at_k]])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[new], grams[new]


def class_ids(owner: np.ndarray, tokens: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, class) of each row: equal sets have equal classes."""
    n = np.bincount(owner, minlength=rows).astype(np.int64)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tb.mix(tokens ^ np.uint64(0xA0761D6478BD642F)), out=sums[1:])
    end = np.cumsum(n)
    return n, tb.mix(sums[end] - sums[end - n] + n.astype(np.uint64)).view(np.int64)


def _least_overlap(n: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    a, b = similarity
    return (a * n + b - 1) // b


def _distinct_sets(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, size) of one set of each class, and (place in those, token) of their tokens."""
    cls, n, tokens = (np.concatenate(x) for x in zip(*sets, strict=True))
    _, first = np.unique(cls, return_index=True)
    first.sort()
    take = np.repeat(np.isin(np.arange(len(n)), first), n)
    return cls[first], n[first], np.repeat(np.arange(len(first)), n[first]), tokens[take]


def _gathered(batches: Iterator[pa.RecordBatch], words: int, each: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct sets of about BLOCK_BYTES of texts at a time; ``each`` sees every chunk of rows."""
    held, size = [], 0
    for batch in batches:
        data, offsets, _ = tb.string_column(batch, "text")
        for i, j in tb.chunks(offsets):
            owner, tokens = token_sets(data, offsets[i : j + 1], words)
            n, cls = class_ids(owner, tokens, j - i)
            if each:
                each(batch, i, j, n, cls)
            some = n > 0
            held.append((cls[some], n[some], tokens))
            size += int(offsets[j] - offsets[i])
            if size >= BLOCK_BYTES:
                yield _distinct_sets(held)
                held, size = [], 0
    if held:
        yield _distinct_sets(held)
    held.clear()
    tb.release()


def _signatures(df: DataFrame, words: int) -> DataFrame:
    """(id, n, cls) per row, cls null for an empty set; and rows of n -1 with (hot, many): tokens that
    many sets of one block hold."""
    names = ["id", "n", "cls", "hot", "many"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []

        def sign(batch: pa.RecordBatch, i: int, j: int, n: np.ndarray, cls: np.ndarray) -> None:
            none = pa.nulls(j - i, pa.int64())
            rows.append(pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(cls, mask=n == 0), none, none], names=names))

        for cls, _, _, tokens in _gathered(batches, words, sign):
            found, many = np.unique(tokens, return_counts=True)
            hot = many >= max(HOT_LEAST, len(cls) // HOT_SHARE)
            none = pa.nulls(int(hot.sum()), pa.int64())
            rows.append(pa.RecordBatch.from_arrays([none, pa.array(np.full(len(none), -1)), none, pa.array(found[hot].view(np.int64)), pa.array(many[hot].astype(np.int64))], names=names))
            yield from rows
            rows.clear()
        yield from rows

    return df.select("id", "text").mapInArrow(scan, "id long, n long, cls long, hot long, many long")


def _hot_tokens(signs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(token, frequency), by token, of at most MOST_HOT tokens: the most frequent of those that crowd a block.

    Any set of tokens would do: those left out are counted like the others.
    """
    top = signs.where("n < 0").groupBy("hot").agg(F.sum("many").alias("many")).orderBy(F.desc("many"), "hot").limit(MOST_HOT)
    rows = top.toPandas()
    token, freq = rows["hot"].to_numpy(np.int64).view(np.uint64), np.minimum(rows["many"].to_numpy(np.int64), MANY)
    order = np.argsort(token)
    return token[order], freq[order]


def _is_hot(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = np.searchsorted(hot, tokens)
    out = np.zeros(len(tokens), bool)
    inside = at < len(hot)
    out[inside] = hot[at[inside]] == tokens[inside]
    return out


def _parted(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of 64-bit keys dealt to equal ranges."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), order[cuts[p] : cuts[p + 1]]


def _blocks(df: DataFrame, words: int, parts: int, hot: np.ndarray) -> DataFrame:
    """Packed tokens by part of the token space, without hot ones: classes, set sizes, tokens per class, tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, n, owner, tokens in _gathered(batches, words):
            cold = ~_is_hot(tokens, hot)
            owner, tokens, rows = owner[cold], tokens[cold], []
            for p, own in _parted(tokens, parts):
                who, count = np.unique(owner[own], return_counts=True)
                runs = -(-count // RUN)  # of a set's tokens here; only very large sets have several
                if runs.max() > 1:
                    last = np.cumsum(runs) - 1
                    who, count = np.repeat(who, runs), np.where(np.isin(np.arange(runs.sum()), last), np.repeat(count - RUN * (runs - 1), runs), RUN)
                rows.append((p, cls[who].tobytes(), n[who].astype(np.uint32).tobytes(), count.astype(np.uint16).tobytes(), tokens[own].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "cls", "n", "count", "tokens"])

    return df.select("text").mapInArrow(scan, "part long, cls binary, n binary, count binary, tokens binary")


def _packed(cls: np.ndarray, n: np.ndarray, tokens: np.ndarray, freq: np.ndarray, parts: int) -> pd.DataFrame:
    """Rows of SHARED, by part of the classes."""
    kinds = ((cls, np.int64), (n, np.uint32), (tokens, np.uint64), (freq, np.uint32))
    rows = [(p, *(x[own].astype(k).tobytes() for x, k in kinds)) for p, own in _parted(cls.view(np.uint64), parts)]
    return pd.DataFrame(rows, columns=["part", "cls", "n", "tokens", "freq"])


def _hot_entries(df: DataFrame, words: int, parts: int, hot: np.ndarray, freq: np.ndarray) -> DataFrame:
    """The hot tokens of every set, in SHARED: their frequencies are known, so nothing of them has to meet.

    Copies in several blocks come several times.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, n, owner, tokens in _gathered(batches, words):
            own = _is_hot(tokens, hot)
            owner, tokens = owner[own], tokens[own]
            out = _packed(cls[owner], n[owner], tokens, freq[np.searchsorted(hot, tokens)], parts)
            if len(out):
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return df.select("text").mapInArrow(scan, SHARED)


def _joined(pdf: pd.DataFrame, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[name]), kind)


class TokenCounts:
    """Counts one part of the token space as its packed blocks stream by.

    Holds about ``most`` entries.  Beyond that, a token that many classes of these hold gets
    the frequency MANY for good: its entries, and those still to come, go on at once.  So one
    token may have any number of sets, and all of its entries have one frequency.
    """

    def __init__(self, most: int):
        self.most, self.held, self.size = most, [], 0
        self.many = np.zeros(0, np.uint64)

    def add(self, cls: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(class, set size, token, frequency) of entries that are done."""
        if len(self.many):
            known = _is_hot(tokens, self.many)
            if known.any():
                yield cls[known], n[known], tokens[known], np.full(int(known.sum()), MANY)
                cls, n, tokens = cls[~known], n[~known], tokens[~known]
        self.held.append((cls, n, tokens))
        self.size += len(tokens)
        if self.size > self.most:
            cls, n, tokens, freq = self._distinct()
            large = freq > max(2, self.most // 64)
            self.many = np.union1d(self.many, np.unique(tokens[large]))
            if large.any():
                yield cls[large], n[large], tokens[large], np.full(int(large.sum()), MANY)
            self.held, self.size = [(cls[~large], n[~large], tokens[~large])], int((~large).sum())
            self.most = max(self.most, 2 * self.size)  # many tokens, none of them frequent

    def done(self) -> tuple[np.ndarray, ...]:
        """What is left of the part: the entries of tokens that two classes or more hold."""
        cls, n, tokens, freq = self._distinct()
        self.held, self.size = [], 0
        some = freq >= 2
        return cls[some], n[some], tokens[some], freq[some]

    def _distinct(self) -> tuple[np.ndarray, ...]:
        cls, n, tokens = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint64))
        self.held.clear()
        order = np.argsort(tokens)
        tokens = tokens[order]
        same = np.zeros(len(tokens) + 1, bool)
        same[1:-1] = tokens[1:] == tokens[:-1]
        twice = same[1:] | same[:-1]  # met twice, if maybe in one class
        alone = [x[order[~twice]] for x in (cls, n)] + [tokens[~twice]]
        order, tokens = order[twice], tokens[twice]
        cls, n = cls[order], n[order]
        order = np.lexsort((cls, tokens))
        cls, n, tokens = cls[order], n[order], tokens[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])
        cls, n, tokens = cls[new], n[new], tokens[new]
        _, back, freq = np.unique(tokens, return_inverse=True, return_counts=True)
        return np.concatenate([cls, alone[0]]), np.concatenate([n, alone[1]]), np.concatenate([tokens, alone[2]]), np.concatenate([freq[back], np.ones(len(alone[0]), np.int64)])


def _shared_tokens(blocks: DataFrame, parts: int, most: int = HELD_TOKENS) -> DataFrame:
    """SHARED of the blocks' tokens that two classes or more hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, TokenCounts(most)

        def out(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            made = _packed(*found, parts)
            if len(made):
                yield pa.RecordBatch.from_pandas(made, preserve_index=False)

        for batch in batches:
            for part, cls, n, each, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    yield from out(counts.done())
                    now, counts = part, TokenCounts(most)
                size = np.frombuffer(each, np.uint16)
                rows = np.repeat(np.frombuffer(cls, np.int64), size), np.repeat(np.frombuffer(n, np.uint32), size), np.frombuffer(tokens, np.uint64)
                for found in counts.add(*rows):
                    yield from out(found)
        yield from out(counts.done())
        tb.release()

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(count, SHARED)


def choose_matches(freq: np.ndarray, n: int, least: int) -> tuple[int, int]:
    """(l, how many of the shared tokens are in the l-prefix) of least estimated cost.

    ``freq``: ascending frequencies of the set's tokens that other sets hold too; the n - len(freq)
    others come first in the order.  Reading costs a list's length; a candidate costs its verification.
    """
    alone = n - len(freq)
    l = np.arange(1, min(least, MOST_MATCHES) + 1)
    inside = np.clip(n - least + l - alone, 0, len(freq))
    read = np.concatenate([[0], np.cumsum(freq - 1)])[inside]
    best = int(np.argmin(read + VERIFY_COST * n * read / l))
    return int(l[best]), int(inside[best])


def _prefixes(shared: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(cls, n, l, weight, prefix, tokens) of the sets that can be similar to another set.

    ``weight``, the mean frequency of the tokens, tells how typical a set is of its group.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, n = _joined(pdf, "cls", np.int64), _joined(pdf, "n", np.uint32).astype(np.int64)
        tokens, freq = _joined(pdf, "tokens", np.uint64), _joined(pdf, "freq", np.uint32).astype(np.int64)
        order = np.lexsort((tokens, freq, cls))
        cls, n, tokens, freq = cls[order], n[order], tokens[order].view(np.int64), freq[order]
        new = np.ones(len(cls), bool)
        new[1:] = (cls[1:] != cls[:-1]) | (tokens[1:] != tokens[:-1])
        cls, n, tokens, freq = cls[new], n[new], tokens[new], freq[new]
        starts = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.zeros(0, np.int64)
        rows = []
        for i, j in zip(starts, [*starts[1:], len(cls)], strict=True):
            least = int(_least_overlap(n[i], similarity))
            if j - i >= least:
                l, inside = choose_matches(freq[i:j], int(n[i]), least)
                rows.append((int(cls[i]), int(n[i]), l, int(freq[i:j].sum() // n[i]), tokens[i : i + inside], tokens[i:j]))
        return pd.DataFrame(rows, columns=["cls", "n", "l", "weight", "prefix", "tokens"])

    return shared.groupBy("part").applyInPandas(choose, "cls long, n long, l int, weight long, prefix array<long>, tokens array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of classes whose exact similarity is high enough."""
    a, b = similarity
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return pairs.join(left, "a").join(right, "b").where(b * both >= a * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _fits(x: Column, y: Column, similarity: tuple[int, int]) -> Column:
    a, b = similarity
    return (b * x >= a * y) & (b * y >= a * x)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left shares with each on the right; sets have no repeats."""
    out = np.zeros((len(left), len(right)), np.int32)
    tokens = np.concatenate([*left, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(left)), [len(x) for x in left])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for j, other in enumerate(right):
        lo, hi = np.searchsorted(tokens, other), np.searchsorted(tokens, other, "right")
        each = hi - lo
        at = np.repeat(lo - np.cumsum(each) + each, each) + np.arange(each.sum())
        out[:, j] = np.bincount(owner[at], minlength=len(left))
    return out


def _open_pairs(entries: DataFrame, leads: DataFrame, label: DataFrame, sets: DataFrame, similarity: tuple[int, int], tables: Tables, rows: int, many: int) -> DataFrame:
    """A forest (a, b) of the similar pairs of classes that the leaders have left in different components.

    ``rows`` and ``many``: how many sets and how many entries there are.

    A class is open if a posting list holds it and mostly another component.  Open classes form
    chunks of those with one leader; a chunk meets each class that shares enough prefix tokens with
    it once, and inside such a meeting the pairs' own prefixes and sets decide.
    """
    num, den = similarity
    known = entries.join(label, F.col("cls") == F.col("node"), "left").select("token", "cls", "n", "l", F.coalesce("component", "cls").alias("comp"))
    main = known.groupBy("token", "comp").count().groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps"))
    lists = tables.save(known.join(main.where("comps > 1").drop("comps"), "token"), many)
    opened = lists.where("comp <> main").select("cls", "comp", "n").distinct().join(leads, F.col("cls") == F.col("a"), "left")
    opened = opened.select("cls", "comp", "n", F.coalesce("b", "cls").alias("lead"))
    pieces = lambda sets, tokens: F.greatest(F.ceil(sets / CHUNK_SETS), F.ceil(tokens / MEETING_TOKENS))
    of_lead = opened.groupBy("lead").agg(pieces(F.count("*"), F.sum("n")).alias("parts"))
    opened_ = opened = tables.save(opened.join(of_lead, "lead"), rows)
    chunks = opened.agg(F.coalesce(pieces(F.count("*"), F.sum("n")), F.lit(0))).first()[0]
    chunk = F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("cls"), "parts")), F.lit(max(1, 2 * chunks)))
    opened = opened.select("cls", "comp", chunk.alias("chunk"))
    asked = lists.join(opened.select("cls", "chunk"), "cls").groupBy("chunk", "token").agg(F.min("l").alias("least"))
    met = asked.join(lists.select("token", "cls", "l"), "token").groupBy("chunk", "cls").agg(F.count("*").alias("shared"), F.min(F.least("least", "l")).alias("need"))
    met = tables.save(met.where("shared >= need").select("chunk", "cls"), many)
    size = met.join(sets.select("cls", "n"), "cls").groupBy("chunk").agg(F.ceil(F.sum("n") / MEETING_TOKENS).alias("parts"))
    size = tables.save(size, rows)
    give_back(sets.sparkSession)
    full = sets.join(label, F.col("cls") == F.col("node"), "left").select("cls", "n", "l", F.coalesce("component", "cls").alias("comp"), "prefix", "tokens")
    own = opened.select("cls", "chunk").join(size, "chunk").select("cls", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(full, "cls")
    other = met.join(size, "chunk").select("cls", "chunk", F.pmod(F.xxhash64("cls"), "parts").alias("part")).join(full, "cls")

    own, other = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (own, other))  # columns of their own

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        col = lambda f, c: f[c].to_numpy()
        arrays = lambda f, c: [np.asarray(v, np.int64) for v in f[c]]
        found = [np.zeros((2, 0), np.int64)]
        for i in range(0, len(x), CHUNK_SETS):
            for j in range(0, len(y), TILE_SETS):
                u, v = x.iloc[i : i + CHUNK_SETS], y.iloc[j : j + TILE_SETS]
                may = overlaps(arrays(u, "prefix"), arrays(v, "prefix")) >= np.minimum(col(u, "l")[:, None], col(v, "l")[None, :])
                may &= col(u, "comp")[:, None] != col(v, "comp")[None, :]
                p, q = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
                u, v, may = u.iloc[p], v.iloc[q], may[np.ix_(p, q)]
                both = overlaps(arrays(u, "tokens"), arrays(v, "tokens"))
                p, q = np.nonzero(may & (den * both >= num * (col(u, "n")[:, None] + col(v, "n")[None, :] - both)))
                found.append(np.stack([col(u, "cls")[p], col(v, "cls")[q]]))
                if sum(f.shape[1] for f in found) > MEETING_TOKENS:
                    found = [np.stack(stars(*np.concatenate(found, 1)))]
        a, b = stars(*np.concatenate(found, 1))  # links of a meeting as a forest, not pair by pair
        return pd.DataFrame({"a": a, "b": b})

    pairs = own.groupBy("chunk", "part").cogroup(other.groupBy("chunk", "part")).applyInPandas(meet, "a long, b long")
    out = tables.save(pairs, met.count())
    tables.drop(lists, opened_, met, size)
    return out


def _class_components(sets: DataFrame, similarity: tuple[int, int], tables: Tables) -> DataFrame:
    """(node, component) of the classes that have a similar class."""
    give_back(sets.sparkSession)
    rows, many = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()
    entries = sets.select("cls", "n", "l", "weight", F.explode("prefix").alias("token"))
    # First, each class and the most typical class of its posting lists that it meets most often.
    lead = entries.groupBy("token").agg(F.max(F.struct("weight", "cls", "n")).alias("lead"), F.count("*").alias("many")).where("many > 1")
    meets = entries.join(lead, "token").where((F.col("cls") != F.col("lead.cls")) & _fits(F.col("n"), F.col("lead.n"), similarity))
    votes = meets.groupBy("cls", F.col("lead.cls").alias("b")).count().groupBy(F.col("cls").alias("a"))
    leads = tables.save(votes.agg(F.max_by("b", F.struct("count", "b")).alias("b")), rows)
    led = tables.save(_similar(leads, sets, similarity), rows)
    give_back(sets.sparkSession)
    label = tables.save(components(led, tables, rows), rows)
    give_back(sets.sparkSession)
    met = _open_pairs(entries, leads, label, sets, similarity, tables, rows, many)
    give_back(sets.sparkSession)
    out = tables.save(components(led.unionByName(met), tables, rows), rows)
    give_back(sets.sparkSession)
    tables.drop(leads, led, label, met)
    return out


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """(id, n_shingles, component_id) per row: component_id is the least id reachable over links.

    Two rows link when the Jaccard similarity of their sets of word shingles is at least
    ``similarity``; A-Z are lower-cased.  Fewer than ``words`` words make one shingle.  Rows
    without words, null ones included, have n_shingles 0 and link with nothing: they are their own
    component.  A null id stays null and takes no part in naming components.  Repeated rows come
    back as often as they came; extra columns don't matter.
    """
    tables = Tables(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scanned = tables.save(_signatures(rows, words))
    hot, freq = _hot_tokens(scanned)
    signs = scanned.where("n >= 0").select("id", "n", "cls")
    total = signs.agg(F.sum("n")).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_TOKENS))
    shared = _shared_tokens(_blocks(rows, words, parts, hot), parts, held_tokens)
    if len(hot):
        shared = shared.unionByName(_hot_entries(rows, words, parts, hot, freq))
    sets = tables.save(_prefixes(shared, similarity), total // TOKENS_PER_ROW)
    label = _class_components(sets, similarity, tables)
    tables.drop(sets)
    of_class = signs.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"))
    named = of_class.join(label, of_class.cls == label.node, "left").select("cls", "least", F.coalesce("component", "cls").alias("comp"))
    joined = named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("cls", "component_id")
    return signs.join(joined, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
