"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Texts become hashed features where they are read: a feature's bucket is the CRC-32 of its bytes,
modulo the number of buckets.  The postings (bucket, document, count) are packed by block of
documents and by range of buckets, and shuffled by range; a range of many postings is dealt to
several tasks by block.  With each range comes what both corpora hold in its buckets, so a task
computes its buckets' gains by itself, adds them up for the documents of its postings, and emits one
contribution for each document; contributions are reduced by document.  Gumbel noise from a hash of
the id turns the weights into scores, and the highest scores are a weighted draw without
replacement.

Hot buckets: what a bucket holds is summed up in each block before it moves, and its postings are
split by block, so no task holds all of a bucket's documents.

Defined results: a null text has no words, no features and weight 0; a null id draws like an empty
string and comes after others in ties; repeated rows are weighed one by one and ranked one after
the other; no documents give no rows; with an empty target all gains follow the documents alone.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaloom.llm import textblocks as tb
from qaloom.llm.packed import packed, summed, unpacked
from qaloom.sources.durable import Tables

BUCKETS = 10_000
PARTS = 32  # ranges of buckets
SALT_BLOCKS = 64  # blocks whose postings of one range meet in a task
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1 << 16
LEAST_WORDS, SHARE = 20, 25
_PENDING = 1 << 23  # occurrences held before they are counted
_LOOPED = 64  # longest word whose CRC is computed beside others
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- CRC-32 of many words at once


@functools.cache
def _zeros(power: int) -> np.ndarray:
    """Four tables, one for each byte of a CRC: what 2**power zero bytes after it make of it."""
    if power == 0:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
        return np.stack([one, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in (0, 1, 2))])
    half = _zeros(power - 1)
    return _through(half, _through(half, np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])))


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return tables[0][crc & byte] ^ tables[1][(crc >> np.uint32(8)) & byte] ^ tables[2][(crc >> np.uint32(16)) & byte] ^ tables[3][crc >> np.uint32(24)]


def crc_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of text[start:end], for each pair."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, length = starts[order], length[order]
    long = int(np.searchsorted(-length, -_LOOPED, "left"))
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    table = _zeros(0)[0]
    for k in range(int(length[long]) if long < len(at) else 0):
        n = long + int(np.searchsorted(-length[long:], -k, "left"))  # words longer than k
        part = crc[long:n]
        crc[long:n] = table[(part ^ text[at[long:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    crc = ~crc
    for i in range(long):
        crc[i] = zlib.crc32(text[at[i] : at[i] + length[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def crc_pairs(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, a space and the word after it, from the words' own."""
    joined = _through(_zeros(0), crc[:-1]) ^ np.uint32(zlib.crc32(b" "))
    after = length[1:].astype(np.int64)
    for power in range(int(after.max(initial=0)).bit_length()):
        has = np.flatnonzero((after >> power) & 1)
        joined[has] = _through(_zeros(power), joined[has])
    return joined ^ crc[1:]


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(CRC-32, length, row) of the words of rows ``data[offsets[i]:offsets[i + 1]]``, in order, by segments."""
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        to = min(last, at + tb.SEGMENT)
        while to < last and _WORD[_LOWER[data[to - 1]]] and _WORD[_LOWER[data[to]]]:  # not inside a word, unless it is a row's end
            back = np.flatnonzero(~_WORD[_LOWER[data[at:to]]])
            edge = offsets[np.searchsorted(offsets, to, "right") - 1]
            cut = max(at + int(back[-1]) + 1 if len(back) else at, int(edge))
            if cut > at:
                to = cut
                break
            to = min(last, to + tb.SEGMENT)
        text = _LOWER[data[at:to]]
        inside = np.zeros(to - at + 2, bool)
        inside[1:-1] = _WORD[text]
        begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = np.unique(offsets[(offsets > at) & (offsets < to)]) - at
        begin[edges], end[edges - 1] = inside[1:-1][edges], inside[1:-1][edges - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield crc_words(text, starts, ends), ends - starts, np.searchsorted(offsets, starts + at, "right") - 1
        at = to


# --- postings of blocks of documents


class Block:
    """Counts of (bucket, document) of up to BLOCK_DOCS documents."""

    def __init__(self, buckets: int):
        self.buckets, self.ids, self.words, self.bytes = buckets, [], [], 0
        self.keys, self.counts, self.pending, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        first, n = sum(map(len, self.ids)), np.zeros(len(ids), np.int64)
        last = None  # the word before, which a segment's end may part from its pair
        for crc, length, row in words(data, offsets):
            if not len(crc):
                continue
            n += np.bincount(row, minlength=len(ids))
            if last is not None:
                crc, length, row = (np.concatenate([a, b]) for a, b in zip(last, (crc, length, row), strict=True))
            pairs = crc_pairs(crc, length)[row[1:] == row[:-1]]
            single = slice(1 if last is not None else 0, None)
            self.count(crc[single], row[single] + first)
            self.count(pairs, row[1:][row[1:] == row[:-1]] + first)
            last = crc[-1:], length[-1:], row[-1:]
        self.ids.append(ids)
        self.words.append(n)
        self.bytes += int(offsets[-1] - offsets[0])

    def count(self, crc: np.ndarray, doc: np.ndarray) -> None:
        self.pending.append((crc % np.uint32(self.buckets)).astype(np.uint64) << np.uint64(16) | doc.astype(np.uint64))
        self.held += len(crc)
        if self.held >= _PENDING:
            self.fold()

    def fold(self) -> None:
        if self.pending:
            fresh, n = np.unique(np.concatenate(self.pending), return_counts=True)
            self.keys, self.counts = summed(np.concatenate([self.keys, fresh]), np.concatenate([self.counts, n]))
            self.pending, self.held = [], 0

    def rows(self, name: str, parts: int) -> dict[str, list]:
        """A row for each range of buckets, and one, of part -1, of the documents themselves."""
        self.fold()
        n_words = np.concatenate(self.words)
        out = {"part": [-1], "block": [name] * (parts + 1), "docs": [len(n_words)] * (parts + 1), "ids": [pa.concat_arrays(self.ids), *[None] * parts], "words": [n_words, *[None] * parts], "sums": [None], "lengths": [None], "gaps": [None], "counts": [None]}
        bucket, doc = (self.keys >> np.uint64(16)).astype(np.int64), (self.keys & np.uint64(0xFFFF)).astype(np.int64)
        for p in range(parts):
            lo, hi = _range(p, parts, self.buckets)
            i, j = np.searchsorted(bucket, [lo, hi])
            b, d, c = bucket[i:j] - lo, doc[i:j], self.counts[i:j]
            opens = np.concatenate([[True], b[1:] != b[:-1]])[: len(b)]
            gaps = np.where(opens, d, np.diff(d, prepend=0)).astype(np.uint16)
            out["part"].append(p)
            out["sums"].append(np.bincount(b, c, hi - lo).astype(np.int64))
            out["lengths"].append(np.bincount(b, minlength=hi - lo).astype(np.int32))
            out["gaps"].append(packed(gaps))
            out["counts"].append(packed(c.astype(np.uint32)))
        return out


def _range(part: int, parts: int, buckets: int) -> tuple[int, int]:
    return part * buckets // parts, (part + 1) * buckets // parts


def postings(df: DataFrame, id_col: str, text_col: str, buckets: int, parts: int) -> DataFrame:
    """The packed postings of ``df``; a block's name is unique in one run of the scan, so they must be written once."""
    kind = df.select(F.col(f"`{id_col}`")).dtypes[0][1]
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        done, block = 0, Block(buckets)

        def made() -> pa.RecordBatch:
            out = block.rows(f"{task}-{done}", parts)
            big = lambda v: pa.array(v, pa.binary())
            ids = out["ids"]
            held = pa.ListArray.from_arrays(pa.array([0, *[len(ids[0])] * (parts + 1)], pa.int32()), ids[0])
            cols = [pa.array(out["part"], pa.int32()), pa.array(out["block"]), pa.array(out["docs"], pa.int32()), held, pa.array(out["words"], pa.list_(pa.int64())), pa.array(out["sums"], pa.list_(pa.int64())), pa.array(out["lengths"], pa.list_(pa.int32())), big(out["gaps"]), big(out["counts"])]
            return pa.RecordBatch.from_arrays(cols, names=["part", "block", "docs", "ids", "words", "sums", "lengths", "gaps", "counts"])

        for batch in batches:
            data, offsets, _ = tb.string_column(batch, "_text")
            ids = batch.column(0)
            for i, j in tb.chunks(offsets):
                for lo in range(i, j, BLOCK_DOCS // 2):
                    hi = min(j, lo + BLOCK_DOCS // 2)
                    block.add(ids.slice(lo, hi - lo), data, offsets[lo : hi + 1])
                    if block.bytes >= BLOCK_BYTES or sum(map(len, block.ids)) > BLOCK_DOCS // 2:
                        yield made()
                        done, block = done + 1, Block(buckets)
        if block.ids:
            yield made()
        tb.release()

    return rows.mapInArrow(post, f"part int, block string, docs int, ids array<{kind}>, words array<long>, sums array<long>, lengths array<int>, gaps binary, counts binary")


def _held(posted: DataFrame, name: str) -> DataFrame:
    """What a corpus holds in each bucket: summed up by block already, then map-side."""
    return posted.where("part >= 0").select("part", F.posexplode("sums").alias("nth", "_n")).groupBy("part", "nth").agg(F.sum("_n").alias(name))


# --- gains, contributions, weights


def importance_weights(df: DataFrame, target: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, parts: int = PARTS) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_features, weight (the floored mean of its features' gains)."""
    kind = df.select(F.col(f"`{id_col}`")).dtypes[0][1]
    posted = tables.save(postings(df, id_col, text_col, buckets, parts))
    wanted = postings(target.select(F.lit(0).alias("_id"), F.col(f"`{target_text}`").alias("_text_of")), "_id", "_text_of", buckets, parts)
    both = tables.save(_held(posted, "s").join(_held(wanted, "t"), ["part", "nth"], "full").na.fill(0, ["s", "t"]), buckets)
    s_all, t_all = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    blocks = posted.where("part = -1").count()
    salts = max(1, -(-blocks // SALT_BLOCKS))
    ranges = both.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("nth", "s", "t"))).alias("held"))  # at most buckets/parts entries each
    ranges = ranges.select("part", F.col("held.nth").alias("nth"), F.col("held.s").alias("s"), F.col("held.t").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = posted.where("part >= 0").select("part", F.pmod(F.hash("block"), F.lit(salts)).alias("salt"), "block", "docs", "lengths", "gaps", "counts")

    def contribute(found: pa.Table, held: pa.Table) -> pa.Table:
        blocks_, out = found.column("block").to_pylist(), []
        if not len(blocks_):
            return pa.table({"block": pa.array([], pa.string()), "part": pa.array([], pa.int32()), "sums": pa.array([], pa.list_(pa.int64()))})
        part = found.column("part")[0].as_py()
        lo, hi = _range(part, parts, buckets)
        gain = np.zeros(hi - lo, np.int64)
        if held.num_rows:
            nth, s, t = (np.array(held.column(c)[0].as_py(), float) for c in ("nth", "s", "t"))
            gain[nth.astype(np.int64)] = np.floor(1000 * np.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
        for k in range(found.num_rows):
            length = found.column("lengths")[k].values.to_numpy()
            doc = unpacked(found.column("gaps")[k].as_py(), np.uint16).astype(np.int64)
            counts = unpacked(found.column("counts")[k].as_py(), np.uint32).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(doc)])
            ends = np.cumsum(length)
            doc = sums[1:] - np.repeat(sums[ends - length], length)
            total = np.zeros(int(found.column("docs")[k].as_py()), np.int64)
            np.add.at(total, doc, counts * np.repeat(gain, length))
            out.append(total)
        return pa.table({"block": pa.array(blocks_), "part": pa.array([part] * len(blocks_), pa.int32()), "sums": pa.array(out, pa.list_(pa.int64()))})

    given = dealt.groupBy("part", "salt").cogroup(ranges.groupBy("part", "salt")).applyInArrow(contribute, "block string, part int, sums array<long>")
    header = posted.where("part = -1").select("block", F.lit(-1).alias("part"), F.lit(None).cast("array<long>").alias("sums"), "ids", "words")
    given = given.withColumns({"ids": F.lit(None).cast(f"array<{kind}>"), "words": F.lit(None).cast("array<long>")})

    def reduce(rows: pa.Table) -> pa.Table:
        """A block's documents with the sum of what the ranges gave them."""
        parts_ = np.asarray(rows.column("part"))
        top = int(np.flatnonzero(parts_ == -1)[0])
        n_words = rows.column("words")[top].values.to_numpy()
        features = 2 * n_words - (n_words > 0)
        total = np.zeros(len(n_words), np.int64)
        for k in np.flatnonzero(parts_ >= 0):
            total += rows.column("sums")[int(k)].values.to_numpy()
        ids = rows.column("ids")[top].values
        return pa.table({id_col: ids, "n_words": n_words, "n_features": features, "weight": np.where(features > 0, total // np.maximum(features, 1), 0)})

    return header.unionByName(given).groupBy("block").applyInArrow(reduce, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def importance_resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    share: int = SHARE,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_features, weight, score, rank.

    Of the N rows of at least ``least_words`` words, the floor(share * N / 100) of the highest scores
    are drawn and ranked from 1, ties to smaller ids; rank is null for all others.
    """
    tables = Tables(df.sparkSession)
    weights = importance_weights(df, target, tables, id_col, text_col, target_text, buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weights.withColumn("score", F.col("weight") + noise).withColumn("_may", F.col("n_words") >= least_words)
    # Sorted by ranges, written, then numbered: the place in a partition and the rows of those before it.
    by = [F.desc("_may"), F.desc("score"), F.asc_nulls_last(f"`{id_col}`")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = scored.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = tables.save(in_order.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.count_if("_may").alias("_able"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.floor(F.sum("_able").over(whole) * share / 100).alias("_drawn"))
    rank = F.col("_before") + F.col("_nth") + 1
    found = placed.join(F.broadcast(sizes), "_part")  # a row for each partition
    return found.select(F.col(f"`{id_col}`"), "n_words", "n_features", "weight", "score", F.when(F.col("_may") & (rank <= F.col("_drawn")), rank).alias("rank"))
