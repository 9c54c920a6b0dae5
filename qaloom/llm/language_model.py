"""Language-model scoring by context-tree weighting.

A byte is eight binary decisions, at the nodes of a tree of its leading bits.  Each decision node has
a context tree of its own: the contexts are the bytes before, up to DEPTH of them, newest first.  In
each context the zeros and ones seen in training give a Krichevsky-Trofimov estimate, and from the
deepest contexts upwards

    Pw(s) = 1/2 Pkt(s) + 1/2 product of Pw over the contexts one byte longer

weighs all depths against each other.  The next decision's probability then is a mixture of the
estimates of all depths on its path, deepest context first; the code length of a text is the sum
over its bytes, and an end mark, given the tree of the training texts.

How it runs: texts are read in blocks.  A block sends its distinct (context, byte) grams, and its
distinct words for the unigram base, each once with its count in training texts, packed by bin; so
what moves grows with different grams, not with text.  Grams go to bins by their SPLIT newest
context bytes: a bin holds whole subtrees, of at most 256 ** (DEPTH - SPLIT + 1) grams each, however
much text there is, and weighs them by itself; the few levels above are grouped and joined by Spark.
Counts from many blocks are added up in rounds of FAN.  Then every block gets its own grams' code
lengths and words' counts back, and scores its texts.

Words are known by 64-bit hashes.  Code lengths are whole millionths of a bit, and base logarithms
whole 1e-10ths, so sums are the same in any order.

Defined results: a null text is an empty one, an end mark alone; a null id is trained on; repeated
rows count and are scored one by one; without training texts each byte costs eight bits; no rows
give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm import textblocks as tb
from qaloom.llm.packed import packed, packed_keys, summed, unpacked, unpacked_keys
from qaloom.sources.durable import Tables

DEPTH, SPLIT = 5, 3  # context bytes; of these, the newest ones that decide a gram's bin
END = 0xFF  # no byte of UTF-8: ends a text, and stands before it
BLOCK_BYTES = 32 << 20
BIN_BYTES = 256 << 20  # of text for each bin, between LEAST_BINS and MOST_BINS
LEAST_BINS, MOST_BINS = 32, 4096
FAN = 256  # packed rows of one bin that meet in a task
END_WORD = np.uint64(0xFFFFFFFFFFFFFFFF)
_MICRO, _UNIT = 1_000_000, 10**10
_PENDING = 1 << 22
_SMALL = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LGAMMA = np.array([math.inf, *(math.lgamma(k / 2) for k in range(1, _SMALL))])


# --- grams and words of blocks


def _stream(padded: np.ndarray) -> np.ndarray:
    """The gram of each byte but the first DEPTH: its context, newest byte first and highest, and then the byte itself."""
    wide = padded.astype(np.uint64)
    out = wide[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        out |= wide[DEPTH - k : len(wide) - k] << np.uint64(8 * (DEPTH + 1 - k))
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, grams of rows i to j in order, how many each row has) of rows ``data[offsets[i]:offsets[i + 1]]``.

    Each byte and the end of each row is a gram; a long row comes in several parts.
    """
    for i, j in tb.chunks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * tb.SEGMENT:
            length = np.diff(offsets[i : j + 1])
            row = np.repeat(np.arange(j - i), length)
            padded = np.full(hi - lo + (DEPTH + 1) * (j - i), END, np.uint8)
            padded[np.arange(hi - lo) + (DEPTH + 1) * row + DEPTH] = _LOWER[data[lo:hi]]
            real = np.ones(len(padded), bool)
            real[((np.cumsum(length + DEPTH + 1) - length - DEPTH - 1)[:, None] + np.arange(DEPTH)).ravel()] = False
            yield i, j, _stream(padded)[real[DEPTH:]], length + 1
            continue
        for at in range(lo, hi, tb.SEGMENT):
            to = min(hi, at + tb.SEGMENT)
            before = _LOWER[data[max(lo, at - DEPTH) : at]]
            part = np.concatenate([np.full(DEPTH - len(before), END, np.uint8), before, _LOWER[data[at:to]], np.full(int(to == hi), END, np.uint8)])
            yield i, j, _stream(part), np.array([to - at + (to == hi)])


class Counts:
    """Distinct keys with sums, folded together now and then."""

    def __init__(self) -> None:
        self.keys, self.sums, self.pending, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counted: np.ndarray) -> None:
        """Keys, of which those that ``counted`` says count."""
        for part, one in ((keys[counted], 1), (keys[~counted], 0)):
            found, n = np.unique(part, return_counts=True)
            self.pending.append((found, n * one))
            self.held += len(found)
        if self.held >= _PENDING:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = zip((self.keys, self.sums), *self.pending, strict=True)
        self.keys, self.sums = summed(np.concatenate(keys), np.concatenate(sums))
        self.pending, self.held = [], 0
        return self.keys, self.sums


def _bin_of(kind: str, keys: np.ndarray, bins: int) -> np.ndarray:
    newest = keys >> np.uint64(8 * (DEPTH + 1 - SPLIT)) if kind == "g" else keys
    return (tb.mix(newest) % np.uint64(bins)).astype(np.int32)


def by_bin(kind: str, keys: np.ndarray, bins: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bin, which keys), for every bin."""
    of = _bin_of(kind, keys, bins)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(bins + 1))
    for b in range(bins):
        yield b, order[ends[b] : ends[b + 1]]


_ASKED = "kind string, bin int, block string, keys binary, counts binary, ids array<{}>, held array<boolean>, lengths array<long>, text binary"


def gather(df: DataFrame, id_col: str, text_col: str, held_out: str, bins: int) -> DataFrame:
    """Blocks: a row of kind t with the texts, and rows of grams (g) and words (w) for each bin.

    A block's name is unique in one run of the scan, so the rows must be written once.
    """
    kind = df.select(F.col(f"`{id_col}`")).dtypes[0][1]
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.expr(held_out).alias("_held"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        names = [x.split()[0] for x in _ASKED.split(", ")]
        empty = {c: None for c in names}
        done, texts, ids, held, lengths, found, size = 0, [], [], [], [], {"g": Counts(), "w": Counts()}, 0

        def made() -> Iterator[pa.RecordBatch]:
            block = f"{task}-{done}"
            raw = b"".join(texts)
            ids_ = pa.concat_arrays(ids)
            one = pa.RecordBatch.from_arrays(
                [pa.array(["t"]), pa.array([None], pa.int32()), pa.array([block]), *[pa.array([None], pa.binary())] * 2, pa.ListArray.from_arrays(pa.array([0, len(ids_)], pa.int32()), ids_), pa.array([np.concatenate(held)], pa.list_(pa.bool_())), pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)], pa.binary())],
                names=names,
            )
            yield one
            for kind_, counts in found.items():
                keys, sums = counts.fold()
                asked = [empty | {"kind": kind_, "bin": b, "block": block, "keys": packed_keys(keys[at]), "counts": packed(sums[at])} for b, at in by_bin(kind_, keys, bins)]
                yield pa.RecordBatch.from_pylist(asked, schema=one.schema)

        for batch in batches:
            data, offsets, _ = tb.string_column(batch, "_text")
            out = np.asarray(batch.column(2))
            for i, j in tb.chunks(offsets):
                part = offsets[i : j + 1]
                for a, b, keys, of_row in grams(data, part):
                    found["g"].add(keys, np.repeat(~out[i + a : i + b], of_row))
                hashes, row, _, _ = tb.words(data, part, lower=True)
                found["w"].add(np.concatenate([hashes, np.full(j - i, END_WORD)]), ~out[i:j][np.concatenate([row, np.arange(j - i)])])
                texts.append(data[part[0] : part[-1]].tobytes())
                ids.append(batch.column(0).slice(i, j - i))
                held.append(out[i:j])
                lengths.append(np.diff(part))
                size += int(part[-1] - part[0])
                if size >= BLOCK_BYTES:
                    yield from made()
                    done, texts, ids, held, lengths, found, size = done + 1, [], [], [], [], {"g": Counts(), "w": Counts()}, 0
        if ids:
            yield from made()
        tb.release()

    return rows.mapInArrow(read, _ASKED.format(kind))


def add_up(asked: DataFrame, blocks: int, tables: Tables) -> DataFrame:
    """One row for each kind and bin: distinct keys and their counts, in rounds of FAN rows."""

    def merge(rows: pa.Table) -> pa.Table:
        counts = Counts()
        for k, c in zip(rows.column("keys"), rows.column("counts"), strict=True):
            counts.pending.append((unpacked_keys(k.as_py()), unpacked(c.as_py(), np.int64)))
            counts.held += len(counts.pending[-1][0])
            if counts.held >= _PENDING:
                counts.fold()
        keys, sums = counts.fold()
        first = lambda c: [rows.column(c)[0].as_py()]
        return pa.table({"kind": pa.array(first("kind")), "bin": pa.array(first("bin"), pa.int32()), "salt": pa.array(first("salt"), pa.int32()), "keys": [packed_keys(keys)], "counts": [packed(sums)], "known": [int((sums > 0).sum())], "total": [int(sums.sum())]})

    schema = "kind string, bin int, salt int, keys binary, counts binary, known long, total long"
    held = asked.select("kind", "bin", F.hash("block").alias("salt"), "keys", "counts")
    many = blocks
    while True:
        many = -(-many // FAN)
        out = tables.save(held.withColumn("salt", F.pmod("salt", F.lit(max(1, many)))).groupBy("kind", "bin", "salt").applyInArrow(merge, schema))
        tables.drop(held)
        held = out
        if many <= 1:
            return held.drop("salt")


# --- the weighting


def _lgamma(twice: np.ndarray) -> np.ndarray:
    """log Gamma of twice / 2, for positive whole numbers: a table, and Stirling's series beyond it."""
    x = np.maximum(twice, _SMALL) / 2.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(twice < _SMALL, _LGAMMA[np.minimum(twice, _SMALL - 1)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    a, b = np.asarray(zeros, np.int64), np.asarray(ones, np.int64)
    return _lgamma(2 * a + 1) + _lgamma(2 * b + 1) - _lgamma(2 * (a + b) + 2) - math.log(math.pi)


def weigh(zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts with longer ones: log Pw, the share of the own estimate in the mixture, and that estimate of a one."""
    own = log_kt(zeros, ones)
    share = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
    return np.logaddexp(own, longer) - math.log(2), share, (ones + 0.5) / (zeros + ones + 1.0)


class Subtrees:
    """The contexts of DEPTH to SPLIT bytes at the decision nodes of one bit of the byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int):
        byte = (keys & np.uint64(255)).astype(np.int64)
        node = (1 << bit) | (byte >> (8 - bit))
        self.ones = ((byte >> (7 - bit)) & 1).astype(bool)
        at = (keys & ~np.uint64(255)) | node.astype(np.uint64)  # sorted, as the keys are
        opens = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
        first = np.flatnonzero(opens)
        self.leaf = np.cumsum(opens) - 1
        add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        at, zeros, ones = at[first], add(np.where(self.ones, 0, counts)), add(np.where(self.ones, counts, 0))
        weighed = log_kt(zeros, ones)
        self.leaf_one = (ones + 0.5) / (zeros + ones + 1.0)
        self.levels = []  # from the longest contexts to the shortest: (level above of each, share, estimate)
        for _ in range(DEPTH - SPLIT):
            up = ((at >> np.uint64(16)) << np.uint64(8)) | (at & np.uint64(255))  # the oldest byte of the context goes
            at, above = np.unique(up, return_inverse=True)
            total = lambda x, above=above, n=len(at): np.bincount(above, x, n)
            zeros, ones, longer = total(zeros), total(ones), total(weighed)
            weighed, share, one = weigh(zeros, ones, longer)
            self.levels.append((above, share, one))
        self.at, self.zeros, self.ones_, self.weighed = at, zeros.astype(np.int64), ones.astype(np.int64), weighed

    def cost(self, left: np.ndarray, said: np.ndarray) -> np.ndarray:
        """Bits of this decision in each gram; ``left`` is the weight that shorter contexts leave, ``said`` what they say of a one."""
        for above, share, one in reversed(self.levels):
            left, said = (left * (1 - share))[above], (said + left * share * one)[above]
        p = (said + left * self.leaf_one)[self.leaf]
        return -np.log2(np.where(self.ones, p, 1 - p))


_TOP = "bin int, ctx long, node int, zeros long, ones long, weighed double"


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bin, its contexts of SPLIT bytes at all decision nodes."""
    for batch in batches:
        for b, k, c in zip(batch.column("bin"), batch.column("keys"), batch.column("counts"), strict=True):
            keys, counts = unpacked_keys(k.as_py()), unpacked(c.as_py(), np.int64)
            for bit in range(8):
                t = Subtrees(keys, counts, bit)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t.at), b.as_py(), np.int32)), pa.array((t.at >> np.uint64(8)).astype(np.int64)), pa.array((t.at & np.uint64(255)).astype(np.int32)), pa.array(t.zeros), pa.array(t.ones_), pa.array(t.weighed)], names=[x.split()[0] for x in _TOP.split(", ")])
    tb.release()


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        zeros, ones, longer = (np.asarray(batch.column(c)) for c in ("zeros", "ones", "weighed"))
        weighed, share, one = weigh(zeros, ones, longer)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weighed), pa.array(share), pa.array(one)], names=["ctx", "node", "zeros", "ones", "weighed", "share", "one"])


def code_lengths(held: DataFrame, tables: Tables) -> DataFrame:
    """(kind, bin, keys, values): of every gram the millionths of a bit that its byte costs in its context."""
    grams_ = held.where("kind = 'g'").select("bin", "keys", "counts")
    tops = tables.save(grams_.mapInArrow(_tops, _TOP))
    levels, at = [], tops
    for _ in range(SPLIT):  # upwards: contexts of SPLIT - 1 bytes to none
        sums = at.groupBy(F.expr("shiftright(ctx, 8)").alias("ctx"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighed").alias("weighed"))
        at = tables.save(sums.mapInArrow(_weighed, "ctx long, node int, zeros long, ones long, weighed double, share double, one double"))
        levels.append(at)
    down = levels[-1].select(F.col("ctx").alias("_ctx"), "node", (1 - F.col("share")).alias("left"), (F.col("share") * F.col("one")).alias("said"))
    for level in reversed(levels[:-1]):
        longer = level.withColumn("_ctx", F.expr("shiftright(ctx, 8)")).join(down, ["_ctx", "node"])
        down = longer.select(F.col("ctx").alias("_ctx"), "node", (F.col("left") * (1 - F.col("share"))).alias("left"), (F.col("said") + F.col("left") * F.col("share") * F.col("one")).alias("said"))
    above = tops.select("bin", "ctx", "node", F.expr("shiftright(ctx, 8)").alias("_ctx")).join(down, ["_ctx", "node"]).select("bin", "ctx", "node", "left", "said")

    def predict(found: pa.Table, given: pa.Table) -> pa.Table:
        if not found.num_rows:
            return pa.table({"kind": pa.array([], pa.string()), "bin": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "values": pa.array([], pa.binary())})
        keys, counts = unpacked_keys(found.column("keys")[0].as_py()), unpacked(found.column("counts")[0].as_py(), np.int64)
        at = (np.asarray(given.column("ctx")) << 8 | np.asarray(given.column("node"))).astype(np.uint64)
        order = np.argsort(at)
        at, left, said = at[order], np.asarray(given.column("left"))[order], np.asarray(given.column("said"))[order]
        bits = np.zeros(len(keys))
        for bit in range(8):
            t = Subtrees(keys, counts, bit)
            here = np.searchsorted(at, t.at)
            bits += t.cost(left[here], said[here])
        return pa.table({"kind": ["g"], "bin": pa.array([found.column("bin")[0].as_py()], pa.int32()), "keys": [found.column("keys")[0].as_py()], "values": [packed(np.rint(bits * _MICRO).astype(np.int64))]})

    return tables.save(grams_.groupBy("bin").cogroup(above.groupBy("bin")).applyInArrow(predict, "kind string, bin int, keys binary, values binary"))


# --- scores


def score_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: str = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 7) = 2",
) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``held_out`` is a condition in SQL; rows for which it doesn't hold train the model.  base_score
    is the add-one unigram log10 probability of the words and an end; score the tree's of the
    lower-cased bytes and an end mark, which bits_per_byte spreads over the n_bytes and that mark.
    """
    spark = df.sparkSession
    tables = Tables(spark)
    kind = df.select(F.col(f"`{id_col}`")).dtypes[0][1]
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    bins = min(MOST_BINS, max(LEAST_BINS, size // BIN_BYTES))
    asked = tables.save(gather(df, id_col, text_col, held_out, bins))
    blocks = asked.where("kind = 't'").count()
    packs = asked.where("kind <> 't'")
    held = add_up(packs, blocks, tables)
    train, distinct = held.where("kind = 'w'").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    model = code_lengths(held, tables).unionByName(held.where("kind = 'w'").select("kind", "bin", "keys", F.col("counts").alias("values")))
    salts = max(1, -(-blocks // FAN))

    def answer(want: pa.Table, have: pa.Table) -> pa.Table:
        """The values of a bin's keys that blocks ask for, in the order in which they ask."""
        out = []
        if want.num_rows:
            keys, values = unpacked_keys(have.column("keys")[0].as_py()), unpacked(have.column("values")[0].as_py(), np.int64)
            out = [packed(values[np.searchsorted(keys, unpacked_keys(k.as_py()))]) for k in want.column("keys")]
        return pa.table({"block": want.column("block"), "kind": want.column("kind"), "bin": want.column("bin"), "values": pa.array(out, pa.binary())})

    salted = packs.select("kind", "bin", F.pmod(F.hash("block"), F.lit(salts)).alias("salt"), "block", "keys")
    spread = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    by = ["kind", "bin", "salt"]
    answers = salted.groupBy(*by).cogroup(spread.groupBy(*by)).applyInArrow(answer, "block string, kind string, bin int, values binary")

    def score(texts: pa.Table, values: pa.Table) -> pa.Table:
        """All texts of a block."""
        raw = texts.column("text")[0].as_py()
        data = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), np.uint8)
        length = texts.column("lengths")[0].values.to_numpy()
        offsets = np.concatenate([[0], np.cumsum(length)])
        told = {(k, b): v for k, b, v in zip(values.column("kind").to_pylist(), values.column("bin").to_pylist(), values.column("values"), strict=True)}

        found = {"g": Counts(), "w": Counts()}
        none = lambda x: np.zeros(len(x), bool)
        for _, _, keys, _ in grams(data, offsets):
            found["g"].add(keys, none(keys))
        for i, j in tb.chunks(offsets):
            keys = tb.words(data, offsets[i : j + 1], lower=True)[0]
            found["w"].add(keys, none(keys))
        found["w"].add(np.array([END_WORD]), np.zeros(1, bool))
        known, value = {}, {}
        for k, counts in found.items():
            distinct_, _ = counts.fold()
            value[k] = np.zeros(len(distinct_), np.int64)
            for b, at in by_bin(k, distinct_, bins):
                value[k][at] = unpacked(told[k, b].as_py(), np.int64)
            known[k] = pd.Index(distinct_)
        below = train + distinct + 1
        logs = lambda c: np.rint(np.log10((c + 1) / below) * _UNIT).astype(np.int64)
        end = int(value["w"][-1])  # the greatest key
        cols = {c: np.zeros(len(length), np.int64) for c in ("tokens", "known", "base", "bits")}
        for i, j in tb.chunks(offsets):
            hashes, row, _, _ = tb.words(data, offsets[i : j + 1], lower=True)
            n, c = np.bincount(row, minlength=j - i), value["w"][known["w"].get_indexer(hashes)]
            cols["tokens"][i:j] = n + 1
            cols["known"][i:j] = _by_row(c > 0, n) + (end > 0)
            cols["base"][i:j] = _by_row(logs(c), n) + logs(np.array(end))
        for i, j, keys, n in grams(data, offsets):
            cols["bits"][i:j] += _by_row(value["g"][known["g"].get_indexer(keys)], n)
        bits = cols["bits"] / _MICRO
        return pa.table({id_col: texts.column("ids")[0].values, "held_out": texts.column("held")[0].values, "n_tokens": cols["tokens"], "n_known": cols["known"], "train_tokens": np.full(len(length), train, np.int64), "base_score": cols["base"] / _UNIT, "score": -bits * math.log10(2), "n_bytes": length, "bits_per_byte": bits / (length + 1)})

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    whole = asked.where("kind = 't'").select("block", "ids", "held", "lengths", "text")
    return whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def _by_row(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sums of the next ``many[i]`` values, for each i."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(many)
    return sums[ends] - sums[ends - many]
