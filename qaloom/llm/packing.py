"""Best-fit packing by a length histogram.

Texts become token ids where they are read; only lengths and checksums move.  The plan is made
over counts of lengths, of which there are at most ``capacity``: best fit, longest first, filling
whole groups of equal sequences at once.  Each planned slot is a range of ranks within a length,
and a piece finds its slot by its own rank within its length.

Defined results: a null text is an empty one, which is the closing id alone; repeated rows are
packed one by one, each with its own slots; no rows give no sequences; extra columns don't matter.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm import textblocks as tb
from qaloom.sources.durable import Tables
from qaloom.llm.ranks import running

CAPACITY = 2048
CLOSING_ID = 0
KEEP_WORDS, HELD_WORDS = 1_000_000, 400_000  # that a worker remembers, of about 30 bytes each; and between tasks
WORD_END = "</w>"  # of the vocabulary's tokens that end a run of letters, a digit or a run of signs
SIGNS = frozenset((b".", b",", b";", b":", b"!", b"?"))
CHUNK_BYTES = 2 << 20  # of text tokenized at once
TOKENIZER = "word_bpe_49k.json"

_loaded: dict[str, object] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """Ids of whole texts, word by word.

    The vocabulary drops white space before it merges, so a text's ids are its words' ids one after
    another, and a word needs to be merged only once.  Words are known by 64-bit hashes, sorted,
    beside the places of their ids in one array; a full memory starts anew.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        ends = [t for t in self.model.get_vocab().items() if t[0].endswith(WORD_END)]
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for _, i in ends]] = True
        self.signs = {s: _packed(self.model.encode(s.decode(), add_special_tokens=False).ids) for s in SIGNS} | {b"": b""}
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.again, self.ids, self.used = np.zeros(0, bool), np.zeros(1 << 16, "<u4"), 0

    def shrink(self) -> None:
        """Keep words that have been met in several chunks, HELD_WORDS of them at most."""
        keep = np.flatnonzero(self.again)
        keep = keep[:: max(1, -(-len(keep) // HELD_WORDS))]
        length = self.lengths[keep].astype(np.int64)
        start = np.cumsum(length) - length
        self.ids = self.ids[np.arange(length.sum()) + np.repeat(self.starts[keep] - start, length)] if len(keep) else np.zeros(1 << 16, "<u4")
        self.hashes, self.starts, self.lengths, self.used = self.hashes[keep], start, self.lengths[keep], int(length.sum())
        self.again = np.zeros(len(keep), bool)

    def merge(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, ids) of words not seen before.

        A word of letters only is one run to the tokenizer and ends with the only token marked so:
        such words are encoded together, as one text, and cut apart after those tokens.  A sign
        after the letters is a run of its own.
        """
        plain, bodies, rest = [], [], []
        for w in words:
            sign = w[-1:] if w[-1:] in SIGNS else b""
            body = (w[:-1] if sign else w).decode("utf-8", "replace")
            if body.isalpha() and (body.isascii() or (body.lower().isalpha() and is_normalized("NFC", body))):
                plain.append((w, sign))
                bodies.append(body)
            else:
                rest.append(w)
        lines = [" ".join(bodies[i : i + 256]) for i in range(0, len(bodies), 256)]
        ids = [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([*ids, np.zeros(0, "<u4")])
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(cuts) == len(plain):
            raw, at = ids.tobytes(), 0
            for (w, sign), cut in zip(plain, cuts.tolist(), strict=True):
                yield w, raw[at:cut] + self.signs[sign]
                at = cut
        else:
            rest = words
        for w, e in zip(rest, self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False), strict=True):
            yield w, _packed(e.ids)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Remember words by their sorted hashes."""
        known: dict[bytes, bytes] = {}
        for i in range(0, len(words), 4096):
            known.update(self.merge(words[i : i + 4096]))
        packed = [known[w] for w in words]
        lengths = np.array([len(x) // 4 for x in packed], np.int32)
        fresh = np.frombuffer(b"".join(packed), "<u4")
        while self.used + len(fresh) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(fresh), "<u4")])
        self.ids[self.used : self.used + len(fresh)] = fresh
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.again = np.insert(self.again, at, False)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(lengths) - lengths)
        self.lengths = np.insert(self.lengths, at, lengths)
        self.used += len(fresh)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each with its closing id; where each row begins, and the end)."""
        hashes, rows, begins, ends = tb.words(data, offsets, lower=False)
        found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(found) > KEEP_WORDS:
            self.shrink()
        at = np.searchsorted(self.hashes, found)
        new = np.ones(len(found), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != found[inside]
        self.again[at[~new]] = True
        if new.any():
            base = int(offsets[0])
            cut = [data[base + i : base + j].tobytes() for i, j in zip(begins[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            self.learn(found[new], cut)
            at = np.searchsorted(self.hashes, found)
        start, length = self.starts[at][back], self.lengths[at][back].astype(np.int64)
        total, many = int(length.sum()), len(offsets) - 1
        before = np.cumsum(length) - length
        place = np.arange(total)
        out = np.full(total + many, CLOSING_ID, "<u4")
        out[place + np.repeat(rows, length)] = self.ids[place + np.repeat(start - before, length)]
        size = np.bincount(rows, weights=length, minlength=many).astype(np.int64) + 1
        return out, np.concatenate([[0], np.cumsum(size)])


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, name: str, keep_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every text's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(tokenizer_path(name))
        for batch in batches:
            data, offsets, _ = tb.string_column(batch, text_col)
            names = batch.column(0)
            for i, j in tb.chunks(offsets, CHUNK_BYTES):
                out, cuts = own.rows(data, offsets[i : j + 1])
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    for p, at in enumerate(range(lo, hi, capacity)):
                        part = out[at : min(hi, at + capacity)]
                        row.append(i + k)
                        piece.append(p)
                        start.append(at - lo)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(part.tobytes())
                cols = [names.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                heads = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, heads = [*cols, pa.array(kept, pa.binary())], [*heads, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=heads)
        own.shrink()
        tb.release()

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias(text_col)).mapInArrow(
        cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    )


def plan_slots(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset), by length and rank.

    Best fit over counts, longest first: pieces of one length go to the fullest sequences that
    still have room, a whole group of equal sequences at a time; the rest open new ones.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    rooms: list[int] = []  # a sorted list of the rooms that groups have

    def put(room: int, first: int, many: int) -> None:
        if room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, many))

    fresh = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            room = rooms[k] if k < len(rooms) else capacity
            each = room // length
            if k < len(rooms):
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    del rooms[k]
                take = min(many, max(1, left // each))
                if take < many:
                    put(room, first + take, many - take)
            else:
                first, take = fresh, max(1, left // each)
                fresh += take
            fit = min(each, left // take)  # the last sequence of a length may get fewer
            for f in range(fit):
                rows.append((length, rank, take, first, capacity - room + f * length))
                rank += take
                left -= take
            put(room - fit * length, first, take)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, on request).

    Only texts of more than ``capacity`` ids are cut.  ``ids``: little-endian unsigned 32-bit.
    """
    tables = Tables(df.sparkSession)
    pieces = tables.save(token_pieces(df, id_col, text_col, capacity, tokenizer, keep_ids))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_slots(counts, capacity)
    key = plan[:, 0] << 44 | plan[:, 1]
    table = F.array(*[F.lit(counts.get(k, 0)).cast("long") for k in range(capacity + 1)])
    sized = pieces.withColumn("_rows", F.element_at(table, F.col("length").cast("int") + 1))
    ranked = running(sized, ["length"], ["id", "piece", "ids_crc32"], sum(counts.values()), to="rank", key_rows="_rows")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda n: np.asarray(batch.column(batch.schema.get_field_index(n)))  # noqa: E731, B023
            rank = col("rank")
            at = np.searchsorted(key, col("length") << 44 | rank, "right") - 1
            done = {"sequence_id": pa.array(plan[at, 3] + rank - plan[at, 1]), "offset": pa.array(plan[at, 4])}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *done.values()], names=[*batch.schema.names[:-1], *done])

    kinds = [f"{n} {k}" for n, k in pieces.dtypes]
    out = ranked.select(*pieces.columns, "rank").mapInArrow(place, ", ".join([*kinds, "sequence_id long", "offset long"]))
    return out.withColumnRenamed("id", id_col)
