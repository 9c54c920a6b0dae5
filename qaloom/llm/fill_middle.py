"""Fill-in-middle transformation: overlapping-chunk decomposition.

A unit is a word with the white space before it, or the white space that ends a text.  So a unit
ends wherever a character that isn't white space stands before one that is: a predicate on two
neighbours.  Texts are taken apart into chunks of bounded size, each read with the one byte before
it, so that every pair of neighbours lies in exactly one chunk.  The chunks' boundaries are counted,
all chunks alike and without regard to one another; prefix sums of the counts give each text its
number of units, from which both cut ranks follow, and tell which chunk owns a cut.  Only these
chunks are read again, to find the place inside them.

No shuffle: a row's text is in one task anyway, and memory beyond the texts is that of one segment
of chunks.

Defined results: a null text is an empty one, which stays plain; a null id draws like an empty
string; repeated rows are cut alike; no rows give none; white space is 0x20 and 0x09-0x0D; texts of
any length are cut whole; other columns stay out unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm import textblocks as tb

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_BYTES = 1 << 14
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For each place from lo to hi, whether a unit ends before it: reads from lo - 1, which the first place lacks."""
    if lo == 0:
        return np.concatenate([np.zeros(min(hi, 1), bool), unit_ends(data, 1, hi)]) if hi else np.zeros(0, bool)
    return ~_SPACE[data[lo - 1 : hi - 1]] & _SPACE[data[lo:hi]]


class Chunks:
    """The chunks of a batch of texts, with the boundaries that each holds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk_bytes: int = CHUNK_BYTES):
        self.data = data
        length = np.diff(offsets)
        many = np.maximum(1, -(-length // chunk_bytes))
        self.first = np.concatenate([[0], np.cumsum(many)])  # chunk of each text
        nth = np.arange(self.first[-1]) - np.repeat(self.first[:-1], many)
        self.lo = np.repeat(offsets[:-1], many) + nth * chunk_bytes
        self.hi = np.minimum(self.lo + chunk_bytes, np.repeat(offsets[1:], many))
        self.opens = nth == 0
        counts = np.zeros(len(self.lo), np.int64)
        for i, j in tb.chunks(np.concatenate([self.lo, self.hi[-1:]]) if len(self.lo) else np.zeros(1, np.int64)):
            base, end = int(self.lo[i]), int(self.hi[j - 1])
            marks = self.within(base, end, self.lo[i:j][self.opens[i:j]])
            sums = np.concatenate([[0], np.cumsum(marks)])
            counts[i:j] = sums[self.hi[i:j] - base] - sums[self.lo[i:j] - base]
        self.before = np.concatenate([[0], np.cumsum(counts)])  # boundaries in earlier chunks, of all texts
        self.units = self.before[self.first[1:]] - self.before[self.first[:-1]] + (length > 0)

    def within(self, lo: int, hi: int, openings: np.ndarray) -> np.ndarray:
        """Boundaries from lo to hi; a text's first place is none, whatever the text before it ends with."""
        if lo == hi:
            return np.zeros(0, bool)
        marks = unit_ends(self.data, lo, hi)
        marks[openings[openings < hi] - lo] = False
        return marks

    def place(self, text: int, rank: int) -> int:
        """Where the text's first ``rank`` units end, from the batch's start."""
        a, b = int(self.first[text]), int(self.first[text + 1])
        if rank == 0:
            return int(self.lo[a])
        if rank == self.units[text]:
            return int(self.hi[b - 1])
        nth = int(self.before[a]) + rank
        owner = a + int(np.searchsorted(self.before[a + 1 : b + 1], nth, "left"))
        lo, hi = int(self.lo[owner]), int(self.hi[owner])
        marks = self.within(lo, hi, self.lo[owner : owner + 1] if self.opens[owner] else self.lo[:0])
        return lo + int(np.flatnonzero(marks)[nth - int(self.before[owner]) - 1])


def _chars(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    seed: int = 42,
    share: int = 50,
    spm_share: int = 80,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per row of ``df``: id, ``carry``, n (units), form, prefix_chars, middle_chars, output.

    Draws come from the hex SHA-256 of ``seed:id``.  form: plain (the text itself) if the text is
    empty, holds a marker or isn't drawn into ``share`` percent; else spm for ``spm_share`` percent
    of the rest, or psm.  prefix_chars and middle_chars, in code points, are null where plain.
    """
    names = list(dict.fromkeys([id_col, *carry]))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]
    keep = [F.col(f"`{c}`") for c in dict.fromkeys([*names, text_col])]
    rows = df.select(*keep, digest.alias("_digest")).select(*keep, *draw)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            whole, every, _ = tb.string_column(batch, text_col)
            for i, j in tb.chunks(every):
                data, offsets = whole[every[i] : every[j]], every[i : j + 1] - every[i]
                chunks = Chunks(data, offsets, chunk_bytes)
                h1, h2, h3, h4 = (np.asarray(column(f"_h{k}"))[i:j] for k in (1, 2, 3, 4))
                a, b = h1 % (chunks.units + 1), h2 % (chunks.units + 1)
                forms, heads, middles, out = [], [], [], []
                for r in range(j - i):
                    text = data[offsets[r] : offsets[r + 1]].tobytes()
                    if not text or h3[r] % 100 >= share or p in text or s in text or m in text:
                        forms.append("plain")
                        heads.append(None)
                        middles.append(None)
                        out.append(text)
                        continue
                    cut, end = (chunks.place(r, int(k)) - int(offsets[r]) for k in (min(a[r], b[r]), max(a[r], b[r])))
                    prefix, middle, suffix = text[:cut], text[cut:end], text[end:]
                    spm = h4[r] % 100 < spm_share
                    forms.append("spm" if spm else "psm")
                    heads.append(_chars(prefix))
                    middles.append(_chars(middle))
                    out.append(b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)))
                cols = [column(c).slice(i, j - i) for c in names]
                cols += [pa.array(chunks.units), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64())]
                large = sum(map(len, out)) >= 1 << 31
                cols.append(pa.array(out, pa.large_binary() if large else pa.binary()).view(pa.large_string() if large else pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n", "form", "prefix_chars", "middle_chars", "output"])
        tb.release()

    kinds = dict(df.select(*[F.col(f"`{c}`") for c in names]).dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(turn, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of: each marker occurs once in it, unless it is plain."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
