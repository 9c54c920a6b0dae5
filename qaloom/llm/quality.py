"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths tell which words of a text lie in n-grams that the text
repeats; the share of the text's characters in such n-grams, and in lines that repeat an earlier
line, decides.  One pass over the rows, no shuffle: each text is judged where it is read.

Defined results: a null text counts as an empty one (no words, base_failed); extra columns stay
out of the result; repeated rows are judged one by one; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm import textblocks as tb

#: Largest share of word characters inside repeated n-grams, by n-gram length.
COVERAGE = {5: 0.45, 8: 0.35, 12: 0.30}
#: Largest share of characters in lines that repeat an earlier line.
LINE_COVERAGE = 0.30
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_BLANK = bytes([0x20, *range(0x09, 0x0E)])

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, gram_chars array<long>, base_failed boolean, kept boolean"
)


def repeated_words(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words that its row holds twice or more."""
    windows, at = tb.grams(hashes, rows, n)
    mark = np.zeros(len(hashes) + 1, np.int32)
    if len(windows):
        keys = tb.mix(windows + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        first = at[twice]
        np.add.at(mark, first, 1)
        np.add.at(mark, first + n, -1)
    return np.cumsum(mark[:-1]) > 0


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word equal to an earlier line, and their code points."""
    if b"\n" not in text:
        return 0, 0
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0, 0
    seen: set[bytes] = set()
    n = chars = 0
    for line in lines:
        if line in seen:
            if line.strip(_BLANK):
                n += 1
                chars += len(line.decode("utf-8", "replace"))
        else:
            seen.add(line)
    return n, chars


def measure(data: np.ndarray, offsets: np.ndarray, lengths: Sequence[int]) -> dict[str, np.ndarray]:
    """The measures of each row of one chunk."""
    k = len(offsets) - 1
    text = data[int(offsets[0]) : int(offsets[-1])]
    hashes, rows, starts, ends = tb.words(data, offsets, lower=False)
    points = np.zeros(len(text) + 1, np.int64)
    np.cumsum((text & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    total = lambda w: np.bincount(rows, weights=w, minlength=k).astype(np.int64)  # noqa: E731  exact below 2**53
    lines = np.array([_lines(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(k)], np.int64).reshape(k, 2)
    return {
        "n_words": np.bincount(rows, minlength=k).astype(np.int64),
        "word_chars": total(chars),
        "n_symbols": tb.row_counts(_SYMBOL[text], offsets),
        "n_repeat_words": total(repeated_words(hashes, rows, 8)),
        "n_dup_lines": lines[:, 0],
        "dup_line_chars": lines[:, 1],
        "n_chars": points[offsets[1:] - offsets[0]] - points[offsets[:-1] - offsets[0]],
        "gram_chars": np.stack([total(chars * repeated_words(hashes, rows, n)) for n in lengths], 1),
    }


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    coverage: dict[int, float] | None = None,
    line_coverage: float = LINE_COVERAGE,
) -> DataFrame:
    """One row per row of ``df``: id, ``carry`` columns, the measures, base_failed and kept.

    base_failed: fewer than 20 words, or over 30% of the words in 8-word windows found twice.
    kept: not base_failed, and no n-gram length of ``coverage`` and no repeated lines take a
    larger share of the characters than allowed.
    """
    limits = coverage or COVERAGE
    lengths = sorted(limits)
    names = list(dict.fromkeys([id_col, *carry]))
    rows = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text_col])])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = tb.string_column(batch, text_col)
            for i, j in tb.chunks(offsets):
                m = measure(data, offsets[i : j + 1], lengths)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                bad = m["dup_line_chars"] > line_coverage * m["n_chars"]
                for g, n in zip(m["gram_chars"].T, lengths, strict=True):
                    bad |= g > limits[n] * m["word_chars"]
                cols = [batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in names]
                cols += [pa.array(m[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")]
                flat = m["gram_chars"].ravel()
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * len(lengths), pa.int32()), pa.array(flat)))
                cols += [pa.array(failed), pa.array(~failed & ~bad)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *[x.split()[0] for x in SCHEMA.split(", ")]])
        tb.release()

    kinds = dict(df.select(*[F.col(f"`{c}`") for c in names]).dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + SCHEMA
    return rows.mapInArrow(judge, schema)
