"""Column functions over text: Column -> Column, all JVM-side."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of answer types, footers and front matter, tested in this order.
NUMERIC = r"(?i)LKR|\d{1,3}(?:,\d{3})+|\b\d+\s*%|\b\d+\s*(?:hours?|minutes?|days?|min)\b|\d{1,2}:\d{2}\s*[ap]m"
PROCEDURAL = r"(?i)\bmust\b|\brequired\b|\bshould\b|\bbring\b|\bapply\b|\bcontact\b|\bsubmit\b"
NUMBER = r"\d[\d,]*"
FOOTERS = (
    r"(?i)^Page\s+\d+\s+of\s+\d+$",
    r"(?i)^SGH-[A-Z]+-\d+\s*\|\s*Rev",
    r"(?i)^Prices subject to revision",
    r"(?i)^Document integrity verified",
    r"(?i)^Issued by:\s*SGH PKI",
    r"(?i)^Certificate chain:",
    r"(?i)^Digitally Signed$",
    r"(?i)^\s*✓?\s*Digitally Signed",
)
FRONT_MATTER = {
    "doc_id": r"Ref:\s*(SGH-[A-Z]+-\d+)",
    "issued": r"Issued:\s*(\d{1,2}\s*\|?\s*\w+\s+\d{4})",
    "rev": r"Rev:\s*([\d.]+)",
    "dept": r"Dept:\s*([^|]+?)\s*(?:\||Valid Until|$)",
    "valid_until": r"Valid Until:\s*(\d{1,2}\s*\|?\s*\w+\s+\d{4})",
}
#: White space that Python's strip() takes off and that texts here can hold.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"


def strip(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze_blank_lines(text: Column) -> Column:
    """Three or more line feeds become two."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def tokens(text: Column) -> Column:
    """The distinct tokens of a text: lower case, letters and digits only."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")), "")


def similar(inter: Column, a: Column, b: Column, num: int = 4, den: int = 5) -> Column:
    """Whether sets of sizes a and b that share ``inter`` have Jaccard similarity num/den or more; two empty sets haven't."""
    return (den * inter >= num * (a + b - inter)) & (inter > 0)


def answer_type(text: Column) -> Column:
    """numeric, procedural or factual."""
    return F.when(text.rlike(NUMERIC), "numeric").when(text.rlike(PROCEDURAL), "procedural").otherwise("factual")


def ungrounded(answer: Column, evidence: Column) -> Column:
    """Whether a number of the answer is missing from the evidence, commas apart."""
    bare = F.replace(evidence, F.lit(","), F.lit(""))
    return F.exists(F.regexp_extract_all(answer, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: ~F.contains(bare, F.replace(n, F.lit(","), F.lit(""))))


def fee(value: Column, unit: str = "LKR") -> Column:
    """A bare amount gets its unit."""
    v = strip(value)
    return F.when(v.rlike("^[0-9]") & ~F.contains(v, F.lit("%")), F.concat(v, F.lit(f" {unit}"))).otherwise(v)


def is_footer(line: Column, letterheads: Sequence[str] = (), footers: Sequence[str] = FOOTERS, banner: str | None = None) -> Column:
    """A running footer, a signature remnant, or one of the letterheads (upper case).

    ``banner``: the institution's name as running footers write it, before a raised dot, in that case and anywhere in the line.
    """
    out = F.upper(strip(line)).isin(list(letterheads)) if letterheads else F.lit(False)
    if banner:
        out |= line.rlike(re.escape(banner) + r"\s*·")
    for pattern in footers:
        out |= line.rlike(pattern)
    return out


def front_matter(header: Column) -> dict[str, Column]:
    """The fields of a reference block by name; empty where one is missing."""
    return {name: F.trim(F.regexp_replace(F.regexp_extract(header, pattern, 1), r"\s*\|\s*", " ")) for name, pattern in FRONT_MATTER.items()}


def title_of(file_name: Column) -> Column:
    """A title from a source file's name."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(file_name, r"(?i)\.pdf$", ""), r"\s+", " "))
    return F.replace(F.regexp_replace(stem, r"^FAQ\s*-\s*", "FAQ — "), F.lit(" - "), F.lit(" — "))


def fixed_chunks(text: Column, width: int = 1200, least: int = 200) -> Column:
    """array<struct<chunk, body>>: slices of ``width`` characters, stripped, that keep more than ``least``."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(width))
    cut = F.transform(starts, lambda i: F.struct(F.call_function("div", i, F.lit(width)).cast("int").alias("chunk"), strip(F.substring(text, i + 1, F.lit(width))).alias("body")))
    return F.filter(cut, lambda c: F.length(c["body"]) > least)


def token_count(text: Column) -> Column:
    """The default counter of an estimate: runs of non-blanks.  A model's own tokenizer is a seam."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))
