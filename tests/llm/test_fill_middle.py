from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from qaloom.llm.fill_middle import Chunks, fill_in_middle, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, share=50, spm_share=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= share:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_share:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, **options):
    got = fill_in_middle(df, **options).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = {}
    for r in df.select("doc_id", "text").collect():
        want.setdefault(r["doc_id"], []).append((*plain(r["doc_id"], r["text"], options.get("share", 50), options.get("spm_share", 80)), r["text"] or ""))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]))
    sortable = lambda d: {k: sorted(v, key=str) for k, v in d.items()}
    assert sortable(have) == sortable(want)


@pytest.mark.parametrize("chunk_bytes", [1, 7, 1 << 14])
def test_odd_rows(spark, odd, chunk_bytes):
    if chunk_bytes == 1:
        odd = odd.where("length(text) < 1000 or text is null")
    check(odd, share=100, spm_share=50, chunk_bytes=chunk_bytes)


def test_tables_and_forms(spark, documents):
    check(documents)
    forms = {r["form"]: r["count"] for r in fill_in_middle(documents).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm", "psm"}


def test_markers_and_edges_of_white_space(spark):
    rows = [(i, t) for i, t in enumerate(["a<P>b c d", "<S>", "x <M", "  lead", "trail \t", " ", "\n\n\x0b", "é  è ü  ß 😀", "a\x85b c", "<P", "P><S", "one"] * 9)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), share=90)


def test_chunk_borders_count_once():
    text = b"ab  cd e \tf" * 50
    data = np.frombuffer(text + text, np.uint8)
    offsets = np.array([0, len(text), 2 * len(text)])
    for size in (1, 2, 3, 5, 64, 1000):
        chunks = Chunks(data, offsets, size)
        units = UNIT.findall(text.decode())
        assert chunks.units.tolist() == [len(units)] * 2
        for rank in range(len(units) + 1):
            at = len("".join(units[:rank]))
            assert (chunks.place(0, rank), chunks.place(1, rank)) == (at, at + len(text))


def test_empty_and_carried(spark, odd, empty):
    assert fill_in_middle(empty).count() == 0
    held = fill_in_middle(odd, carry=["source"])
    assert held.columns == ["doc_id", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert held.count() == odd.count()
