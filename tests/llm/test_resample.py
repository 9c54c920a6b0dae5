from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from qaloom.llm import resample
from qaloom.llm.resample import importance_resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) of each document, sorted."""
    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in made:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, n, f in made:
        m = sum(f.values())
        weight = sum(c * gain(b) for b, c in f.items()) // m if m else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, m, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: 25 * len(able) // 100]
    left = [r for r in rows if not r[4]] + able[len(drawn) :]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in left], key=str)


def check(df, target):
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in importance_resample(df, target).collect()), key=str)
    assert got == plain([(r["doc_id"], r["text"]) for r in df.collect()], [r["text"] for r in target.collect()])


def test_odd_rows(spark, odd):
    target = spark.createDataFrame([(1, "w5x5 w6x6 one two", 3), (2, None, 3), (3, "", 3)], "item_id long, text string, part int")
    more = odd.selectExpr("*").unionByName(odd.selectExpr("doc_id + 100 AS doc_id", "concat(text, ' ', repeat('A-b_9 ', 30)) AS text", "source", "lang", "n_chars", "id", "n", "size", "cls", "html", "rank", "piece", "kept", "host", "segments", "shard", "row"))
    check(more, target)


def test_empty(spark, empty, odd):
    target = spark.createDataFrame([(1, "w5x5")], "item_id long, text string")
    assert importance_resample(empty, target).count() == 0
    check(odd, target.where("false"))


def test_blocks_salts_and_segments(spark, documents, monkeypatch):
    """The same, whatever the blocks: here many small ones, of which few meet in a task."""
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    monkeypatch.setattr(resample, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(resample, "SALT_BLOCKS", 3)
    check(documents.repartition(3).coalesce(2), target)


def test_pairs_across_segments(monkeypatch):
    monkeypatch.setattr(resample.tb, "SEGMENT", 9)
    monkeypatch.setattr(resample, "_PENDING", 10)
    texts = ["one two three four five six one two", "", "one two", "..", "seven\neight nine ten ten ten"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    block = resample.Block(10_000)
    block.add(resample.pa.array(range(len(texts))), data, np.cumsum([0, *map(len, texts)]))
    block.fold()
    got = {(int(k) & 0xFFFF, int(k) >> 16): int(c) for k, c in zip(block.keys, block.counts, strict=True)}
    assert got == {(r, b): c for r, t in enumerate(texts) for b, c in features(t)[1].items()}


def test_crc_of_words_and_pairs():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in [1, 2, 3, 63, 64, 65, 130, 1000, 5000, 7, 1, 300]]
    text = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    crc = resample.crc_words(text, starts, ends)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    assert resample.crc_pairs(crc, ends - starts).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]


@pytest.mark.parametrize("segment", [3, 8, 64, 1 << 20])
def test_words_by_segments(monkeypatch, segment):
    monkeypatch.setattr(resample.tb, "SEGMENT", segment)
    texts = ["Ab cd", "", "é-zz9", "x" * 100 + " y", "tail", "head ", "  ", "q"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = [(int(c), int(r)) for crc, _, row in resample.words(data, offsets) for c, r in zip(crc, row, strict=True)]
    assert got == [(zlib.crc32(w.encode()), r) for r, t in enumerate(texts) for w in WORDS.findall(t.translate(LOWER))]


def test_target_like_documents_are_drawn_more(spark):
    rows = [(i, " ".join(("alpha beta gamma" if i % 4 == 0 else "delta omega sigma").split() * 10) + f" n{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(1, "alpha beta gamma " * 50)], "item_id long, text string")
    drawn = [r["doc_id"] for r in importance_resample(docs, target).where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(i % 4 == 0 for i in drawn) > 90
