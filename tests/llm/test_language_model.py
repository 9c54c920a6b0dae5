from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from qaloom.llm import language_model as lm

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def decisions(text):
    """(decision node, bit, the DEPTH bytes before, oldest first) of each bit of the text and its end."""
    data = bytes([lm.END] * lm.DEPTH) + (text or "").translate(LOWER).encode() + bytes([lm.END])
    for i in range(lm.DEPTH, len(data)):
        for k in range(8):
            yield (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1, data[i - lm.DEPTH : i]


class PlainTree:
    """Context-tree weighting as its recursion says it, context by context."""

    def __init__(self, texts):
        self.seen = defaultdict(lambda: [0, 0])
        self.longer = defaultdict(set)
        for text in texts:
            for node, bit, ctx in decisions(text):
                for d in range(lm.DEPTH + 1):
                    self.seen[node, ctx[lm.DEPTH - d :]][bit] += 1
                    if d < lm.DEPTH:
                        self.longer[node, ctx[lm.DEPTH - d :]].add(ctx[lm.DEPTH - d - 1 :])
        self.memo = {}

    def kt(self, node, ctx):
        p, seen = 0.0, [0, 0]
        for bit, n in enumerate(self.seen.get((node, ctx), (0, 0))):
            for _ in range(n):
                p += math.log((seen[bit] + 0.5) / (sum(seen) + 1))
                seen[bit] += 1
        return p

    def both(self, node, ctx):
        """Log of the own estimate, and of the product over longer contexts."""
        if (node, ctx) not in self.memo:
            self.memo[node, ctx] = self.kt(node, ctx), sum(self.pw(node, c) for c in self.longer.get((node, ctx), ()))
        return self.memo[node, ctx]

    def pw(self, node, ctx):
        own, longer = self.both(node, ctx)
        return own if len(ctx) == lm.DEPTH else math.log(0.5 * math.exp(own - max(own, longer)) + 0.5 * math.exp(longer - max(own, longer))) + max(own, longer)

    def one(self, node, ctx, d=0):
        """Probability of a one after all that was seen: Pw with it over Pw without."""
        here = ctx[lm.DEPTH - d :]
        zeros, ones = self.seen.get((node, here), (0, 0))
        estimate = (ones + 0.5) / (zeros + ones + 1)
        if d == lm.DEPTH:
            return estimate
        own, longer = self.both(node, here)
        share = 1 / (1 + math.exp(min(700, longer - own)))
        return share * estimate + (1 - share) * self.one(node, ctx, d + 1)

    def score(self, text):
        return sum(math.log10(p if bit else 1 - p) for node, bit, ctx in decisions(text) for p in [self.one(node, ctx)])


def plain(rows):
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = lambda t: [*WORDS.findall((t or "").translate(LOWER)), None]
    counts = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    tree = PlainTree([t for i, t in rows if not out(i)])
    return [(i, out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), tree.score(t)) for i, t in rows]


def check(df, **options):
    got = [tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in lm.score_texts(df, **options).collect()]
    want = plain([(r["doc_id"], r["text"]) for r in df.collect()])
    key = lambda r: (str(r[0]), r[2], -r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-4)


def test_against_the_recursion(spark):
    words = "the of and reing onth table whst ED Er é 猫 x9".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "the of"), (9, rows[9][1]), (9, rows[9][1]), (102, " \t"), (103, "\x00\x01"), (109, "zz unseen zz")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_blocks_and_rounds(spark, monkeypatch):
    """The same from many small blocks, added up in several rounds."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 50)
    monkeypatch.setattr(lm, "FAN", 3)
    rows = [(i, f"the {i % 5} of and{i % 3} table") for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_odd_rows_and_empty(spark, odd, empty):
    got = lm.score_texts(odd).collect()
    assert len(got) == odd.count() and all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in got)
    assert lm.score_texts(empty).count() == 0
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    r = lm.score_texts(df, held_out="true").first()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0) and r["bits_per_byte"] == 8


def test_long_rows_in_parts(monkeypatch):
    monkeypatch.setattr(lm.tb, "SEGMENT", 10)
    monkeypatch.setattr(lm.tb.chunks, "__defaults__", (10,))
    texts = [b"short", b"", b"a longer ROW of several parts, thrice ten", b"x" * 20, b"y" * 21]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = {}
    for i, _, keys, n in lm.grams(data, offsets):
        for r, part in enumerate(np.split(keys, np.cumsum(n)[:-1])):
            got.setdefault(i + r, []).extend(part.tolist())
    for r, text in enumerate(texts):
        padded = bytes([lm.END] * lm.DEPTH) + text.lower() + bytes([lm.END])
        assert got[r] == [int.from_bytes(padded[k - 1 - lm.DEPTH + 1 : k][::-1] + padded[k : k + 1], "big") for k in range(lm.DEPTH, len(padded))]


def test_gamma_table_meets_series():
    x = np.array([1, 2, 3, lm._SMALL - 1, lm._SMALL, lm._SMALL + 1, 10**9, 10**13])
    assert lm._lgamma(x) == pytest.approx([math.lgamma(v / 2) for v in x.tolist()], rel=1e-13)


def test_probabilities_add_up():
    """After any context the 256 bytes' probabilities sum to one, also after contexts never seen."""
    keys, counts = lm.summed(np.array([0x6162636465_61, 0x6162636465_62, 0x6162636466_61, 0x6162636465_61], np.uint64), np.array([1, 1, 1, 1]))
    for ctx in (0x6162636465, 0x6162636399, 0x6162630000):
        every = (np.uint64(ctx) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        both, n = lm.summed(np.concatenate([keys, every]), np.concatenate([counts, np.zeros(256, np.int64)]))
        bits = np.zeros(len(both))
        for bit in range(8):
            t = lm.Subtrees(both, n, bit)
            bits += t.cost(np.ones(len(t.at)), np.zeros(len(t.at)))
        assert (2 ** -bits[both >> np.uint64(8) == np.uint64(ctx)]).sum() == pytest.approx(1)


def test_held_out_texts_cost_less_than_unigrams_of_bytes(spark, documents):
    """The tree learns: held-out texts take fewer bits than with contexts of no bytes, and strangers more."""
    rows = lm.score_texts(documents).where("held_out and n_tokens > 50").collect()
    assert sum(r["bits_per_byte"] for r in rows) / len(rows) < 3.2
    mixed = documents.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2, reverse(text), text) AS text")
    worse = {r["doc_id"]: r["score"] for r in lm.score_texts(mixed).where("held_out").collect()}
    assert sum(worse[r["doc_id"]] < r["score"] for r in rows) > 0.95 * len(rows)
