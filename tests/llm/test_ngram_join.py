from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa

from qaloom.llm import ngram_join as nj
from qaloom.llm import textblocks as tb
from tests.llm.conftest import WORD

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(id, set size, component) of each row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                comp[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in nj.ngram_components(df, **kw).collect()), key=str)


def test_against_all_pairs(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert run(documents) == brute(rows)


def test_tokens_let_go_change_nothing(documents, odd):
    for df, most in ((documents, 300), (documents, 3000), (odd, 50)):
        assert run(df, held_tokens=most) == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_counts_of_a_stream():
    rnd = np.random.default_rng(3)
    cls, tokens = rnd.integers(0, 400, 6000), np.where(rnd.random(6000) < 0.3, 7, rnd.integers(10, 900, 6000)).astype(np.uint64)
    pairs = {(int(c), int(t)) for c, t in zip(cls, tokens, strict=True)}
    classes = {}
    for c, t in pairs:
        classes.setdefault(t, set()).add(c)
    counts, got, most = nj.TokenCounts(1000), [], 0
    for i in range(0, 6000, 250):
        part = slice(i, i + 250)
        got += list(counts.add(cls[part], np.full(250, 9, np.uint32), tokens[part]))
        most = max(most, counts.size)
    got.append(counts.done())
    c, _, t, f = (np.concatenate(x) for x in zip(*got, strict=True))
    freq = {}
    for x, y in zip(t.tolist(), f.tolist(), strict=True):
        assert freq.setdefault(x, y) == y  # one frequency for all entries of a token
    assert freq[7] == nj.MANY and all(y == nj.MANY or y == len(classes[x]) for x, y in freq.items())
    assert {(int(a), int(b)) for a, b in zip(c, t, strict=True)} == {(a, b) for a, b in pairs if len(classes[b]) > 1}
    assert most <= sum(len(x) for k, x in classes.items() if k != 7) + 1250  # the rare tokens' entries, and what came last


def test_odd_rows(odd):
    assert run(odd) == brute([tuple(r) for r in odd.select("doc_id", "text").collect()])


def test_empty(empty):
    assert run(empty) == []


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nj, "CHUNK_SETS", 8)
    monkeypatch.setattr(nj, "MEETING_TOKENS", 4000)
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rnd.choice((1, 2, 4, 5, 6, 7, 9))):
            words[rnd.randrange(150)] = f"m{rnd.randrange(10**9)}"
        if i % 10 == 0:
            words = words[: 90 + i // 2]
        rows.append((i, " ".join(words)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_prefixes_share_what_the_lower_choice_needs():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randrange(8, 60)
        x = rnd.sample(range(200), n)
        y = x[: rnd.randrange(n * 3 // 4, n + 1)] + rnd.sample(range(200, 300), rnd.randrange(0, max(1, n // 8)))
        both = len(set(x) & set(y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        picks = []
        for s in (x, y):
            least = (3 * len(s) + 3) // 4
            l, inside = nj.choose_matches(np.array(sorted(rnd.randrange(2, 50) for _ in s)), len(s), least)
            assert inside == len(s) - least + l
            picks.append((l, set(sorted(s)[:inside])))
        assert len(picks[0][1] & picks[1][1]) >= min(picks[0][0], picks[1][0])


def test_words_and_grams_in_pieces(monkeypatch):
    monkeypatch.setattr(tb, "SEGMENT", 16)
    texts = ["alpha beta gamma delta epsilon zeta", "", "alphabetagammadeltaepsilonzetaeta theta", "beta", "  x  ", "caf\u00e9 caf\u00e9"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    data, offsets, _ = tb.string_column(batch, "text")
    hashes, rows, starts, ends = tb.words(data, offsets, lower=False)
    got = [(r, data[s:e].tobytes().decode()) for r, s, e in zip(rows, starts, ends, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    same = {}
    for h, (_, w) in zip(hashes, got, strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


class Plain:
    """Takes the functions that a DataFrame would ship, to run them here."""

    def repartition(self, *cols):
        return self

    def sortWithinPartitions(self, *cols):
        return self

    def select(self, *_):
        return self

    groupBy = select

    def mapInArrow(self, function, schema):
        return function

    applyInPandas = mapInArrow


def test_runs_and_hot_tokens_change_nothing(monkeypatch):
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(3, 60))) for _ in range(80)]
    texts += [t + " end" for t in texts[:40]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

    def sets(run, hot):
        monkeypatch.setattr(nj, "RUN", run)
        frames = [b.to_pandas() for b in nj._blocks(Plain(), 5, 3, hot)(iter([batch]))]
        rows = pd.concat(frames).sort_values("part", kind="stable")
        shared = pd.concat([b.to_pandas() for b in nj._shared_tokens(Plain(), 2)(iter([pa.RecordBatch.from_pandas(rows, preserve_index=False)]))])
        if len(hot):
            more = [b.to_pandas() for b in nj._hot_entries(Plain(), 5, 2, hot, np.full(len(hot), 99))(iter([batch]))]
            shared = pd.concat([shared, *more])
        out = pd.concat([nj._prefixes(Plain(), (75, 100))(g) for _, g in shared.groupby("part")])
        return {c: (n, frozenset(t)) for c, n, t in zip(out["cls"], out["n"], out["tokens"], strict=True)}

    none = np.zeros(0, np.uint64)
    want = sets(0xFFFF, none)
    assert len(want) > 40 and sets(2, none) == want
    owner, tokens = nj.token_sets(*tb.string_column(batch, "text")[:2], 5)
    found, many = np.unique(tokens, return_counts=True)
    assert sets(0xFFFF, found[many >= 2][::2]) == want  # half of the shared tokens, as hot ones
