from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaloom.llm import mixing, packing, queries, sharding
from qaloom.llm.ranks import running
from qaloom.sources.durable import Tables
from tests.llm.conftest import DIR, WORD


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=30))
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    goal = mixing.targets(sizes, weights)
    assert sum(goal) == sum(sizes) and all(0 <= g <= 3 * s for g, s in zip(goal, sizes, strict=True))
    free = [g / w for g, w, s in zip(goal, weights, sizes, strict=True) if g < 3 * s]
    assert len(set(free)) <= 1  # those below their limit share by weight
    assert all(3 * s / w <= free[0] for g, w, s in zip(goal, weights, sizes, strict=True) if free and g == 3 * s)


@given(st.lists(st.integers(0, 500), max_size=8), st.integers(1, 9))
def test_tree_is_exact(quotas, shards):
    got = mixing.split_tree(quotas, shards, 3)
    assert [sum(g[s] for g in got) for s in range(len(quotas))] == quotas
    sizes = [sum(g) for g in got]
    assert max(sizes) - min(sizes) <= 1 and got == mixing.split_tree(quotas, shards, 3)


def check_mix(df):
    rows = df.select("doc_id", "text", "source").collect()
    got = mixing.mix_sources(df, carry=["source"]).collect()
    count = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r["doc_id"], r["source"], count(r["text"])) for r in rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = (r["target"], r["source_size"])
        assert r["taken"] <= 3 * r["size"] and sum(s["words"] for s in r["segments"]) == r["taken"]
        pieces = sorted((s["epoch"], s["first"], s["words"]) for s in r["segments"])
        for a, b in zip(pieces, pieces[1:], strict=False):
            assert a[0] < b[0] or a[1] + a[2] == b[1]
        assert all(s["first"] + s["words"] <= r["size"] and s["words"] > 0 for s in r["segments"])
    order = sorted(target, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))])
    for s, w in zip(order, want, strict=True):
        assert target[s] == (float(w), size[s]) and abs(taken[s] - w) <= 1
    return got


def test_mix(documents, odd, empty):
    got = check_mix(documents)
    again = mixing.mix_sources(documents.repartition(7), carry=["source"]).collect()
    key = lambda rs: sorted((r["doc_id"], r["taken"], str(r["segments"])) for r in rs)
    assert key(got) == key(again)
    check_mix(odd)
    check_mix(empty)


def test_blocks_belong_to_one_shard_each(documents):
    got = mixing.mix_sources(documents, carry=["source"]).collect()
    shard, words = {}, Counter()
    for r in got:
        for s in r["segments"]:
            assert shard.setdefault((r["source"], s["block"]), s["shard"]) == s["shard"]
            words[r["source"], s["block"]] += s["words"]
    assert max(words.values()) <= mixing.BLOCK_WORDS
    assert max(Counter(shard.values()).values()) - min(Counter(shard.values()).values()) <= 1


def plain_permutation(at, n, *key):
    """The keyed permutation in plain Python; its hash is Spark's, value upon value."""
    side = math.isqrt(n)
    width = n // side

    def number(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    def grid(x, salt):
        r, c = divmod(x, width)
        for k in range(4):
            r, c = ((r + number(*key, 4 * salt + k, c) % side) % side, c) if k % 2 == 0 else (r, (c + number(*key, 4 * salt + k, r) % width) % width)
        return r * width + c

    held = side * width
    for salt, lo in ((0, 0), (1, n - held), (2, 0)):
        at = lo + grid(at - lo, salt) if lo <= at < lo + held else at
    return at


def test_permutations_are_keyed_bijections(spark):
    sizes = [1, 2, 3, 5, 7, 12, 48, 99, 1000]
    df = spark.createDataFrame([(n, j) for n in sizes for j in range(n)], "n long, j long")
    keyed = lambda seed: mixing.permuted(F.col("j"), F.col("n"), F.lit(seed).cast("long"), F.lit(3).cast("long"))
    got = defaultdict(lambda: ([], []))
    for r in df.select("n", "j", keyed(7).alias("a"), keyed(8).alias("b")).orderBy("n", "j").collect():
        assert r["a"] == plain_permutation(r["j"], r["n"], 7, 3)
        got[r["n"]][0].append(r["a"])
        got[r["n"]][1].append(r["b"])
    assert all(sorted(a) == sorted(b) == list(range(n)) for n, (a, b) in got.items())
    a, b = got[1000]
    assert sum(x == y for x, y in zip(a, b, strict=True)) < 20  # another seed, another order
    assert len({(y - x) % 1000 for x, y in zip(a, a[1:], strict=False)}) > 300  # neighbours don't stay at one distance


@pytest.mark.parametrize(("good", "bad", "sample"), [(40, 60, 30), (60, 40, 80), (12, 400, 200), (300, 500, 100), (7, 30, 9)])
def test_wide_draws_follow_the_law(good, bad, sample):
    """Chi-square against the exact probabilities."""
    rng, n = np.random.default_rng(5), 3000
    got = Counter(mixing.draw_wide(rng, good, bad, sample) for _ in range(n))
    law = {k: math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample) for k in range(max(0, sample - bad), min(good, sample) + 1)}
    cells = [(got[k], n * p) for k, p in law.items() if n * p >= 5]
    rest = (n - sum(o for o, _ in cells), n - sum(e for _, e in cells))
    chi = sum((o - e) ** 2 / e for o, e in [*cells, *([rest] if rest[1] > 1 else [])])
    assert sum(got.values()) == n and chi < len(cells) + 4 * math.sqrt(2 * len(cells)) + 4


def test_trees_of_wide_draws_follow_the_law(monkeypatch):
    """Small quotas through the wide draws: each shard's mean and spread are those of numpy's draws."""
    quotas, n = [30, 50, 20], 400
    exact = np.array([mixing.split_tree(quotas, 4, s) for s in range(n)])
    monkeypatch.setattr(mixing, "MOST_DRAWN", 5)
    wide = np.array([mixing.split_tree(quotas, 4, s) for s in range(n)])
    assert np.abs(exact.mean(0) - wide.mean(0)).max() < 0.7 and np.abs(exact.std(0) - wide.std(0)).max() < 0.4


def test_query_holds_the_trees_result(spark, documents):
    """From the query's rows alone: exact quotas of blocks, each in the one shard that a plain tree and permutation give it."""
    rows = queries.op7_source_mixing(spark, DIR).collect()
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    blocks, words, want, places = {}, Counter(), {}, defaultdict(list)
    for r in rows:
        pieces = [list(map(int, x.split(":"))) for x in r["segments"].split(",") if x]
        assert sum(p[2] for p in pieces) == r["taken"]
        want[source[r["doc_id"]]] = math.floor(Fraction(r["target"]) + Fraction(1, 2))
        for _, _, n, block, shard, place in pieces:
            assert blocks.setdefault((source[r["doc_id"]], block), shard) == shard
            words[source[r["doc_id"]], block] += n
            places[shard].append(place)
    order = sorted(want, key=lambda s: (s is None, s or ""))
    quotas = [-(-want[s] // mixing.BLOCK_WORDS) for s in order]
    got = [[sum(1 for (s, _), at in blocks.items() if s == src and at == k) for src in order] for k in range(8)]
    assert got == mixing.split_tree(quotas, 8, 7)
    for s, q in zip(order, quotas, strict=True):
        ends = np.cumsum([g[order.index(s)] for g in got])
        assert all(words[s, b] == min(mixing.BLOCK_WORDS, want[s] - b * mixing.BLOCK_WORDS) for b in range(q))
        nth = order.index(s)
        assert all(blocks[s, b] == int(np.searchsorted(ends, plain_permutation(b, q, 7, nth), "right")) for b in range(q))
    assert all(len(set(p)) > 0.9 * len(p) for p in places.values())


def test_draws_beyond_numpys_limit():
    rng = np.random.default_rng(1)
    for good, bad, sample in ((10**10, 3 * 10**10, 2 * 10**10), (5, 4 * 10**9, 10**9), (2 * 10**9, 0, 7), (10**10, 1, 10**10)):
        got = [mixing.draw(rng, good, bad, sample) for _ in range(50)]
        assert all(max(0, sample - bad) <= g <= min(good, sample) for g in got) and abs(sum(got) / 50 - sample * good / (good + bad)) <= 1 + 1e-4 * sample
    quotas = [3 * 10**9, 10**10, 7]
    tree = mixing.split_tree(quotas, 8, 1)
    assert [sum(g[s] for g in tree) for s in range(3)] == quotas and max(map(sum, tree)) - min(map(sum, tree)) <= 1


def test_running_sums(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("abc") if rnd.random() < 0.9 else None, i, rnd.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for rows_said in (400, 4096 * 5):  # one bucket, and five
        got = running(df, ["k"], ["i"], rows_said, "v").collect()
        groups = defaultdict(list)
        for r in got:
            groups[r["k"]].append((r["before"], r["v"]))
        for g in groups.values():
            ends = sorted((b, b + v) for b, v in g)
            assert ends[0][0] == 0 and all(x[1] == y[0] for x, y in zip(ends, ends[1:], strict=False))


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40)))
def test_plan_gives_each_piece_one_slot(counts):
    plan = packing.plan_slots(counts, 64)
    slots = defaultdict(list)
    for length, rank, many, first, offset in plan.tolist():
        for k in range(many):
            slots[first + k].append((offset, length))
    assert Counter(n for s in slots.values() for _, n in s) == Counter(counts)
    for s in slots.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 64
    rooms = []  # best fit, longest first, piece by piece
    for n in sorted(Counter(counts).elements(), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 64) - n)
    assert len(slots) == len(rooms)


def check_pack(df):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r["doc_id"], p, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    got = packing.pack(df).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 2048
    return len(seqs), sum(r["length"] for r in got)


def test_packing(documents, odd, empty):
    n, total = check_pack(documents)
    assert n <= -(-total // 2048) + 1
    check_pack(odd)
    assert check_pack(empty) == (0, 0)


def test_packed_ids_come_back(documents):
    rows = packing.pack(documents, keep_ids=True).where("doc_id = 3").orderBy("piece").collect()
    ids = b"".join(r["ids"] for r in rows)
    assert zlib.crc32(bytes(rows[0]["ids"])) == rows[0]["ids_crc32"] and ids[-4:] == b"\0\0\0\0"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé\u0301\u0130'.,!1 \n\u00a0<|>\u1e97H\u0331", max_size=30), max_size=6))
def test_word_ids_are_text_ids(texts):
    import numpy as np
    import pyarrow as pa

    from qaloom.llm import textblocks as tb

    own = packing._tokenizer(packing.tokenizer_path())
    data, offsets, _ = tb.string_column(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"]), "t")
    out, cuts = own.rows(data, offsets) if texts else (np.zeros(0), [0])
    for k, text in enumerate(texts):
        assert out[cuts[k] : cuts[k + 1]].tolist() == [*own.model.encode(text, add_special_tokens=False).ids, 0], text


def check_shards(df, shards=8):
    rows = df.select("doc_id", "text").collect()
    got = sharding.shard_documents(df, shards=shards).collect()
    octets = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len(octets(r["text"])) + 1, zlib.crc32(octets(r["text"]))) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return got


def test_sharding(documents, odd, empty, texts):
    got = check_shards(documents)
    where = defaultdict(set)
    for r in got:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    check_shards(odd)
    check_shards(empty)


def test_a_hot_text_fills_whole_shards(spark):
    rows = [(i, "hot" if i % 2 == 0 else f"t{i}") for i in range(400)]
    got = check_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8)
    held = Counter(r["shard"] for r in got if r["doc_id"] % 2 == 0)
    assert len(held) == 4 and all(n == 50 for n in held.values())


def test_links_pull_documents_together(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(64)], "doc_id long, text string")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 16, 2)], "src long, dst long")
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, shards=4, links=links).collect()}
    assert sum(got[i] != got[i + 1] for i in range(0, 16, 2)) <= 1


def plain_propagation(rows, edges, caps, rounds):
    """The rounds of balanced label propagation in plain Python: {(text, shard): count}."""
    n = len(caps)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    spread = lambda lead, k: sign(xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack("<q", lead), 42)))
    labels, at = Counter(), 0
    for g in sorted(rows):
        for p in range(at, at + rows[g]):
            labels[g, p % n] += 1
        at += rows[g]
    near = defaultdict(dict)
    for (g, h), w in edges.items():
        near[g][h] = w
    still = 0
    for turn in range(rounds):
        held = Counter()
        for (_, k), c in labels.items():
            held[k] += c
        free = [caps[k] - held[k] for k in range(n)]
        to = {}
        for g in rows:
            votes = Counter({k: labels[g, k] for k in range(n) if labels[g, k]})
            for h, w in near[g].items():
                for k in range(n):
                    if labels[h, k]:
                        votes[k] += w * labels[h, k]
            lead = min([g, *near[g]])
            rank = {k: (v, spread(lead, k), k) for k, v in votes.items()}
            best = max((r for k, r in rank.items() if free[k] > 0 or turn % 2 == 0), default=None)
            for k in range(n):
                if labels[g, k]:
                    to[g, k] = best[2] if best and best > rank[k] else k
        demand = [[0] * n for _ in range(n)]
        for (g, k), j in to.items():
            demand[k][j] += labels[g, k] if j != k else 0
        allow = sharding.quotas(demand, free)
        moved = sum(map(sum, allow))
        if moved:
            after = Counter()
            for g, k in sorted(to):
                j, c = to[g, k], labels[g, k]
                go = min(c, allow[k][j]) if j != k else 0
                if j != k:
                    allow[k][j] -= go
                after[g, j] += go
                after[g, k] += c - go
            labels = after
        still = 0 if moved else still + 1
        if still == 2:
            break
    return {x: c for x, c in labels.items() if c}


def test_propagation_against_plain_rounds(spark):
    rnd = random.Random(8)
    for _ in range(3):
        rows = {rnd.randrange(-(2**62), 2**62): rnd.randrange(1, 6) for _ in range(40)}
        ids = list(rows)
        edges = {}
        for _ in range(50):
            g, h = rnd.sample(ids, 2)
            edges[g, h] = edges[h, g] = rnd.randrange(1, 3)
        total = sum(rows.values()) + 37  # others, that no link tells apart
        caps = sharding.capacities(total, 4)
        linked = spark.createDataFrame(list(rows.items()), "g long, rows long")
        edge_rows = spark.createDataFrame([(g, h, w) for (g, h), w in edges.items()], "g long, h long, weight long")
        got = sharding.propagate(linked, edge_rows, caps, 4, Tables(spark)).collect()
        assert {(r["g"], r["shard"]): r["cnt"] for r in got} == plain_propagation(rows, edges, caps, 4)


def test_cut_edges_of_the_query(spark, documents, texts):
    """Equal texts, and texts of one longest sentence, over the whole table: counted plainly, and few are cut."""
    got = queries.op2_balanced_sharding(spark, DIR)
    shard = {r["doc_id"]: r["shard"] for r in got.collect()}
    links, cut = sharding.cut_edges(got, documents)
    first, want = {}, [0, 0]
    for i in sorted(texts):
        t = texts[i] or ""
        if t in first:
            want[0] += 1
            want[1] += shard[i] != shard[first[t]]
        first.setdefault(t, i)
    like = defaultdict(list)
    for t, i in first.items():
        parts = [(len(x), x.strip(" ")) for x in re.split(r"[.!?\n]+", t)]
        size = max(n for n, _ in parts)
        if size >= sharding.SENTENCE_CHARS and sum(n == size for n, _ in parts) == 1:
            like[max(parts)[1]].append(i)
    near = sum(len(x) - 1 for x in like.values())
    assert links >= want[0] + near * 0.9 and links <= want[0] + near * 1.1 + 3 and cut >= want[1] and cut <= 0.1 * links
    rnd = random.Random(0)
    dealt = spark.createDataFrame([(i, rnd.randrange(8)) for i in shard], "doc_id long, shard int")
    assert sharding.cut_edges(dealt, documents)[1] > 3 * cut


def test_quotas_keep_capacities():
    demand = [[0, 5, 3], [2, 0, 0], [9, 1, 0]]
    free = [1, 4, 0]
    q = sharding.quotas(demand, free)
    assert all(q[i][j] <= demand[i][j] for i in range(3) for j in range(3) if i != j)
    for j in range(3):
        assert sum(q[i][j] for i in range(3)) - sum(q[j]) <= free[j]
