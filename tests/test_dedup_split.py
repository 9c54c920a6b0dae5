from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qaloom.operators import dedup, split
from qaloom.sources.durable import shared_dir


def keep(spark, edges):
    return {r["id"]: r["kept"] for r in dedup.greedy_keep(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_greedy_is_not_transitive(spark):
    assert keep(spark, [(1, 2), (2, 3)]) == {1: True, 2: False, 3: True}  # a~b~c, a and c apart
    assert keep(spark, [(1, 2), (1, 3)]) == {1: True, 2: False, 3: False}  # the middle one first


@settings(max_examples=8, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)).filter(lambda e: e[0] < e[1]), min_size=1))
def test_greedy_against_the_loop(spark, edges):
    want, ids = {}, sorted({x for e in edges for x in e})
    for i in ids:
        want[i] = not any(want[j] for j in want if (j, i) in edges)
    assert keep(spark, list(edges)) == want


def test_same_fact_needs_both_columns(spark):
    rows = [(1, "what is the cost of a", "5 coins"), (2, "what is the cost of a", "5 coins"), (3, "what is the cost of a", "six pounds"), (4, "", ""), (5, "", "")]
    df = spark.createDataFrame(rows, "id long, q string, a string")
    assert [tuple(r) for r in dedup.same_fact_pairs(df, "id", ["q", "a"]).collect()] == [(1, 2)]


def test_allocation_golden(spark):
    # (position, rows, places) of 13 strata that share 100 places; three remainders tie at one half
    rows = [(0, 38, 10), (1, 23, 6), (2, 19, 5), (3, 22, 5), (4, 24, 6), (5, 23, 6), (6, 25, 6), (7, 29, 7), (8, 31, 8), (9, 51, 13), (10, 42, 10), (11, 24, 6), (12, 49, 12)]
    got = split.largest_remainder(spark.createDataFrame(rows, "d long, n long, want long"), 100, "d", "n", "d").collect()
    assert all(r["want"] == r["quota"] for r in got) and len(got) == 13


def test_allocation_is_capped(spark):
    got = {r["d"]: r["quota"] for r in split.largest_remainder(spark.createDataFrame([(1, 1), (2, 2)], "d long, n long"), 30, "d", "n", "d").collect()}
    assert got == {1: 1, 2: 2}


def test_split_sizes_order_and_leaks(spark):
    rows = [(i, f"text number {i} of stratum {i % 3}", f"s{i % 3}", f"k{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, s string, k string")
    one = {r["id"]: r["part"] for r in split.stratified_split(df, "id", "s", "k", 10).collect()}
    two = {r["id"]: r["part"] for r in split.stratified_split(df.repartition(7), "id", "s", "k", 10).collect()}
    assert one == two and list(one.values()).count("test") == 10
    made = split.stratified_split(df.unionByName(df.withColumn("id", df.id + 100)), "id", "s", "k", 10)
    found = split.leaks(made.where("part = 'train'"), made.where("part = 'test'"), "id", ["text"])
    assert found.where("reason = 'same id'").count() == 0 and found.where("reason = 'same fact'").count() > 0


def test_working_set(spark):
    pool = spark.createDataFrame([(1, True), (2, False)], "id long, verified boolean")
    assert split.working_set(pool, 1, False).count() == 1 and split.working_set(pool, 9, True).count() == 1
    assert split.working_set(pool.where("not verified"), 9, True).count() == 1
    with pytest.raises(ValueError, match="only 1"):
        split.working_set(pool, 2, False)


def test_classes_of_copies(spark):
    """Ten thousand equal rows are one class, and all but the first go."""
    copies = spark.range(100, 10_100).selectExpr("id", "'what does a visit cost' AS q", "'five coins each' AS a")
    others = spark.createDataFrame([(1, "what does a visit cost today", "five coins each"), (2, "when is it open", "at nine"), (3, "", "x"), (4, "what does a visit cost today", "five coins each")], "id long, q string, a string")
    df = copies.unionByName(others)
    classes = dedup.token_classes(df, "id", ["q", "a"])
    assert classes.select("class").distinct().count() == 3 and classes.where("id = 3").count() == 0
    got = dedup.greedy_dedup(df, "id", ["q", "a"])
    assert sorted(r["id"] for r in got.where("kept").collect()) == [1, 2, 3] and got.count() == 10_004


def test_pairs_and_fates_against_plain_loops(spark):
    import random

    rng = random.Random(9)
    rows = [(i, " ".join(rng.sample("one two three four five six seven".split(), rng.randrange(0, 7))), " ".join(rng.sample("a b c d".split(), rng.randrange(1, 5)))) for i in range(120)]
    like = lambda x, y: 5 * len(x & y) >= 4 * len(x | y) > 0
    sets = [(i, set(q.split()), set(a.split())) for i, q, a in rows]
    pairs = [(i, j) for i, q, a in sets for j, r, b in sets if i < j and like(q, r) and like(a, b)]
    df = spark.createDataFrame(rows, "id long, q string, a string")
    assert sorted(map(tuple, dedup.same_fact_pairs(df, "id", ["q", "a"]).collect())) == pairs and len(pairs) > 10
    kept = []
    for i, q, a in sets:
        if not any(like(q, r) and like(a, b) for _, r, b in kept):
            kept.append((i, q, a))
    assert sorted(r["id"] for r in dedup.greedy_dedup(df, "id", ["q", "a"]).where("kept").collect()) == [i for i, *_ in kept]
    leaks = split.leaks(df.where("id % 2 = 0"), df.where("id % 2 = 1 OR id = 4"), "id", ["q", "a"]).collect()
    side = lambda i: {0, 1} if i == 4 else {i % 2}
    assert sorted(tuple(r) for r in leaks) == sorted([("same id", 4, 4)] + [("same fact", i, j) for i, j in pairs if side(i) != side(j) or len(side(i)) == 2])


def test_candidates_are_few(spark):
    """Eighty texts of fifteen words of their own and 85 of all: one join of shared words made 28,440 rows of them."""
    df = spark.range(80).selectExpr("id", "concat_ws(' ', transform(sequence(1, 100), k -> if(k <= 15, concat('own', id, 'w', k), concat('all', k)))) AS text")
    classes = dedup.token_classes(df.unionByName(spark.createDataFrame([(80, "own3w1 all20"), (81, "own3w1 all20 all21"), (82, "all20 own3w1 all21 all22 all23"), (83, "own3w1 all20 all21 all22")], "id long, text string")), "id", ["text"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = dedup.similar_classes(classes)
        assert sorted(map(tuple, found.collect())) == [(82, 83)]
        plan, rows = [found._jdf.queryExecution().executedPlan()], []
        while plan:
            node = plan.pop()
            plan += [node.children().apply(k) for k in range(node.children().size())]
            if "Join" in node.nodeName():
                rows.append(node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(rows) > 2 and max(rows) < 2_000


@pytest.mark.parametrize(("num", "den"), [(4, 5), (1, 2), (9, 10), (1, 1)])
def test_similar_classes_at_any_threshold(spark, num, den):
    import random

    rng = random.Random(num)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        kept = rng.sample(base[: rng.choice([2, 5, 20, 60])], k=2)
        kept = rng.choice(rows)[1].split() if rows and rng.random() < 0.7 else kept + rng.sample(base, rng.randrange(30))
        kept = [w for w in kept if rng.random() < 0.95] + (["x%d" % rng.randrange(9)] if rng.random() < 0.3 else [])
        rows.append((i, " ".join(kept)))
    sets = {i: set(t.split()) for i, t in rows}
    want = sorted((i, j) for i in sets for j in sets if i < j and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) > 0)
    got = dedup.same_fact_pairs(spark.createDataFrame(rows, "id long, text string"), "id", ["text"], num, den)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5



def test_leaks_of_an_id_with_two_texts(spark):
    """Each part's text of an id counts in that part only."""
    train = spark.createDataFrame([(4, "when is the clinic open"), (8, "when is the clinic open"), (5, "what does a visit cost")], "id long, text string")
    test = spark.createDataFrame([(4, "what does a visit cost"), (6, "no such thing")], "id long, text string")
    assert sorted(map(tuple, split.leaks(train, test, "id", ["text"]).collect())) == [("same fact", 4, 5), ("same id", 4, 4)]


def test_greedy_dedup_moves_and_keeps_little(spark):
    """Whole sets are shuffled where classes are made and once more; what is left on disk holds none."""
    from pathlib import Path

    def kept():
        return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if p.is_file())

    def shuffled():
        return sum(x.totalShuffleWrite() for x in map(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply, range(1)))

    df = spark.range(600).selectExpr("id", "concat_ws(' ', transform(sequence(1, 200), k -> concat('w', pmod(xxhash64(id, k), 5000)))) AS text").localCheckpoint()
    size = df.selectExpr("8 * sum(size(array_distinct(split(text, ' ')))) AS n").first()["n"]
    moved, had = shuffled(), kept()
    got = dedup.greedy_dedup(df, "id", ["text"])
    assert kept() - had < size / 4
    assert got.where("kept").count() == 600
    assert shuffled() - moved < 2 * size


def test_near_copies_meet_kept_ones_only(spark, monkeypatch):
    """Sixty near copies of one text are 1,770 pairs, of which whole sets need to meet in 59."""
    met, alike = [], dedup._alike
    monkeypatch.setattr(dedup, "_alike", lambda pairs, sets, *rest: met.append(pairs.count()) or alike(pairs, sets, *rest))
    df = spark.range(60).selectExpr("id", "concat_ws(' ', concat('own', id), transform(sequence(1, 100), k -> concat('all', k))) AS text")
    assert [r["id"] for r in dedup.greedy_dedup(df, "id", ["text"]).where("kept").collect()] == [0]
    assert sum(met) == 59


def test_a_chain_of_likes_keeps_every_other(spark):
    """Each text is like its neighbours and no other: more rounds than there are tables in one plan."""
    df = spark.range(50).selectExpr("id", "concat_ws(' ', transform(sequence(1, 20), k -> concat('w', 2 * id + k))) AS text")
    assert sorted(r["id"] for r in dedup.greedy_dedup(df, "id", ["text"]).where("kept").collect()) == list(range(0, 50, 2))
