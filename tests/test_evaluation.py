from __future__ import annotations

import functools

import pytest
from pyspark.sql import functions as F

from qaloom.operators import aggregate, checks, collect, cost, retrieval, verdict, worklist


def test_done_and_todo(spark):
    answers = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", "boom")], "question_id long, producer string, error string")
    assert {r["question_id"] for r in worklist.done(answers).collect()} == {1, 2}
    todo = worklist.todo(spark.range(1, 4).withColumnRenamed("id", "question_id"), spark.createDataFrame([("a",)], "producer string"), answers)
    assert [tuple(r) for r in todo.collect()] == [(3, "a")]
    assert worklist.drop_rows(answers, "a", errors_only=True).count() == 2 and worklist.drop_rows(answers).count() == 0


def test_verdicts(spark):
    good = '{"faithfulness": 5, "accuracy": "4", "completeness": 3.0, "clarity": 1, "safety_flag": %s, "reason": "r", "extra": 1}'
    cases = [
        (good % "false", True), (good % '"yes"', True), (good % '"maybe"', False), ((good % "true").replace("5", "0"), False), ((good % "true").replace("5", "6"), False),
        ((good % "true").replace("3.0", "3.5"), False), ((good % "true").replace('"reason": "r", ', ""), False), ((good % "true")[:-1], False), ("", False), (None, False),
    ]
    rows = spark.createDataFrame(cases, "v string, want boolean").select("v", "want", verdict.parse(F.col("v")).alias("p")).collect()
    assert all((r["p"] is not None) == r["want"] for r in rows), [r for r in rows if (r["p"] is not None) != r["want"]]
    tenths = spark.createDataFrame([cases[0]], "v string, want boolean").select(verdict.weighted_tenths(verdict.parse(F.col("v"))).alias("w")).first()["w"]
    assert tenths == 4 * 5 + 3 * 4 + 2 * 3 + 1


def test_routing(spark):
    results = spark.createDataFrame([("a", True, "v"), ("b", False, "v"), ("c", True, None), ("d", True, "v"), ("x", True, "v")], "custom_id string, succeeded boolean, verdict string")
    manifest = spark.createDataFrame([("a", 1, "p"), ("b", 2, "p"), ("c", 3, "p"), ("d", 4, "p")], "custom_id string, question_id long, producer string")
    scores = spark.createDataFrame([(4, "p")], "question_id long, producer string")
    got = {r["custom_id"]: r["status"] for r in worklist.route(results, manifest, scores).collect()}
    assert got == {"a": "written", "b": "failed", "c": "failed", "d": "skipped"}


def test_master_table(spark):
    scores = spark.createDataFrame([(1, "p", 5, 4, 3, 2, True, 4.0, 0.5), (2, "p", 4, 4, 4, 4, False, 4.0, 0.5), (1, "q", 1, 1, 1, 1, False, 1.0, 0.5)], "question_id long, producer string, faithfulness int, accuracy int, completeness int, clarity int, safety_flag boolean, weighted double, cost_usd double")
    answers = spark.createDataFrame([(1, "p", 2.0, 0.1, None), (2, "p", 4.0, 0.2, "bad")], "question_id long, producer string, latency_s double, cost_usd double, error string")
    who = spark.createDataFrame([("p", "rag", "m", "s", 1), ("q", "rag", "m", "s", 0), ("none", "rag", "m", "s", 2)], "producer string, method string, model string, size string, ord int")
    jobs = spark.createDataFrame([("q", 4.0)], "producer string, train_cost_usd double")
    rows = aggregate.master_table(aggregate.frames(scores, answers), who, jobs).collect()
    assert [r["producer"] for r in rows] == ["p", "q"]
    p, q = rows
    assert (p["n"], p["faithfulness"], p["safety_flag_rate"], p["mean_latency_s"], p["answer_cost_usd"]) == (2, 4.5, 0.5, 2.0, 0.1)
    assert q["mean_latency_s"] is None and q["answer_cost_usd"] == 0.0 and q["total_cost_usd"] == 4.0
    with pytest.raises(ValueError, match="repeat"):
        aggregate.frames(scores.union(scores), answers)


def test_prices(spark):
    prices = spark.createDataFrame([("base", 1.0, 2.0, 3.0)], "model string, inp double, out double, train double")
    calls = spark.createDataFrame([("base",), ("ft:base:org::id",)], "model string")
    assert sorted((r["inp"], r["out"]) for r in cost.priced(calls, prices).collect()) == [(1.0, 2.0), (2.0, 4.0)]
    with pytest.raises(ValueError, match="no price"):
        cost.priced(spark.createDataFrame([("ft:other:x",)], "model string"), prices)


def test_tiers_and_ranks(spark):
    kind = "hits array<struct<doc_id:string,section:string>>, want string"
    cases = [(None, "3. neither"), ([], "3. neither"), ([("d", "s")], "1. gold section"), ([("x", "s"), ("d", "t")], "2. right doc")]
    rows = spark.createDataFrame(cases, kind).select("want", retrieval.tier(F.col("hits"), F.lit("d"), F.lit("s")).alias("t")).collect()
    assert all(r["want"] == r["t"] for r in rows)
    got = retrieval.recall(spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id long, rank int")).first()
    assert got["recall_1"] == pytest.approx(1 / 3) and got["recall_5"] == pytest.approx(2 / 3) and got["mrr"] == pytest.approx((1 + 0.25) / 3)
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, doc_id long, rank int")
    fused = {r["doc_id"]: r["score"] for r in retrieval.fuse(a, a.where("doc_id = 2")).collect()}
    assert fused[2] == pytest.approx(2 / 62) and fused[1] == pytest.approx(1 / 61)


@pytest.mark.parametrize("tile", [3, 7, 10_000])
def test_top_k_of_tiles_equals_a_plain_scan(spark, tile):
    import random

    rng = random.Random(tile)
    vector = lambda: [rng.choice([rng.gauss(0, 1), 0.5, -0.5]) for _ in range(4)]
    corpus = [(f"c{i:03}", vector()) for i in range(90)]
    corpus += [(f"d{i}", corpus[5][1]) for i in range(9)]  # ties
    queries = [(i, vector()) for i in range(20)] + [(77, [0.0] * 4)]
    odd = [("null", None), ("hole", [1.0, None, 1.0, 1.0]), ("short", [9.0, 9.0])]
    got = retrieval.top_k(spark.createDataFrame([*queries, (88, None)], "query_id int, query array<double>"), spark.createDataFrame(corpus + odd, "chunk_id string, vector array<double>"), 4, tile).collect()
    want = []
    for q, v in queries:
        scores = sorted((-functools.reduce(lambda t, ab: t + ab[0] * ab[1], zip(v, w, strict=True), 0.0), c) for c, w in corpus)
        want += [(q, c, r, -s) for r, (s, c) in enumerate(scores[:4], 1)]
    assert sorted((r["query_id"], r["chunk_id"], r["rank"], r["score"]) for r in got) == sorted(want)


def test_top_k_without_rows(spark):
    q, c = spark.createDataFrame([(1, [1.0])], "query_id int, query array<double>"), spark.createDataFrame([(1, [1.0])], "chunk_id int, vector array<double>")
    assert retrieval.top_k(q, c.where("false")).count() == 0 and retrieval.top_k(q.where("false"), c).count() == 0


def test_top_k_breaks_ties_by_id(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in (3, 1, 2)] + [(9, [0.0, 1.0])], "chunk_id long, vector array<double>")
    got = retrieval.top_k(spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, query array<double>"), corpus, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 2]


def test_collect_makes_errors_rows(spark):
    def provider(model: str, prompt: str) -> dict:
        if model == "bad":
            raise RuntimeError("no such model")
        return {"answer": prompt.upper(), "prompt_tokens": 1, "completion_tokens": 2}

    todo = spark.createDataFrame([(1, "p", "good", "hi"), (2, "p", "bad", "hi")], "question_id long, producer string, model string, prompt string")
    got = {r["question_id"]: (r["answer"], r["error"]) for r in collect.collect(todo, provider, parallel=2).collect()}
    assert got == {1: ("HI", None), 2: (None, "RuntimeError: no such model")}


def test_retry_waits_longer():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429" if len(calls) == 2 else "timeout")
        return {"answer": "x"}

    assert collect.with_retry(call, lambda e: True, lambda e: "429" in str(e), waits.append) == {"answer": "x"}
    assert 2 <= waits[0] < 3 and waits[1] == 65.0
    with pytest.raises(ValueError, match="bug"):
        collect.with_retry(lambda: (_ for _ in ()).throw(ValueError("bug")), lambda e: False, lambda e: False, waits.append)


def test_checks(spark):
    report = spark.createDataFrame([("p", 2, 1, 1, 1)], "producer string, expected long, good long, errors long, missing long")
    with pytest.raises(ValueError, match="incomplete"):
        checks.assert_complete(report)
    checks.assert_complete(report.where("producer = 'q'"))
    with pytest.raises(ValueError, match="several"):
        checks.assert_one_judge(spark.createDataFrame([("a",), ("b",)], "judge_model string"))


def test_models_and_jobs(spark):
    who = spark.createDataFrame([("a", "prompting", "m", True, 2), ("b", "finetuned", "base", False, 1), ("c", "finetuned", "base", True, 0)], "producer string, method string, model string, is_local boolean, ord int")
    jobs = spark.createDataFrame([("b", "trained-b"), ("c", "")], "producer string, trained_model string")
    got = worklist.resolve_models(who, jobs)
    assert {r["producer"]: r["called_model"] for r in got.collect()} == {"a": "m", "b": "trained-b", "c": None}
    assert [r["producer"] for r in worklist.untrained(got).collect()] == ["c"]
    assert [r["producer"] for r in worklist.select_producers(who, local_only=True, limit=1).collect()] == ["c"]
    assert [r["producer"] for r in worklist.select_producers(who, "finetuned", ["b"]).collect()] == ["b"]
    runs = spark.createDataFrame([("j1", "s", "ok", 1), ("j2", "s", "CANCELLED", 2)], "job_id string, suffix string, status string, created_at int")
    assert worklist.latest_live_job(runs).first()["job_id"] == "j1"
    ids = spark.createDataFrame([("q-1--p00",), ("q 1--p00",), ("x" * 65,)], "custom_id string")
    assert worklist.bad_ids(ids).count() == 2


def test_token_estimates(spark):
    block = "struct<kind:string,text:string,items:array<string>,header:array<string>,rows:array<array<string>>>"
    rows = [("a head", [("para", "one two", None, None, None), ("bullets", None, ["x y", "z"], None, None)]), ("t", [("table", None, None, ["h1", "h2"], [["1", "2 3"]])])]
    sections = spark.createDataFrame(rows, f"heading string, content array<{block}>")
    assert cost.section_tokens(sections) == round((7 + 6) / 2) and cost.section_tokens(sections.where("false")) == 400
    train = spark.createDataFrame([([("user", "a b"), ("assistant", "c")],)], "messages array<struct<role:string,content:string>>")
    assert cost.train_tokens(train) == 3 and cost.train_tokens(train.where("false")) == 0


def test_gate_and_sheet(spark):
    from qaloom.operators import split

    a = spark.createDataFrame([(1, "the same five words here", "x")], "id long, q string, a string")
    with pytest.raises(ValueError, match="leak"):
        split.require_no_leaks(a, a.withColumn("id", F.lit(2).cast("long")), "id", ["q"])
    split.require_no_leaks(a, spark.createDataFrame([(3, "other", "y")], "id long, q string, a string"), "id", ["q"])
    pool = spark.createDataFrame([("d-q001", "D", "S", "Q?", "A", "E", "factual", False), ("d-q002", "D", "S", "Q?", "7", "E", "numeric", True)], "id string, doc_id string, section string, question string, answer string, evidence string, answer_type string, needs_attention boolean")
    assert [r["line"].split(" |")[0] for r in split.review_sheet(pool).orderBy("nth").collect()] == ["- [ ] d-q002 (check)", "- [ ] d-q001"]
