"""The retrieval corpus, collection, judging in batches, reports, sources and sinks."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from qaloom.operators import checks, cleaning, collect, corpus, derive, judging, reports, retrieval, segment, split, verdict
from qaloom.functions import text as t
from qaloom.sources import records, sinks


def test_index_keeps_its_configuration(spark, tmp_path):
    gold = spark.createDataFrame([("a", "s", "f", "one two", False)], "doc_id string, section string, source_doc string, text string, is_distractor boolean")
    far = corpus.distractors(spark.createDataFrame([(1, "x" * 1300), (2, None), (3, "short")], "doc_id long, text string"))
    whole = corpus.union(gold, far)
    made = corpus.embed(whole, lambda said: [[3.0, 4.0] if "one" in s else [0.0, 0.0] for s in said], batch=1)
    config = corpus.build_index(made, str(tmp_path / "index"), "m", 3, "{context}")
    assert (config["chunks_total"], config["chunks_gold"], config["chunks_distractor"], config["dim"]) == (2, 1, 1, 2)
    held, again = corpus.load_index(spark, str(tmp_path / "index"))
    assert again == config and sorted([round(x, 3) for x in r["embedding"]] for r in held.collect()) == [[0.0, 0.0], [0.6, 0.8]]
    corpus.union(gold, far.limit(0)).withColumn("embedding", F.array(F.lit(1.0).cast("float"))).write.mode("overwrite").parquet(str(tmp_path / "index" / "vectors"))
    with pytest.raises(ValueError, match="doesn't hold"):
        corpus.load_index(spark, str(tmp_path / "index"))
    none = corpus.embed(whole.limit(0), lambda said: [])
    assert none.count() == 0 and none.columns[-1] == "embedding"


def test_normalised_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<double>, z array<double>").select(retrieval.normalised(F.col("v")).alias("v"), retrieval.normalised(F.col("z")).alias("z")).first()
    assert row["v"] == pytest.approx([0.6, 0.8]) and row["z"] == [0.0, 0.0]


def test_row_chunks(spark):
    docs = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |")], "k long, body string")
    got = corpus.row_chunks(segment.blocks_of(docs, "k"), "k").orderBy("nth").collect()
    assert [r["body"] for r in got] == ["a: 1; b: 2", "a: 3; b: 4"]


def test_recall_and_reciprocal_rank(spark):
    ranks = spark.createDataFrame([("a", 1), ("a", 4), ("b", None)], "gold string, rank int")
    got = {r["gold"]: r for r in retrieval.recall(ranks, (1, 5), ("gold",)).collect()}
    assert (got["a"]["recall_1"], got["a"]["recall_5"], got["a"]["mrr"], got["a"]["queries"]) == (0.5, 1.0, 0.625, 2) and got["b"]["mrr"] == 0.0


QUESTIONS = "question_id long, prompt string"


def test_a_run_resumes_and_asks_errors_again(spark, tmp_path):
    path = str(tmp_path / "log")
    questions = spark.createDataFrame([(k, f"q{k}" if k else "") for k in range(6)], QUESTIONS)
    first = collect.run_producer(spark, "p", "m", questions.where("question_id < 3"), path, collect.echo(""))
    assert first == 3 and collect.run_producer(spark, "p", "m", questions, path, collect.echo(""), at_once=2) == 4
    rows = spark.read.parquet(path).collect()
    assert sorted((r["question_id"], r["answer"]) for r in rows) == [(0, None), *[(k, f"said: q{k}") for k in range(1, 6)]]
    assert all(r["latency_s"] >= 0 and r["ts"] is not None and (r["error"] is None) == (r["question_id"] > 0) for r in rows)
    fixed = spark.createDataFrame([(0, "q0")], QUESTIONS)
    assert collect.run_producer(spark, "p", "m", fixed, path, collect.echo("")) == 1 and spark.read.parquet(path).where("error is not null").isEmpty()
    with pytest.raises(ValueError, match="another model"):
        collect.run_producer(spark, "p", "other", questions, path, collect.echo(""))


def test_reset_asks_first(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "question_id long, producer string, model string, error string"
    rows = [(1, "it's", "m", None), (2, "it's", "m", "bad"), (3, "b", "m", "bad"), (4, "b", "m", "")]
    spark.createDataFrame(rows, schema).write.parquet(path)
    said = []
    assert collect.reset(spark, path, schema, ["it's", "b"], "it's", confirm=lambda what: said.append(what)) == 0 and said == ["2 rows of it's, by m"]
    assert collect.reset(spark, path, schema, ["it's", "b"], "it's", errors=True, confirm=lambda what: True) == 1
    assert collect.reset(spark, path, schema, ["it's", "b"], errors=True, confirm=lambda what: True) == 1
    assert sorted(r["question_id"] for r in spark.read.parquet(path).collect()) == [1, 4]
    for bad in ({}, {"producer": "nobody"}):
        with pytest.raises(ValueError):
            collect.reset(spark, path, schema, ["b"], **bad)


def test_clients_and_ping():
    made = []
    clients = collect.Clients({"echo": lambda key: made.append(key) or collect.echo(key), "closed": collect.echo}, {"echo": "k"})
    assert clients.get("echo") is clients.get("echo") and made == ["k"]
    got = collect.ping(clients, [("a", "echo", "m"), ("b", "closed", "m"), ("c", "none", "m")])
    assert got[0] == ("a", "ok") and got[1][1].startswith("PermissionError") and got[2][1].startswith("KeyError")


def test_transient_errors(spark):
    rows = spark.createDataFrame([("HTTP 429",), ("connection reset",), ("bad request",), (None,)], "e string").select(collect.is_transient(F.col("e")).alias("x")).collect()
    assert [r["x"] for r in rows] == [True, True, False, False]


class Service:
    def __init__(self):
        self.done = False

    def create(self, requests):
        self.sent = requests.collect()
        return "b1"

    def ended(self, batch_id):
        return self.done

    def results(self, batch_id):
        spark = self.spark
        return spark.createDataFrame([(r["custom_id"], True, "{}") for r in reversed(self.sent)] + [("unknown", True, "{}")], "custom_id string, succeeded boolean, verdict string")


WORK = "custom_id string, question_id long, producer string, prompt string"


def test_a_batch_is_submitted_polled_and_collected(spark, tmp_path):
    service, path = Service(), str(tmp_path / "batch")
    service.spark = spark
    scores = spark.createDataFrame([(2, "p")], "question_id long, producer string")
    assert judging.state(spark, path) is None
    with pytest.raises(ValueError, match="no batch"):
        judging.collect(spark, service, path, scores)
    work = spark.createDataFrame([(f"q{k}--p00", k, "p", "x") for k in (1, 2)], WORK)
    assert judging.submit(work, service, path, "j") == "b1" and judging.state(spark, path) == {"batch_id": "b1", "judge_model": "j", "thinking": False, "submitted": 2}
    assert judging.collect(spark, service, path, scores) is None
    service.done = True
    got = {r["custom_id"]: (r["status"], r["judge_model"]) for r in judging.collect(spark, service, path, scores).collect()}
    assert got == {"q1--p00": ("written", "j"), "q2--p00": ("skipped", "j")}
    assert judging.submit(work.limit(0), service, str(tmp_path / "none"), "j") is None
    with pytest.raises(ValueError, match="refuse"):
        judging.submit(work.withColumn("custom_id", F.lit("a b")), service, str(tmp_path / "bad"), "j")


def test_a_manifest_survives_a_service_that_fails(spark, tmp_path):
    class Broken(Service):
        def create(self, requests):
            raise OSError("gone")

    work = spark.createDataFrame([("q1--p00", 1, "p", "x")], WORK)
    with pytest.raises(OSError):
        judging.submit(work, Broken(), str(tmp_path / "b"), "j")
    assert spark.read.parquet(str(tmp_path / "b" / "requests")).count() == 1 and judging.state(spark, str(tmp_path / "b")) is None


def test_status_next_step_and_violations(spark):
    who = spark.createDataFrame([("a",), ("b",)], "producer string")
    questions = spark.createDataFrame([(1,), (2,)], "question_id long")
    answers = spark.createDataFrame([(1, "a", None), (2, "a", "bad")], "question_id long, producer string, error string")
    schema = "question_id long, producer string, judge_model string, cost_usd double"
    full = [(q, p, "j", 0.5) for q in (1, 2) for p in "ab"]
    scores = lambda rows: spark.createDataFrame(rows, schema)
    steps = [judging.next_step(judging.judge_status(who, answers, scores(rows), 2), m) for rows, m in (([], False), (full[:3], False), (full, False), (full, True))]
    assert steps == ["estimate", "collect", "aggregate", "report"]
    assert {r["producer"]: (r["answered"], r["scored"], r["state"]) for r in judging.judge_status(who, answers, scores(full[:3]), 2).collect()} == {"a": (1, 2, "judged"), "b": (0, 1, "partial"), None: (1, 3, "partial")}
    judging.assert_complete(questions, who, scores(full))
    bad = scores([*full[:3], (9, "c", "k", None)])
    assert sorted(map(str, map(tuple, judging.violations(questions, who, bad).collect()))) == sorted(map(str, [("judges", None, 2), ("count", "b", 1), ("missing", "b", 1), ("unknown", "c", 1)]))
    with pytest.raises(ValueError, match="judges"):
        judging.assert_complete(questions, who, bad)
    assert [tuple(r) for r in judging.judges_used(bad).orderBy("judge_model").collect()] == [("j", 3, 1.5), ("k", 1, 0.0)]


def test_score_records(spark):
    said = json.dumps({"faithfulness": 5, "accuracy": "4", "completeness": 3.0, "clarity": 2, "safety_flag": "true", "reason": "r"})
    content = spark.createDataFrame([([("thinking", "t"), ("text", said)], 1, "p", "written", 2.0), ([], 2, "p", "failed", 2.0)], "content array<struct<type:string,text:string>>, question_id long, producer string, status string, token_cost double")
    routed = content.withColumn("verdict", verdict.text_block(F.col("content")))
    assert routed.where("question_id = 2").first()["verdict"] is None
    got = verdict.score_records(routed, spark.createDataFrame([("p", "rag")], "producer string, method string")).collect()
    assert [(r["question_id"], r["method"], r["accuracy"], r["safety_flag"], r["weighted"], r["cost_usd"]) for r in got] == [(1, "rag", 4, True, 4.0, 1.0)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 10, None), ("a", 5, 1.5)], "name string, n long, cost double")
    assert reports.show(df, ["name", "n", "cost"], ["name"], "Title").split("\n") == ["Title", "name   n    cost", "-" * 16, "a      5  1.5000", "b     10       -"]
    assert [r["line"] for r in reports.text_table(df.limit(0), ["name"], ["name"]).collect()] == ["name"]
    rows = spark.createDataFrame([("a", 1, 2, 3, 0.5, 0.0), ("b", 1, 2, 3, 1.5, 4.0)], "producer string, calls long, in_tokens long, out_tokens long, infer_usd double, train_usd double")
    total = reports.estimate_totals(rows, verified=True).where("producer is null").first()
    assert (total["calls"], total["total_usd"], total["note"]) == (2, 6.0, None) and reports.estimate_totals(rows, False).first()["note"] == reports.UNVERIFIED
    sinks.write_jsonl(spark.createDataFrame([(1,)], "x long").coalesce(1), str(tmp_path / "train"))
    parts = spark.createDataFrame([("d", "test"), ("d", "train"), ("e", "train")], "doc_id string, part string")
    text = reports.manifest(spark, parts, ["doc_id"], {"train": str(tmp_path / "train")}, 42, 3, preview=True)
    file = next((tmp_path / "train").glob("*.json"))
    assert hashlib.sha256(file.read_bytes()).hexdigest() in text and "- Train: 2, test: 1" in text and "| e | 0 | 1 |" in text and "PREVIEW" in text and "dropped: 3" in text
    pool = spark.createDataFrame([("d", True), ("d", False)], "doc_id string, needs_attention boolean")
    assert {tuple(r) for r in reports.pool_counts(pool).collect()} == {("d", 2, 1), (None, 2, 1)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps({"p1": {"trained_model": "t", "epochs": 3}, "p2": {"train_seconds": 1.5}}))
    got = {r["producer"]: r for r in records.read_jobs(spark, str(tmp_path / "jobs.json")).collect()}
    assert got["p1"]["trained_model"] == "t" and got["p1"]["epochs"] == 3 and got["p2"]["train_seconds"] == 1.5 and records.read_jobs(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("# A\n\ntext")
    assert [(r["clean_path"].endswith("a.md"), r["text"]) for r in records.read_markdown(spark, str(tmp_path / "md")).collect()] == [(True, "# A\n\ntext")]
    train = split.chat_messages(spark.createDataFrame([("q", "a", 1)], "question string, answer string, id int"), "question", "answer", "s")
    sinks.messages_only(train, str(tmp_path / "messages"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "messages").glob("*.json"))) == {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    sinks.write_report(spark.createDataFrame([("x", 1.5)], "a string, b double"), str(tmp_path / "report"))
    assert "".join(f.read_text() for f in (tmp_path / "report").glob("*.csv")).split() == ["a,b", "x,1.5"]


def test_files_to_spans_and_whole_texts(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"hello|world")
    (tmp_path / "other.pdf").write_bytes(b"x")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    span = {"line": 0, "span": 0, "size": 9.0, "font": "f", "flags": 0, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}
    decoder = lambda raw: [{**span, "page": k, "text": x.decode()} for k, x in enumerate(raw.split(b"|"))]
    spans = cleaning.decode_pdfs(files, decoder, spark.createDataFrame([("one.pdf", "one")], "file_name string, slug string"))
    assert [(r["slug"], r["page"], r["text"]) for r in spans.orderBy("page").collect()] == [("one", 0, "hello"), ("one", 1, "world")]
    assert [tuple(r) for r in cleaning.whole_texts(spans.select("doc", "page", "text")).collect()] == [("one.pdf", "hello\nworld")]


def test_banner_of_a_running_footer(spark):
    lines = spark.createDataFrame([("x EXAMPLE HOUSE · CITY",), ("x Example House · City",), ("EXAMPLE HOUSE",)], "l string")
    assert [r["f"] for r in lines.select(t.is_footer(F.col("l"), banner="EXAMPLE HOUSE").alias("f")).collect()] == [True, False, False]


def test_review_order(spark):
    pool = spark.createDataFrame([("d", "2", False), ("d", "1", False), ("d", "3", True), ("c", "9", False)], "doc_id string, id string, needs_attention boolean")
    assert [r["id"] for r in derive.review_order(pool).collect()] == ["9", "3", "1", "2"]


def test_split_tops_up_and_trims(spark):
    rows = [(k, "big" if k < 90 else f"s{k}", "abc"[k % 3]) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, of string, kind string")
    for k in (0, 7, 60, 100):
        got = split.stratified_split(df, "id", "of", "kind", k)
        assert got.where("part = 'test'").count() == k and got.count() == 100 and got.columns == ["id", "of", "kind", "part"]
    checks.require_empty(split.leaks(got.where("part = 'train'"), got.where("part = 'test'"), "id", ["kind"]).where("reason = 'same id'"), "leak")


def test_vectors_keep_what_floats_would_round(spark, tmp_path):
    """Components that a float lifts over a half, or lowers under it."""
    import duckdb

    from qaloom.plans import lifecycle

    counts = [(47, 47, 17, 37, 18), (62, 75, 57, 48, 87), (72, 20, 85, 86, 94), (53, 43, 43, 50, 98)]
    spark.createDataFrame([(k, "".join(v * n for v, n in zip("aeiou", c, strict=True))) for k, c in enumerate(counts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(c.execute(lifecycle.R.sql["chunk_vectors"]).fetchall())
    assert sorted(map(tuple, lifecycle.chunk_vectors(spark, str(tmp_path)).collect())) == want and len(want) > 2
