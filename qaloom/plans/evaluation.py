"""Queries over answers and scores: master table, cuts, status, work-lists, checks, costs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators import aggregate, checks, cost, verdict, worklist
from qaloom.plans import views
from qaloom.plans.registry import Registry
from qaloom.sources.durable import shared_dir
from qaloom.sources.snapshots import SnapshotTable
from qaloom.sources.tables import table

R = Registry()
WITH = f"WITH {views.ANSWERS_SQL.strip()}, {views.SCORES_SQL.strip()}, {views.PRODUCERS_SQL.strip()}"
JOINED = """,
joined AS (SELECT s.*, a.latency_s, a.cost_usd AS answer_cost_usd FROM scores s LEFT JOIN (SELECT * FROM answers WHERE error IS NULL) a USING (question_id, producer))"""
MASTER = (
    JOINED
    + """,
master AS (
  SELECT p.producer, p.method, p.model, p.size, count(*) AS n, avg(faithfulness) AS faithfulness, avg(accuracy) AS accuracy, avg(completeness) AS completeness, avg(clarity) AS clarity,
    avg(weighted) AS weighted, avg(CAST(safety_flag AS INT)) AS safety_flag_rate, avg(latency_s) AS mean_latency_s,
    coalesce(sum(answer_cost_usd), 0.0) AS answer_cost_usd, coalesce(sum(j.cost_usd), 0.0) AS judge_cost_usd,
    CASE WHEN p.method = 'finetuned' THEN 4.0 ELSE 0.0 END::DOUBLE AS train_cost_usd
  FROM joined j JOIN producers p USING (producer) GROUP BY p.producer, p.method, p.model, p.size)"""
)


def _table_of(spark: SparkSession, rows: DataFrame) -> SnapshotTable:
    held = SnapshotTable(spark, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    held.create(rows.schema)
    held.append(rows)
    return held


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.frames(views.scores(spark, d), views.answers(spark, d))


def _master(spark: SparkSession, d: str) -> DataFrame:
    who = views.producers(spark)
    jobs = who.where("method = 'finetuned'").select("producer", F.lit(4.0).alias("train_cost_usd"))
    return aggregate.master_table(_joined(spark, d), who, jobs, exact=True)


@R.query(WITH + MASTER + " SELECT *, answer_cost_usd + train_cost_usd AS total_cost_usd FROM master")
def master_table(spark: SparkSession, d: str) -> DataFrame:
    return _master(spark, d)


@R.query(
    WITH + MASTER + """ SELECT base, treated, t.weighted - b.weighted AS weighted_lift, t.faithfulness - b.faithfulness AS faithfulness_lift
  FROM (VALUES ('p0', 'p2'), ('p3', 'p5'), ('p6', 'nobody')) v(base, treated) JOIN master b ON b.producer = base JOIN master t ON t.producer = treated"""
)
def ab_lift(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.sql("SELECT * FROM VALUES ('p0', 'p2'), ('p3', 'p5'), ('p6', 'nobody') AS v(base, treated)")
    return aggregate.lift(_master(spark, d), pairs)


@R.query(WITH + MASTER + " SELECT leg, label, producer, n, weighted, faithfulness FROM master JOIN (VALUES (1, 'prompting', 'p0'), (2, 'fine-tuned', 'p1'), (3, 'retrieval', 'p2')) v(leg, label, producer) USING (producer)")
def triad(spark: SparkSession, d: str) -> DataFrame:
    legs = spark.sql("SELECT * FROM VALUES (1, 'prompting', 'p0'), (2, 'fine-tuned', 'p1'), (3, 'retrieval', 'p2') AS v(leg, label, producer)")
    return aggregate.members(_master(spark, d), legs).select("leg", "label", "producer", "n", "weighted", "faithfulness")


@R.query(WITH + MASTER + " SELECT CASE size WHEN 'small' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS leg, size, producer, weighted FROM master WHERE method = 'finetuned'")
def ladder(spark: SparkSession, d: str) -> DataFrame:
    steps = F.when(F.col("size") == "small", 1).when(F.col("size") == "medium", 2).otherwise(3)
    group = views.producers(spark).where("method = 'finetuned'").select("producer", steps.alias("leg"))
    return aggregate.members(_master(spark, d), group).select("leg", "size", "producer", "weighted")


@R.query(WITH + JOINED + ", tiered AS (SELECT *, CASE WHEN latency_s IS NULL THEN '3. neither' WHEN latency_s % 2 = 0 THEN '1. gold section' ELSE '2. right doc' END AS tier FROM joined) SELECT producer, tier, count(*) AS n, avg(faithfulness) AS faithfulness, avg(accuracy) AS accuracy, avg(weighted) AS weighted FROM tiered GROUP BY ALL")
def tier_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("latency_s").isNull(), "3. neither").when(F.col("latency_s") % 2 == 0, "1. gold section").otherwise("2. right doc")
    return aggregate.diagnosis(_joined(spark, d).withColumn("tier", tier))


@R.query(WITH + " SELECT producer, count(*) AS flags FROM scores WHERE safety_flag GROUP BY producer")
def safety_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.safety_counts(views.scores(spark, d))


@R.query("SELECT toxic = 1 AS toxic, count(*) AS n, count(*) FILTER (quality = 1) AS good FROM labels GROUP BY 1")
def toxic_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))


@R.query(
    WITH + """ SELECT producer, coalesce(good, 0) AS good, coalesce(errors, 0) AS errors,
    CASE WHEN coalesce(good, 0) >= 900 THEN 'complete' WHEN coalesce(good, 0) > 0 THEN 'partial' WHEN producer = 'p10' THEN 'not trained' ELSE 'none' END AS state
  FROM (SELECT producer FROM producers UNION ALL VALUES ('p10'), ('p11')) LEFT JOIN (
    SELECT producer, count(*) FILTER (coalesce(error, '') = '') AS good, count(*) FILTER (coalesce(error, '') <> '') AS errors FROM answers GROUP BY producer) USING (producer)"""
)
def status_by_producer(spark: SparkSession, d: str) -> DataFrame:
    who = views.producers(spark).select("producer").unionByName(spark.sql("SELECT * FROM VALUES ('p10'), ('p11') AS v(producer)"))
    return aggregate.status(who, views.answers(spark, d), 900, spark.sql("SELECT 'p10' AS producer"))


@R.query(WITH + " SELECT producer, sum(coalesce(cost_usd, 0)) AS spent, count(*) AS answers FROM answers GROUP BY ROLLUP (producer)")
def spend_rollup(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.spend(views.answers(spark, d))


@R.query("SELECT l_returnflag AS producer, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS answers FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def lineitem_spend(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("producer"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return aggregate.spend(rows, F.col("cents")).withColumnRenamed("spent", "cents")


@R.query("SELECT o_orderkey AS question_id, producer FROM orders CROSS JOIN (VALUES ('A'), ('N'), ('R')) p(producer) WHERE NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = producer AND l_linestatus <> 'O')")
def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"))
    given = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("producer"), F.when(F.col("l_linestatus") == "O", "open").alias("error"))
    return worklist.todo(questions, spark.sql("SELECT * FROM VALUES ('A'), ('N'), ('R') AS p(producer)"), given)


@R.query(WITH + " SELECT DISTINCT a.producer, a.model FROM answers a JOIN producers p USING (producer) WHERE a.model <> p.model")
def model_mix_guard(spark: SparkSession, d: str) -> DataFrame:
    return worklist.model_mix(views.answers(spark, d), views.producers(spark).select("producer", F.col("model").alias("expected_model")))


@R.query(WITH + " SELECT * EXCLUDE (ts) FROM answers WHERE NOT (producer = 'p3' AND coalesce(error, '') <> '')")
def clear_errors(spark: SparkSession, d: str) -> DataFrame:
    """The log is a table with a commit log: the delete is one commit, which rewrites only what holds such rows."""
    held = _table_of(spark, views.answers(spark, d))
    held.delete(worklist.doomed("p3", errors_only=True))
    return held.read().drop("ts")


@R.query(
    """WITH q AS (SELECT s_suppkey AS question_id, s_nationkey FROM supplier), p AS (SELECT r_name AS producer, r_regionkey AS ord FROM region),
  a AS (SELECT c_nationkey, n_regionkey, max(c_custkey) AS answer_id FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
  good AS (SELECT question_id, producer, ord, answer_id FROM q JOIN a ON s_nationkey = c_nationkey JOIN p ON n_regionkey = ord)
  SELECT question_id, producer, answer_id, question_id || '--p' || printf('%02d', ord) AS custom_id FROM good WHERE question_id % 3 <> 0"""
)
def judge_worklist(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("question_id"), "s_nationkey")
    p = table(spark, d, "region").select(F.col("r_name").alias("producer"), F.col("r_regionkey").alias("ord"))
    people = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    latest = people.groupBy("c_nationkey", "n_regionkey").agg(F.max("c_custkey").alias("answer_id"))  # 25 nations: their newest answers
    given = latest.join(p, F.col("n_regionkey") == F.col("ord")).join(q, F.col("c_nationkey") == F.col("s_nationkey"))
    given = given.select("question_id", "producer", "answer_id", F.lit(None).cast("string").alias("error"))
    scored = q.where("question_id % 3 = 0").crossJoin(F.broadcast(p)).select("question_id", "producer")
    return worklist.judge_worklist(q.select("question_id"), p, given, scored, order="answer_id").select("question_id", "producer", "answer_id", "custom_id")


@R.query(
    """WITH grid AS (SELECT c_custkey AS question_id, producer FROM customer CROSS JOIN (VALUES ('F'), ('O'), ('P')) p(producer)),
  s AS (SELECT o_custkey AS question_id, o_orderstatus AS producer, count(*) FILTER (o_orderpriority <> '1-URGENT') AS g, count(*) FILTER (o_orderpriority = '1-URGENT') AS e FROM orders GROUP BY ALL)
  SELECT producer, count(*) AS expected, count(*) FILTER (g > 0) AS good, CAST(coalesce(sum(e), 0) AS BIGINT) AS errors, count(*) FILTER (coalesce(g, 0) = 0) AS missing FROM grid LEFT JOIN s USING (question_id, producer) GROUP BY producer"""
)
def completeness_grid(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderstatus").alias("producer"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").alias("error"))
    return worklist.completeness(table(spark, d, "customer").select(F.col("c_custkey").alias("question_id")), spark.sql("SELECT * FROM VALUES ('F'), ('O'), ('P') AS p(producer)"), given)


@R.query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_check(spark: SparkSession, d: str) -> DataFrame:
    return checks.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unresolved_documents(spark: SparkSession, d: str) -> DataFrame:
    return checks.unresolved(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@R.query(
    r"""WITH raw AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
  SELECT event_id, k % 7 BETWEEN 1 AND 5 AND k % 11 <> 0 AND k % 13 <> 0 AS valid,
    CASE WHEN k % 7 BETWEEN 1 AND 5 AND k % 11 <> 0 AND k % 13 <> 0 THEN CAST(4 * (k % 7) + 3 * (k % 5 + 1) + 2 * (k % 4 + 1) + k % 3 + 1 AS INT) ELSE 0 END AS tenths FROM raw"""
)
def verdict_validate(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts made from the events' numbers: some as strings, some with a part missing, some cut off."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").select("event_id", k.alias("k"))
    marks = F.concat(
        F.lit('{"faithfulness": '), F.col("k") % 7, F.lit(', "accuracy": "'), F.col("k") % 5 + 1, F.lit('", "completeness": '), F.col("k") % 4 + 1, F.lit('.0, "clarity": '), F.col("k") % 3 + 1,
        F.when(F.col("k") % 11 == 0, ', "safety_flag": "maybe"').otherwise(', "safety_flag": false'), F.lit(', "extra": 1, "reason": "r"'), F.when(F.col("k") % 13 == 0, "").otherwise("}"),
    )
    rows, v = rows.select("event_id", verdict.parse(marks).alias("v")), F.col("v")
    return rows.select("event_id", v.isNotNull().alias("valid"), F.coalesce(verdict.weighted_tenths(v), F.lit(0)).alias("tenths"))


@R.query(
    """WITH m AS (SELECT o_orderkey, o_custkey % 12 AS question_id, 'p' || o_custkey % 2 AS producer, o_orderstatus <> 'P' AS ok FROM orders WHERE o_custkey % 5 <> 0)
  SELECT status, count(*) AS n FROM (SELECT CASE WHEN question_id < 4 THEN 'skipped' WHEN ok AND o_orderkey % 9 <> 0 THEN 'written' ELSE 'failed' END AS status FROM m) GROUP BY status"""
)
def result_routing(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    results = orders.select(F.col("o_orderkey").alias("custom_id"), (F.col("o_orderstatus") != "P").alias("succeeded"), F.when(F.col("o_orderkey") % 9 != 0, "ok").alias("verdict"))
    manifest = orders.where("o_custkey % 5 <> 0").select(F.col("o_orderkey").alias("custom_id"), (F.col("o_custkey") % 12).alias("question_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 2).cast("string")).alias("producer"))
    scored = manifest.where("question_id < 4")
    return worklist.route(results, manifest, scored).groupBy("status").agg(F.count("*").alias("n"))


PRICES = "VALUES ('m0', 2.0, 8.0, 25.0), ('m1', 0.0, 0.0, 0.0), ('m2', 1.5, 9.0, NULL)"
FLAT = "CAST(model AS VARCHAR) AS model, CAST(inp AS DOUBLE) AS inp, CAST(outp AS DOUBLE) AS outp"


def _prices(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT model, CAST(inp AS DOUBLE) AS inp, CAST(out AS DOUBLE) AS out, CAST(train AS DOUBLE) AS train FROM {PRICES} AS p(model, inp, out, train)")


@R.query(
    f"""WITH p AS (SELECT {FLAT} FROM ({PRICES}) p(model, inp, outp, train)), calls AS (SELECT o_orderkey, CASE o_custkey % 4 WHEN 3 THEN 'ft:m2:org::x' ELSE 'm' || o_custkey % 4 END AS model, o_custkey AS tin, o_orderkey AS tout FROM orders)
  SELECT o_orderkey, calls.model, (tin * coalesce(p.inp, 2 * b.inp) + tout * coalesce(p.outp, 2 * b.outp)) / 1000000 AS usd FROM calls LEFT JOIN p USING (model) LEFT JOIN p b ON b.model = split_part(calls.model, ':', 2) AND calls.model LIKE 'ft:%'"""
)
def price_lookup(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("o_custkey") % 4 == 3, "ft:m2:org::x").otherwise(F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")))
    calls = table(spark, d, "orders").select("o_orderkey", "o_custkey", own.alias("model"))
    return cost.priced(calls, _prices(spark)).select("o_orderkey", "model", cost.cost(F.col("o_custkey"), F.col("o_orderkey")).alias("usd"))


@R.query(
    f"""WITH p AS (SELECT {FLAT} FROM ({PRICES}) p(model, inp, outp, train)), q AS (SELECT count(*) AS calls, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))) AS BIGINT) AS s FROM benchmark)
  SELECT producer, calls, s + calls * (50 + ctx) AS in_tokens, calls * 300 AS out_tokens, ((s + calls * (50 + ctx)) * inp + calls * 300 * outp) / 1000000 AS infer_usd, train_usd
  FROM q CROSS JOIN (VALUES ('p0', 'm0', 0, 0.0::DOUBLE), ('p1', 'm1', 0, 4.0::DOUBLE), ('p2', 'm2', 261, 0.0::DOUBLE)) v(producer, model, ctx, train_usd) JOIN p USING (model)"""
)
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    from qaloom.functions.text import token_count

    who = spark.sql("SELECT * FROM VALUES ('p0', 'prompting', 'm0', false, false), ('p1', 'finetuned', 'm1', true, true), ('p2', 'rag', 'm2', false, false) AS v(producer, method, model, is_local, trains_remotely)")
    return cost.estimate(who, table(spark, d, "benchmark").select(token_count(F.col("text")).alias("q_tokens")), _prices(spark), 50, 261, 25853, 3, 300)


@R.query(
    """WITH q AS (SELECT count(*) AS n, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) + n_chars) AS BIGINT) AS own FROM documents), t AS (SELECT n * 10 AS calls, (own + n * (400 + 60 + 300)) * 10 AS in_tokens FROM q)
  SELECT scenario, calls, in_tokens, calls * cap AS out_tokens, (in_tokens * 3.0::DOUBLE + calls * cap * 15.0::DOUBLE) / 1000000 AS sync_usd, (in_tokens * 3.0::DOUBLE + calls * cap * 15.0::DOUBLE) / 1000000 * 0.5::DOUBLE AS batched_usd FROM t CROSS JOIN (VALUES ('plain', 512), ('thinking', 912)) c(scenario, cap)"""
)
def judge_estimate(spark: SparkSession, d: str) -> DataFrame:
    from qaloom.functions.text import token_count

    q = table(spark, d, "documents").select(token_count(F.col("text")).alias("q_tokens"), F.col("n_chars").alias("doc_tokens"))
    return cost.judge_estimate(q, 10, 3.0, 15.0, 400, 60)


@R.query("SELECT coalesce(n.o_custkey, o.c_custkey) AS producer, coalesce(n.paid, o.c_acctbal) AS paid, o.c_mktsegment AS segment FROM customer o FULL JOIN (SELECT o_custkey, max(o_totalprice) AS paid FROM orders GROUP BY 1) n ON n.o_custkey = o.c_custkey")
def job_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("producer"), F.col("c_acctbal").alias("paid"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("producer")).agg(F.max("o_totalprice").alias("paid"))
    held = _table_of(spark, old)
    held.upsert(new, "producer")
    return held.read()


@R.query(
    """WITH a AS (SELECT user_id % 50 AS question_id, 'p' || (user_id % 10) AS producer, event_id AS answer_id, ts, event_type FROM events WHERE event_type <> 'error')
  SELECT question_id, producer, answer_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, producer ORDER BY answer_id DESC) AS nth FROM a) WHERE nth = 1"""
)
def latest_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        (F.col("user_id") % 50).alias("question_id"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("producer"), F.col("event_id").alias("answer_id"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )
    return worklist.latest(rows, "answer_id").select("question_id", "producer", "answer_id")


@R.query("SELECT CAST(d.doc_id AS VARCHAR) AS custom_id, 'Document: ' || trim(text) || chr(10) || 'Question: ' || source || chr(10) || 'Answer: ' || lang AS prompt FROM documents d JOIN labels l USING (doc_id)")
def blind_prompts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("clean_path", F.col("doc_id").cast("string"))
    work = docs.join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    work = work.select(F.col("clean_path").alias("custom_id"), "clean_path", F.col("source").alias("question"), F.col("lang").alias("answer"), "quality", "toxic")
    return worklist.blind_prompt(work, docs.select("clean_path", "text"), "Document: {document}\nQuestion: {question}\nAnswer: {answer}")


@R.query(
    """SELECT s_name AS producer, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_acctbal > 0 THEN 'trained-' || s_suppkey END ELSE 'm' || s_nationkey END AS called_model FROM supplier"""
)
def resolved_models(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    number = F.col("s_suppkey").cast("string")
    who = rows.select(F.col("s_name").alias("producer"), F.when(F.col("s_suppkey") % 3 == 0, "finetuned").otherwise("prompting").alias("method"), F.concat(F.lit("m"), F.col("s_nationkey").cast("string")).alias("model"))
    jobs = rows.where("s_suppkey % 2 = 0 OR s_acctbal > 0").select(F.col("s_name").alias("producer"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("trained-"), number)).otherwise("").alias("trained_model"))
    return worklist.resolve_models(who, jobs).select("producer", "called_model")


@R.query("SELECT o_custkey AS suffix, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS job_id FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def live_jobs(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "Failed").otherwise("running")
    return worklist.latest_live_job(table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("suffix"), state.alias("status"), F.col("o_orderdate").alias("created_at")))
