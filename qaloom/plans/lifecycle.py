"""Queries over whole runs: the retrieval corpus and its index, collection, judging in batches, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators import aggregate, collect, corpus, judging, reports, retrieval, verdict
from qaloom.plans import evaluation, texts, views
from qaloom.plans.registry import Registry
from qaloom.sources.durable import shared_dir
from qaloom.sources.tables import table

R = Registry()
WITH = evaluation.WITH


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items are the ground truth, each a section of one paragraph; documents are distractors."""
    para = "named_struct('block', 1, 'kind', 'para', 'level', cast(null as int), 'text', text, 'items', cast(null as array<string>), 'header', cast(null as array<string>), 'rows', cast(null as array<array<string>>))"
    sections = table(spark, d, "benchmark").selectExpr("concat('b', item_id) AS doc_id", "'benchmark' AS source_doc", "concat('item ', item_id) AS heading", f"array({para}) AS content")
    return corpus.union(corpus.gold_chunks(sections), corpus.distractors(table(spark, d, "documents")))


CORPUS = r"""corpus AS (
  SELECT 'b' || item_id AS doc_id, 'item ' || item_id AS section, 'benchmark' AS source_doc, 'item ' || item_id || chr(10) || text AS text, false AS is_distractor FROM benchmark
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'chunk ' || CAST(i AS INT), CAST(doc_id AS VARCHAR), body, true FROM (
    SELECT doc_id, i, regexp_replace(substr(text, CAST(i * 1200 + 1 AS BIGINT), 1200), '^\s+|\s+$', '', 'g') AS body FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 1200 + 1)) AS i FROM documents)) WHERE length(body) > 200)"""


@R.query(f"WITH {CORPUS} SELECT doc_id, section, source_doc, is_distractor, md5(text) AS digest FROM corpus")
def retrieval_corpus(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("doc_id", "section", "source_doc", "is_distractor", F.md5("text").alias("digest"))


VOWELS = "aeiou"


def _vowel_counts(said: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: how often each vowel occurs."""
    return [[float(t.count(v)) for v in VOWELS] for t in said]


LENGTHS = ", ".join(f"(length(text) - length(replace(text, '{v}', '')))::DOUBLE AS {v}" for v in VOWELS)


@R.query(
    f"""WITH {CORPUS}, counts AS (SELECT doc_id, section, {LENGTHS} FROM corpus), sized AS (SELECT *, sqrt({' + '.join(f'{v} * {v}' for v in VOWELS)}) AS n FROM counts)
  SELECT doc_id, section, CAST(5 AS BIGINT) AS dims, CAST(round(CASE WHEN n = 0 THEN 0 ELSE a / n END * 1000) AS BIGINT) AS first_1000, CASE WHEN n = 0 THEN 0 ELSE 1 END AS length FROM sized"""
)
def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    made = corpus.embed(_corpus(spark, d).select("doc_id", "section", "text"), _vowel_counts, double=True)
    v = F.col("embedding")
    return made.select("doc_id", "section", F.size(v).cast("long").alias("dims"), F.round(v[0] * 1000).cast("long").alias("first_1000"), F.round(F.sqrt(retrieval.dot(v, v)), 3).cast("int").alias("length"))


@R.query(f"WITH {CORPUS} SELECT 5 AS dim, 3 AS top_k, count(*) AS chunks_total, count(*) FILTER (NOT is_distractor) AS chunks_gold, count(*) FILTER (is_distractor) AS chunks_distractor, 'vowel counts' AS embed_model FROM corpus")
def index_config(spark: SparkSession, d: str) -> DataFrame:
    """The index is written, its configuration frozen, and both read again."""
    path = _folder(spark)
    corpus.build_index(corpus.embed(_corpus(spark, d), _vowel_counts), path, "vowel counts", 3)
    held, config = corpus.load_index(spark, path)
    counted = held.agg(F.max(F.size("embedding")).alias("dim"), F.lit(config["top_k"]).alias("top_k"), F.count("*").alias("chunks_total"), F.count_if(~F.col("is_distractor")).alias("chunks_gold"))
    return counted.select("*", F.lit(config["chunks_distractor"]).cast("long").alias("chunks_distractor"), F.lit(config["embed_model"]).alias("embed_model"))


@R.query(f"WITH {texts.TOP} SELECT query_id, rank, label AS doc_id, chunk_id AS section, chunk_id % 2 = 1 AS is_distractor FROM ranked WHERE rank <= 3")
def hit_provenance(spark: SparkSession, d: str) -> DataFrame:
    hit = F.struct("rank", F.col("label").alias("doc_id"), F.col("chunk_id").alias("section"), "score", (F.col("chunk_id") % 2 == 1).alias("is_distractor"), F.lit("its text").alias("text"))
    rows = texts._labelled(spark, d, 3).groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    each = rows.select("query_id", F.posexplode(corpus.provenance(F.col("hits"))).alias("at", "h"))
    return each.select("query_id", (F.col("at") + 1).cast("long").alias("rank"), "h.doc_id", "h.section", "h.is_distractor")


@R.query(
    f"""WITH {texts.TOP}, g AS (SELECT query_id, any_value(gold) AS gold, min(rank) FILTER (label = gold) AS r FROM ranked WHERE rank <= 10 GROUP BY query_id)
  SELECT gold, avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE) AS recall_1, avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE) AS recall_3, avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE) AS recall_10, round(avg(coalesce(1.0::DOUBLE / r, 0.0)), 9) AS mrr, count(*) AS queries FROM g GROUP BY gold"""
)
def recall_by_document(spark: SparkSession, d: str) -> DataFrame:
    best = texts._labelled(spark, d, 10).groupBy("query_id").agg(F.any_value("gold").alias("gold"), F.min(F.when(F.col("label") == F.col("gold"), F.col("rank"))).alias("rank"))
    return retrieval.recall(best, (1, 3, 10), ("gold",)).withColumn("mrr", F.round("mrr", 9))


@R.query("SELECT item_id AS question_id, CASE WHEN item_id % 7 <> 0 THEN 'said: ' || text END AS answer, 'm0' AS model, CASE WHEN item_id % 7 = 0 THEN 'ValueError: empty prompt' END AS error FROM benchmark")
def collected_answers(spark: SparkSession, d: str) -> DataFrame:
    """Half of the questions are answered, then the run goes on with all: only what is left is asked."""
    path = _folder(spark)
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 7 == 0, "").otherwise(F.col("text")).alias("prompt"))
    provider = collect.Clients({"echo": collect.echo}, {"echo": "none needed"}).get("echo")
    collect.run_producer(spark, "p0", "m0", questions.where("question_id % 2 = 0"), path, provider, at_once=500)
    collect.run_producer(spark, "p0", "m0", questions, path, provider, at_once=500)
    return spark.read.parquet(path).select("question_id", "answer", "model", "error")


class _Marks:
    """A stand-in for a batch service: marks by the length of a request; a tenth of the requests fail."""

    def create(self, requests: DataFrame) -> str:
        self.requests = requests
        return "batch-1"

    def ended(self, batch_id: str) -> bool:
        return True

    def results(self, batch_id: str) -> DataFrame:
        n = F.length("prompt")
        mark = lambda k: (F.floor(n / k) % 5 + 1).cast("string")
        said = F.concat(F.lit('{"faithfulness": '), mark(1), F.lit(', "accuracy": '), mark(2), F.lit(', "completeness": '), mark(3), F.lit(', "clarity": '), mark(4), F.lit(', "safety_flag": false, "reason": "r"}'))
        return self.requests.select("custom_id", (n % 10 != 0).alias("succeeded"), said.alias("verdict"))


@R.query(
    """WITH w AS (SELECT doc_id, toxic, length(text) AS n FROM documents JOIN labels USING (doc_id)), m AS (SELECT *, n % 10 <> 0 AS ok, CAST(4 * (n % 5 + 1) + 3 * (n // 2 % 5 + 1) + 2 * (n // 3 % 5 + 1) + n // 4 % 5 + 1 AS INT) AS tenths FROM w)
  SELECT doc_id AS question_id, 'p' || toxic AS producer, CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN ok THEN 'written' ELSE 'failed' END AS status, CASE WHEN ok THEN tenths END AS tenths, 'judge' AS judge_model FROM m"""
)
def judged_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch is submitted with its manifest, collected by id, and routed; a fifth of the keys was scored meanwhile."""
    path, client = _folder(spark), _Marks()
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    work = rows.select(F.format_string("%s--p%02d", F.col("doc_id").cast("string"), F.col("toxic").cast("int")).alias("custom_id"), F.col("doc_id").alias("question_id"), F.concat(F.lit("p"), F.col("toxic").cast("string")).alias("producer"), F.col("text").alias("prompt"))
    judging.submit(work, client, path, "judge")
    client.requests = spark.read.parquet(f"{path}/requests")
    done = judging.collect(spark, client, path, work.where("question_id % 5 = 0").select("question_id", "producer"))
    marks = verdict.parse(F.when(F.col("succeeded"), F.col("verdict")))
    return done.withColumn("v", marks).select("question_id", "producer", "status", verdict.weighted_tenths(F.col("v")).alias("tenths"), "judge_model")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    who = F.when(F.col("question_id") % 97 == 0, "judge-b").otherwise("judge-a")
    return views.scores(spark, d).withColumn("judge_model", who)


JUDGED = ", judged AS (SELECT *, CASE WHEN question_id % 97 = 0 THEN 'judge-b' ELSE 'judge-a' END AS judge_model FROM scores)"


@R.query(
    WITH + """, e AS (SELECT producer, coalesce(a.n, 0) AS answered, coalesce(s.n, 0) AS scored FROM (SELECT producer FROM producers UNION ALL VALUES ('p10')) LEFT JOIN (SELECT producer, count(*) AS n FROM answers WHERE coalesce(error, '') = '' GROUP BY producer) a USING (producer)
    LEFT JOIN (SELECT producer, count(*) AS n FROM scores GROUP BY producer) s USING (producer)),
  r AS (SELECT producer, CAST(sum(answered) AS BIGINT) AS answered, CAST(sum(scored) AS BIGINT) AS scored, count(*) AS many FROM e GROUP BY ROLLUP (producer))
  SELECT producer, answered, scored, CASE WHEN scored = 0 THEN 'none' WHEN scored = 600 * many THEN 'judged' ELSE 'partial' END AS state, 'collect' AS next_step FROM r"""
)
def judge_status(spark: SparkSession, d: str) -> DataFrame:
    who = views.producers(spark).select("producer").unionByName(spark.sql("SELECT 'p10' AS producer"))
    status = judging.judge_status(who, views.answers(spark, d), views.scores(spark, d), 600)
    return status.withColumn("next_step", F.lit(judging.next_step(status, False)))


@R.query(WITH + JUDGED + " SELECT judge_model, count(*) AS n, sum(coalesce(cost_usd, 0)) AS spent FROM judged GROUP BY judge_model")
def judges_used(spark: SparkSession, d: str) -> DataFrame:
    return judging.judges_used(_judged(spark, d))


@R.query(
    WITH + JUDGED + """, q AS (SELECT event_id AS question_id FROM events WHERE event_id < 400), w AS (SELECT producer FROM producers WHERE ord < 9), h AS (SELECT producer, count(*) AS n FROM judged GROUP BY producer)
  SELECT 'judges' AS "check", NULL::VARCHAR AS producer, count(DISTINCT judge_model) AS n FROM judged HAVING count(DISTINCT judge_model) > 1
  UNION ALL SELECT 'count', producer, coalesce(n, 0) FROM w LEFT JOIN h USING (producer) WHERE coalesce(n, 0) <> (SELECT count(*) FROM q)
  UNION ALL SELECT 'missing', producer, count(*) FROM q CROSS JOIN w WHERE NOT EXISTS (FROM judged s WHERE s.question_id = q.question_id AND s.producer = w.producer) GROUP BY producer
  UNION ALL SELECT 'unknown', producer, n FROM h WHERE producer NOT IN (SELECT producer FROM w)"""
)
def score_violations(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "events").where("event_id < 400").select(F.col("event_id").alias("question_id"))
    return judging.violations(questions, views.producers(spark).where("ord < 9"), _judged(spark, d))


@R.query(
    f"""WITH e AS ({evaluation.R.sql['cost_estimate']})
  SELECT producer, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(in_tokens) AS BIGINT) AS in_tokens, CAST(sum(out_tokens) AS BIGINT) AS out_tokens, round(sum(infer_usd), 9) AS infer_usd, sum(train_usd) AS train_usd, round(sum(infer_usd) + sum(train_usd), 9) AS total_usd, '{reports.UNVERIFIED}' AS note FROM e GROUP BY ROLLUP (producer)"""
)
def estimate_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.estimate_totals(evaluation.cost_estimate(spark, d), verified=False)
    return rows.withColumns({c: F.round(c, 9) for c in ("infer_usd", "total_usd")})


@R.query(
    f"""WITH {texts.SPLIT} SELECT 'all' AS section, 'all' AS name, count(*) FILTER (part = 'test') AS test, count(*) FILTER (part = 'train') AS train FROM parts
  UNION ALL SELECT 'source', source, count(*) FILTER (part = 'test'), count(*) FILTER (part = 'train') FROM parts GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FILTER (part = 'test'), count(*) FILTER (part = 'train') FROM parts GROUP BY lang"""
)
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.split_counts(texts._split(spark, d), ["source", "lang"])


@R.query("SELECT source AS doc_id, count(*) AS pairs, count(*) FILTER (toxic = 1) AS flagged FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def pool_counts(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return reports.pool_counts(pool.select(F.col("source").alias("doc_id"), (F.col("toxic") == 1).alias("needs_attention")))


@R.query(
    """WITH t AS (SELECT row_number() OVER (ORDER BY c_mktsegment) AS i, c_mktsegment AS segment, count(*) AS n, sum(CAST(round(c_acctbal * 100) AS BIGINT))::DOUBLE / 100 AS balance FROM customer GROUP BY c_mktsegment),
  s AS (SELECT 0 AS i, 'segment' AS a, 'n' AS b, 'balance' AS c UNION ALL SELECT i, segment, n::VARCHAR, printf('%.2f', balance) FROM t)
  SELECT CAST(i AS INT) AS line_no, rtrim(rpad(a, (SELECT max(length(a)) FROM s)::INT, ' ') || '  ' || lpad(b, (SELECT max(length(b)) FROM s)::INT, ' ') || '  ' || lpad(c, (SELECT max(length(c)) FROM s)::INT, ' ')) AS line FROM s"""
)
def text_report(spark: SparkSession, d: str) -> DataFrame:
    cents = F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).cast("double") / 100
    rows = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), cents.alias("balance"))
    return reports.text_table(rows, ["segment", "n", "balance"], ["segment"], places=2)


@R.query(
    WITH + evaluation.MASTER + """ SELECT base, treated, round(round(t.weighted, 3) - round(b.weighted, 3), 9) AS weighted_lift, round(round(t.faithfulness, 3) - round(b.faithfulness, 3), 9) AS faithfulness_lift
  FROM (VALUES ('p0', 'p2'), ('p3', 'p5'), ('p6', 'nobody')) v(base, treated) JOIN master b ON b.producer = base JOIN master t ON t.producer = treated"""
)
def lift_of_rounded(spark: SparkSession, d: str) -> DataFrame:
    """The lift as the report gives it: of means that the master table has rounded."""
    who = views.producers(spark)
    jobs = who.where("method = 'finetuned'").select("producer", F.lit(4.0).alias("train_cost_usd"))
    pairs = spark.sql("SELECT * FROM VALUES ('p0', 'p2'), ('p3', 'p5'), ('p6', 'nobody') AS v(base, treated)")
    rows = aggregate.lift(aggregate.master_table(aggregate.frames(views.scores(spark, d), views.answers(spark, d)), who, jobs), pairs)
    return rows.withColumns({c: F.round(c, 9) for c in ("weighted_lift", "faithfulness_lift")})
