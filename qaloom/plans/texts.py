"""Queries over documents, pages, conversations and embeddings: cleaning, sections, splits, retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions import table_functions
from qaloom.functions import text as t
from qaloom.operators import cleaning, cost, dedup, derive, ranking, retrieval, segment, split  # noqa: F401
from qaloom.plans.registry import Registry
from qaloom.sources.durable import Tables
from qaloom.sources.tables import table

R = Registry()
TOKENS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> ''))"
MOST_ITEMS = 100_000  # benchmark items whose hashes are broadcast
NUMERIC = t.NUMERIC.removeprefix("(?i)")
PROCEDURAL = t.PROCEDURAL.removeprefix("(?i)")


@R.query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '{NUMERIC}', 'i') THEN 'numeric' WHEN regexp_matches(text, '{PROCEDURAL}', 'i') THEN 'procedural' ELSE 'factual' END AS answer_type FROM documents")
def answer_type_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.answer_type(F.col("text")).alias("answer_type"))


@R.query(
    r"""SELECT d.doc_id, len(list_filter(regexp_extract_all(d.text, '\d[\d,]*'), lambda n: NOT contains(replace(coalesce(e.text, ''), ',', ''), replace(n, ',', '')))) > 0 AS flagged
  FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id - 1"""
)
def number_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a document that the document before it, as evidence, doesn't hold."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    evidence = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("evidence"))
    return docs.join(evidence, "doc_id", "left").select("doc_id", t.ungrounded(F.col("text"), F.coalesce("evidence", F.lit(""))).alias("flagged"))


@R.query(
    r"""WITH h AS (SELECT page_id, 'Ref: SGH-PG-' || page_id || ' | Issued: ' || (page_id % 28 + 1) || ' | June 2026 Rev: 1.' || page_id % 7 || ' Dept: ' || split_part(url, '/', 3) || ' | Valid Until: 30 | September 2026' AS s FROM pages)
  SELECT page_id, 'SGH-PG-' || page_id AS doc_id, (page_id % 28 + 1) || ' June 2026' AS issued, '1.' || page_id % 7 AS rev, regexp_extract(s, 'Dept:\s*([^|]+?)\s*(?:\||Valid Until|$)', 1) AS dept, '30 September 2026' AS valid_until FROM h"""
)
def frontmatter_extract(spark: SparkSession, d: str) -> DataFrame:
    pid = F.col("page_id").cast("string")
    head = F.concat(
        F.lit("Ref: SGH-PG-"), pid, F.lit(" | Issued: "), (F.col("page_id") % 28 + 1).cast("string"), F.lit(" | June 2026 Rev: 1."), (F.col("page_id") % 7).cast("string"),
        F.lit(" Dept: "), F.split("url", "/")[2], F.lit(" | Valid Until: 30 | September 2026"),
    )
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in t.front_matter(head).items()])


@R.query(
    r"""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
  WHERE NOT (regexp_matches(line, '^Page\s+\d+\s+of\s+\d+$', 'i') OR regexp_matches(line, '^Prices subject to revision', 'i') OR regexp_matches(line, '^Digitally Signed$', 'i') OR upper(line) = 'RELEASED UNDER THE MIT LICENSE.')"""
)
def boilerplate_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(~t.is_footer(F.col("line"), ["RELEASED UNDER THE MIT LICENSE."]))


def _as_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents as markdown: lines of up to 40 characters head sections, by turns of two levels; lines with bars are tables.

    Only line feeds end a line; other breaks in it become spaces.  A line of spaces is blank.
    """
    size = F.length(F.col("text"))
    lines = F.split("text", "\n", -1)
    line = lambda x: F.regexp_replace(x, r"\R", " ")
    made = F.transform(lines, lambda x, i: F.when(F.trim(x) == "", "").when(F.length(x) <= 40, F.concat(F.when(i % 2 == 0, "## ").otherwise("### "), line(x))).when(F.contains(x, F.lit(" | ")), F.concat(F.lit("| "), line(x), F.lit(" |"))).when(F.length(x) % 5 == 0, F.concat(F.lit("- "), line(x))).otherwise(line(x)))
    head = F.concat(F.lit('---\ndoc_id: "D-'), F.col("doc_id").cast("string"), F.lit('"\ntitle: "'), F.col("source"), F.lit('"\n---\n# '), F.col("source"), F.lit("\n\n"))
    return table(spark, d, "documents").where(size >= 0).select("doc_id", F.concat(head, F.array_join(made, "\n")).alias("markdown"))


LINES = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  kinds AS (SELECT doc_id, i, x, CASE WHEN trim(x) = '' THEN 'blank' WHEN length(x) <= 40 AND x <> '' THEN 'heading' WHEN contains(x, ' | ') THEN 'table' WHEN length(x) % 5 = 0 THEN 'bullets' ELSE 'para' END AS kind,
    CASE WHEN length(x) <= 40 AND trim(x) <> '' THEN CASE WHEN i % 2 = 0 THEN 2 ELSE 3 END END AS level FROM lines),
  marked AS (SELECT *, CASE WHEN kind IN ('table', 'bullets') AND lag(kind) OVER (PARTITION BY doc_id ORDER BY i) = kind THEN 0 ELSE 1 END AS first FROM kinds),
  blocks AS (SELECT doc_id, b, kind, min(i) AS i, min(level) AS level, count(*) AS n, arg_min(x, i) AS x FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM marked) WHERE kind <> 'blank' GROUP BY ALL)"""


@R.query(f"WITH {LINES} SELECT doc_id, kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS lines FROM blocks GROUP BY ALL")
def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    blocks = segment.blocks_of(segment.split_front_matter(_as_markdown(spark, d), "markdown"), "doc_id")
    size = F.when(F.col("kind") == "bullets", F.size("items")).when(F.col("kind") == "table", F.size("rows") + 1).otherwise(1)
    return blocks.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(size).alias("lines"))


@R.query(
    f"""WITH {LINES}, numbered AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER w AS s, last_value(CASE WHEN level = 2 THEN trim(x) END IGNORE NULLS) OVER w AS above FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))
  SELECT doc_id, CAST(s AS BIGINT) AS section, max(CASE WHEN kind = 'heading' THEN trim(x) END) AS heading, max(level) AS level, max(CASE WHEN kind = 'heading' AND level = 3 THEN coalesce(above, '') WHEN kind = 'heading' THEN '' END) AS parent, count(*) - 1 AS blocks FROM numbered WHERE s > 0 GROUP BY ALL"""
)
def sections(spark: SparkSession, d: str) -> DataFrame:
    made = segment.sections_of(segment.blocks_of(segment.split_front_matter(_as_markdown(spark, d), "markdown"), "doc_id"), "doc_id")
    return made.select("doc_id", "section", "heading", "level", "parent", F.size("content").cast("long").alias("blocks"))


@R.query(f"WITH {LINES}, numbered AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM blocks) SELECT doc_id, CAST(s AS BIGINT) AS section, count(*) AS pairs FROM numbered JOIN (SELECT doc_id, s AS hs FROM numbered WHERE kind = 'heading' AND level = 3 AND ends_with(rtrim(x), '.')) h USING (doc_id) WHERE s = hs AND kind <> 'heading' GROUP BY ALL")
def faq_sections(spark: SparkSession, d: str) -> DataFrame:
    made = segment.sections_of(segment.blocks_of(segment.split_front_matter(_as_markdown(spark, d), "markdown"), "doc_id"), "doc_id")
    asked = made.where((F.col("level") == 3) & F.rtrim(F.col("heading")).endswith("."))
    return asked.where(F.size("content") > 0).select("doc_id", "section", F.size("content").cast("long").alias("pairs"))


@R.query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, md5(array_to_string(list_sort({TOKENS}), ' ')) AS digest FROM documents")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "documents").select("doc_id", t.tokens(F.col("text")).alias("ts"))
    return made.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("ts"), " ")).alias("digest"))


PAIRS = f"""sets AS (SELECT doc_id, {TOKENS} AS ts FROM documents), each AS (SELECT doc_id, unnest(ts) AS tok, len(ts) AS n FROM sets),
  freq AS (SELECT tok, count(*) AS f FROM each GROUP BY tok), ranked AS (SELECT doc_id, n, tok, f, row_number() OVER (PARTITION BY doc_id ORDER BY f, tok) AS r FROM each JOIN freq USING (tok)),
  pre AS (SELECT doc_id, tok FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1 AND f > 1),
  cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM pre x JOIN pre y ON x.tok = y.tok AND x.doc_id < y.doc_id),
  pairs AS (SELECT a, b FROM cand JOIN sets sa ON sa.doc_id = a JOIN sets sb ON sb.doc_id = b WHERE 5 * len(list_intersect(sa.ts, sb.ts)) >= 4 * (len(sa.ts) + len(sb.ts) - len(list_intersect(sa.ts, sb.ts))))"""


@R.query(f"WITH {PAIRS} SELECT a, b FROM pairs")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.same_fact_pairs(table(spark, d, "documents"), "doc_id", ["text"])


@R.query(
    f"""WITH RECURSIVE {PAIRS}, nodes AS (SELECT DISTINCT b AS id FROM pairs UNION SELECT DISTINCT a FROM pairs), seq AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM nodes),
  near AS (SELECT b, list(a) AS earlier FROM pairs GROUP BY b),
  fold(r, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT seq.r, CASE WHEN len(list_intersect(coalesce(near.earlier, []), kept)) > 0 THEN kept ELSE list_append(kept, seq.id) END FROM fold JOIN seq ON seq.r = fold.r + 1 LEFT JOIN near ON near.b = seq.id),
  final AS (SELECT kept FROM fold ORDER BY r DESC LIMIT 1)
  SELECT doc_id, NOT (doc_id IN (SELECT id FROM nodes) AND NOT list_contains((SELECT kept FROM final), doc_id)) AS kept FROM documents"""
)
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.greedy_dedup(table(spark, d, "documents"), "doc_id", ["text"]).select("doc_id", "kept")


@R.query(
    """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, n * 100 // sum(n) OVER () AS q, n * 100 % sum(n) OVER () AS rest FROM s), k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS nth, 100 - sum(q) OVER () AS left_over FROM r)
  SELECT source, n, CAST(least(q + CASE WHEN nth <= left_over THEN 1 ELSE 0 END, n) AS BIGINT) AS quota FROM k"""
)
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    return split.largest_remainder(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), 100, "source", "n", "source")


SPLIT = """base AS (SELECT doc_id, text, source, lang, md5('42:' || doc_id) AS h FROM documents), s AS (SELECT source, count(*) AS n FROM base GROUP BY source),
  r AS (SELECT *, n * 100 // sum(n) OVER () AS q, n * 100 % sum(n) OVER () AS rest FROM s), k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS nth, 100 - sum(q) OVER () AS left_over FROM r),
  quota AS (SELECT source, least(q + CASE WHEN nth <= left_over THEN 1 ELSE 0 END, n) AS quota FROM k), t AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY h, doc_id) AS turn FROM base),
  p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, lang, h, doc_id) AS nth FROM t), parts AS (SELECT doc_id, text, source, lang, CASE WHEN nth <= quota THEN 'test' ELSE 'train' END AS part FROM p JOIN quota USING (source))"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_split(table(spark, d, "documents").select("doc_id", "text", "source", "lang"), "doc_id", "source", "lang", 100)


@R.query(f"WITH {SPLIT} SELECT doc_id, source, lang, part FROM parts")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("doc_id", "source", "lang", "part")


@R.query(f"WITH {SPLIT} SELECT source, count(*) FILTER (part = 'test') AS test, count(*) FILTER (part = 'train') AS train FROM parts GROUP BY source")
def split_coverage(spark: SparkSession, d: str) -> DataFrame:
    return split.coverage(_split(spark, d), "source")


@R.query(f"WITH {SPLIT}, {PAIRS} SELECT 'same fact' AS reason, a, b FROM pairs JOIN parts x ON x.doc_id = a JOIN parts y ON y.doc_id = b WHERE x.part <> y.part")
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    made = _split(spark, d)
    return split.leaks(made.where("part = 'train'"), made.where("part = 'test'"), "doc_id", ["text"])


@R.query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item word for word: by its first five words, then exactly."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.split("text", r"\s+").alias("w"))
    shifted = F.arrays_zip(*[F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(5)])  # five words from each place on
    grams = F.array_distinct(F.transform(shifted, lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(5)])))
    # An item may begin and end inside words: its second to sixth words are whole in any document that holds it.
    items = table(spark, d, "benchmark").withColumn("w", F.split("text", r"\s+")).select("item_id", F.col("text").alias("item"), F.when(F.size("w") >= 7, F.xxhash64(*[F.get("w", F.lit(k)) for k in range(1, 6)])).alias("gram"))
    docs = docs.withColumn("grams", grams).drop("w")
    known = items.where("gram is not null")
    if known.count() <= MOST_ITEMS:  # then every task knows all items' grams, and only documents that hold one go on
        wanted = known.agg(F.collect_set("gram").alias("wanted"))
        met = docs.crossJoin(F.broadcast(wanted)).select("doc_id", "text", F.explode(F.array_intersect("grams", "wanted")).alias("gram"))
        long_ = met.join(known, "gram").where(F.contains("text", F.col("item")))
    else:
        met = docs.select("doc_id", F.explode("grams").alias("gram")).join(known, "gram").select("doc_id", "item_id", "item").distinct()
        long_ = met.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item")))
    short = docs.crossJoin(items.where("gram is null")).where(F.contains("text", F.col("item")))  # items of six words or fewer: a query set against all rows
    return long_.select("doc_id", "item_id").unionByName(short.select("doc_id", "item_id")).distinct()


@R.query(
    """SELECT u.conv_id, u.turn, 'system: helpful' || chr(10) || 'user: ' || u.text || chr(10) || 'assistant: ' || a.text AS chat FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""
)
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    given = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    made = split.chat_messages(asked.join(given, ["conv_id", "turn"]), "question", "answer", "helpful")
    return made.select("conv_id", "turn", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("chat"))


@R.query(r"SELECT role, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def message_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.sum(t.token_count(F.col("text"))).alias("tokens"))


@R.query(
    r"""SELECT doc_id, CAST(i AS INT) AS chunk, body FROM (SELECT doc_id, i, regexp_replace(substr(text, CAST(i * 1200 + 1 AS BIGINT), 1200), '^\s+|\s+$', '', 'g') AS body FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 1200 + 1)) AS i FROM documents)) WHERE length(body) > 200"""
)
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.distractor_chunks(table(spark, d, "documents"), "doc_id", "text")


DOT = "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
TOP = "scored AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS gold, c.label AS label, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"


def _ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    rows = table(spark, d, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = retrieval.top_k(queries, rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), k + 1)
    from pyspark.sql import Window

    others = found.where("chunk_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return others.where(F.col("rank") <= k)


def _labelled(spark: SparkSession, d: str, k: int) -> DataFrame:
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "label")
    found = _ranked(spark, d, k).join(label.select(F.col("v").alias("chunk_id"), "label"), "chunk_id")
    return found.join(label.select(F.col("v").alias("query_id"), F.col("label").alias("gold")), "query_id")


@R.query(f"WITH {TOP} SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= 3")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, 3).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@R.query(f"WITH {TOP} SELECT query_id, CASE WHEN count(*) FILTER (label = gold AND chunk_id % 2 = 0) > 0 THEN '1. gold section' WHEN count(*) FILTER (label = gold) > 0 THEN '2. right doc' ELSE '3. neither' END AS tier FROM ranked WHERE rank <= 3 GROUP BY query_id")
def retrieval_tiers(spark: SparkSession, d: str) -> DataFrame:
    hit = F.struct(F.col("label").alias("doc_id"), (F.col("chunk_id") % 2).alias("section"))
    rows = _labelled(spark, d, 3).groupBy("query_id").agg(F.collect_list(hit).alias("hits"), F.any_value("gold").alias("gold"))
    return rows.select("query_id", retrieval.tier(F.col("hits"), F.col("gold"), F.lit(0)).alias("tier"))


@R.query(f"WITH {TOP}, g AS (SELECT query_id, min(rank) FILTER (label = gold) AS r FROM ranked WHERE rank <= 10 GROUP BY query_id) SELECT count(*) FILTER (r <= 1) AS hits_1, count(*) FILTER (r <= 3) AS hits_3, count(*) FILTER (r <= 5) AS hits_5, count(*) FILTER (r <= 10) AS hits_10, count(*) AS queries FROM g")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    best = _labelled(spark, d, 10).groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("gold"), F.col("rank"))).alias("rank"))
    counts = F.count("*").alias("queries")
    return best.agg(*[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in (1, 3, 5, 10)], counts)


@R.query(
    f"""WITH {TOP}, ctx AS (SELECT query_id, string_agg('[' || label || ' · ' || chunk_id || ']' || chr(10) || 'vector ' || chunk_id, chr(10) || chr(10) ORDER BY rank) AS c FROM ranked WHERE rank <= 3 GROUP BY query_id)
  SELECT query_id, '<documents>' || chr(10) || c || chr(10) || '</documents>' || chr(10) || 'Question: what is ' || query_id || '?' AS prompt FROM ctx"""
)
def rag_prompt(spark: SparkSession, d: str) -> DataFrame:
    cid = F.col("chunk_id").cast("string")
    hits = _labelled(spark, d, 3).select("query_id", "rank", F.col("label").alias("doc_id"), F.col("chunk_id").alias("section"), F.concat(F.lit("vector "), cid).alias("body"), F.concat(F.lit("what is "), F.col("query_id").cast("string"), F.lit("?")).alias("question"))
    return retrieval.prompt(hits, "<documents>\n{context}\n</documents>\nQuestion: {question}")


_TERMS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '')"


@R.query(
    rf"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark), docs AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
  stats AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM docs), words AS (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM docs), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM words GROUP BY ALL),
  idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf CROSS JOIN stats GROUP BY term, n),
  hits AS (SELECT query_id, doc_id, CAST(sum(CAST(round(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) * 1000000000) AS BIGINT)) AS BIGINT) AS s0, count(*) AS s1 FROM q JOIN tf USING (term) JOIN idf USING (term) CROSS JOIN stats GROUP BY ALL),
  ranks AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s0 DESC, doc_id) AS r0, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, doc_id) AS r1 FROM hits),
  fused AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + r0) + 1.0::DOUBLE / (60 + r1) AS score FROM ranks)
  SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 10"""
)
def bm25_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items against documents: BM25 ranks fused with ranks by shared distinct terms, of whole rankings."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return ranking.fused_top(queries, table(spark, d, "documents").select("doc_id", "text"))


@R.query(
    """WITH pts AS (SELECT l_suppkey AS grp, l_orderkey * 10 + l_linenumber AS id, floor(l_extendedprice) AS x FROM lineitem), m AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY grp ORDER BY x) > 22 THEN 1 ELSE 0 END AS gap FROM pts),
  n AS (SELECT *, sum(gap) OVER (PARTITION BY grp ORDER BY x ROWS UNBOUNDED PRECEDING) AS a FROM m) SELECT grp, CAST(a AS BIGINT) AS anchor_no, avg(x) AS anchor, count(*) AS n FROM n GROUP BY ALL"""
)
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.anchors(_points(spark, d), "grp", "x")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.floor("l_extendedprice").cast("double").alias("x"))


@R.query(
    """WITH pts AS (SELECT p_size AS grp, p_partkey AS id, floor(p_retailprice) AS x FROM part), anc AS (SELECT p_size AS grp, row_number() OVER (PARTITION BY p_size ORDER BY max_x) - 1 AS anchor_no, max_x AS anchor FROM (SELECT p_size, p_brand, max(floor(p_retailprice)) AS max_x FROM part GROUP BY ALL) GROUP BY p_size, max_x),
  d AS (SELECT pts.grp, id, anchor_no, row_number() OVER (PARTITION BY pts.grp, id ORDER BY abs(x - anchor), anchor_no) AS r FROM pts JOIN anc USING (grp)) SELECT grp, id, anchor_no FROM d WHERE r = 1"""
)
def nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    part = table(spark, d, "part")
    points = part.select(F.col("p_size").alias("grp"), F.col("p_partkey").alias("id"), F.floor("p_retailprice").cast("double").alias("x"))
    tops = part.groupBy(F.col("p_size").alias("grp"), "p_brand").agg(F.max(F.floor("p_retailprice")).cast("double").alias("anchor")).select("grp", "anchor").distinct()
    found = tops.withColumn("anchor_no", (F.row_number().over(Window.partitionBy("grp").orderBy("anchor")) - 1).cast("long"))
    return cleaning.nearest_anchor(points, found, "grp", "id", "x")


@R.query(
    """WITH RECURSIVE items AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS line FROM lineitem),
  lines AS (SELECT l_suppkey AS doc, CAST(line // 50 AS INT) AS page, line, l_quantity AS x0, (l_partkey % 700)::DOUBLE AS y, l_returnflag AS text FROM items),
  heads(doc, page, row, y) AS (SELECT doc, page, 0, min(y) FROM lines GROUP BY ALL UNION ALL SELECT h.doc, h.page, h.row + 1, (SELECT min(l.y) FROM lines l WHERE l.doc = h.doc AND l.page = h.page AND l.y > h.y + 5) AS y FROM heads h WHERE h.y IS NOT NULL),
  placed AS (SELECT l.*, max(h.row) AS row FROM lines l JOIN heads h ON h.doc = l.doc AND h.page = l.page AND h.y <= l.y GROUP BY ALL)
  SELECT doc, page, CAST(row AS INT) AS row, min(y) AS y0, max(y) + 10 AS y1, CAST(count(*) AS INT) AS n_cells, string_agg(text, ' ' ORDER BY x0, line) AS text FROM placed GROUP BY doc, page, row"""
)
def visual_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as text lines on pages: rows by a fold from each row's first line."""
    from pyspark.sql import Window

    items = table(spark, d, "lineitem").withColumn("line", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")))
    lines = items.select(
        F.col("l_suppkey").alias("doc"), F.floor(F.col("line") / 50).cast("int").alias("page"), "line", F.col("l_quantity").alias("x0"), (F.col("l_partkey") % 700).cast("double").alias("y0"),
        (F.col("l_partkey") % 700 + 10).cast("double").alias("y1"), F.lit(10.0).alias("h"), F.col("l_returnflag").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("all_bold"),
    )
    return cleaning.roll_up(cleaning.visual_rows(lines)).select("doc", "page", "row", "y0", "y1", "n_cells", "text")


@R.query(
    rf"""WITH {LINES}, numbered AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER w AS s, last_value(CASE WHEN level = 2 THEN trim(x) END IGNORE NULLS) OVER w AS above FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
  heads AS (SELECT doc_id, s, trim(x) AS heading, CASE WHEN level = 3 THEN coalesce(above, '') ELSE '' END AS parent, level FROM numbered WHERE kind = 'heading'),
  runs AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS b, kind, trim(x) AS x FROM marked),
  said AS (SELECT doc_id, b, string_agg(x, '; ' ORDER BY i) AS x, min(i) AS i FROM runs WHERE kind IN ('para', 'bullets') GROUP BY ALL),
  bodies AS (SELECT n.doc_id, n.s, trim(string_agg(t.x, ' ' ORDER BY t.i)) AS answer FROM numbered n JOIN said t ON t.doc_id = n.doc_id AND t.b = n.b WHERE n.s > 0 GROUP BY ALL),
  found AS (SELECT *, starts_with('D-' || doc_id, 'D-1') AS faq FROM heads JOIN bodies USING (doc_id, s)),
  pairs AS (
    SELECT doc_id, s, parent AS section, heading AS question, answer FROM found WHERE faq AND level = 3 AND ends_with(rtrim(heading), '?') AND answer <> ''
    UNION ALL SELECT doc_id, s, CASE WHEN parent <> '' THEN parent ELSE heading END, 'What is said on ' || heading || '?', answer FROM found WHERE NOT faq AND length(answer) >= 40)
  SELECT 'd-' || doc_id || '-q' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) AS VARCHAR), 3, '0') AS id, 'D-' || doc_id AS doc_id, '' AS source_doc, section, question, answer, answer AS evidence,
    CASE WHEN doc_id % 10 = 7 THEN 'sevens' ELSE 'general' END AS topic, CASE WHEN regexp_matches(answer, '{NUMERIC}', 'i') THEN 'numeric' WHEN regexp_matches(answer, '{PROCEDURAL}', 'i') THEN 'procedural' ELSE 'factual' END AS answer_type,
    false AS needs_attention, false AS verified, '' AS verify_note FROM pairs"""
)
def prose_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Question-answer pairs of documents read as markdown, without what their tables say."""
    made = Tables(spark).save(_parsed(spark, d).withColumn("content", F.filter("content", lambda b: b["kind"] != "table")))
    return _pairs(made)


@R.query(
    rf"""WITH {LINES}, numbered AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER w AS s, last_value(CASE WHEN level = 2 THEN trim(x) END IGNORE NULLS) OVER w AS above FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
  heads AS (SELECT doc_id, s, trim(x) AS heading, CASE WHEN level = 3 THEN coalesce(above, '') ELSE '' END AS parent, level FROM numbered WHERE kind = 'heading'),
  runs AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS b, kind, trim(x) AS x FROM marked),
  cells AS (SELECT doc_id, b, i, list_transform(string_split(regexp_replace('| ' || x || ' |', '^\|+|\|+$', '', 'g'), '|'), lambda v: trim(v)) AS c FROM runs WHERE kind = 'table'),
  kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, b ORDER BY i) AS rn FROM cells WHERE NOT list_bool_and(list_transform(c, lambda v: regexp_matches(v, '^[-: ]+$')))),
  grid AS (SELECT k.doc_id, k.b, k.rn, h.c AS h, list_concat(k.c, list_transform(range(greatest(len(h.c) - len(k.c), 0)), lambda z: '')) AS r FROM kept k JOIN kept h ON h.doc_id = k.doc_id AND h.b = k.b AND h.rn = 1 WHERE k.rn > 1),
  said AS (
    SELECT doc_id, b, string_agg(x, '; ' ORDER BY i) AS x, min(i) AS i, false AS tabular FROM runs WHERE kind IN ('para', 'bullets') GROUP BY ALL
    UNION ALL SELECT doc_id, b, string_agg(array_to_string(c, ' | '), ' ;; ' ORDER BY rn), min(i), true FROM kept GROUP BY ALL),
  bodies AS (SELECT n.doc_id, n.s, trim(string_agg(t.x, ' ' ORDER BY t.i)) AS whole, trim(string_agg(t.x, ' ' ORDER BY t.i) FILTER (NOT tabular)) AS prose FROM numbered n JOIN said t ON t.doc_id = n.doc_id AND t.b = n.b WHERE n.s > 0 GROUP BY ALL),
  found AS (SELECT *, starts_with('D-' || doc_id, 'D-1') AS faq FROM heads JOIN bodies USING (doc_id, s)),
  columns_ AS (SELECT doc_id, b, rn, h, r, unnest(range(2, greatest(len(h), 2) + 1)) AS j FROM grid),
  pairs AS (
    SELECT doc_id, 0 AS pass, s, 0 AS b, 0 AS rn, 0 AS j, parent AS section, heading AS question, whole AS answer, whole AS evidence FROM found WHERE faq AND level = 3 AND ends_with(rtrim(heading), '?') AND whole <> ''
    UNION ALL SELECT doc_id, 0, s, 0, 0, 0, CASE WHEN parent <> '' THEN parent ELSE heading END, 'What is said on ' || heading || '?', prose, prose FROM found WHERE NOT faq AND length(prose) >= 40
    UNION ALL SELECT c.doc_id, 1, n.s, c.b, c.rn, c.j, heading, trim('For ' || r[1] || ' at Example House, what is the ' || h[j] || '?'), trim(r[j] || '.'), trim(array_to_string(r, ' | '))
      FROM columns_ c JOIN numbered n ON n.doc_id = c.doc_id AND n.b = c.b JOIN heads d ON d.doc_id = n.doc_id AND d.s = n.s WHERE coalesce(h[j], '') <> '' AND coalesce(r[j], '') <> '')
  SELECT 'd-' || doc_id || '-q' || printf('%03d', row_number() OVER (PARTITION BY doc_id ORDER BY pass, s, b, rn, j)) AS id, 'D-' || doc_id AS doc_id, '' AS source_doc, section, question, answer, evidence,
    CASE WHEN doc_id % 10 = 7 THEN 'sevens' ELSE 'general' END AS topic, CASE WHEN regexp_matches(answer, '{NUMERIC}', 'i') THEN 'numeric' WHEN regexp_matches(answer, '{PROCEDURAL}', 'i') THEN 'procedural' ELSE 'factual' END AS answer_type,
    false AS needs_attention, false AS verified, '' AS verify_note FROM pairs"""
)
def derived_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Question-answer pairs of documents read as markdown."""
    return _pairs(Tables(spark).save(_parsed(spark, d)))  # parsed once, read five times


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment(_as_markdown(spark, d).select(F.col("doc_id").alias("no"), "markdown"), "no", "markdown").drop("no")


def _pairs(made: DataFrame) -> DataFrame:
    stems = made.groupBy("heading").agg(F.lit(None).cast("string").alias("stem_doc"), F.concat(F.lit("What is said on "), F.col("heading"), F.lit("?")).alias("stem")).withColumnRenamed("heading", "stem_heading")
    pairs = derive.derive_pairs(made, stems, "Example House", "Example", faq_prefix="D-1")
    topics = made.select("doc_id").distinct().where(F.col("doc_id").endswith("7")).withColumn("topic", F.lit("sevens"))
    return derive.number_pairs(pairs, topics)


@R.query(r"SELECT p_partkey, replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace('FAQ - ' || p_name || ' - ' || p_brand || '.PDF', '\.pdf$', '', 'i'), '\s+', ' ', 'g')), '^FAQ\s*-\s*', 'FAQ — '), '  ', ' ', 'g'), ' - ', ' — ') AS title FROM part")
def title_from_filename(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("FAQ - "), F.col("p_name"), F.lit(" - "), F.col("p_brand"), F.lit(".PDF"))
    return table(spark, d, "part").select("p_partkey", t.title_of(name).alias("title"))


@R.query("SELECT doc_id, strlen(text) AS bytes, sha256(text) AS sha FROM documents")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"))


@R.query("SELECT vec_id, CAST(round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 1000) AS BIGINT) AS length_1000, len(embedding) AS dims FROM embeddings")
def vector_lengths(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(retrieval.dot(v, v)) * 1000).cast("long").alias("length_1000"), F.size(v).cast("long").alias("dims"))


@R.query(
    rf"""WITH {LINES},
  placed AS (SELECT doc_id, i, x, kind, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM kinds WHERE kind <> 'blank'),
  said AS (SELECT doc_id, s, i, CASE kind WHEN 'bullets' THEN '- ' || trim(x) WHEN 'table' THEN regexp_replace(trim(x), '\s*\|\s*', ' | ', 'g') ELSE trim(x) END AS line FROM placed)
  SELECT doc_id, CAST(s AS BIGINT) AS section, string_agg(line, chr(10) ORDER BY i) AS body FROM said WHERE s > 0 GROUP BY ALL"""
)
def section_texts(spark: SparkSession, d: str) -> DataFrame:
    """Sections of documents read as markdown, each as one text for retrieval."""
    made = segment.sections_of(segment.blocks_of(segment.split_front_matter(_as_markdown(spark, d), "markdown"), "doc_id"), "doc_id")
    return made.select("doc_id", "section", segment.section_text(F.col("heading"), F.col("content")).alias("body"))


@R.query(f"WITH {LINES} SELECT doc_id, kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS lines FROM blocks GROUP BY ALL")
def sql_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of ``block_kinds`` from a SQL text, through the table function."""
    table_functions.register(spark)
    view = f"documents_{uuid.uuid4().hex}"
    segment.split_front_matter(_as_markdown(spark, d), "markdown").createOrReplaceTempView(view)
    size = "CASE kind WHEN 'bullets' THEN size(items) WHEN 'table' THEN size(rows) + 1 ELSE 1 END"
    return spark.sql(f"SELECT doc_id, kind, count(*) AS n, sum({size}) AS lines FROM {view}, LATERAL markdown_blocks(body) GROUP BY doc_id, kind")
