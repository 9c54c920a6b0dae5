"""Sharding by balanced label propagation, under the law of rows: counts at most one apart.

Documents of equal text are linked, and so are texts with the same longest sentence, through the
least of them as a hub; links between documents may be given besides.  Documents
that no link tells apart, those of one text in one shard, are one vertex with a count.  Round by
round, joins bring each vertex the votes of its neighbours' shards; vertices that want to move ask
for it, and quotas of shard to shard, made from swaps and from the room that unlinked documents
can leave, say how many may.  Unlinked documents then fill what room is left.

A text with more copies than a shard has room fills whole shards.  The tables of the rounds hold
linked texts only, with at most as many rows each as there are shards; the driver sees shards by
shards numbers.

Texts of one sentence that many share are as many links, not pairs.

Defined results: a null text has size 1, checksum 0 and is linked like an empty one; repeated rows
each get a slot; no rows give none; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.sources.durable import Tables
from qaloom.llm.ranks import running

SHARDS = 8
ROUNDS = 6
SENTENCE_CHARS = 60  # a longest sentence of fewer characters links nothing


def capacities(rows: int, shards: int) -> list[int]:
    """Rows of each shard: all of them, at most one apart."""
    return [rows * (k + 1) // shards - rows * k // shards for k in range(shards)]


def quotas(demand: list[list[int]], free: list[int]) -> list[list[int]]:
    """How many may move from shard to shard: swaps keep sizes, the rest goes where room is free."""
    n = len(free)
    out = [[min(demand[i][j], demand[j][i]) if i != j else 0 for j in range(n)] for i in range(n)]
    for j in range(n):
        room = max(0, free[j])
        for i in sorted(range(n), key=lambda i: (out[i][j] - demand[i][j], i)):  # the largest demand first
            more = min(room, demand[i][j] - out[i][j]) if i != j else 0
            out[i][j] += more
            room -= more
    return out


def _votes(labels: DataFrame, edges: DataFrame | None) -> DataFrame:
    """(g, shard, votes, lead): linked documents of each shard, a text's own ones and its neighbours'.

    ``lead``, the least of a text and its neighbours, breaks ties, so that the ends of a link agree.
    """
    own = labels.select("g", "shard", F.col("cnt").alias("votes"))
    if edges is None:
        return own.withColumn("lead", F.col("g"))
    near = edges.join(labels.withColumnRenamed("g", "h"), "h").select("g", "shard", (F.col("weight") * F.col("cnt")).alias("votes"))
    least = edges.groupBy("g").agg(F.min("h").alias("least"))
    votes = own.unionByName(near).groupBy("g", "shard").agg(F.sum("votes").alias("votes")).join(least, "g", "left")
    return votes.withColumn("lead", F.coalesce(F.least("g", "least"), "g")).drop("least")


def _round(labels: DataFrame, edges: DataFrame | None, caps: list[int], only_free: bool, tables: Tables) -> tuple[DataFrame, int]:
    """Labels after one round, and how many documents moved."""
    shards = len(caps)
    held = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.sum("cnt").alias("n")).collect()}
    free = [c - held.get(j, 0) for j, c in enumerate(caps)]
    rank = F.struct("votes", F.xxhash64("lead", "shard"), "shard")
    votes = _votes(labels, edges).withColumn("rank", rank)
    open_ = [j for j in range(shards) if free[j] > 0 or not only_free]
    best = votes.where(F.col("shard").isin(open_)).groupBy("g").agg(F.max("rank").alias("best"))
    now = labels.join(votes.select("g", "shard", "rank"), ["g", "shard"]).join(best, "g", "left")
    now = now.withColumn("to", F.when(F.col("best") > F.col("rank"), F.col("best.shard")).otherwise(F.col("shard"))).select("g", "shard", "cnt", "to")
    now = tables.save(now)
    demand = [[0] * shards for _ in range(shards)]
    asked = now.where("to <> shard").groupBy("shard", "to").agg(F.sum("cnt").alias("n"), F.count("*").alias("rows")).collect()
    for r in asked:
        demand[r["shard"]][r["to"]] = r["n"]
    allow = quotas(demand, free)
    if not any(map(sum, allow)):
        return labels, 0
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in allow])
    moving = running(now.where("to <> shard"), ["shard", "to"], ["g"], sum(r["rows"] for r in asked), "cnt")
    quota = F.element_at(F.element_at(table, F.col("shard") + 1), F.col("to") + 1)
    moving = moving.withColumn("go", F.greatest(F.lit(0), F.least("cnt", quota - F.col("before"))))
    parts = moving.select("g", F.inline(F.array(F.struct(F.col("to").alias("shard"), F.col("go").alias("cnt")), F.struct("shard", (F.col("cnt") - F.col("go")).alias("cnt")))))
    after = now.where("to = shard").select("g", "shard", "cnt").unionByName(parts).where("cnt > 0").groupBy("g", "shard").agg(F.sum("cnt").alias("cnt"))
    after = tables.save(after)
    tables.drop(now, labels)
    return after, sum(map(sum, allow))


def propagate(linked: DataFrame, edges: DataFrame | None, caps: list[int], rounds: int, tables: Tables) -> DataFrame:
    """(g, shard, cnt) for the texts of ``linked`` (g, rows)."""
    shards = len(caps)
    first = running(linked.withColumn("_one", F.lit(1)), ["_one"], ["g"], linked.count(), "rows", "start")
    # Dealt out one by one to begin with: place p goes to shard p mod shards.
    upto = lambda p, k: F.floor((p + (shards - 1 - k)) / shards)  # noqa: E731  places below p in shard k
    deal = F.array(*[F.struct(F.lit(k).alias("shard"), (upto(F.col("start") + F.col("rows"), k) - upto(F.col("start"), k)).cast("long").alias("cnt")) for k in range(shards)])
    labels = tables.save(first.select("g", F.inline(deal)).where("cnt > 0"))
    still = 0
    for k in range(rounds):
        labels, moved = _round(labels, edges, caps, k % 2 == 1, tables)
        still = 0 if moved else still + 1
        if still == 2:
            break
    return labels


def _sentence(text: Column) -> Column:
    """The hash of a text's longest sentence; null if that is short."""
    sizes = F.transform(F.split(text, r"[.!?\n]+", -1), lambda x: F.struct(F.length(x).alias("n"), F.xxhash64(F.trim(x)).alias("h")))
    longest = F.array_max(sizes)
    return F.when(longest["n"] >= SENTENCE_CHARS, longest["h"])


def _edges(texts: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(g, h, weight), both ways, of texts (g, sentence) with one sentence, and of pairs (g, h)."""
    hubs = texts.where("sentence is not null").groupBy("sentence").agg(F.min("g").alias("h"), F.count("*").alias("n")).where("n > 1")
    found = texts.join(hubs, "sentence").select("g", "h")
    found = (found if pairs is None else found.unionByName(pairs)).where("g <> h")
    return found.unionByName(found.select(F.col("h").alias("g"), F.col("g").alias("h"))).groupBy("g", "h").agg(F.count("*").alias("weight"))


def cut_edges(sharded: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """(links, cut ones) of what ``shard_documents`` returned for ``df``, whose ids are unique: links of equal and of like texts."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").alias(id_col), F.xxhash64(text).alias("g"), _sentence(text).alias("sentence"))
    at = sharded.select(id_col, "shard").join(docs, id_col)
    texts = at.groupBy("g").agg(F.min_by("shard", id_col).alias("home"), F.any_value("sentence").alias("sentence"))
    own = at.join(texts.select("g", "home"), "g").agg((F.count("*") - F.count_distinct("g")).alias("n"), F.count_if(F.col("shard") != F.col("home")).alias("cut")).first()
    hubs = texts.where("sentence is not null").groupBy("sentence").agg(F.min_by("home", "g").alias("hub"), F.count("*").alias("n")).where("n > 1")
    near = texts.join(hubs, "sentence").agg((F.count("*") - F.count_distinct("sentence")).alias("n"), F.count_if(F.col("home") != F.col("hub")).alias("cut")).first()
    return own["n"] + near["n"], own["cut"] + near["cut"]


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, links: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per row: id, size, text_crc32, law, shard, slot (gapless in the shard) and grown_shard (null).

    ``links``: (src, dst) pairs of ids that should be together, besides equal texts and equal sentences.
    """
    tables = Tables(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = tables.save(
        df.select(
            F.col(f"`{id_col}`").alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"), _sentence(text).alias("sentence")
        )
    )
    total = docs.count()
    caps = capacities(total, shards)
    texts = docs.groupBy("g").agg(F.count("*").alias("rows"), F.any_value("sentence").alias("sentence"))
    docs = docs.drop("sentence")
    pairs = None
    if links is not None:
        of = docs.select("id", "g").distinct()
        pairs = links.select(F.col(links.columns[0]).alias("src"), F.col(links.columns[1]).alias("dst"))
        pairs = pairs.join(of.select(F.col("id").alias("src"), "g"), "src").join(of.select(F.col("id").alias("dst"), F.col("g").alias("h")), "dst").select("g", "h")
    edges = tables.save(_edges(texts, pairs))
    texts = texts.drop("sentence").join(edges.select("g").distinct().withColumn("near", F.lit(True)), "g", "left").where("rows > 1 or near").drop("near")
    linked = tables.save(texts)
    labels = propagate(linked, edges, caps, rounds, tables)
    held = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.sum("cnt").alias("n")).collect()}
    cuts = labels.groupBy(F.col("g").alias("_g")).agg(F.sum("cnt").alias("rows"), F.array_sort(F.collect_list(F.struct("shard", "cnt"))).alias("parts"))  # a row per shard at most
    of_text = docs.join(cuts, F.col("g") == F.col("_g"), "left").drop("_g")
    together = running(of_text.where("parts is not null"), ["g"], ["id", "size"], total, to="nth", key_rows="rows")
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(-1).alias("shard"))
    step = lambda a, p: F.when(a["upto"] > F.col("nth"), a).otherwise(F.struct((a["upto"] + p["cnt"]).alias("upto"), p["shard"].alias("shard")))
    together = together.withColumn("shard", F.aggregate("parts", start, step, lambda a: a["shard"]))
    room, ends = 0, []
    for j, c in enumerate(caps):
        room += c - held.get(j, 0)
        ends.append(room)
    alone = running(of_text.where("parts is null").withColumn("_one", F.lit(1)), ["_one"], ["id", "size", "g"], total, to="nth")
    fill = F.lit(shards - 1)
    for j in reversed(range(shards)):
        fill = F.when(F.col("nth") < ends[j], F.lit(j)).otherwise(fill)
    keep = ["id", "size", "text_crc32", "shard"]
    placed = together.select(*keep).unionByName(alone.withColumn("shard", fill).select(*keep))
    slots = running(placed, ["shard"], ["id", "size", "text_crc32"], total, to="slot")
    return slots.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
