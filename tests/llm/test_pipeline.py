"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from qaloom.llm.mixing import mix_sources
from tests.llm.conftest import DIR, WORD
from tests.llm.test_ngram_join import brute
from tests.llm.test_quality_secrets import base, spans


def staged(spark, docs, tmp_path):
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path / f"{k}.parquet")
        stage(spark, out[-1], DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(spark, documents, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "ngram_jaccard_join", "secret_scans", "source_mixing", "best_fit_packing"]
    docs, good, unique, clean, mixed, packed = staged(spark, documents, tmp_path)
    assert all(x.columns == cp.COLUMNS for x in (good, unique, clean, mixed))
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if not base(r["text"])[-1] and r["doc_id"] in kept} and len(kept) > 150
    assert {r["doc_id"] for r in unique.collect()} == {i for i, _, c in brute([(r["doc_id"], r["text"]) for r in good.collect()]) if i == c}
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    for r in clean.collect():
        assert not spans(r["text"]) and r["n_chars"] == len(r["text"]) and (r["text"] == before[r["doc_id"]] or spans(before[r["doc_id"]]))
    whole = {r["doc_id"]: r["text"] for r in clean.collect()}
    times, cut = Counter(), 0
    for r in mixed.collect():
        times[r["doc_id"]] += 1
        if r["text"] != whole[r["doc_id"]]:
            cut += 1
            words = WORD.findall(r["text"])
            assert words == WORD.findall(whole[r["doc_id"]])[: len(words)]
        assert r["n_chars"] == len(r["text"])
    assert max(times.values()) <= 3 and cut <= 20
    assert abs(sum(len(WORD.findall(r["text"])) for r in mixed.collect()) - sum(len(WORD.findall(t)) for t in whole.values())) <= 20
    assert packed.select("doc_id").where("piece = 0").count() == mixed.count()
    assert Counter(tuple(r) for r in cp.run(spark, DIR).select("doc_id", "piece", "length", "ids_crc32").collect()) == Counter(tuple(r) for r in packed.select("doc_id", "piece", "length", "ids_crc32").collect())


def test_odd_rows_pass_all_stages(spark, odd, empty, tmp_path):
    """Nulls, repeated rows, one id with two texts, an empty and a very long text, and extra columns, stage by stage."""
    text = lambda k, n=40: " ".join(f"word{k}x{i}" for i in range(n))
    rows = [
        (1, text(1), "en", "a", 1), (1, text(1), "en", "a", 1), (1, text(2), "en", "a", 2), (2, text(1) + " end", None, "b", None), (3, text(3) + " token=abcd1234", "en", None, 4),
        (None, text(4), "en", "a", 5), (None, text(4), "en", "a", 5), (4, None, None, None, None), (5, "", "en", "a", 0), (6, "few words", "en", "a", 9), (7, text(7, 40_000), "en", "b", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS id", "'x' AS n", "2 AS size", "3 AS _key", "array(1) AS segments")
    _, good, unique, clean, mixed, packed = staged(spark, docs, tmp_path)
    key = lambda df: sorted(str((r["doc_id"], (r["text"] or "")[:9])) for r in df.collect())
    kept = [(1, text(1)), (1, text(2)), (3, text(3)), (None, text(4)), (7, text(7))]
    assert key(good) == sorted(str((i, t[:9])) for i, t in [*kept, (1, text(1)), (2, text(1)), (None, text(4))])
    assert key(unique) == key(clean) == sorted(str((i, t[:9])) for i, t in kept)
    assert {r["doc_id"]: r["text"] for r in clean.collect()}[3] == text(3) + " [SECRET]"
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    held = {(r["doc_id"], r["source"]): len(WORD.findall(r["text"])) for r in clean.collect()}
    assert set(words) <= set(held) and sum(words.values()) > 0
    assert packed.where("piece = 0").count() == mixed.count() and packed.agg({"length": "max"}).first()[0] == 2048
    (tmp_path / "none").mkdir()
    assert staged(spark, empty, tmp_path / "none")[-1].count() == 0


def test_the_mix_comes_by_shard(spark, documents):
    """In each partition, documents that the mix takes once stand by shard and place."""
    out = cp.mixture(spark, documents, DIR).withColumn("part", F.spark_partition_id())
    first: dict[int, dict[int, tuple[int, int]]] = {}
    for r in mix_sources(documents).collect():
        for s in sorted(r["segments"]):
            first.setdefault(r["doc_id"], {}).setdefault(s["epoch"], (s["shard"], s["place"]))
    at: dict[int, list[tuple[int, int]]] = {}
    for r in out.collect():
        found = list(first[r["doc_id"]].values())
        if len(found) == 1:
            at.setdefault(r["part"], []).append(found[0])
    assert sum(map(len, at.values())) > 50 and all(x == sorted(x) for x in at.values())
