"""The data source of logs: byte ranges, pushed filters, bad files and lines, commits."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qaloom.sources import log_format

SCHEMA = "question_id long, producer string, answer string, good boolean, cost double, retrieved array<struct<doc:string,rank:int>>"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    log_format.register(spark)
    at = tmp_path_factory.mktemp("log")
    rng = random.Random(4)
    rows = [{"question_id": k, "producer": rng.choice(["p0", "p1", "é2", None]), "answer": "x" * rng.randrange(60) + "é\n", "good": rng.random() < 0.5, "cost": k / 4, "retrieved": [{"doc": "d", "rank": 1}] * (k % 3)} for k in range(500)]
    for n in range(3):
        (at / f"part{n}.jsonl").write_text("".join(json.dumps(r, ensure_ascii=n > 0) + "\n" * (1 + r["question_id"] % 2) for r in rows[n::3]))
    return str(at), rows


def read(spark, path, schema=SCHEMA, **options):
    return spark.read.format("answer_log").schema(schema).options(**options).load(path)


def test_ranges_read_each_line_once(spark, log):
    path, rows = log
    for part_bytes in (1, 2, 7, 50, 997, 1 << 20):
        reader = log_format.LogReader(StructType(), path, part_bytes)
        seen = sorted((p.path, at, line) for p in reader.partitions() for at, line in reader.lines(p))
        assert [json.loads(x) for *_, x in seen] == rows[0::3] + rows[1::3] + rows[2::3], part_bytes
        for file, at, line in seen:
            with open(file, "rb") as f:
                f.seek(at)
                assert f.readline().rstrip(b"\n") == line
    got = read(spark, path, part_bytes="9000").orderBy("question_id").collect()
    assert [r.asDict(True) for r in got] == rows


def test_filters_are_pushed_and_right(spark, log):
    path, rows = log
    df = read(spark, path)
    tests = {
        "producer = 'p1' AND question_id >= 100": lambda r: r["producer"] == "p1" and r["question_id"] >= 100, "producer IN ('p0', 'é2') AND NOT good": lambda r: r["producer"] in ("p0", "é2") and not r["good"],
        "producer IS NULL": lambda r: r["producer"] is None, "producer LIKE 'é%'": lambda r: (r["producer"] or "").startswith("é"), "NOT producer = 'p0'": lambda r: r["producer"] not in (None, "p0"),
        "cost > 60 AND question_id < 250": lambda r: r["cost"] > 60 and r["question_id"] < 250, "size(retrieved) = 2 AND good": lambda r: len(r["retrieved"]) == 2 and r["good"],
    }
    for sql, keep in tests.items():
        assert sorted(r["question_id"] for r in df.where(sql).collect()) == [r["question_id"] for r in rows if keep(r)], sql
    plan = df.where("producer = 'p1' AND cost > 60")._jdf.queryExecution().executedPlan().toString()
    left = next(line for line in plan.splitlines() if "Filter (" in line)
    assert "cost" in left and "producer" not in left  # Spark is left with the comparison of fractions alone


def test_bad_files_and_lines_are_named(spark, log, tmp_path):
    path, rows = log
    for name, text in (("a", '{"question_id": 1}\n[1]\nnot json\n{"question_id": "x"}\n{"question_id": 2, "cost": 0.5}'), ("b", "\x00\x01\n")):
        (tmp_path / f"{name}.jsonl").write_text(text)
    (tmp_path / "c.jsonl").symlink_to(tmp_path / "a.jsonl")
    (tmp_path / "gone.jsonl").write_text('{"question_id": 9}')
    os.chmod(tmp_path / "gone.jsonl", 0)
    got = read(spark, str(tmp_path), SCHEMA + ", _bad string").collect()
    good = sorted(r["question_id"] for r in got if r["_bad"] is None)
    assert [x for x in good if x != 9] == [1, 1, 2, 2]  # one who may read all files reads the ninth
    bad = [r["_bad"] for r in got if r["_bad"]]
    assert sum("a.jsonl:" in x for x in bad) == 3 == sum("c.jsonl:" in x for x in bad) and sum("b.jsonl:0" in x for x in bad) == 1
    assert sorted(r["question_id"] for r in read(spark, str(tmp_path)).where("question_id < 9").collect()) == [1, 1, 2, 2]


def test_commits_and_aborts(spark, log, tmp_path):
    path, rows = log
    to = str(tmp_path / "out")
    df = read(spark, path)
    df.repartition(3).write.format("answer_log").mode("append").save(to)
    assert read(spark, to).exceptAll(df).count() == 0 and read(spark, to).count() == 500
    failing = df.withColumn("answer", F.when(F.col("question_id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("answer")))
    with pytest.raises(Exception, match="stop"):
        failing.repartition(3).write.format("answer_log").mode("append").save(to)
    assert read(spark, to).count() == 500 and not [n for n in os.listdir(to) if n.startswith(".staged")]
    df.where("question_id < 10").write.format("answer_log").mode("overwrite").save(to)
    assert read(spark, to).count() == 10
    assert read(spark, str(tmp_path / "nowhere")).count() == 0
