from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.operators import cleaning
from qaloom.sources import records, sinks
from qaloom.streaming import append_log

LINE = "doc string, page int, line int, x0 double, y0 double, y1 double, h double, text string, bold boolean, all_bold boolean"


def line(page, n, x, y, text, bold=False, doc="FAQ - X.pdf"):
    return (doc, page, n, float(x), float(y), float(y) + 10, 10.0, text, bold, bold)


def test_rows_hang_on_their_first_line(spark):
    df = spark.createDataFrame([line(1, k, k, 100 + 4 * k, str(k)) for k in range(4)], LINE)
    rows = cleaning.roll_up(cleaning.visual_rows(df)).orderBy("row").collect()
    assert [r["text"] for r in rows] == ["0 1", "2 3"]  # 4 points each: 8 from the first is too far


def test_spans(spark):
    span = "doc string, page int, line int, span int, size double, font string, flags int, text string, x0 double, y0 double, x1 double, y1 double"
    rows = [("d", 0, 1, 1, 10.0, "Arial", 16, " a  ", 5.0, 1.0, 9.0, 11.0), ("d", 0, 1, 2, 10.0, "Arial", 0, "b", 9.0, 2.0, 12.0, 12.0), ("d", 0, 2, 1, 5.0, "Arial", 0, "tiny", 0.0, 0.0, 0.0, 0.0), ("d", 0, 3, 1, 9.0, "Nirmala", 0, "x", 0.0, 0.0, 0.0, 0.0), ("d", 0, 4, 1, 9.0, "Arial", 0, "•", 0.0, 0.0, 0.0, 0.0)]
    got = cleaning.lines_from_spans(spark.createDataFrame(rows, span)).collect()
    assert [(r["text"], r["x0"], r["y0"], r["y1"], r["h"], r["bold"], r["all_bold"]) for r in got] == [("a b", 5.0, 1.0, 12.0, 11.0, True, False)]


def test_a_document_becomes_markdown(spark):
    rows = [
        line(0, 0, 57, 60, "LETTERHEAD"), line(0, 1, 300, 100, "Ref: SGH-LAB-001 Rev: 1.0"), line(0, 2, 300, 112, "Dept: Lab"),
        line(0, 3, 57, 150, "Intro sentence that ends here."), line(0, 4, 57, 170, "TESTS", True),
        line(0, 5, 57, 200, "Name"), line(0, 6, 200, 200, "Price"), line(0, 7, 57, 230, "Blood"), line(0, 8, 200, 230, "5"), line(0, 9, 200, 240, "only"),
        line(1, 0, 57, 50, "Page 2 of 2"), line(1, 1, 57, 70, "Why?", True), line(1, 2, 57, 90, "short item"), line(1, 3, 57, 110, "A first line,"), line(1, 4, 57, 121, "and its end."),
    ]
    got = cleaning.markdown(cleaning.clean_documents(spark.createDataFrame(rows, LINE), letterheads=["LETTERHEAD"])).first()
    assert (got["doc_id"], got["rev"], got["dept"], got["title"]) == ("SGH-LAB-001", "1.0", "Lab", "FAQ — X")
    want = "Intro sentence that ends here.\n\n## TESTS\n\n| Name | Price |\n| --- | --- |\n| Blood | 5 only |\n\n### Why?\n- short item\n\nA first line, and its end."
    assert got["body"] == want
    assert got["markdown"].startswith('---\nsource_pdf: "FAQ - X.pdf"\ndoc_id: "SGH-LAB-001"\n')
    assert got["markdown"].endswith('valid_until: ""\n---\n# FAQ — X\n\n' + want + "\n")


def test_anchors_and_nearest(spark):
    pts = spark.createDataFrame([("g", i, x) for i, x in enumerate((10.0, 30.0, 50.0, 100.0, 111.0))], "g string, id long, x double")
    found = cleaning.anchors(pts, "g", "x").orderBy("anchor_no").collect()
    assert [(r["anchor"], r["n"]) for r in found] == [(30.0, 3), (105.5, 2)]
    two = spark.createDataFrame([("g", 0, 0.0), ("g", 1, 20.0)], "g string, anchor_no long, anchor double")
    near = {r["id"]: r["anchor_no"] for r in cleaning.nearest_anchor(pts, two, "g", "id", "x").collect()}
    assert near[0] == 0 and near[1] == 1  # 10 is as near to both: the first wins


def test_readers_and_sinks(spark, tmp_path):
    assert records.read_jsonl(spark, str(tmp_path / "none.jsonl"), "answers").count() == 0
    scores = spark.createDataFrame([("q", "p", 'says "x",\nand more')], "question_id string, producer string, reason string")
    full = records.read_csv(spark, str(tmp_path / "none.csv"), "scores").unionByName(scores, allowMissingColumns=True)
    full.write.csv(str(tmp_path / "scores"), header=True, quote='"', escape='"')
    assert records.read_csv(spark, str(tmp_path / "scores"), "scores").first()["reason"] == 'says "x",\nand more'
    log = str(tmp_path / "log")
    sinks.append(spark.range(5), log)
    assert sinks.delete_rows(spark, log, "id long", "id >= 3") == 2 and spark.read.parquet(log).count() == 3
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    new = spark.createDataFrame([("a", None, "z"), ("c", 3, None)], "k string, n int, s string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, "k").collect()) == [("a", 1, "z"), ("b", 2, "y"), ("c", 3, None)]
    (tmp_path / "m.json").write_text('{"batch_id": "b", "manifest": {"q--p00": {"question_id": "q", "producer": "p"}}}')
    assert tuple(records.read_manifest(spark, str(tmp_path / "m.json")).first()) == ("q--p00", "q", "p")
    (tmp_path / "f.txt").write_text("abc")
    assert sinks.digests(spark, str(tmp_path / "f.txt")).first()["sha256"].startswith("ba7816bf")


def test_the_append_log_takes_a_key_once(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([(1, "p"), (1, "p"), (2, "p")], "question_id long, producer string").write.parquet(source)
    append_log.append_new(spark.createDataFrame([(2, "p")], "question_id long, producer string"), log, ["question_id", "producer"])
    stream = spark.readStream.schema("question_id long, producer string").parquet(source)
    append_log.start(stream, log, str(tmp_path / "state"), ["question_id", "producer"]).awaitTermination()
    assert sorted(r["question_id"] for r in spark.read.parquet(log).collect()) == [1, 2]
    assert spark.read.parquet(log).where(F.col("producer").isNull()).count() == 0
