from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions import text as t


def one(spark, value, column, name="x"):
    return spark.createDataFrame([(value,)], f"{name} string").select(column.alias("r")).first()["r"]


def test_answer_types(spark):
    cases = {"25% off": "numeric", "at 10:00 am": "numeric", "lkr 5": "numeric", "1,000": "numeric", "3 Hours": "numeric", "you MUST bring it": "procedural", "mustard": "factual", "": "factual"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", t.answer_type(F.col("x")).alias("r")).collect()
    assert {r["x"]: r["r"] for r in rows} == cases


def test_number_grounding(spark):
    cases = [("1,000 LKR", "costs 1000", False), ("1,000,", "1000", False), ("12", "120", False), ("7", "eight", True), ("none", "", False)]
    rows = spark.createDataFrame(cases, "a string, e string, want boolean").select("want", t.ungrounded(F.col("a"), F.col("e")).alias("r")).collect()
    assert all(r["want"] == r["r"] for r in rows)


def test_chunks_at_the_edges(spark):
    for n, want in ((0, 0), (200, 0), (201, 1), (1200, 1), (1201, 1), (1401, 2)):
        assert len(one(spark, "x" * n, t.fixed_chunks(F.col("x")))) == want, n
    assert one(spark, " " * 1000 + "y" * 100, t.fixed_chunks(F.col("x"))) == []
    found = one(spark, "a" * 1200 + "\t" + "b" * 300, t.fixed_chunks(F.col("x")))
    assert [(c["chunk"], len(c["body"])) for c in found] == [(0, 1200), (1, 300)]


def test_front_matter_tolerates_a_stray_bar(spark):
    head = "Ref: SGH-LAB-001 | Issued: 01 | June 2026 Rev: 2.1 | Dept: Lab, Block C | Valid Until: 30 | September 2026"
    got = {k: one(spark, head, c) for k, c in t.front_matter(F.col("x")).items()}
    assert got == {"doc_id": "SGH-LAB-001", "issued": "01 June 2026", "rev": "2.1", "dept": "Lab, Block C", "valid_until": "30 September 2026"}
    assert one(spark, "nothing", t.front_matter(F.col("x"))["rev"]) == ""


def test_footers_titles_and_fees(spark):
    assert one(spark, "page 3 OF 12", t.is_footer(F.col("x")))
    assert one(spark, " House ", t.is_footer(F.col("x"), ["HOUSE"]))
    assert not one(spark, "Page of", t.is_footer(F.col("x"), ["HOUSE"]))
    assert one(spark, "FAQ -  Lab - Tests.PDF", t.title_of(F.col("x"))) == "FAQ — Lab — Tests"
    assert [one(spark, v, t.fee(F.col("x"))) for v in (" 500 ", "5%", "Free")] == ["500 LKR", "5%", "Free"]


def test_token_sets_and_similarity(spark):
    assert sorted(one(spark, "The CAT's  cat!", t.tokens(F.col("x")))) == ["cat", "s", "the"]
    both = spark.range(1).select(*[t.similar(F.lit(i), F.lit(a), F.lit(b)).alias(n) for n, i, a, b in (("edge", 4, 5, 4), ("below", 4, 5, 5), ("none", 0, 0, 0))]).first()
    assert (both["edge"], both["below"], both["none"]) == (True, False, False)


def test_strip_takes_all_white_space(spark):
    assert one(spark, " \t x y \n", t.strip(F.col("x"))) == "x y"
    assert one(spark, "a\n\n\n\nb", t.squeeze_blank_lines(F.col("x"))) == "a\n\nb"
