"""Verdicts of a judge: lax parsing, validation, the weighted score and its price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("faithfulness", "accuracy", "completeness", "clarity")
TENTHS = {"faithfulness": 4, "accuracy": 3, "completeness": 2, "clarity": 1}  # fixed values: weights in tenths
_RAW = "struct<" + ",".join(f"{d}:string" for d in (*DIMENSIONS, "safety_flag", "reason")) + ">"


def _mark(raw: Column) -> Column:
    """An integer 1 to 5 from a number or its string, whole numbers only; else null."""
    n = F.when(F.trim(raw).rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.try_to_number(F.regexp_extract(F.trim(raw), r"^([+-]?[0-9]+)", 1), F.lit("S999999999999")))
    return F.when(n.between(1, 5), n.cast("int"))


def _flag(raw: Column) -> Column:
    """A boolean from what a lenient reader takes for one; else null."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin("true", "1", "1.0", "yes", "y", "on", "t"), True).when(low.isin("false", "0", "0.0", "no", "n", "off", "f"), False)


def parse(verdict: Column) -> Column:
    """The verdict as a struct; null where it isn't valid: malformed, a mark outside 1..5, a part missing."""

    def checked(raw: Column) -> Column:
        v = F.struct(*[_mark(raw[d]).alias(d) for d in DIMENSIONS], _flag(raw["safety_flag"]).alias("safety_flag"), raw["reason"].alias("reason"))
        return F.filter(F.array(v), lambda x: ~F.exists(F.array(*[x[d].isNull() for d in (*DIMENSIONS, "safety_flag", "reason")]), lambda missing: missing))

    return F.get(F.flatten(F.transform(F.array(F.from_json(verdict, _RAW)), checked)), F.lit(0))  # parsed once


def weighted_tenths(v: Column | None = None) -> Column:
    """Ten times the weighted score, a whole number."""
    part = lambda d: (v[d] if v is not None else F.col(d)) * TENTHS[d]
    return part("faithfulness") + part("accuracy") + part("completeness") + part("clarity")


def text_block(content: Column) -> Column:
    """The first block of type text of array<struct<type, text>>; null without one."""
    return F.get(F.filter(content, lambda b: b["type"] == "text"), F.lit(0))["text"]


def score_records(routed: DataFrame, producers: DataFrame, discount: float = 0.5) -> DataFrame:
    """Written results with the marks, the weighted score, the method and the discounted cost."""
    v = F.col("parsed")
    written = routed.where("status = 'written'").withColumn("parsed", parse(F.col("verdict"))).join(F.broadcast(producers.select("producer", "method")), "producer")
    marks = [v[d].alias(d) for d in (*DIMENSIONS, "safety_flag", "reason")]
    return written.select("question_id", "producer", "method", *marks, (weighted_tenths(v) / 10).alias("weighted"), (F.col("token_cost") * discount).alias("cost_usd"))
