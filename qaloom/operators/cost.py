"""Prices and estimates.  The price table is an input: (model, inp, out, train), USD a million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.operators.checks import require_empty

TUNED_MULTIPLIER = 2.0  # fixed value: a tuned model's price over its base


def priced(df: DataFrame, prices: DataFrame, model: str = "model", strict: bool = True) -> DataFrame:
    """``df`` with inp, out and train; a tuned id, ft:base:..., costs its base's price times a multiplier.

    A model without a price raises, if ``strict``.
    """
    base = F.get(F.split(F.col(model), ":"), F.lit(1))
    tuned = F.col(model).startswith("ft:")
    own = F.broadcast(prices.select(F.col("model").alias("_own"), F.col("inp").alias("_i"), F.col("out").alias("_o"), F.col("train").alias("_t")))
    of_base = F.broadcast(prices.select(F.col("model").alias("_base"), F.col("inp").alias("_bi"), F.col("out").alias("_bo"), F.col("train").alias("_bt")))
    joined = df.join(own, F.col(model) == F.col("_own"), "left").join(of_base, tuned & F.col("_own").isNull() & (base == F.col("_base")), "left")
    if strict:
        require_empty(joined.where("_own is null and _base is null").select(model), "no price")
    pick = lambda a, b: F.when(F.col("_own").isNotNull(), F.col(a)).otherwise(F.col(b) * TUNED_MULTIPLIER)
    train = F.coalesce("_t", "_bt")
    return joined.withColumns({"inp": pick("_i", "_bi"), "out": pick("_o", "_bo"), "train": train}).drop("_own", "_i", "_o", "_t", "_base", "_bi", "_bo", "_bt")


def cost(prompt: Column, completion: Column) -> Column:
    """USD of a call, of a priced row."""
    return (prompt * F.col("inp") + completion * F.col("out")) / 1_000_000


def estimate(producers: DataFrame, questions: DataFrame, prices: DataFrame, system: int, context: int, train_tokens: int, epochs: int, cap: int, job_floor: float = 4.0) -> DataFrame:
    """A ceiling for each producer: input and output tokens, inference and training USD.

    producers: (producer, method, model, is_local, trains_remotely); questions: (q_tokens).
    Retrieval adds ``context`` tokens a question; a remote training job costs its flat floor.
    """
    asked = questions.agg(F.count("*").alias("calls"), F.coalesce(F.sum("q_tokens"), F.lit(0)).alias("q_sum"))
    rows = priced(producers, prices).crossJoin(F.broadcast(asked))
    each = F.lit(system) + F.when(F.col("method") == "rag", context).otherwise(0)
    rows = rows.withColumns({"in_tokens": F.col("q_sum") + F.col("calls") * each, "out_tokens": F.col("calls") * cap})
    tuned = (F.col("method") == "finetuned") & ~F.col("is_local")
    rate = F.when(tuned, F.lit(TUNED_MULTIPLIER)).otherwise(1.0)
    train = F.when(F.col("trains_remotely"), F.lit(job_floor)).when(tuned, train_tokens * epochs * F.coalesce("train", F.lit(0.0)) / 1_000_000).otherwise(0.0)
    return rows.select("producer", "calls", "in_tokens", "out_tokens", (cost(F.col("in_tokens"), F.col("out_tokens")) * rate).alias("infer_usd"), train.alias("train_usd"))


def judge_estimate(questions: DataFrame, producers: int, inp: float, out: float, rubric: int, scaffold: int, answer_cap: int = 300, output_cap: int = 512, thinking: int = 400, discount: float = 0.5) -> DataFrame:
    """(scenario, calls, in_tokens, out_tokens, sync_usd, batched_usd) from (q_tokens, doc_tokens) of each question."""
    total = questions.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("q_tokens") + F.col("doc_tokens")), F.lit(0)).alias("own"))
    total = total.select((F.col("n") * producers).alias("calls"), ((F.col("own") + F.col("n") * (rubric + scaffold + answer_cap)) * producers).alias("in_tokens"))
    cases = F.explode(F.array(F.struct(F.lit("plain").alias("scenario"), F.lit(output_cap).alias("cap")), F.struct(F.lit("thinking").alias("scenario"), F.lit(output_cap + thinking).alias("cap"))))
    rows = total.select("calls", "in_tokens", cases.alias("c")).select(F.col("c.scenario").alias("scenario"), "calls", "in_tokens", (F.col("calls") * F.col("c.cap")).alias("out_tokens"))
    sync = (F.col("in_tokens") * F.lit(inp) + F.col("out_tokens") * F.lit(out)) / 1_000_000
    return rows.withColumns({"sync_usd": sync, "batched_usd": sync * discount})


def section_tokens(sections: DataFrame, default: int = 400) -> int:
    """Mean tokens of a section (heading, content): what retrieval injects; ``default`` without sections."""
    from qaloom.functions.text import token_count

    row = lambda r: F.array_join(r, " ")
    none = F.array().cast("array<string>")
    part = lambda b: (
        F.when(b["kind"] == "para", F.array(b["text"])).when(b["kind"] == "bullets", b["items"])
        .when(b["kind"] == "table", F.concat(F.array(row(b["header"])), F.transform(b["rows"], row))).otherwise(none)
    )
    text = F.array_join(F.concat(F.array("heading"), F.flatten(F.transform("content", part))), "\n")
    mean = sections.agg(F.avg(token_count(text)).alias("mean")).first()["mean"]
    return default if mean is None else round(mean)


def train_tokens(train: DataFrame) -> int:
    """Tokens of all messages of training records."""
    from qaloom.functions.text import token_count

    return train.select(F.explode("messages").alias("m")).agg(F.coalesce(F.sum(token_count(F.col("m.content"))), F.lit(0)).alias("n")).first()["n"]
