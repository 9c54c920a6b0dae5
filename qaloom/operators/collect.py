"""Calls to outside models as rows: a provider is a seam, an error is a row, retries happen in the task."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators import worklist
from qaloom.operators.checks import require_empty
from qaloom.sources import sinks
from qaloom.sources.durable import Tables
from qaloom.sources.records import exists

TRIES, RATE_LIMIT_WAIT = 4, 65.0  # fixed values
COMPLETION = "answer string, latency_s double, prompt_tokens int, completion_tokens int, error string"
TRANSIENT = r"(?i)rate.?limit|429|timeout|timed out|connection|overloaded|unavailable|50[0234]"


def is_transient(error: Column) -> Column:
    """Whether an error may pass by itself."""
    return F.coalesce(error.rlike(TRANSIENT), F.lit(False))


def with_retry(call: Callable[[], dict], transient: Callable[[Exception], bool], limited: Callable[[Exception], bool], wait: Callable[[float], None] = time.sleep) -> dict:
    """The call's result; transient failures are tried again, waiting longer each time."""
    for n in range(TRIES):
        try:
            return call()
        except Exception as e:  # noqa: BLE001  classified below
            if n + 1 == TRIES or not transient(e):
                raise
            wait(RATE_LIMIT_WAIT if limited(e) else 2 * 2**n + random.random())
    raise AssertionError


def collect(todo: DataFrame, provider: Callable[[str, str], dict], local: bool = False, parallel: int = 8) -> DataFrame:
    """``todo`` (question_id, producer, model, prompt) with COMPLETION.

    provider(model, prompt) gives answer, prompt_tokens and completion_tokens.  A local model is
    called from one task, a remote one from ``parallel``.  A retried task repeats its calls: write
    the result before using it twice, and leave speculation off.
    """
    import re

    seen = re.compile(TRANSIENT)

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for model, prompt in zip(pdf["model"], pdf["prompt"], strict=True):
                at = time.monotonic()
                try:
                    got = with_retry(lambda: provider(model, prompt), lambda e: bool(seen.search(str(e))), lambda e: "429" in str(e))  # noqa: B023
                    rows.append((got["answer"], time.monotonic() - at, got.get("prompt_tokens"), got.get("completion_tokens"), None))
                except Exception as e:  # noqa: BLE001  becomes a row
                    rows.append((None, time.monotonic() - at, None, None, f"{type(e).__name__}: {e}"))
            yield pdf.assign(**dict(zip(("answer", "latency_s", "prompt_tokens", "completion_tokens", "error"), map(list, zip(*rows, strict=True)), strict=True))) if rows else pdf.iloc[:0].assign(answer=None, latency_s=None, prompt_tokens=None, completion_tokens=None, error=None)

    dealt = todo.coalesce(1) if local else todo.repartition(parallel)
    schema = ", ".join(f"{n} {k}" for n, k in todo.dtypes)
    return dealt.mapInPandas(work, f"{schema}, {COMPLETION}")


def _quoted(value: str) -> str:
    """A string literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Clients:
    """Clients by provider, made when first asked for, once a worker; a missing key fails before any call."""

    def __init__(self, make: dict[str, Callable[[str], Callable[[str, str], dict]]], keys: dict[str, str]):
        self.make, self.keys, self.made = make, keys, {}

    def __getstate__(self) -> dict:
        return {"make": self.make, "keys": self.keys, "made": {}}

    def require(self, provider: str) -> str:
        if provider not in self.make:
            raise KeyError(f"unknown provider {provider!r}")
        if not self.keys.get(provider):
            raise PermissionError(f"no key for {provider!r}")
        return self.keys[provider]

    def get(self, provider: str) -> Callable[[str, str], dict]:
        if provider not in self.made:
            self.made[provider] = self.make[provider](self.require(provider))
        return self.made[provider]


def echo(key: str) -> Callable[[str, str], dict]:
    """An offline provider that says the prompt again; an empty prompt is an error."""

    def call(model: str, prompt: str) -> dict:
        if not prompt:
            raise ValueError("empty prompt")
        return {"answer": f"said: {prompt}", "prompt_tokens": len(prompt.split()), "completion_tokens": len(prompt.split())}

    return call


def ping(clients: Clients, models: Sequence[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(producer, 'ok' or what is wrong) of (producer, provider, model): one short call each."""
    out = []
    for producer, provider, model in models:
        try:
            clients.get(provider)(model, "ping")
            out.append((producer, "ok"))
        except Exception as e:  # noqa: BLE001  it is the report
            out.append((producer, f"{type(e).__name__}: {e}"))
    return out


def run_producer(spark: SparkSession, producer: str, model: str, questions: DataFrame, path: str, provider: Callable[[str, str], dict], local: bool = False, at_once: int = 1000, retry_errors: bool = True) -> int:
    """Answer what is left of (question_id, prompt), appending to the log at ``path``; how many were asked.

    Rows of errors go first, so that they are asked again.  Good answers by another model stop the run before any call.  Questions
    go in slices of about ``at_once``, each appended when it is done: a run that breaks off loses one slice.
    """
    schema = f"question_id {dict(questions.dtypes)['question_id']}, producer string, model string, prompt string, {COMPLETION}, ts timestamp"
    if exists(spark, path):
        mine = spark.read.schema(schema).parquet(path).where(F.col("producer") == producer)
        require_empty(worklist.model_mix(mine.where(F.coalesce("error", F.lit("")) == ""), mine.sparkSession.createDataFrame([(producer, model)], "producer string, expected_model string")), "answers by another model")
        if retry_errors:
            sinks.delete_rows(spark, path, schema, f"producer = {_quoted(producer)} AND coalesce(error, '') <> ''")
    else:
        spark.createDataFrame([], schema).write.parquet(path)
    said = spark.read.schema(schema).parquet(path)
    who = spark.createDataFrame([(producer,)], "producer string")
    left = worklist.todo(questions, who, said).join(questions, "question_id").select("question_id", "producer", F.lit(model).alias("model"), "prompt")
    tables = Tables(spark)
    work = tables.save(left)
    n = work.count()
    slices = max(1, -(-n // at_once))
    for k in range(slices if n else 0):
        part = work.where(F.pmod(F.xxhash64("question_id"), F.lit(slices)) == k)
        sinks.append(collect(part, provider, local).withColumn("ts", F.current_timestamp()), path)
    tables.drop(work)
    return n


def reset(spark: SparkSession, path: str, schema: str, known: Sequence[str], producer: str | None = None, errors: bool = False, confirm: Callable[[str], bool] = lambda what: False) -> int:
    """Delete a producer's answers, its errors, or all errors, once ``confirm`` agrees; how many went.

    Nothing selected, or an unknown producer, raises.
    """
    if producer is None and not errors:
        raise ValueError("nothing selected: name a producer, or errors")
    if producer is not None and producer not in known:
        raise ValueError(f"unknown producer {producer!r}; known: {', '.join(known)}")
    bad, mine = "coalesce(error, '') <> ''", f"producer = {_quoted(producer or '')}"
    doomed = " AND ".join([mine] * (producer is not None) + [bad] * errors)
    rows = spark.read.schema(schema).parquet(path).where(doomed)
    n, models = rows.count(), sorted(r["model"] for r in rows.select("model").distinct().collect())
    if not confirm(f"{n} rows of {producer or 'all producers'}{', errors only' if errors else ''}, by {', '.join(map(str, models)) or 'no model'}"):
        return 0
    return sinks.delete_rows(spark, path, schema, doomed)
