"""Calls to a provider under one budget for all tasks, each made once.

Tasks of a barrier stage run at the same time, agree on a start, and share out time: call number j of
task i of n may begin at start + (j * n + i) / rate.  So no more than ``rate`` calls begin in any
second, whichever tasks make them, and nobody waits for a permit.  A task makes its calls in
threads, so a slow answer doesn't hold up the next call.

A finished call is written to a log in a shared folder before its task makes another one in that
thread.  A task that runs again, or a run that is started again, reads what the logs have and asks
only for the rest; calls under way when a task died are the only ones that can be made twice, ``threads`` of a task at most.
Errors that may pass are tried again within the same schedule.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.operators.collect import COMPLETION, TRIES
from qaloom.sources.records import exists

LOG = f"question_id string, producer string, {COMPLETION}"


class Schedule:
    """The moments at which one task may begin a call."""

    def __init__(self, start: float, task: int, tasks: int, rate: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.next, self.step, self.clock, self.sleep, self.lock = start + task / rate, tasks / rate, clock, sleep, threading.Lock()

    def wait(self) -> float:
        """Until the task's next moment, which is returned.  A moment that passed unused is lost: none is made up for in a burst."""
        with self.lock:
            now = self.clock()
            if self.next < now:
                self.next += self.step * -(-(now - self.next) // self.step)
            at = self.next
            self.next += self.step
        while (left := at - self.clock()) > 0:
            self.sleep(left)
        return at


class Log:
    """Finished calls of one attempt of a task: a file of JSON lines in a folder of any file system that Arrow knows."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.fs, self.at = FileSystem.from_uri(folder)
        self.fs.create_dir(self.at, recursive=True)
        self.out, self.lock = None, threading.Lock()

    def finished(self) -> dict[tuple[str, str], dict]:
        """What earlier attempts and runs finished; a line that a dying task cut short counts for nothing."""
        from pyarrow.fs import FileSelector

        found = {}
        for file in self.fs.get_file_info(FileSelector(self.at)):
            for line in self.fs.open_input_stream(file.path).readall().decode("utf-8", "replace").split("\n"):
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                found[row["question_id"], row["producer"]] = row
        return found

    def add(self, row: dict) -> None:
        with self.lock:
            if self.out is None:
                self.out = self.fs.open_output_stream(f"{self.at}/{uuid.uuid4().hex}.jsonl")
            self.out.write((json.dumps(row) + "\n").encode())
            self.out.flush()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def call_once(schedule: Schedule, provider: Callable[[str, str], dict], transient: Callable[[str], bool], key: tuple[str, str], model: str, prompt: str) -> dict:
    """A question's row: its answer, or its last error."""
    for n in range(TRIES):
        schedule.wait()
        began = time.monotonic()
        try:
            got = provider(model, prompt)
            said = {"answer": got["answer"], "prompt_tokens": got.get("prompt_tokens"), "completion_tokens": got.get("completion_tokens"), "error": None}
        except Exception as e:  # noqa: BLE001  becomes a row
            said = {"answer": None, "prompt_tokens": None, "completion_tokens": None, "error": f"{type(e).__name__}: {e}"}
        if said["error"] is None or n + 1 == TRIES or not transient(said["error"]):
            return {"question_id": key[0], "producer": key[1], **said, "latency_s": time.monotonic() - began}
    raise AssertionError


def collect_within(todo: DataFrame, provider: Callable[[str, str], dict], folder: str, rate: float, tasks: int = 4, threads: int = 8) -> DataFrame:
    """(question_id, producer, COMPLETION) of ``todo`` (question_id, producer, model, prompt), read from the log when all is done.

    Ids come as strings.  ``rate``: calls that may begin in a second, of all tasks together.  ``tasks``: at most as many as run at once.
    ``folder``: a URI in a folder that all machines share, of this run alone.
    """
    import re

    from qaloom.operators.collect import TRANSIENT

    seen = re.compile(TRANSIENT)
    spark = todo.sparkSession

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        log = Log(folder)
        done = log.finished()
        start = max(map(float, context.allGather(str(time.time())))) + 0.05
        schedule = Schedule(start, context.partitionId(), len(context.getTaskInfos()), rate)
        n = 0
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                left = [r for r in batch.itertuples(index=False) if (r.question_id, r.producer) not in done]
                for row in pool.map(lambda r: _logged(log, call_once(schedule, provider, lambda e: bool(seen.search(e)), (r.question_id, r.producer), r.model, r.prompt)), left):
                    done[row["question_id"], row["producer"]] = row
                    n += 1
        log.close()
        yield pd.DataFrame({"n": [n]})

    asked = todo.select(F.col("question_id").cast("string").alias("question_id"), "producer", "model", "prompt").dropDuplicates(["question_id", "producer"])
    if exists(spark, folder):
        asked = asked.join(spark.read.schema(LOG).json(folder).select("question_id", "producer"), ["question_id", "producer"], "left_anti")
    asked.repartition(tasks).mapInPandas(work, "n long", barrier=True).agg(F.sum("n")).collect()
    rows = spark.read.schema(LOG).json(folder) if exists(spark, folder) else spark.createDataFrame([], LOG)
    return rows.where("question_id IS NOT NULL").dropDuplicates(["question_id", "producer"])


def _logged(log: Log, row: dict) -> dict:
    log.add(row)
    return row
