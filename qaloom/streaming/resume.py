"""Where each (question, producer) stands, as a stream of attempts goes on.

State of a key: its newest good answer, how many attempts failed, and when the last one did; and the
attempts seen, which expire by TTL.  So a batch costs what it brings, not what the log holds, and an
attempt that arrives twice, or in another order, changes nothing: the newest good answer is that of
the greatest (time, attempt), failures are counted as a set.  A failed key gets a timer for its next
try; when it fires and the key still has no answer, the key is given out as due.  After TRIES
failures without an answer it is given up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from qaloom.operators.collect import RATE_LIMIT_WAIT, TRANSIENT, TRIES
from qaloom.sources.snapshots import SnapshotTable
from qaloom.streaming.windows import into_table

ATTEMPT = "question_id long, producer string, attempt long, answer string, error string, ts timestamp"
STATUS = "question_id long, producer string, status string, answer string, attempt long, failures long, retry_at timestamp, step long"
LIMITED = "429"


def wait_seconds(failures: int, limited: bool) -> int:
    """How long to wait after the last of so many failures."""
    return int(RATE_LIMIT_WAIT) if limited else 2 * 2 ** (failures - 1)


class Standing(StatefulProcessor):
    """The state of one key; ``ttl_ms`` is how long a repeated attempt is known as one.

    A call to the state store costs more than all else, so what a key has is one value, read and written
    once a batch: the attempts seen are in it, with the times they came, and expired ones go when it is written.
    Times are microseconds, in and out.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "answer string, good_us long, good_attempt long, failures long, failed_us long, failed_attempt long, limited boolean, permanent boolean, step long, seen array<long>, seen_ms array<long>")

    def _row(self, key, s: list, due: bool = False) -> Row:
        answer, _, good_attempt, failures, failed_us, _, limited, permanent, step = s
        good = good_attempt is not None
        over = not good and (failures >= TRIES or permanent)
        retry = None if good or over else failed_us + wait_seconds(failures, limited) * 1_000_000
        status = "done" if good else "given_up" if over else "due" if due else "retry"
        return Row(question_id=key[0], producer=key[1], status=status, answer=answer, attempt=good_attempt, failures=failures, retry_us=retry, step=step)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, now = self.now.get(), timerValues.getCurrentProcessingTimeInMs()
        s = list(held[:9]) if held else [None, None, None, 0, None, None, False, False, 0]
        seen = {k: ms for k, ms in zip(held[9], held[10], strict=True) if ms + self.ttl_ms > now} if held else {}
        changed = False
        for row in rows:
            attempt, answer, error, us = row["attempt"], row["answer"], row["error"], row["us"]
            if attempt in seen:
                continue
            seen[attempt] = now
            changed = True
            if not error:
                if s[1] is None or (us, attempt) > (s[1], s[2]):
                    s[0], s[1], s[2] = answer, us, attempt
                continue
            s[3] += 1
            if s[4] is None or (us, attempt) > (s[4], s[5]):
                s[4], s[5], s[6] = us, attempt, LIMITED in error
            s[7] = s[7] or not transient(error)
        if not changed:
            return
        s[8] += 1
        self.now.update((*s, list(seen), list(seen.values())))
        row = self._row(key, s)
        if row["status"] == "retry":
            self.handle.registerTimer(max(s[4] // 1000 + 1000 * wait_seconds(s[3], s[6]), now + 1))
        yield row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.now.get()
        s = list(held[:9])
        if self._row(key, s, due=True)["status"] == "due" and expiredTimerInfo.getExpiryTimeInMs() >= s[4] // 1000 + 1000 * wait_seconds(s[3], s[6]):  # not an earlier failure's
            s[8] += 1
            self.now.update((*s, list(held[9]), list(held[10])))
            yield self._row(key, s, due=True)

    def close(self) -> None:
        pass


def transient(error: str) -> bool:
    """Whether an error may pass by itself."""
    return re.search(TRANSIENT, error) is not None


def standings(attempts: DataFrame, ttl_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """A row (STATUS) for each key that a batch changes, and for each that falls due; ``step`` numbers a key's rows.

    attempts: a stream of ATTEMPT.  The state store must be RocksDB (``windows.on_disk``).
    """
    timed = attempts.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    made = timed.groupBy("question_id", "producer").transformWithState(Standing(ttl_ms), STATUS.replace("retry_at timestamp", "retry_us long"), "Update", "ProcessingTime")
    return made.select("question_id", "producer", "status", "answer", "attempt", "failures", F.timestamp_micros("retry_us").alias("retry_at"), "step")


def catch_up(attempts: DataFrame, table: SnapshotTable, name: str, checkpoint: str, ttl_ms: int = 30 * 24 * 3600 * 1000) -> StreamingQuery:
    """Add the standings that all attempts there are now bring; keys that fell due since come with them.

    Timers of processing time ask for batches without end, which a run over what is there now must not wait for.
    """
    conf, empty = attempts.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(empty)
    conf.set(empty, "false")  # the query keeps what it was started with
    try:
        return into_table(standings(attempts, ttl_ms), table, name, checkpoint, "update")
    finally:
        conf.set(empty, before)


def newest(rows: DataFrame) -> DataFrame:
    """Of each key the row of its last step."""
    last = Window.partitionBy("question_id", "producer").orderBy(F.desc("step"))
    return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "step")


def fold(attempts: DataFrame) -> DataFrame:
    """The same standings from a whole log at once, without those that are due."""
    bad = F.coalesce("error", F.lit("")) != ""
    at = F.struct("ts", "attempt")
    once = attempts.dropDuplicates(["question_id", "producer", "attempt"])
    sums = once.groupBy("question_id", "producer").agg(
        F.max_by(F.struct("answer", "attempt"), F.when(~bad, at)).alias("best"), F.count_if(bad).alias("failures"),
        F.max_by(F.struct("ts", F.col("error").contains(LIMITED).alias("limited")), F.when(bad, at)).alias("last"),
        F.coalesce(F.bool_or(bad & ~F.col("error").rlike(TRANSIENT)), F.lit(False)).alias("permanent"),
    )
    over = (F.col("failures") >= TRIES) | F.col("permanent")
    status = F.when(F.col("best").isNotNull(), "done").when(over, "given_up").otherwise("retry")
    wait = F.when(F.col("last.limited"), F.lit(int(RATE_LIMIT_WAIT))).otherwise(2 * F.pow(F.lit(2), F.col("failures") - 1)).cast("long")
    retry = F.when(status == "retry", F.timestamp_micros(F.unix_micros("last.ts") + wait * 1_000_000))
    return sums.select("question_id", "producer", status.alias("status"), "best.answer", "best.attempt", "failures", retry.alias("retry_at"))
