"""Event-time windows, sessions, and the standing of keys: against batches, late rows, restarts, repeated batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from qaloom.sources.snapshots import SnapshotTable
from qaloom.streaming import resume, windows

ROW = "producer string, ts timestamp, error string, cost_usd double"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


class Replay:
    """A folder that rows arrive in, and a stream over it that is stopped after each arrival."""

    def __init__(self, spark, path, schema, make=None):
        windows.on_disk(spark)
        self.spark, self.path, self.schema, self.make = spark, str(path), schema, make
        self.table = SnapshotTable(spark, f"{self.path}/out")

    def arrive(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        return self.run()

    def run(self):
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")
        end = self.table, "replay", f"{self.path}/checkpoint"
        query = windows.into_table(self.make(stream), *end) if self.make else resume.catch_up(stream, *end)
        assert query.awaitTermination(60)
        return query

    def rows(self, *columns):
        return sorted(tuple(r[c] for c in columns) for r in self.table.read().collect())


def test_sliding_windows_leave_late_rows_out_and_survive_restarts(spark, tmp_path):
    r = Replay(spark, tmp_path, ROW, lambda s: windows.by_window(s, "10 minutes", "5 minutes", "2 minutes"))
    r.arrive([("a", at(1), None, 2.0), ("a", at(6), "x", None), ("b", at(2), None, 1.0)])  # watermark 4
    assert r.rows("n") == []
    r.arrive([("a", at(3), "", 4.0), ("a", at(23), None, 1.0)])  # late, but within the delay; watermark 21
    want = [("a", at(-5), 2, 0, 6.0), ("a", at(0), 3, 1, 6.0), ("a", at(5), 1, 1, 0.0), ("b", at(-5), 1, 0, 1.0), ("b", at(0), 1, 0, 1.0)]
    assert r.rows("producer", "start", "n", "errors", "spent") == want
    r.arrive([("a", at(2), None, 9.0), ("a", at(22), None, 1.0)])  # the first is too late for all its windows
    r.run()  # nothing new
    assert r.rows("producer", "start", "n", "errors", "spent") == want
    r.arrive([("b", at(60), None, 1.0)])
    assert r.rows("producer", "start", "n", "errors", "spent")[3:5] == [("a", at(15), 2, 0, 2.0), ("a", at(20), 2, 0, 2.0)]


def test_windows_of_a_stream_and_of_a_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), at(rng.random() * 300), rng.choice([None, "", "bad"]), float(rng.randrange(9))) for _ in range(300)]
    r = Replay(spark, tmp_path, ROW, lambda s: windows.by_window(s, "30 minutes", delay="1000 minutes"))
    for k in range(3):
        r.arrive(rows[k::3])
    r.arrive([("z", at(10_000), None, 0.0)])
    batch = windows.by_window(spark.createDataFrame(rows, ROW), "30 minutes")
    assert r.rows("producer", "start", "end", "n", "errors", "spent") == sorted(map(tuple, batch.collect()))


def test_sessions_merge_across_batches(spark, tmp_path):
    r = Replay(spark, tmp_path, ROW, lambda s: windows.by_session(s, "10 minutes", "30 minutes"))
    r.arrive([("a", at(0), None, 1.0), ("a", at(15), None, 1.0), ("b", at(3), None, 1.0)])
    r.arrive([("a", at(8), None, 1.0), ("a", at(50), None, 1.0)])  # joins the two sessions; watermark 20
    assert r.rows("producer", "start", "end", "n") == [("b", at(3), at(13), 1)]
    r.arrive([("a", at(9), None, 1.0), ("b", at(4), None, 1.0), ("a", at(100), None, 1.0)])  # both ended before 20: too late
    assert r.rows("producer", "start", "end", "n") == [("a", at(0), at(25), 3), ("a", at(50), at(60), 1), ("b", at(3), at(13), 1)]


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    """The stream dies after its commit to the table and before its own: the batch runs again."""
    import shutil

    r = Replay(spark, tmp_path, ROW, lambda s: windows.by_window(s, "10 minutes"))
    r.arrive([("a", at(1), None, 1.0)])
    r.arrive([("a", at(25), None, 1.0)])
    before, version = r.rows("producer", "start", "n"), r.table.snapshot().version
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    shutil.move(last, tmp_path / "lost")
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    r.run()
    assert r.rows("producer", "start", "n") == before == [("a", at(0), 1)] and r.table.snapshot().version == version


def attempts(rng, n):
    errors = [None, "", "429 too many", "timeout", "timeout", "connection lost", "bad request"]
    out = []
    for k in range(n):
        error = rng.choices(errors, [3, 1, 4, 4, 4, 4, 1])[0]
        out.append((rng.randrange(8), rng.choice("pq"), k, None if error else f"a{k}", error, at(rng.randrange(50))))
    return out


def plain(rows):
    found = {}
    for q, p, k, answer, error, ts in rows:
        found.setdefault((q, p), {})[k] = (ts, k, answer, error)
    out = []
    for (q, p), tries in found.items():
        good = max(((ts, k, a) for ts, k, a, e in tries.values() if not e), default=None)
        bad = sorted((ts, k, e) for ts, k, _, e in tries.values() if e)
        if good:
            out.append((q, p, "done", good[2], good[1], len(bad), None))
        elif len(bad) >= 4 or any(e == "bad request" for *_, e in bad):
            out.append((q, p, "given_up", None, None, len(bad), None))
        else:
            out.append((q, p, "retry", None, None, len(bad), bad[-1][0] + dt.timedelta(seconds=65 if "429" in bad[-1][2] else 2 ** len(bad))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_standings_equal_the_fold_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = attempts(rng, 40)
    shuffled = rows + rng.sample(rows, 10)
    rng.shuffle(shuffled)
    r = Replay(spark, tmp_path, resume.ATTEMPT)
    for k in range(3):
        r.arrive(shuffled[k::3])
    columns = ["question_id", "producer", "status", "answer", "attempt", "failures", "retry_at"]
    of = lambda df: sorted((tuple(row[c] for c in columns) for row in df.collect()), key=str)
    got = [(*row[:2], "retry" if row[2] == "due" else row[2], *row[3:]) for row in of(resume.newest(r.table.read()))]
    assert got == plain(rows) == of(resume.fold(spark.createDataFrame(shuffled, resume.ATTEMPT)))
    n = r.table.read().where("status <> 'due'").count()
    r.arrive(rows)  # all again
    assert r.table.read().where("status <> 'due'").count() == n


def test_a_failed_key_falls_due_once(spark, tmp_path):
    r = Replay(spark, tmp_path, resume.ATTEMPT)
    r.arrive([(1, "p", 1, None, "timeout", at(0)), (2, "p", 2, "yes", None, at(0)), (3, "p", 3, None, "timeout", dt.datetime(2200, 1, 1))])
    r.arrive([(2, "p", 4, "yes again", None, at(1))])
    r.arrive([(2, "p", 5, "older", None, at(0))])
    due = r.table.read().where("status = 'due'").collect()
    assert [(x["question_id"], x["failures"], x["step"]) for x in due] == [(1, 1, 2)]
    r.arrive([(1, "p", 6, "late", None, at(2))])
    got = {x["question_id"]: (x["status"], x["answer"]) for x in resume.newest(r.table.read()).collect()}
    assert got == {1: ("done", "late"), 2: ("done", "yes again"), 3: ("retry", None)}


def test_a_key_costs_one_read_and_one_write():
    """Calls to the state store, by which a stream of many keys is slow."""
    from types import SimpleNamespace

    class Value:
        def __init__(self):
            self.held, self.calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

    value, timers, now = Value(), [], SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1_000)
    standing = resume.Standing(ttl_ms=500)
    standing.init(SimpleNamespace(getValueState=lambda *a: value, registerTimer=timers.append))
    tries = [{"attempt": k, "answer": None, "error": "timeout", "us": k} for k in (1, 2, 1)]
    (row,) = standing.handleInputRows((1, "p"), iter(tries), now)
    assert (row["status"], row["failures"], row["retry_us"], value.calls, timers) == ("retry", 2, 4_000_002, 2, [4_000])
    assert list(standing.handleInputRows((1, "p"), iter(tries), now)) == [] and value.calls == 3
    later = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1_600)  # the attempts have expired: one comes as new
    (row,) = standing.handleInputRows((1, "p"), iter(tries[:1]), later)
    assert (row["failures"], value.held[9]) == (3, [1])
