"""Calls under a budget: never more in a second than the rate, none twice after a task died."""

from __future__ import annotations

import json
import os
import time
from collections import Counter

import pytest

from qaloom.operators.budget import Log, Schedule, collect_within

TODO = "question_id long, producer string, model string, prompt string"


def recording(path, slow=0.0, die=None):
    """A provider that writes down when it was called; it can end its process, as a lost executor would."""

    def call(model, prompt):
        with open(path, "a") as f:
            f.write(json.dumps([time.time(), prompt]) + "\n")
        if die and prompt == die and not os.path.exists(f"{path}.died"):
            open(f"{path}.died", "w").close()
            time.sleep(0.3)
            os._exit(1)
        time.sleep(slow)
        if prompt == "bad":
            raise ValueError("no such thing")
        if prompt.startswith("busy") and sum(p == prompt for _, p in calls(path)) < 2:
            raise RuntimeError("429 too many requests")
        return {"answer": prompt.upper(), "prompt_tokens": 1}

    return call


def calls(path):
    with open(path) as f:
        return [json.loads(line) for line in f if line.endswith("\n")]


def most_in_a_second(times):
    return max(sum(t <= u < t + 1 for u in times) for t in times)


def test_rate_is_shared_by_all_tasks(spark, tmp_path):
    rows = [(k, "p", "m", f"q{k}") for k in range(40)] + [(100, "p", "m", "bad"), (101, "p", "m", "busy now"), (5, "p", "m", "q5")]
    got = collect_within(spark.createDataFrame(rows, TODO), recording(f"{tmp_path}/calls", slow=0.4), (tmp_path / "log").as_uri(), rate=15, tasks=3, threads=4).collect()
    answers = {r["question_id"]: (r["answer"], r["error"]) for r in got}
    assert len(got) == 42 and answers["7"] == ("Q7", None) and answers["100"] == (None, "ValueError: no such thing") and answers["101"] == ("BUSY NOW", None)
    made = calls(f"{tmp_path}/calls")
    assert Counter(p for _, p in made) == Counter([f"q{k}" for k in range(40)] + ["bad", "busy now", "busy now"])
    assert most_in_a_second([t for t, _ in made]) <= 15 + 1  # one for the clock between permit and note


def test_a_task_that_died_goes_on(spark, tmp_path):
    """A worker ends amid its calls: the barrier stage runs again, and asks only for what isn't in the log."""
    todo = spark.createDataFrame([(k, "p", "m", f"q{k}") for k in range(30)], TODO)
    folder = (tmp_path / "log").as_uri()
    provider = recording(f"{tmp_path}/calls", die="q11")
    got = collect_within(todo, provider, folder, rate=60, tasks=2, threads=2)
    assert sorted(int(r["question_id"]) for r in got.collect()) == list(range(30)) and os.path.exists(f"{tmp_path}/calls.died")
    made = Counter(p for _, p in calls(f"{tmp_path}/calls"))
    assert made["q11"] == 2 and max(made.values()) == 2 and sum(made.values()) <= 30 + 2 * 2  # those under way, at most
    collect_within(todo, provider, folder, rate=60, tasks=2, threads=2)  # all is done
    assert Counter(p for _, p in calls(f"{tmp_path}/calls")) == made


def test_schedule_never_bursts():
    now = [0.0]
    made = [Schedule(1.0, i, 3, 6.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)) for i in range(3)]
    first = sorted(s.wait() for _ in range(4) for s in made)
    assert first == pytest.approx([1 + k / 6 for k in range(12)])
    now[0] = 50.0
    later = sorted(s.wait() for _ in range(4) for s in made)
    assert all(b - a == pytest.approx(1 / 6) for a, b in zip(later, later[1:], strict=False)) and later[0] >= 50


def test_cut_lines_count_for_nothing(tmp_path):
    (tmp_path / "x.jsonl").write_text('{"question_id": "1", "producer": "p", "answer": "a"}\n{"question_id": "2", "prod')
    assert list(Log(tmp_path.as_uri()).finished()) == [("1", "p")]
