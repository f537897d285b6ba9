"""Streams with state: windows that close, late rows that are counted, a queue that does not depend on the order of events."""

import datetime as dt
import random

import pytest

from pgsloom.queries import QUERIES, streams
from pgsloom.streaming import events, queue

START = dt.datetime(2024, 1, 1)
EVENT = "event_id string, individual_id string, trait_id string, kind string, priority int, ts timestamp_ntz"
ROW = "id long, ts timestamp_ntz, event_type string, user_id long, value double"
HOUR = 3600


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def deliver(spark, folder, parts, schema, make):
    """Run a stream over one delivery after the other, and once more over nothing new."""
    for part in [*parts, None]:
        if part is not None:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = events.drain(make(events.read_stream(spark, f"{folder}/in", 100)), folder)
        rows = sorted((tuple(r) for r in out.collect()), key=repr)
        if part is None:
            assert rows == before  # replay adds nothing
        before = rows
    return rows


def state_rows(spark, folder):
    return spark.read.format("statestore").load(f"{folder}/checkpoint").count()


def test_windows_close_and_late_rows_are_counted(spark, tmp_path):
    rnd = random.Random(1)
    first = [(i, at(rnd.randrange(6 * HOUR)), rnd.choice("ab"), rnd.randrange(5), rnd.choice([1.5, None])) for i in range(200)] + [(0, None, "a", 1, 1.0), (1, at(6 * HOUR), "a", 1, 1.0)]
    second = [(i, at(rnd.randrange(12 * HOUR)), rnd.choice("ab"), rnd.randrange(5), 1.0) for i in range(200)] + [(2, at(12 * HOUR), "b", 1, 1.0)]
    got = deliver(spark, str(tmp_path / "w"), [first, second], ROW, lambda s: events.windows_and_late(s, 600, "1 hour"))
    want = {}
    marks = [None, at(5 * HOUR), at(11 * HOUR)]
    for k, part in enumerate((first, second)):
        for _, ts, kind, _, value in part:
            if ts is None:
                continue
            begin = START + (ts - START) // dt.timedelta(minutes=10) * dt.timedelta(minutes=10)
            stop = begin + dt.timedelta(minutes=10)
            late = marks[k] is not None and stop <= marks[k]
            if late or stop <= marks[2]:
                n, total = want.get((begin, kind, "late" if late else "window"), (0, 0.0))
                want[(begin, kind, "late" if late else "window")] = (n + 1, total + (value or 0.0))
    assert got == sorted([(*k, *v) for k, v in want.items()], key=repr) and sum(k[2] == "late" for k in want) > 20
    assert state_rows(spark, tmp_path / "w") <= 2 * 7  # only what lies within the last hour is kept


def test_distinct_users(spark, tmp_path):
    rnd = random.Random(2)
    parts = [[(i, at(h * HOUR + rnd.randrange(HOUR)), "a", rnd.choice([None, *range(6)]), 1.0) for i in range(30) for h in hours] for hours in (range(0, 4), range(3, 8))]
    parts.append([(0, at(20 * HOUR), "a", 1, 1.0)])
    got = deliver(spark, str(tmp_path / "d"), parts, ROW, lambda s: events.distinct_users(s, "1 hour", "1 hour"))
    want = {}
    for part in parts:
        for _, ts, _, user, _ in part:
            if user is not None:
                want.setdefault(ts.replace(minute=0, second=0), set()).add(user)
    assert got == sorted([(k, len(v)) for k, v in want.items() if k < at(8 * HOUR)], key=repr)


def brute_queue(parts, late_s, idle_s):
    """Plain replay: drop what is late, sort the rest by time, apply the rules one by one."""
    mark, kept, out = None, [], []
    for part in parts:
        for e in part:
            if None in (e[1], e[2], e[5]) or e[3] not in queue.KINDS:
                continue
            if mark is not None and e[5] <= mark:
                out.append((e[1], e[2], "late", e[4] or 0, None, e[5]))
            elif e not in kept:
                kept.append(e)
        mark = max(e[5] for p in parts[: parts.index(part) + 1] for e in p if e[5] and e[1] and e[2] and e[3] in queue.KINDS) - dt.timedelta(seconds=late_s)
    idle, jobs = dt.timedelta(seconds=idle_s), {}
    for _, person, trait, kind, priority, ts in sorted((e for e in kept if e[5] <= mark), key=lambda e: (e[5], queue.KINDS.index(e[3]), e[0])):
        key, job = (person, trait), jobs.get((person, trait))
        if job and ts >= job["last"] + idle:
            out.append((*key, "expired", job["priority"], job["added"], job["last"] + idle))
            job = jobs.pop(key) and None
        if job is None:
            if kind == "add":
                jobs[key] = {"priority": priority or 0, "added": ts, "last": ts, "runs": False}
            continue
        job["last"] = ts
        if kind == "add":
            job["priority"] = max(job["priority"], priority or 0)
        elif kind == "start":
            job["runs"] = True
        elif kind == "next":
            job["priority"] = job["priority"] if job["runs"] else 3
        elif kind != "remove" or not job["runs"]:
            out.append((*key, {"remove": "removed"}.get(kind, kind), job["priority"], job["added"], ts))
            del jobs[key]
    for key, job in jobs.items():
        if job["last"] + idle <= mark:
            out.append((*key, "expired", job["priority"], job["added"], job["last"] + idle))
    return sorted(out, key=repr), sum(job["last"] + idle > mark for job in jobs.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_queue(spark, tmp_path, seed):
    rnd = random.Random(seed)
    every = [(f"e{i}", rnd.choice("pq"), rnd.choice("TU"), rnd.choice([*queue.KINDS, "add", "add", "odd"]), rnd.choice([0, 1, 2, None]), at(rnd.randrange(0, 40) * 600)) for i in range(120)]
    every += [("x", None, "T", "add", 1, at(0)), ("y", "p", "T", "add", 1, None)]
    rnd.shuffle(every)
    parts = [every[:60] + every[10:20], every[60:100], every[100:] + [("end", "z", "Z", "add", 1, at(60 * 600))]]
    got = deliver(spark, str(tmp_path / "q"), parts, EVENT, lambda s: queue.jobs(s, "2 hours", idle_s=HOUR))
    want, open_jobs = brute_queue(parts, 2 * HOUR, HOUR)
    assert got == want and {"late", "expired", "done", "failed", "removed"} <= {r[2] for r in got}
    assert state_rows(spark, tmp_path / "q") == open_jobs + 1  # and the one event that no watermark has passed


def test_queue_does_not_depend_on_the_order(spark, tmp_path):
    """An end that comes before its beginning, within the watermark, ends it all the same."""
    one = [("1", "p", "T", "done", None, at(100)), ("2", "p", "U", "add", 1, at(50))]
    two = [("3", "p", "T", "add", 2, at(10)), ("3", "p", "T", "add", 2, at(10)), ("4", "p", "U", "next", None, at(60)), ("5", "p", "U", "done", None, at(70))]
    three = [("6", "z", "Z", "add", 0, at(10 * HOUR))]
    got = deliver(spark, str(tmp_path / "o"), [one, two, three], EVENT, lambda s: queue.jobs(s, "1 hour"))
    assert got == [("p", "T", "done", 2, at(10), at(100)), ("p", "U", "done", 3, at(50), at(70))]
    assert queue.jobs(events.read_stream(spark, f"{tmp_path}/o/in")).isStreaming


def test_queue_by_buckets_does_the_same(spark, tmp_path):
    """Jobs that share a row of state do not touch each other; ended ones leave nothing in it."""
    rnd = random.Random(3)
    every = [(f"e{i}", rnd.choice("pqrs"), rnd.choice("TU"), rnd.choice([*queue.KINDS, "add", "add"]), rnd.choice([0, 1, 2, None]), at(rnd.randrange(0, 40) * 600)) for i in range(200)]
    parts = [every[:100] + every[10:20], every[100:160], every[160:], [("end", "z", "Z", "add", 1, at(60 * 600))], [("end2", "z", "Z", "done", 1, at(200 * 600))]]
    got = deliver(spark, str(tmp_path / "b"), parts, EVENT, lambda s: queue.jobs(s, "2 hours", idle_s=HOUR, buckets=3))
    want, open_jobs = brute_queue(parts, 2 * HOUR, HOUR)
    assert got == want and {"late", "expired", "done", "failed", "removed"} <= {r[2] for r in got}
    assert open_jobs == 0 and state_rows(spark, tmp_path / "b") == 1  # the one event that no watermark has passed


def test_queue_stream_does_not_call_python_once_a_job(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "scratch", lambda t: str(tmp_path / "s"))
    rows = QUERIES["queue_stream"](spark, "/root/testdata/sf0.01")
    assert rows.select("individual_id", "trait_id").distinct().count() > 500
    assert 0 < state_rows(spark, tmp_path / "s") <= 64
