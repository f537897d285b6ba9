"""The queue of jobs as a stream of events with state by job: one entry a job, whatever is repeated, late or out of order.

An event is (event_id, individual_id, trait_id, kind, priority, ts). ``add`` makes an entry or raises the priority of the
one that is there; ``start`` marks it as running; ``next`` gives a waiting entry the highest priority; ``remove`` deletes a
waiting entry; ``done`` and ``failed`` end an entry. Events wait in the job's state until the watermark has passed them and
are then applied in order of time, so the result does not depend on the order in which they come, as long as none comes
after the watermark. An entry that nothing happens to for ``idle_s`` seconds expires. Ended entries are written once and leave no state.

Defined cases: an event that repeats (by its id) while it waits counts once, later its effect is the same but that an
``add`` after the end is a new job; events without a job, a time or a known kind are left out; an event behind the watermark is
written with the outcome ``late`` and changes nothing; a null priority is 0; ties in time go by kind (in the order above), then id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pgsloom.streaming.events import undropped

#: Fixed value: the priority of an entry that goes next.
URGENT = 3
KINDS = ("add", "start", "next", "remove", "done", "failed")
OUT = "individual_id string, trait_id string, outcome string, priority int, added bigint, ended bigint"


def applied(entry: dict | None, event: dict, idle_ms: int) -> tuple[dict | None, list[tuple]]:
    """The entry after an event, and what ended: (outcome, priority, added, ended)."""
    ended = []
    if entry and event["ts"] >= entry["last"] + idle_ms:
        ended.append(("expired", entry["priority"], entry["added"], entry["last"] + idle_ms))
        entry = None
    kind = KINDS[event["kind"]]
    if entry is None:
        if kind == "add":
            entry = {"priority": event["priority"], "added": event["ts"], "last": event["ts"], "running": False}
        return entry, ended
    entry = entry | {"last": event["ts"]}
    if kind == "add":
        entry["priority"] = max(entry["priority"], event["priority"])
    elif kind == "start":
        entry["running"] = True
    elif kind == "next" and not entry["running"]:
        entry["priority"] = URGENT
    elif kind in ("done", "failed") or kind == "remove" and not entry["running"]:
        ended.append(("removed" if kind == "remove" else kind, entry["priority"], entry["added"], event["ts"]))
        entry = None
    return entry, ended


def jobs(events: DataFrame, late: str = "1 hour", idle_s: int = 7 * 86_400, buckets: int | None = None) -> DataFrame:
    """(individual_id, trait_id, outcome, priority, added, ended) of entries that ended and of late events, in append mode.

    State is a row a job, which suits a stream that touches few of many jobs at a time. With ``buckets`` it is a row for each of
    so many groups of jobs: a call of Python, which costs more than the few events that a job has, then serves a whole
    group, and a group that is touched is written whole. The number has to stay the same for the life of a checkpoint.
    """
    known = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int") - 1
    rows = undropped(events.filter("ts is not null and individual_id is not null and trait_id is not null").withColumn("known", known).filter("known >= 0"), late)
    rows = rows.select("later", F.col("individual_id").cast("string"), F.col("trait_id").cast("string"), F.col("event_id").cast("string").alias("id"), F.col("known").alias("kind"), F.coalesce("priority", F.lit(0)).cast("int").alias("priority"), F.unix_millis("ts").alias("ts"))
    idle_ms = idle_s * 1000

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, out = state.getCurrentWatermarkMs(), []
        held = json.loads(state.get[0]) if state.exists else {"entries": [], "waiting": []}
        entries = {(person, trait): entry for person, trait, entry in held["entries"]}
        waiting = {(person, trait, id_, ts): (ts, kind, id_, priority, person, trait) for ts, kind, id_, priority, person, trait in held["waiting"]}
        if not state.hasTimedOut:
            for part in parts:
                # plain lists: a frame's own records cost more than all the rest for the few events that a job has
                for person, trait, id_, kind, priority, ts in zip(*[part[c].tolist() for c in ("individual_id", "trait_id", "id", "kind", "priority", "ts")]):
                    if ts <= mark:
                        out.append((person, trait, "late", priority, None, ts))
                    else:
                        id_ = str(id_)
                        waiting[person, trait, id_, ts] = (ts, kind, id_, priority, person, trait)
        rest = []
        for event in sorted(waiting.values()):
            ts, kind, id_, priority, person, trait = event
            if ts > mark:
                rest.append(event)
                continue
            entry, ended = applied(entries.pop((person, trait), None), {"kind": kind, "priority": priority, "ts": ts}, idle_ms)
            if entry:
                entries[person, trait] = entry
            out += [(person, trait, *e) for e in ended]
        for (person, trait), entry in [*entries.items()]:
            if entry["last"] + idle_ms <= mark:
                out.append((person, trait, "expired", entry["priority"], entry["added"], entry["last"] + idle_ms))
                del entries[person, trait]
        if entries or rest:
            state.update((json.dumps({"entries": [(*job, entry) for job, entry in entries.items()], "waiting": rest}),))
            first = min([event[0] for event in rest[:1]] + [entry["last"] + idle_ms for entry in entries.values()])
            state.setTimeoutTimestamp(max(first, mark + 1))
        elif state.exists:
            state.remove()
        if out:
            person, trait, outcome, priority, added, ended = zip(*out)
            yield pd.DataFrame({"individual_id": person, "trait_id": trait, "outcome": outcome, "priority": priority, "added": pd.array(added, "Int64"), "ended": ended})

    if buckets:
        groups = rows.withColumn("bucket", F.pmod(F.xxhash64("individual_id", "trait_id"), F.lit(buckets))).groupBy("bucket")
    else:
        groups = rows.groupBy("individual_id", "trait_id")
    out = groups.applyInPandasWithState(step, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("individual_id", "trait_id", "outcome", "priority", *[F.timestamp_millis(c).cast("timestamp_ntz").alias(c) for c in ("added", "ended")])
