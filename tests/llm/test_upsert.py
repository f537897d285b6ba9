"""The keyed upsert against a brute-force version that holds everything in memory."""

import hashlib
import math
import os
import random
import zlib

import pyarrow.parquet as pq
import pytest

from pgsloom.llm import upsert

CLIENT = "client_id bigint, master_id bigint, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CHANGE = "change_id bigint, client_id bigint, seq bigint, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def crc(x):
    return zlib.crc32(str(x).encode())


def brute(clients, changes):
    """{(rows of the file, rewritten)} in order of the files; clients and changes are lists of dicts."""
    m = 1 + len(clients) // 1000
    start = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: (c["client_id"], str(list(c.values()))))
    files = [start[i : i + m] for i in range(0, len(start), m)]
    if not files:
        return []
    first = [f[0]["client_id"] for f in files]
    last = {}
    for c in changes:
        if c["client_id"] is None:
            continue
        rank = tuple((v is not None, v or 0) for v in (c["seq"], c["change_id"]))
        values = (c["op"], c["change_id"], *[c[k] for k in upsert.CHANGED[:3]], c["balance"])
        if c["client_id"] not in last or (rank, repr((c["op"], c["change_id"], values[2:]))) > last[c["client_id"]][0]:
            last[c["client_id"]] = ((rank, repr((c["op"], c["change_id"], values[2:]))), c)
    after = [[dict(r) for r in f] for f in files]
    for k, (_, c) in last.items():
        home = max([i for i, f in enumerate(first) if f <= k], default=0)
        h = crc(first[home]) % 16
        if h > 7:
            continue
        if c["op"] == "D" or c["change_id"] is not None and crc(c["change_id"]) % 8 < h:
            after[home] = [r for r in after[home] if r["client_id"] != k]
            continue
        mine = [r for r in after[home] if r["client_id"] == k]
        if not mine:
            mine = [dict.fromkeys(clients[0])]
            after[home] += mine
        for r in mine:
            r.update({"client_id": k} | {x: c[x] for x in upsert.CHANGED})
    out = []
    for old, new in zip(files, after):
        new.sort(key=lambda r: r["client_id"])
        if new == old:
            out.append((old, False))
            continue
        n = -(-len(new) // m)
        at = 0
        for i in range(n):
            size = len(new) // n + (i < len(new) % n)
            part = new[at : at + size]
            at += size
            if out and out[-1][1] and len(out[-1][0]) + size <= m:
                out[-1] = (out[-1][0] + part, True)
            else:
                out.append((part, True))
    return out


def summary(rows, rewritten):
    cents = sum(math.floor(100 * r["balance"] + 0.5) if r["balance"] is not None and math.isfinite(r["balance"]) else 0 for r in rows)
    sums = sum(crc("|".join(r[c] or "" for c in ("source", "segment", "city"))) for r in rows)
    ids = hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest()
    return (rows[0]["client_id"], len(rows), cents, sums, ids, ",".join(rows[0]), rewritten)


def compare(got, want):
    rows = sorted(got.collect(), key=lambda r: (r["first_id"], r["path"]))
    assert sorted((r["first_id"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["columns"], r["rewritten"]) for r in rows) == sorted(summary(*w) for w in want)
    folders = {os.path.dirname(r["path"]) for r in rows}
    if rows:
        assert len(folders) == 1 and sorted(os.path.join(*folders, f) for f in os.listdir(*folders)) == sorted(r["path"] for r in rows)
    return {r["path"]: r for r in rows}


def dicts(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    clients, changes = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("clients", "client_changes"))
    want = brute(dicts(clients), dicts(changes))
    files = compare(upsert.query(spark, f"/root/testdata/{sf}"), want)
    assert {True, False} == {w[1] for w in want}
    by_first = {w[0][0]["client_id"]: w[0] for w in want}
    for path, r in files.items():
        assert pq.read_table(path).to_pylist() == by_first[r["first_id"]]


def made(spark, seed, n=3000, m=900, far=0):
    """Clients and changes with nulls, repeats, ties, new ids on both sides and a key that has a third of the changes."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", None, "é|x", ""])
    ids = rnd.sample(range(100, 100 + 2 * n), n)
    clients = [(i, rnd.choice([None, i]), word(), None, "n", None, word(), rnd.choice([None, 3]), word(), rnd.choice([None, 1.005, -0.5, float(i)])) for i in ids] + [(None, 1, "x", None, "n", None, "c", 1, "s", 1.0)] * 3
    base = {c[0]: c for c in clients}
    changes = []
    for k in range(m):
        i = rnd.choice([110, rnd.choice(ids), rnd.randrange(0, 100 + 3 * n + far)])
        old = base.get(i)
        same = old is not None and rnd.random() < 0.3
        values = (old[2], old[8], old[6], old[9]) if same else (word(), word(), word(), rnd.choice([None, float("nan"), 2.345]))
        changes.append((rnd.choice([k, k, None]), i, rnd.choice([None, 1, 2, k]), rnd.choice(["U", "U", "I", "D", None]), None, *values))
    changes += [(7, None, 1, "U", None, "a", "b", "c", 1.0)] + rnd.choices(changes, k=200)
    return clients, changes


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_made_tables(spark, seed):
    clients, changes = made(spark, seed, far=20_000 if seed == 3 else 0)
    one, two = spark.createDataFrame(clients, CLIENT), spark.createDataFrame(changes, CHANGE).repartition(5)
    want = brute(dicts(one), dicts(two))
    got = upsert.clients_upsert(one, two)
    rows = [r for r in compare(got, want).values()]
    assert max(r["n_rows"] for r in rows) <= 1 + len(clients) // 1000


def test_splits_and_joins(spark, tmp_path):
    """A home that takes very many new keys is cut into many files by several tasks; emptied neighbours join."""
    rows = spark.createDataFrame([(i, None, "s", None, "n", None, "c", 1, "g", 1.0) for i in range(60)], CLIENT)
    folder = f"file://{tmp_path}/t"

    class Always(upsert.Rule):
        def reaches(self, home):
            return True

        def deletes(self, home, op, change_id):
            return op == "D"

    start = upsert.create(rows, "client_id", folder, 10)
    assert [f.rows for f in start] == [10] * 6
    gone = [(i, i, 1, "D", None, None, None, None, None) for i in [*range(0, 7), *range(10, 17), *range(20, 30)]]
    new = [(i, i, 1, "I", None, "s", "g", "c", 2.0) for i in range(1000, 1405)]
    same = [(31, 31, 1, "U", None, "s", "g", "c", 1.0)]
    changes = spark.createDataFrame(gone + new + same, CHANGE)
    after = upsert.upsert(spark, folder, start, "client_id", changes, 10, Always)
    assert [f.rows for f in after][:3] == [6, 10, 10]
    assert [f.old for f in after][1:3] == [start[3].old, start[4].old]
    last = [f.rows for f in after][3:]
    assert sum(last) == 415 and len(last) == 42 and max(last) - min(last) == 1 and last == sorted(last, reverse=True)
    ids = [v for f in after for v in pq.read_table(f.old)["client_id"].to_pylist()]
    assert ids == [7, 8, 9, 17, 18, 19, *range(30, 60), *range(1000, 1405)]
    assert len(os.listdir(tmp_path / "t")) == len(after)
    # the same changes once more change nothing
    again = upsert.upsert(spark, folder, after, "client_id", spark.createDataFrame(new + same, CHANGE), 10, Always)
    assert [f.old for f in again] == [f.old for f in after]
    # all rows of two files go
    empty = upsert.upsert(spark, folder, after, "client_id", spark.createDataFrame([(i, i, 1, "D", None, None, None, None, None) for i in range(0, 40)], CHANGE), 10, Always)
    assert [v for f in empty for v in pq.read_table(f.old)["client_id"].to_pylist()] == [*range(40, 60), *range(1000, 1405)]


def test_cases(spark):
    none = spark.createDataFrame([], CLIENT)
    some = spark.createDataFrame([(i, 1, None, None, None, None, None, None, None, None) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)], CLIENT)
    change = spark.createDataFrame([(1, 4, 1, "U", None, "s", "g", "c", float("inf"))], CHANGE)
    assert upsert.clients_upsert(none, change).collect() == []
    compare(upsert.clients_upsert(some, spark.createDataFrame([], CHANGE)), brute(dicts(some), []))
    compare(upsert.clients_upsert(some, change), brute(dicts(some), dicts(change)))
    more = some.selectExpr("*", "1 as seq", "'x' as op")
    compare(upsert.clients_upsert(more, change), brute(dicts(more), dicts(change)))


def test_a_task_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    """The folder holds the old files alone when an upsert breaks off in its last write."""
    rows = spark.createDataFrame([(i, None, "s", None, "n", None, "c", 1, "g", 1.0) for i in range(30)], CLIENT)
    folder = f"file://{tmp_path}/t"
    start = upsert.create(rows, "client_id", folder, 10)
    before = {f.old: open(f.old, "rb").read() for f in start}

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(upsert, "write_outputs", broken)
    change = spark.createDataFrame([(i, i, 1, "D", None, None, None, None, None) for i in range(30)], CHANGE)
    with pytest.raises(OSError, match="lost"):
        upsert.upsert(spark, folder, start, "client_id", change, 10)
    assert {f"{tmp_path}/t/{n}": open(f"{tmp_path}/t/{n}", "rb").read() for n in os.listdir(tmp_path / "t") if n.endswith(".parquet")} == before
