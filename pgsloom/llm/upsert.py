"""Copy-on-write upsert by key into a folder of sorted Parquet files.

A folder holds files of at most ``max_rows`` rows, sorted by key, one range of keys each. A change belongs to its home,
the last file that begins at or below its key, else the first. Changes and the rows of the files that they reach are dealt by a range partitioner
over (home, key) and sorted by (home, key, tag, seq, change id); a file's row comes before the changes of its key. A
generator folds each key's rows as they stream by and spools what is left of it, counting rows and whether any differs.
Files none of whose rows differ stay as they are. The others are cut anew from the spools into balanced files, and
a rewritten file joins its left neighbour where both fit into one.

What grows with the table never meets in one place. Before the shuffle each task keeps only the last change of a key, so a
key with very many changes sends one row a task. A home is split where quantiles of the changed keys fall, so one that
takes very many new keys is several tasks. The driver sees one row for each file and spool, never rows of the table. An
output file is written whole by one task that streams its ranges from the spools.

Tasks write under names of their own attempt in a staging folder; the driver moves only what tasks reported when they
ended, and then removes the files replaced and the staging folder. So a task that runs again, or that dies half-way,
leaves nothing behind. Files are written and read through Arrow's file systems by URI.

Defined cases: rows and changes without a key are left out; rows of the table that repeat a key are rows of their own
(in the order of their other columns), and a change applies to all of them in the key's home; changes that repeat count once, and of those that tie in
seq and change id the greatest by its other values wins; a null seq or change id comes before all others; a null op is
no deletion; a change's value equals a row's if both are null or both are NaN; columns of the changes that the table
lacks are not read, and other columns of the table are kept; an empty table has no files, so changes have no home and
are ignored; without changes nothing is rewritten; a null, infinite or NaN balance counts as 0 cents.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pgsloom.llm.common import cut, shared_folder, table

#: Fixed value: what a change sets.
CHANGED = ("source", "segment", "city", "balance")
#: Rows of one row group; a task that needs some rows of a spool reads whole groups.
GROUP_ROWS = 20_000


def crc(value: Any) -> int:
    return zlib.crc32(str(value).encode())


@dataclass
class Part:
    """Rows ``low`` to ``high`` of a Parquet file."""

    path: str
    low: int
    high: int


@dataclass
class Output:
    """A data file of the folder: an old one that stays, or a new one made of parts."""

    rows: int
    parts: list[Part]
    old: str | None = None


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def rows_of(store: fs.FileSystem, part: Part) -> Iterator[pa.RecordBatch]:
    """The rows of a part, a row group at a time."""
    with store.open_input_file(part.path) as file:
        source, at = pq.ParquetFile(file), 0
        for k in range(source.num_row_groups):
            n = source.metadata.row_group(k).num_rows
            if at < part.high and at + n > part.low:
                for batch in source.read_row_group(k).to_batches():
                    low, high = max(0, part.low - at), min(batch.num_rows, part.high - at)
                    if low < high:
                        yield batch.slice(low, high - low)
                    at += batch.num_rows
            else:
                at += n


class Writer:
    """One Parquet file in a staging folder, opened when its first rows come."""

    def __init__(self, staging: str, schema: pa.Schema):
        self.store, self.folder = store_of(staging)
        self.schema, self.path, self.file, self.rows, self.waiting = schema, "", None, 0, []

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows are gathered to groups, so that many small batches do not make as many row groups."""
        self.waiting.append(batch)
        self.rows += batch.num_rows
        if sum(b.num_rows for b in self.waiting) >= GROUP_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.file is None:
            self.path = f"{self.folder}/{uuid.uuid4().hex}.parquet"
            self.file = pq.ParquetWriter(self.path, self.schema, filesystem=self.store)
        self.file.write_table(pa.Table.from_batches(self.waiting, self.schema), row_group_size=GROUP_ROWS)
        self.waiting = []

    def close(self) -> str:
        if self.waiting:
            self.flush()
        if self.file is not None:
            self.file.close()
        return self.path


def write_outputs(spark: SparkSession, outputs: list[Output], staging: str, schema: pa.Schema) -> list[str]:
    """Write each new file by one task that streams its parts; the paths in the staging folder."""
    plan = [(k, [(p.path, p.low, p.high) for p in out.parts]) for k, out in enumerate(outputs)]

    def write(tasks: Iterator[tuple]) -> Iterator[tuple]:
        store, _ = store_of(staging)
        for k, parts in tasks:
            writer = Writer(staging, schema)
            for part in parts:
                for batch in rows_of(store, Part(*part)):
                    writer.add(batch)
            yield k, writer.close()

    context = spark.sparkContext
    done = dict(context.parallelize(plan, max(1, min(len(plan), 4 * context.defaultParallelism))).mapPartitions(write).collect()) if plan else {}
    return [done[k] for k in range(len(plan))]


def move_in(folder: str, paths: list[str], first: int = 0) -> list[str]:
    """Give finished files their names in the folder."""
    store, path = store_of(folder)
    names = [f"{path}/part-{first + k:06d}-{uuid.uuid4().hex}.parquet" for k in range(len(paths))]
    for old, new in zip(paths, names):
        store.move(old, new)
    return names


def arrow_schema(rows: DataFrame) -> pa.Schema:
    """The Arrow schema in which Spark hands over these rows."""
    return rows.limit(0).toArrow().schema


def create(rows: DataFrame, key: str, folder: str, max_rows: int) -> list[Output]:
    """Write rows, sorted by key, as files of ``max_rows`` rows each (the last has the rest) into a new folder.

    Sorted ranges are spooled first; files are ranges of the whole order and so of one or more spools.
    """
    spark, staging = rows.sparkSession, f"{folder}/_staging"
    store, path = store_of(staging)
    store.create_dir(path, recursive=True)
    schema = arrow_schema(rows)
    others = [F.col(f"`{c}`") for c in rows.columns if c != key]
    ordered = rows.filter(F.col(key).isNotNull()).repartitionByRange(key).sortWithinPartitions(key, *others)

    def spool(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = Writer(staging, schema)
        for part in parts:
            writer.add(part.cast(schema))
        if writer.rows:
            path = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([path]), pa.array([writer.rows], pa.int64())], names=["k", "path", "n"])

    spools = sorted(tuple(r) for r in ordered.mapInArrow(spool, "k int, path string, n bigint").collect())  # a row a task
    pieces = [Part(path, 0, n) for _, path, n in spools]
    outputs = slices(pieces, [min(max_rows, sum(n for *_, n in spools) - a) for a in range(0, sum(n for *_, n in spools), max_rows)])
    names = move_in(folder, write_outputs(spark, outputs, staging, schema))
    store.delete_dir(path)
    return [Output(out.rows, [], name) for out, name in zip(outputs, names)]


def slices(pieces: list[Part], sizes: list[int]) -> list[Output]:
    """Cut a row of parts into files of the given sizes."""
    out, rest = [], [Part(p.path, p.low, p.high) for p in reversed(pieces)]
    for size in sizes:
        parts, need = [], size
        while need:
            head = rest[-1]
            n = min(need, head.high - head.low)
            parts.append(Part(head.path, head.low, head.low + n))
            head.low += n
            need -= n
            if head.low == head.high:
                rest.pop()
        out.append(Output(size, parts))
    return out


def balanced(rows: int, max_rows: int) -> list[int]:
    """The fewest sizes of at most ``max_rows`` that differ by one at most, larger first."""
    files = -(-rows // max_rows)
    return [rows // files + (k < rows % files) for k in range(files)]


def layout(old: list[Output], spools: dict[int, list[Part]], max_rows: int) -> list[Output]:
    """The files after the upsert: old ones, or new ones from the spools of the homes that changed."""
    out: list[Output] = []
    for home, file in enumerate(old):
        new = slices(spools[home], balanced(sum(p.high - p.low for p in spools[home]), max_rows)) if home in spools else [file]
        for each in new:
            if out and each.old is None and out[-1].old is None and out[-1].rows + each.rows <= max_rows:
                out[-1] = Output(out[-1].rows + each.rows, out[-1].parts + each.parts)
            else:
                out.append(each)
    return out


def later(a: tuple, b: tuple) -> tuple:
    """Of two changes (order, op, values) of a key the one that wins."""
    return max(a, b, key=lambda c: (c[0], repr(c[1:])))


def latest(rows: Iterator[tuple], most: int = 50_000) -> Iterator[tuple]:
    """(key, change) with one change a key, but for keys that come again after ``most`` others."""
    best: dict[Any, tuple] = {}
    for key, change in rows:
        have = best.get(key)
        best[key] = change if have is None else later(have, change)
        if len(best) >= most:
            yield from best.items()
            best = {}
    yield from best.items()


def equal(a: Any, b: Any) -> bool:
    return a == b or (a is not None and b is not None and a != a and b != b)


@dataclass
class Rule:
    """What a home does with a change, by the first key of the home's file."""

    first: list[Any]

    def reaches(self, home: int) -> bool:
        return crc(self.first[home]) % 16 <= 7

    def deletes(self, home: int, op: str | None, change_id: Any) -> bool:
        return op == "D" or change_id is not None and crc(change_id) % 8 < crc(self.first[home]) % 16


def home_of(first: list[Any], key: Any) -> int:
    return max(0, bisect_right(first, key) - 1)


def upsert(spark: SparkSession, folder: str, old: list[Output], key: str, changes: DataFrame, max_rows: int, rule: type[Rule] = Rule, seq: str = "seq", change_id: str = "change_id", op: str = "op", sets: tuple[str, ...] = CHANGED) -> list[Output]:
    """Apply changes to the files of a folder; the files that the folder has then."""
    store, path = store_of(folder)
    staging = f"{folder}/_staging"
    if not old:
        return old
    store.create_dir(f"{path}/_staging", recursive=True)
    schema = pq.read_schema(old[0].old, filesystem=store).remove_metadata()
    names = schema.names
    sets = tuple(c for c in sets if c in names)
    at, spots, width = names.index(key), [names.index(c) for c in sets], len(names)
    context = spark.sparkContext
    first = first_keys(spark, folder, [f.old for f in old], key)
    rules = rule(first)
    reached = [rules.reaches(h) for h in range(len(first))]

    def order(*values: Any) -> tuple:
        """Null comes first."""
        return tuple((v is not None, v if v is not None else 0) for v in values)

    some = changes.filter(F.col(key).isNotNull()).select(key, seq, change_id, op, *sets)
    dealt = some.rdd.map(lambda r: (r[0], (order(r[1], r[2]), r[3], r[2], tuple(r[4:])))).filter(lambda r: reached[home_of(first, r[0])])
    dealt = dealt.mapPartitions(latest)
    # homes that changes reach, and keys that split them: the numbers of both are bounded, whatever the table's size
    homes = sorted(dealt.map(lambda r: home_of(first, r[0])).mapPartitions(set).distinct().collect())
    if not homes:
        store.delete_dir(f"{path}/_staging")
        return old
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = some.approxQuantile(key, [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 and dict(some.dtypes)[key] in ("int", "bigint") else []
    bounds = sorted({(h, first[h]) for h in homes} | {(home_of(first, int(k)), int(k)) for k in keys if home_of(first, int(k)) in set(homes)})

    def partition(of: tuple) -> int:
        """Ranges of (home, key): a range never holds two homes."""
        return max(0, bisect_right(bounds, of[:2]) - 1)

    def stored(files: Iterator[tuple]) -> Iterator[tuple]:
        store, _ = store_of(folder)
        for home, file, n in files:
            for batch in rows_of(store, Part(file, 0, n)):
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    yield (home, row[at], 0, (), ()), row

    files = [(h, old[h].old, old[h].rows) for h in homes]
    table_rows = context.parallelize(files, min(len(files), 4 * context.defaultParallelism)).mapPartitions(stored)
    change_rows = dealt.map(lambda r: ((home_of(first, r[0]), r[0], 1, r[1][0], repr(r[1][1:])), r[1]))
    both = table_rows.union(change_rows).repartitionAndSortWithinPartitions(len(bounds), partition, True)

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        """A row (partition, home, n, differs, spool) for each home of the partition."""
        from pyspark import TaskContext

        for home, own in groupby(rows, lambda r: r[0][0]):
            writer, differs, waiting = Writer(staging, schema), False, []
            for k, same in groupby(own, lambda r: r[0][1]):
                kept, change = [], None
                for (_, _, tag, *_), value in same:
                    if tag:
                        change = value  # the last is the one that wins
                    else:
                        kept.append(value)
                if change is not None:
                    _, kind, number, values = change
                    if rules.deletes(home, kind, number):
                        differs = differs or bool(kept)
                        kept = []
                    else:
                        was, kept = kept, [list(r) for r in kept] or [[None] * width]
                        for row in kept:
                            row[at] = k
                            for spot, value in zip(spots, values):
                                row[spot] = value
                        differs = differs or not was or not all(equal(a, b) for r, s in zip(was, kept) for a, b in zip(r, s))
                waiting += kept
                if len(waiting) >= GROUP_ROWS:
                    writer.add(to_batch(waiting, schema))
                    waiting = []
            if waiting:
                writer.add(to_batch(waiting, schema))
            yield TaskContext.get().partitionId(), home, writer.rows, differs, writer.close()

    found = sorted(both.mapPartitions(fold).collect())  # a row for each home and part of one
    changed = {home for _, home, _, differs, _ in found if differs}
    spools = {h: [Part(p, 0, n) for _, home, n, _, p in found if home == h and n] for h in changed}
    new = layout(old, spools, max_rows)
    written = iter(move_in(folder, write_outputs(spark, [f for f in new if f.old is None], staging, schema), len(old)))
    after = [Output(f.rows, f.parts, f.old or next(written)) for f in new]
    for home in sorted(changed):
        store.delete_file(old[home].old)
    store.delete_dir(f"{path}/_staging")
    return after


def to_batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def first_keys(spark: SparkSession, folder: str, paths: list[str], key: str) -> list[Any]:
    """The first key of each file, from the first row group alone."""

    def read(paths: Iterator[tuple]) -> Iterator[tuple]:
        store, _ = store_of(folder)
        for k, path in paths:
            with store.open_input_file(path) as file:
                yield k, next(pq.ParquetFile(file).iter_batches(1, columns=[key])).column(0)[0].as_py()

    context = spark.sparkContext
    found = dict(context.parallelize(list(enumerate(paths)), min(len(paths), 4 * context.defaultParallelism)).mapPartitions(read).collect())
    return [found[k] for k in range(len(paths))]


def described(spark: SparkSession, folder: str, files: list[Output], before: set[str], key: str) -> DataFrame:
    """A row for each file, read again as it lies in the folder: counts and digests, its path, and whether it is new."""
    plain = folder.startswith("file:")
    scheme = "" if plain or "://" not in folder else folder[: folder.index("://") + 3]

    def cents(value: float | None) -> int:
        return math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        for part in parts:
            for file, rewritten in zip(*[c.to_pylist() for c in part.columns]):
                first, n, money, sums, digest = None, 0, 0, 0, hashlib.sha256()
                with store.open_input_file(file) as opened:
                    source = pq.ParquetFile(opened)
                    names = source.schema_arrow.names
                    for batch in source.iter_batches(GROUP_ROWS, columns=list(dict.fromkeys([key, *CHANGED]))):
                        ids, *texts, balance = ([*batch.column(c).to_pylist()] for c in (key, "source", "segment", "city", "balance"))
                        first = ids[0] if first is None else first
                        digest.update(("," * bool(n) + ",".join(map(str, ids))).encode())
                        n += len(ids)
                        money += sum(map(cents, balance))
                        sums += sum(crc("|".join(x or "" for x in t)) for t in zip(*texts))
                row = [first, n, money, sums, digest.hexdigest(), ",".join(names), file if plain else scheme + file, rewritten]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=columns)

    types = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.bool_()]
    columns = ["first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "path", "rewritten"]
    rows = spark.createDataFrame([(f.old, f.old not in before) for f in files], "file string, rewritten boolean")
    rows = rows.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)), "file")
    return rows.mapInArrow(read, "first_id bigint, n_rows bigint, cents bigint, rows_crc bigint, ids_sha256 string, columns string, path string, rewritten boolean")


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 7


def clients_upsert(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """Start a folder from part of ``clients``, apply ``changes`` to it, and describe its files."""
    spark = clients.sparkSession
    folder = shared_folder(spark, "clients")
    max_rows = 1 + clients.count() // 1000
    start = create(clients.filter(remainder(F.col("client_id")) > 3), "client_id", folder, max_rows)
    after = upsert(spark, folder, start, "client_id", changes, max_rows)
    return described(spark, folder, after, {f.old for f in start}, "client_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients_upsert(table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes"))
