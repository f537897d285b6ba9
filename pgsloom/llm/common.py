"""Shared pieces of the corpus operators: checkpoints, ranks without one big task, links to components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without its lineage.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is set only where there is none and Spark runs on
    this machine alone (tests).
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    if not spark.sparkContext.getCheckpointDir():
        cut(spark.range(0))
    return re.sub(r"^file:/+", "file:///", f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_slices(parts: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what a task makes of one is small; at the end the worker gives back what it has free.

    A Python worker lives on from task to task, and its allocators would keep the most that any task has used.
    """
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)
    trim()


def trim() -> None:
    """Give back memory that the allocators of this process hold free."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, group: list[str], order: Column, ties: list[str], out: str, per_bucket: int = 50_000, size: str | None = None) -> DataFrame:
    """Add ``out``: for each row the number of rows (or sum of ``size``) before it in its group, by ``order`` then ``ties``.

    ``order`` is a 64-bit hash. A group is cut into equal ranges of the hash, each range is one window, and ranges
    are stitched by the totals before them, so that no group has to fit in one task.
    """
    amount = F.col(size) if size else F.lit(1).cast("long")
    ranges = max(1, -(-df.count() // per_bucket))
    df = df.withColumn("__h", order).withColumn("__b", F.floor((F.col("__h").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * ranges).cast("long"))
    totals = df.groupBy(*group, "__b").agg(F.sum(amount).alias("__t"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__b").alias("__gb"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__at"))
    inside = Window.partitionBy(*group, "__b").orderBy("__h", *ties).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = F.col("__b") == F.col("__gb")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return df.join(totals, same).withColumn(out, F.col("__at") + F.col("__in")).drop("__h", "__b", "__in", "__at", "__gb", *[f"__g{i}" for i in range(len(group))])


def running(df: DataFrame, group: list[str], at: str, amount: str, out: str, width: int = 10_000) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows of a group before this one by ``at``, a number from 0 without ties.

    Ranges of ``width`` numbers are one window each and are stitched by the totals before them.
    """
    df = df.withColumn("__b", F.expr(f"`{at}` div {width}"))
    totals = df.groupBy(*group, "__b").agg(F.sum(amount).alias("__t"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__at"))
    inside = Window.partitionBy(*group, "__b").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return df.join(totals, [*group, "__b"]).withColumn(out, F.col("__at") + F.col("__in")).drop("__b", "__in", "__at")


def components(edges: DataFrame, per_task: int = 250_000) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node that it can reach.

    Large-star and small-star steps alternate until each node hangs from its root: a link goes from a greater to a smaller
    node, so where no node has two links up and none is both above and below, the one above is the least of all.
    Every step is a minimum by node (combined before the shuffle) and a join, and its links are written to the
    checkpoint folder, so no component is ever gathered in one place. A step takes one task for each ``per_task`` links
    that it starts from, so that few links are not spread over as many small files as the session has partitions.
    """

    def star(links: DataFrame, small: bool, tasks: int) -> DataFrame:
        both = links if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
        joined = both.join(least, F.col("u") == F.col("w"))
        if small:  # u > v: all smaller neighbours and u itself hang from the least
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        else:
            moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)

    def state(links: DataFrame) -> tuple:
        """Number of links, and of nodes that hang from several others or from one that hangs itself: without these all is done."""
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        return tuple(nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("low") == 0)))).first())

    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    count, left = state(links)
    while left:
        tasks = count // per_task + 1
        links = cut(star(star(links.coalesce(tasks), False, tasks), True, tasks))
        count, left = state(links)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
