"""Alignment chains: liftover blocks by running sums over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pgsloom.functions.alleles import chromosome_code
from pgsloom.sources.bed import read_bed  # noqa: F401


def lines_in_order(spark: SparkSession, paths: str) -> DataFrame:
    """(file, block, n, value): lines of text files with the split that each is in and its order in there."""
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.text(paths).select(*at, F.monotonically_increasing_id().alias("n"), "value")


def read_chain(spark: SparkSession, paths: str) -> DataFrame:
    """(chr, hg19_start, hg19_end, hg38_offset): the ungapped blocks of chains that stay on one chromosome and strand.

    Files are split like any text. Each line gets its chain: the last header before it in its split, or the last one of the
    splits before (one row a split). Starts of blocks are then running sums of sizes and gaps over the lines of a chain,
    so that no file is read as a whole; a blank line ends a chain.
    """
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    field = lambda i: F.get(f, F.lit(i))
    lines = lines_in_order(spark, paths).filter(~F.trim("value").startswith("#"))
    header = F.struct("block", "n", *[field(i).alias(f"f{i}") for i in (2, 4, 5, 7, 9, 10)])
    blank = F.trim("value") == ""
    # where a chain begins or ends: its header, or a null after it
    lines = lines.withColumn("mark", F.when(field(0) == "chain", F.struct(F.lit(True).alias("open"), header.alias("h"))).when(blank, F.struct(F.lit(False).alias("open"), F.lit(None).cast(lines.select(header.alias("h")).schema["h"].dataType).alias("h"))))
    own = Window.partitionBy("file", "block").orderBy("n")
    lines = lines.withColumn("own", F.last("mark", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    splits = lines.groupBy("file", "block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("n"))).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    lines = lines.join(carried, ["file", "block"]).withColumn("h", F.coalesce("own", "carried")["h"])
    rows = lines.filter(F.col("h").isNotNull() & (field(0) != "chain") & ~blank).filter((F.col("h.f2") == F.col("h.f7")) & (F.col("h.f4") == "+") & (F.col("h.f9") == "+"))
    number = lambda i: F.coalesce(field(i).cast("long"), F.lit(0).cast("long"))
    rows = rows.select("file", "h", "block", "n", number(0).alias("size"), number(1).alias("gap"), number(2).alias("other_gap"))
    chain = Window.partitionBy("file", "h.block", "h.n").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda gap: F.coalesce(F.sum(F.col("size") + F.col(gap)).over(chain), F.lit(0))
    rows = rows.select("h", "size", moved("gap").alias("a"), moved("other_gap").alias("b"))
    start, to = F.col("h.f5").cast("long") + F.col("a"), F.col("h.f10").cast("long") + F.col("b")
    out = rows.select(chromosome_code(F.col("h.f2")).alias("chr"), start.cast("int").alias("hg19_start"), (start + F.col("size")).cast("int").alias("hg19_end"), (to - start).cast("int").alias("hg38_offset"))
    return out.filter("chr is not null")
