"""Mix sources to target weights, in fixed-length blocks of words.

The documents of a source are packed one after the other, in a pseudorandom order, into blocks of ``block_words`` words.
For each output shard the number of blocks of each source is drawn (multinomial: each slot draws its source); counts are
then settled so that every source gets exactly its number of blocks: draws beyond it go to sources that lack some.
The j-th draw of a source takes block ``perm(j mod blocks)`` of the epoch ``j div blocks``, each epoch with a
pseudorandom permutation of its own (rank by a keyed hash), and blocks are joined by index. Only DataFrame operations.
Places of documents, blocks and shards come from prefix scans over ranges; only windows over the table of sources, one
row each, are in one task.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, ordered last;
repeated rows and null doc_ids are documents of their own; documents whose key and size tie are in the order of their rows; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pgsloom.llm.common import cut, ranked, running, table, word_count


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes by weight, no source above ``cap`` times its size.

    What is above is shared again by weight until no source is above. That is the level L with
    sum(min(cap * size, L * weight)) = total, found from running sums over the sources in order of cap * size / weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by = by.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("r") % len(weights) + 1).cast("int")))
    by = by.withColumn("top", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("top") / F.col("w"), "r")
    all_rows = Window.partitionBy()
    by = by.withColumn("full", F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.col("full")) / F.col("rest"))
    by = by.withColumn("L", F.min(F.when(F.col("level") < F.col("top") / F.col("w"), F.struct("full", "level"))).over(all_rows)["level"])
    return by.select("source", "source_size", F.when(F.col("L").isNull(), F.col("top")).otherwise(F.least("top", F.col("L") * F.col("w"))).alias("target"), F.col("r").cast("long").alias("s"))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from a keyed hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / F.lit(2.0**53)


@dataclass
class Mix:
    """The parts of a mix.

    sizes: a row for each document; targets: for each source; slots: (shard, s, j, block, epoch) for each block of the
    output; pieces: (rid, s, block, words) which words of which block come from which document.
    """

    sizes: DataFrame
    targets: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """A row for each document with the words that the mix takes of it, repeats counted."""
        # cut: the driver renders a plan anew after each of its stages, so one long plan takes the square of its length
        times = cut(self.slots.groupBy("s", "block").agg(F.count("*").alias("times")))
        got = cut(self.pieces.join(times, ["s", "block"]).groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
        docs = self.sizes.join(F.broadcast(self.targets) if few(self.targets) else self.targets, self.sizes["source"].eqNullSafe(self.targets["source"])).drop(self.targets["source"])
        return docs.join(got, "rid", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def few(rows: DataFrame, most: int = 10_000) -> bool:
    """Whether a table of sources is small enough to be sent to every task."""
    return rows.count() <= most


def draws(by: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, s, j): the slots of the output; the j of a source are 0 .. quota - 1, each once."""
    spark = by.sparkSession
    order = Window.orderBy("s")
    by = by.withColumn("hi", F.sum("quota").over(order)).withColumn("lo", F.col("hi") - F.col("quota"))
    total, sources = by.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    # each slot draws a source by a uniform number; the range it falls in is found by an equality join on cells
    cells = max(1, 4 * sources)
    ends = by.filter("quota > 0").select("s", "quota", (F.col("lo") / total).alias("p"), (F.col("hi") / total).alias("q")) if total else by.select("s", "quota", F.lit(0.0).alias("p"), F.lit(0.0).alias("q")).limit(0)
    ends = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("p") * cells), F.least(F.floor(F.col("q") * cells), F.lit(cells - 1).cast("long")))))
    slots = spark.range(total).select((F.col("id") / F.lit(shard_blocks)).cast("long").alias("shard"), uniform(F.lit(seed), F.col("id")).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells))
    got = slots.join(ends, "cell").filter("u >= p and (u < q or q >= 1)").groupBy("shard", "s").agg(F.count("*").alias("n"))
    got = cut(got)
    # settle: of each source the draws up to its quota count; the others go, in order, to the sources that lack some
    got = running(got, ["s"], "shard", "n", "from").join(by.select("s", "quota"), "s")
    got = got.withColumn("keep", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("from"))))
    over = got.groupBy("shard").agg(F.sum(F.col("n") - F.col("keep")).alias("over")).filter("over > 0")
    over = running(over, [], "shard", "over", "at")
    over = over.select("shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("over") - 1)).alias("k"))
    lack = by.join(got.groupBy("s").agg(F.sum("n").alias("drawn")), "s", "left").withColumn("have", F.least("quota", F.coalesce("drawn", F.lit(0)))).filter("quota > have")
    lack = lack.withColumn("at", F.coalesce(F.sum(F.col("quota") - F.col("have")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lack = lack.select("s", "at", "have", F.explode(F.sequence(F.col("have"), F.col("quota") - 1)).alias("j")).select("s", "j", (F.col("at") + F.col("j") - F.col("have")).alias("k"))
    kept = got.filter("keep > 0").select("shard", "s", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("keep") - 1)).alias("j"))
    return kept.unionByName(over.join(lack, "k").select("shard", "s", "j"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 128, shard_blocks: int = 4096, seed: int = 20) -> Mix:
    sizes = cut(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", word_count(F.col("text")).alias("size")))
    goal = cut(targets(sizes, weights, share, cap))
    by = goal.withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    by = by.withColumn("quota", F.coalesce(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))).cast("long"), F.lit(0)))
    by = cut(by.withColumn("quota", F.least("quota", (F.floor(F.lit(float(cap)) * F.col("blocks"))).cast("long"))))

    keyed = sizes.filter("size > 0").join(by.select(F.col("source").alias("name"), "s"), F.col("source").eqNullSafe(F.col("name"))).select("rid", "doc_id", "s", "size")
    placed = ranked(keyed, ["s"], F.xxhash64(F.lit(seed), "s", "doc_id"), ["doc_id", "size", "rid"], "at", size="size")
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    pieces = placed.select("rid", "s", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("at"), F.col("block") * block_words)
    pieces = pieces.select("rid", "s", "block", words.alias("words"))

    slots = cut(draws(by, shard_blocks, seed)).join(by.select("s", "blocks"), "s")
    slots = slots.select("shard", "s", "j", F.expr("j div blocks").alias("epoch"), F.expr("j % blocks").alias("i"))
    needed = by.filter("quota > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1) div blocks"))))
    # no single row makes more than 10,000 others: a source's blocks are made in two steps
    needed = needed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(blocks - 1) div 10000"))))
    blocks = needed.select("s", "epoch", F.explode(F.sequence(F.col("part") * 10_000, F.least(F.col("blocks"), (F.col("part") + 1) * 10_000) - 1)).alias("block"))
    blocks = ranked(blocks, ["s", "epoch"], F.xxhash64(F.lit(seed + 1), "s", "epoch", "block"), ["block"], "i")
    return Mix(sizes, goal, slots.join(blocks, ["s", "epoch", "i"]).select("shard", "s", "j", "block", "epoch"), pieces)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).taken()
