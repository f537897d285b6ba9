"""Incremental scoring: genotypes of new people arrive as files and are scored against static packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pgsloom.operators import match, score

#: How the measures of a person's parts make those of the whole: these are least or greatest, all others are sums.
LEAST, GREATEST = ("weight_min",), ("weight_max",)


def score_stream(dna: DataFrame, pack: DataFrame, folder: str) -> DataFrame:
    """Score each batch of new genotypes; a batch that runs again replaces what it wrote before.

    Batches are written to a partition of their own, overwritten as a whole, so replay is idempotent. What is written are
    the measures of the batch's genotypes, to be added up: a person may come in any number of batches, each genotype once.
    """
    out = f"{folder}/scores"

    def one(batch: DataFrame, batch_id: int) -> None:
        scored = score.pgs_aggregate(match.variant_match(pack, batch)).withColumn("batch", F.lit(batch_id))
        scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    dna.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return total(dna.sparkSession.read.parquet(out))


def total(parts: DataFrame) -> DataFrame:
    """The measures of each score of each person over all batches."""
    how = {c: F.min if c in LEAST else F.max if c in GREATEST else F.sum for c in parts.columns if c not in (*score.BY, "batch")}
    return parts.groupBy(*score.BY).agg(*[f(c).alias(c) for c, f in how.items()])
