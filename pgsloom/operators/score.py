"""Aggregates of matched variants, for any number of people, traits and scores in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pgsloom.functions import alleles as A
from pgsloom.functions import display as D

BY = ["individual_id", "pgs_id"]


def pgs_aggregate(matched: DataFrame, by: list[str] = BY) -> DataFrame:
    """Twelve measures of each score of each person."""
    c, w = F.col("contribution"), F.col("effect_weight")

    def count(condition: Column) -> Column:
        return F.count_if(condition)

    return matched.groupBy(*by).agg(
        F.sum(c).alias("raw_score"), F.count("*").alias("matched_variants"), count(F.col("imputed")).alias("imputed_variants"), count(~F.col("imputed")).alias("genotyped_variants"),
        count(c > 0).alias("positive_count"), F.sum(F.when(c > 0, c).otherwise(0.0)).alias("positive_sum"), count(c < 0).alias("negative_count"), F.sum(F.when(c < 0, c).otherwise(0.0)).alias("negative_sum"),
        F.sum(w * w).alias("weight_sum_squared"), F.min(w).alias("weight_min"), F.max(w).alias("weight_max"),
    )


def chromosome_counts(matched: DataFrame, by: list[str] = BY) -> DataFrame:
    return matched.groupBy(*by, "chr").agg(F.count("*").alias("n"))


def chromosome_map(matched: DataFrame, by: list[str] = BY) -> DataFrame:
    """A map from chromosome to matched variants for each score."""
    return chromosome_counts(matched, by).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chr", "n")))).alias("chromosomes"))


def coverage_percent(found: Column, total: Column) -> Column:
    """Per cent of the variants in a map of totals that a map of counts has."""
    add = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.coalesce(F.try_divide(add(found) * 100.0, add(total)), F.lit(0.0))


def weight_histogram(matched: DataFrame, by: list[str] = BY, buckets: int = 10) -> DataFrame:
    """Counts in equal-width buckets of the weights of each score; scores with a single weight have none.

    Rows are first counted by distinct weight, so the ranges are joined with few rows.
    """
    counted = matched.groupBy(*by, "effect_weight").agg(F.count("*").alias("n"))
    span = Window.partitionBy(*by)
    counted = counted.withColumn("low", F.min("effect_weight").over(span)).withColumn("high", F.max("effect_weight").over(span)).filter("low <> high")
    bucket = F.least(F.floor((F.col("effect_weight") - F.col("low")) / ((F.col("high") - F.col("low")) / float(buckets))) + 1, F.lit(buckets)).cast("int")
    return counted.groupBy(*by, bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def weight_buckets(matched: DataFrame, by: list[str] = BY, buckets: int = 10) -> DataFrame:
    """All buckets with bounds, label and count, zeros included; one bucket where all weights are equal."""
    found = weight_histogram(matched, by, buckets)
    spans = matched.groupBy(*by).agg(F.min("effect_weight").alias("low"), F.max("effect_weight").alias("high"), F.count("*").alias("total"))
    spans = spans.withColumn("bucket", F.explode(F.when(F.col("low") == F.col("high"), F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(buckets)))))
    step = (F.col("high") - F.col("low")) / float(buckets)
    out = spans.join(found, [*by, "bucket"], "left").withColumn("from", F.col("low") + (F.col("bucket") - 1) * step).withColumn("to", F.when(F.col("low") == F.col("high"), F.col("high")).otherwise(F.col("low") + F.col("bucket") * step))
    return out.select(*by, "bucket", "from", "to", F.when(F.col("low") == F.col("high"), F.col("total")).otherwise(F.coalesce("n", F.lit(0))).alias("n"), D.bucket_label(F.col("from"), F.col("to")).alias("label"))


def pgs_totals(pack: DataFrame) -> DataFrame:
    return pack.groupBy("pgs_id").agg(F.count("*").alias("total_variants"))


def chromosome_totals(pack: DataFrame, chosen: DataFrame) -> DataFrame:
    """Variants by chromosome of the chosen scores."""
    return pack.join(chosen.select("pgs_id").distinct(), "pgs_id", "left_semi").groupBy("pgs_id", "chr").agg(F.count("*").alias("n"))


def pack_scan(pack: DataFrame) -> DataFrame:
    """Count and first weight of each score, over all packs."""
    return pack.groupBy("pgs_id").agg(F.count("*").alias("n"), F.min_by("effect_weight", F.struct("chr", "pos", "allele_key")).alias("first_weight"))


def top_variants(matched: DataFrame, k: int = 20, by: list[str] = BY) -> DataFrame:
    """The k variants of each score with the largest uncentred contribution; rank 1 first.

    One window for all scores: the planner keeps only k rows a group before the shuffle.
    """
    shown = F.col("effect_weight") * F.col("dosage")
    rows = matched.filter("dosage > 0").withColumn("contribution_display", shown)
    order = Window.partitionBy(*by).orderBy(F.abs("contribution_display").desc(), "variant_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return rows.select(*by, "rank", "variant_id", "effect_allele", "effect_weight", "dosage", "imputed", "contribution_display", A.user_genotype(F.col("user_variant_id"), F.col("imputed"), F.col("dosage")).alias("user_genotype"), "chr", "pos")


def waterfall(top: DataFrame, by: list[str] = BY) -> DataFrame:
    """Where each bar of the running sum of contributions starts and ends."""
    until = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("contribution_display").over(until)
    return top.select(*by, "rank", (end - F.col("contribution_display")).alias("start"), end.alias("end"))


def other_genotypes(top: DataFrame, dna: DataFrame) -> DataFrame:
    """What other people have at the positions of a person's top variants."""
    there = dna.groupBy(F.col("individual_id").alias("other_id"), "chr", "pos").agg(F.max_by("genotype_dosage", "variant_id").alias("other_dosage"))
    here = top.select("individual_id", "pgs_id", "rank", "chr", "pos")
    return here.join(there, ["chr", "pos"]).filter("individual_id <> other_id").select("individual_id", "pgs_id", "rank", "other_id", "other_dosage")
