"""Matching of score variants with people's genotypes, and contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pgsloom.functions import alleles as A

KEYS = ["chr", "pos", "allele_key"]


def load_dna(dna: DataFrame) -> DataFrame:
    """The numeric columns of genotypes; a missing expected dosage is 0."""
    if "expected_dosage" not in dna.columns:
        dna = dna.withColumn("expected_dosage", F.lit(0.0))
    keep = [c for c in ("individual_id", *KEYS, "genotype_dosage", "imputed", "imputation_quality", "expected_dosage", "variant_id") if c in dna.columns]
    return dna.select(*keep).withColumn("expected_dosage", F.coalesce("expected_dosage", F.lit(0.0)))


def contribution(orient: bool = False) -> Column:
    """weight * (dosage - expected if imputed) * (square root of the imputation quality if imputed).

    ``orient``: dosage and expectation count the effect allele where that is not ALT (the documented form).
    """
    dosage, expected = F.col("dosage"), F.when(F.col("imputed"), F.col("expected_dosage")).otherwise(0.0)
    if orient:
        swapped = F.col("effect_allele") != F.col("__alt")
        dosage = F.when(swapped, 2.0 - dosage).otherwise(dosage)
        expected = F.when(F.col("imputed"), F.when(swapped, 2.0 - F.col("expected_dosage")).otherwise(F.col("expected_dosage"))).otherwise(0.0)
    scale = F.when(F.col("imputed") & F.col("imputation_quality").isNotNull(), F.sqrt("imputation_quality")).otherwise(1.0)
    return F.col("effect_weight") * (dosage - expected) * scale


def variant_match(pack: DataFrame, dna: DataFrame, orient: bool = False) -> DataFrame:
    """Inner join on the three integer keys, for any number of people and scores at once.

    Both sides are reduced to what is used before the join; which side is broadcast is left to the planner's size
    check, and large joins are sort-merge joins that adaptive execution splits where a chromosome is skewed.
    """
    right = load_dna(dna).withColumnRenamed("variant_id", "user_variant_id").withColumnRenamed("genotype_dosage", "dosage")
    if orient:
        right = right.withColumn("__alt", A.part(F.col("user_variant_id"), 4))  # once a genotype, not once a match
    return pack.join(right, KEYS).withColumn("contribution", contribution(orient)).drop("__alt")


def keyed(rows: DataFrame, missing: int) -> DataFrame:
    """Rows whose computed allele key is never null: ``missing``, a negative number of its own on each side of a join, matches none.

    For a key that may be null the planner adds a filter and moves it down to the scan, so that the whole hash is computed
    once more for every row that is read. Stored keys need none of this (and bucketed ones are to be joined as they are).
    """
    return rows.withColumn("allele_key", F.coalesce("allele_key", F.lit(missing).cast("long")))


def genotyped_match(pack: DataFrame, genotyped: DataFrame) -> DataFrame:
    """Match by position only; the dosage counts effect alleles, rows without any are dropped.

    Of several genotypes at one position of a person one is kept: the last in the order of the alleles.
    """
    here = genotyped.groupBy("individual_id", F.concat_ws(":", "chromosome", "position").alias("key")).agg(F.max(F.struct("allele1", "allele2")).alias("a"))
    scored = pack.withColumn("key", A.position_key(F.col("variant_id"))).join(here, "key")
    scored = scored.withColumn("dosage", A.count_effect_alleles(F.col("a.allele1"), F.col("a.allele2"), F.col("effect_allele")))
    return scored.filter("dosage > 0").select("individual_id", "pgs_id", "variant_id", "effect_allele", "effect_weight", "dosage", F.concat("a.allele1", "a.allele2").alias("genotype"))


def legacy_match(pack: DataFrame, dna: DataFrame) -> DataFrame:
    """Match by rsid, else by ``chr:pos``, else by variant id."""

    def key(df: DataFrame) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("rsid",) if c in df.columns], A.position_key(F.col("variant_id")), F.col("variant_id"))

    return pack.withColumn("key", key(pack)).join(dna.select(key(dna).alias("key"), *[c for c in dna.columns if c not in pack.columns]), "key")
