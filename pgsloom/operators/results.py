"""Stores of results: upserts, replacement, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win over old rows with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str], always_new: tuple[str, ...] = ()) -> DataFrame:
    """New values win where they are not null; columns of ``always_new`` are taken from new rows in any case."""
    rows = old.alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), keys, "full_outer")
    value = lambda c: F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in always_new else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return rows.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All old rows of a key that new rows have go."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def skip_existing(people: DataFrame, traits: DataFrame, done: DataFrame) -> DataFrame:
    """(individual_id, trait_id) still to be computed."""
    return people.select("individual_id").distinct().crossJoin(traits.select("trait_id").distinct()).join(done, ["individual_id", "trait_id"], "left_anti")


def nested(trait_results: DataFrame, pgs_results: DataFrame) -> DataFrame:
    """Each trait result with the list of its score results, best first."""
    of = F.sort_array(F.collect_list(F.struct("quality_score", "pgs_id", "z_score")), asc=False)
    return trait_results.join(pgs_results.groupBy("individual_id", "trait_id").agg(of.alias("scores")), ["individual_id", "trait_id"], "left")
