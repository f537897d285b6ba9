"""From aggregates to results: normalization, quality, the best score of each trait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pgsloom.functions import quality as Q
from pgsloom.functions import statistics as S

#: Fixed values.
LEAST_COVERAGE = 0.05
SAFE_COVERAGE = 0.8
FAR_SIGMA = 20.0


def best_r2(performance: DataFrame) -> DataFrame:
    """The highest R2 of each score; percentages become shares."""
    value = F.when(F.col("metric_value") > 1, F.col("metric_value") / 100.0).otherwise(F.col("metric_value"))
    kept = performance.filter(S.metric_name(F.col("metric_type")).isin(*S.R2_NAMES))
    return kept.groupBy("pgs_id").agg(F.max(value).alias("r2"))


def registered(people: DataFrame, trait_pgs: DataFrame) -> DataFrame:
    """Every person with every registered score: scores without any match appear as well."""
    return people.select("individual_id").distinct().crossJoin(trait_pgs.select("trait_id", "pgs_id").distinct())


def pgs_results(aggregates: DataFrame, totals: DataFrame, scores: DataFrame, r2: DataFrame, trait_pgs: DataFrame, people: DataFrame) -> DataFrame:
    """A row for each person, trait and registered score."""
    rows = registered(people, trait_pgs).join(aggregates, ["individual_id", "pgs_id"], "left").join(totals, "pgs_id", "left").join(scores.select("pgs_id", "norm_mean", "norm_sd"), "pgs_id", "left").join(r2, "pgs_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    for c in ("matched_variants", "imputed_variants", "genotyped_variants", "positive_count", "negative_count", "total_variants"):
        rows = rows.withColumn(c, zero(c))
    for c in ("raw_score", "positive_sum", "negative_sum", "weight_sum_squared"):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return normalized(rows)


def normalized(rows: DataFrame) -> DataFrame:
    """Add coverage, norm, z, percentile, quality and confidence."""
    matched, total, mean, sd = (F.col(c) for c in ("matched_variants", "total_variants", "norm_mean", "norm_sd"))
    rows = rows.withColumn("coverage", Q.coverage(matched, total))
    has = F.coalesce(sd > 0, F.lit(False))
    enough = F.col("coverage") >= LEAST_COVERAGE
    far = (F.col("coverage") < SAFE_COVERAGE) & (F.coalesce(mean, F.lit(0.0)) != 0) & (F.coalesce(F.abs(F.try_divide(F.col("raw_score") - mean, sd)), F.lit(0.0)) > FAR_SIGMA)
    rows = rows.withColumn("empirical", has & enough & ~far).withColumn("insufficient_empirical", ~has | ~enough)
    theory = ~F.col("empirical") & (matched > 0)
    rows = rows.withColumn("used_mean", F.when(theory, 0.0).otherwise(mean)).withColumn("used_sd", F.when(theory, F.sqrt(F.col("weight_sum_squared") * 0.5)).otherwise(sd))
    z = F.when((matched > 0) & (F.col("used_sd") > 0), F.try_divide(F.col("raw_score") - F.col("used_mean"), F.col("used_sd")))
    rows = rows.withColumn("z_score", z).withColumn("percentile", S.percentile(F.col("z_score"))).withColumn("insufficient_data", matched < Q.LEAST_VARIANTS)
    rows = rows.withColumn("performance", F.coalesce(F.when(F.col("r2") > 0, F.col("r2")), F.lit(Q.DEFAULT_R2)))
    rows = rows.withColumn("quality_score", Q.quality_score(matched, total, F.col("performance"), ~F.col("insufficient_empirical"), F.col("z_score"), F.col("genotyped_variants")))
    return rows.withColumn("confidence", Q.confidence(matched))


def _choice() -> list[Column]:
    """Order of choice: sufficient and not extreme first, then others with a z-score; by quality, then id."""
    first = ~F.col("insufficient_data") & (F.coalesce(F.abs("z_score"), F.lit(0.0)) <= Q.MOST_SIGMA) & (F.col("quality_score") > 0)
    second = F.col("z_score").isNotNull() & (F.col("quality_score") > 0)
    return [F.when(first, 0).when(second, 1).otherwise(2), F.col("quality_score").desc(), F.col("pgs_id")]


def best_pgs(results: DataFrame) -> DataFrame:
    """The best score of each person and trait; traits without a usable score are left out."""
    order = _choice()
    rows = results.withColumn("class", order[0])
    rank = F.row_number().over(Window.partitionBy("individual_id", "trait_id").orderBy("class", *order[1:]))
    return rows.withColumn("rank", rank).filter("rank = 1 and class < 2").drop("rank", "class")


def top_pgs(results: DataFrame, k: int = 4) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("individual_id", "trait_id").orderBy(F.col("quality_score").desc(), "pgs_id"))
    return results.withColumn("rank", rank).filter(F.col("rank") <= k)


def runner_up(results: DataFrame) -> DataFrame:
    """The best score by quality beside the next one."""
    by = Window.partitionBy("individual_id", "trait_id").orderBy(F.col("quality_score").desc(), "pgs_id")
    rows = results.withColumn("rank", F.row_number().over(by)).withColumn("next_pgs", F.lead("pgs_id").over(by)).withColumn("next_quality", F.lead("quality_score").over(by)).withColumn("next_r2", F.lead("performance").over(by))
    return rows.filter("rank = 1").drop("rank")


def trait_results(results: DataFrame, traits: DataFrame) -> DataFrame:
    """A row for each person and trait: z, percentile, confidence and value of the best score.

    Without a best score z is the mean weighted by performance over sufficient, empirical, not extreme scores. Sums and
    the best score come from one aggregate, so results are read once and combined before the shuffle.
    """
    good = ~F.col("insufficient_data") & ~F.col("insufficient_empirical") & (F.abs("z_score") <= Q.MOST_SIGMA)
    first, quality, pgs = _choice()
    place = F.when(first < 2, F.struct(first.alias("c"), (-F.col("quality_score")).alias("q"), pgs.alias("p")))  # null: not to be chosen
    whole = results.groupBy("individual_id", "trait_id").agg(
        F.sum("matched_variants").alias("total_matched"), F.sum("total_variants").alias("total_expected"),
        F.sum(F.when(good, F.col("z_score") * F.col("performance"))).alias("zw"), F.sum(F.when(good, F.col("performance"))).alias("w"),
        F.min_by(F.struct("pgs_id", "z_score", "percentile", "confidence", "performance", "quality_score"), place).alias("best"),
    )
    named = {"best_pgs_id": "pgs_id", "best_z": "z_score", "best_percentile": "percentile", "best_confidence": "confidence", "best_performance": "performance", "best_quality": "quality_score"}
    whole = whole.select("individual_id", "trait_id", "total_matched", "total_expected", "zw", "w", *[F.col(f"best.{c}").alias(n) for n, c in named.items()])
    rows = whole.join(traits.select("trait_id", "trait_type", "phenotype_mean", "phenotype_sd"), "trait_id")
    rows = rows.withColumn("overall_z", F.coalesce("best_z", F.try_divide("zw", "w")))
    rows = rows.withColumn("overall_percentile", F.coalesce("best_percentile", F.when(F.col("overall_z") != 0, S.percentile(F.col("overall_z")))))
    value = F.when(F.col("trait_type") == "quantitative", Q.quantitative_value(F.col("phenotype_mean"), F.col("phenotype_sd"), F.col("overall_z"), F.coalesce("best_performance", F.lit(Q.DEFAULT_R2))))
    return rows.select("individual_id", "trait_id", "best_pgs_id", "overall_z", "overall_percentile", F.coalesce("best_confidence", F.lit("medium")).alias("confidence"), "best_performance", "best_quality", "total_matched", "total_expected", value.alias("value"))


def best_by_performance(results: DataFrame) -> DataFrame:
    """Legacy choice of the best score: by performance metric."""
    rank = F.row_number().over(Window.partitionBy("individual_id", "trait_id").orderBy(F.col("performance").desc_nulls_last(), "pgs_id"))
    return results.withColumn("rank", rank).filter("rank = 1").drop("rank")
