"""Column functions of the quality formula and of what is told about a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pgsloom.functions.statistics import z_score  # noqa: F401

#: Thresholds of the formula.
DEFAULT_R2 = 0.05
LEAST_VARIANTS = 8
REFERENCE_R2 = 0.44
MOST_SIGMA = 5.0


def coverage(matched: Column, total: Column) -> Column:
    return F.when(total > 0, matched / total).otherwise(0.0)


def coverage_penalty(cov: Column) -> Column:
    return F.when(cov < 0.05, F.pow(cov / 0.05, F.lit(2.0))).when(cov < 0.2, F.sqrt(cov / 0.2)).otherwise(1.0)


def quality_parts(matched: Column, total: Column, r2: Column, empirical: Column, z: Column, genotyped: Column) -> dict[str, Column]:
    """The seven parts of the quality score."""
    cov = coverage(matched, total)
    return {
        "accuracy": r2 * 35.0 * coverage_penalty(cov),
        "validation": F.when(r2 > DEFAULT_R2, F.least(r2 / REFERENCE_R2, F.lit(1.0)) * 15.0).otherwise(0.0),
        "reliability": F.coalesce(F.try_divide(genotyped, matched), F.lit(0.0)) * 15.0,
        "coverage": F.least(cov, F.lit(1.0)) * 10.0,
        "size": F.least(F.log10(F.greatest(matched / float(LEAST_VARIANTS), F.lit(1.0))) / 3.1, F.lit(1.0)) * 10.0,
        "normalization": F.when(empirical, 5.0).otherwise(2.5),
        "signal": F.when(z.isNull() | (F.abs(z) > MOST_SIGMA), 0.0).otherwise(F.least(F.abs(z) / 3.0, F.lit(1.0)) * 10.0),
    }


def quality_score(matched: Column, total: Column, r2: Column, empirical: Column, z: Column, genotyped: Column) -> Column:
    """0-100, rounded to four digits; 0 without matches."""
    parts = list(quality_parts(matched, total, r2, empirical, z, genotyped).values())
    whole = parts[0]
    for p in parts[1:]:
        whole = whole + p
    return F.when((matched == 0) | (total == 0), 0.0).otherwise(F.floor(whole * 1e4 + 0.5) / 1e4)


#: Names and highest values of the parts.
PARTS = {"accuracy": ("Predictive Accuracy (R²)", 35), "validation": ("Validation Bonus", 15), "reliability": ("Data Reliability", 15), "coverage": ("Coverage", 10), "size": ("Sample Size", 10), "normalization": ("Normalization", 5), "signal": ("Signal Strength", 10)}


def quality_breakdown(matched: Column, total: Column, r2: Column, empirical: Column, z: Column, genotyped: Column) -> Column:
    """array(struct(name, score, max_score)) of the parts, scores to one digit."""
    parts = quality_parts(matched, total, r2, empirical, z, genotyped)
    return F.array(*[F.struct(F.lit(PARTS[k][0]).alias("name"), (F.floor(v * 10 + 0.5) / 10).alias("score"), F.lit(PARTS[k][1]).alias("max_score")) for k, v in parts.items()])


def explanation(total: Column) -> Column:
    return F.when(total >= 70, "Excellent predictive power and highly informative").when(total >= 50, "Good reliability and informative").when(total >= 30, "Moderate predictive value").otherwise("Limited predictive value")


def confidence(matched: Column) -> Column:
    return F.when(matched == 0, "none").when(matched < LEAST_VARIANTS, "insufficient").when(matched < 10, "low").when(matched < 100, "medium").otherwise("high")


def coverage_confidence(cov: Column) -> Column:
    """The documented, coverage-based variant."""
    return F.when(cov >= 0.8, "high").when(cov >= 0.5, "medium").when(cov > 0, "low").otherwise("none")


def quantitative_value(mean: Column, sd: Column, z: Column, r2: Column) -> Column:
    return mean + z * F.sqrt(r2) * sd


def margin_of_error(sd: Column, r2: Column, cov: Column) -> Column:
    return sd * F.sqrt(1.0 - r2) * F.sqrt(1.0 - cov)
