"""Column functions of the normal distribution, norms and weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polynomial of the error function (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Rational approximation of the inverse normal distribution (centre a/b, tails c/d).
INVERSE_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.38357751867269e2, -3.066479806614716e1, 2.506628277459239)
INVERSE_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1)
INVERSE_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INVERSE_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)
TAIL = 0.02425


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Value of the polynomial whose highest coefficient comes first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    y = 1.0 - polynomial(t, ERF_A[::-1]) * t * F.exp(-x * x)
    return F.when(x >= 0, y).otherwise(-y)


def percentile(z: Column) -> Column:
    """0-100 from a z-score; null for null."""
    return F.lit(50.0) * (1.0 + erf(z / math.sqrt(2)))


def display_percentile(z: Column) -> Column:
    """Whole percentile between 1 and 99."""
    return F.floor(F.greatest(F.lit(1.0), F.least(F.lit(99.0), percentile(z))) + 0.5).cast("int")


def piecewise_percentile(z: Column) -> Column:
    """Legacy percentile: linear between whole standard deviations, 1-99."""
    a = F.abs(z)
    up = F.when(a < 1, 50 + a * 34.13).when(a < 2, 84.13 + (a - 1) * 13.59).when(a < 3, 97.72 + (a - 2) * 2.14).otherwise(99.87)
    both = F.when(z < 0, 100 - up).otherwise(up)
    return F.floor(F.greatest(F.lit(1.0), F.least(F.lit(99.0), both)) + 0.5).cast("int")


def interpretation(p: Column) -> Column:
    steps = ((95, "Very high risk"), (80, "High risk"), (60, "Elevated risk"), (40, "Average risk"), (20, "Below average risk"), (5, "Low risk"))
    out = F.when(p >= steps[0][0], steps[0][1])
    for least, label in steps[1:]:
        out = out.when(p >= least, label)
    return out.otherwise("Very low risk")


def inverse_normal(p: Column) -> Column:
    """z-score of a probability between 0 and 1."""
    low, high = F.sqrt(-2.0 * F.log(p)), F.sqrt(-2.0 * F.log(1.0 - p))
    tail = lambda q: polynomial(q, INVERSE_C) / polynomial(q, (*INVERSE_D, 1.0))
    q = p - 0.5
    r = q * q
    middle = polynomial(r, INVERSE_A) * q / polynomial(r, (*INVERSE_B, 1.0))
    return F.when(p < TAIL, tail(low)).when(p <= 1 - TAIL, middle).otherwise(-tail(high))


def percentile_grid(mean: Column, sd: Column, points: int = 99) -> Column:
    """Scores at the percentiles 1 .. points of a normal distribution."""
    return F.transform(F.sequence(F.lit(1), F.lit(points)), lambda p: mean + inverse_normal(p / 100.0) * sd)


def round_significant(x: Column, digits: int = 3) -> Column:
    """Round to significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x * scale + 0.5) / scale)


def density(mean: Column, sd: Column, bins: int = 25) -> Column:
    """Normal density at the middle of equal bins over mean -4 sd .. mean +4 sd, to three significant digits."""

    def at(i: Column) -> Column:
        z = -4.0 + (i + 0.5) * (8.0 / bins)
        return round_significant(F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi)))

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), at)


def z_score(score: Column, mean: Column, sd: Column) -> Column:
    return F.when(mean.isNotNull() & (sd != 0), F.try_divide(score - mean, sd))


def theoretical_sd(weight_sum_squared: Column, count: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.sqrt(weight_sum_squared * 0.5))


def dr2(truth: Column, dosage: Column) -> Column:
    """Aggregate: squared correlation of true and imputed dosage, 0 where either is constant, between 0 and 1."""
    squared = F.try_divide(F.pow(F.covar_pop(truth, dosage), F.lit(2.0)), F.var_pop(truth) * F.var_pop(dosage))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(squared, F.lit(0.0))))


def log_odds(frequency: Column) -> Column:
    """Weight proxy of an allele frequency."""
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), frequency))
    return F.log(p / (1.0 - p))


def metric_name(name: Column) -> Column:
    """Metric names with single spaces."""
    return F.trim(F.regexp_replace(name, r"\s+", " "))


#: Names of R2 metrics, and ranks of metrics by variant.
R2_NAMES = ("R²", "PGS R2 (no covariates)")
RANKS = {"catalog": {"C-index": 4, "R²": 3, "AUROC": 3, "AUC": 3, "OR": 1, "HR": 1, "β": 1}, "enhanced": {"C-index": 4, "R²": 3, "AUC": 2, "OR": 1, "HR": 1}}


def metric_rank(kind: Column, variant: str = "catalog") -> Column:
    out = F.lit(0)
    for name, rank in RANKS[variant].items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def performance_weight(kind: Column, value: Column, variant: str = "catalog") -> Column:
    """0-1 weight of a score by its best metric; 0.5 without one."""
    classes, ratios = (("C-index", "AUROC", "AUC"), ("OR", "HR", "β")) if variant == "catalog" else (("C-index", "AUC"), ("OR", "HR"))
    centred = F.greatest(F.lit(0.0), (value - 0.5) * 2.0)
    if variant == "catalog":
        centred = F.least(F.lit(1.0), centred)
    return F.when(kind.isNull() | value.isNull(), 0.5).when(kind.isin(*classes), centred).when(kind == "R²", F.least(F.lit(1.0), value)).when(kind.isin(*ratios), F.least(F.lit(1.0), F.abs(F.log(value)) / 2.0)).otherwise(0.5)


def admixed_norm(shares: Column, norms: Column) -> Column:
    """struct(m, s) of a person's norm from maps of ancestry shares and of ancestry norms."""
    keys = F.map_keys(norms)
    add = lambda f: F.aggregate(keys, F.lit(0.0), lambda t, k: t + F.coalesce(F.element_at(shares, k), F.lit(0.0)) * f(F.element_at(norms, k)))
    return F.struct(add(lambda n: n["m"]).alias("m"), F.sqrt(add(lambda n: n["s"] * n["s"])).alias("s"))


def residual(score: Column, components: list[Column], coefficients: list[float], intercept: float = 0.0) -> Column:
    """Score less what principal components predict."""
    predicted = F.lit(float(intercept))
    for c, b in zip(components, coefficients, strict=True):
        predicted = predicted + c * F.lit(float(b))
    return score - predicted
