"""Column functions against known values and properties."""

import math

import pytest
from pyspark.sql import functions as F

from pgsloom.functions import alleles as A
from pgsloom.functions import display as D
from pgsloom.functions import quality as Q
from pgsloom.functions import statistics as S


def value(spark, column, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_allele_key_is_symmetric(spark):
    rows = spark.createDataFrame([("1:5:A:G", "1:5:G:A"), ("1:5:T:C", "1:5:C:T"), ("1:5:A", "1:5:A"), ("1:5::", "1:5::")], "a string, b string")
    for r in rows.select(A.key_of_id(F.col("a")).alias("x"), A.key_of_id(F.col("b")).alias("y")).collect():
        assert r["x"] == r["y"] and 0 <= r["x"] < 1 << 60


@pytest.mark.parametrize(("z", "want"), [(0.0, 50.0), (1.0, 84.13), (-1.0, 15.87), (1.96, 97.5), (-3.0, 0.135), (8.0, 100.0)])
def test_percentile(spark, z, want):
    assert value(spark, S.percentile(F.lit(z))) == pytest.approx(want, abs=0.01)
    assert value(spark, S.percentile(F.lit(z))) + value(spark, S.percentile(F.lit(-z))) == pytest.approx(100)


def test_percentile_of_nothing(spark):
    assert value(spark, S.percentile(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("p", [0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.9999])
def test_inverse_normal(spark, p):
    assert value(spark, S.percentile(S.inverse_normal(F.lit(p)))) == pytest.approx(100 * p, abs=1e-3)


@pytest.mark.parametrize(("z", "want"), [(0.0, 50), (0.5, 67), (-0.5, 33), (1.5, 91), (2.5, 99), (-2.5, 1), (9.0, 99)])
def test_piecewise(spark, z, want):
    assert value(spark, S.piecewise_percentile(F.lit(z))) == want


def test_z_score(spark):
    z = lambda s, m, d: value(spark, S.z_score(F.lit(s), F.lit(m).cast("double"), F.lit(d).cast("double")))
    assert z(0.08, 0.5, 0.2) == pytest.approx(-2.1) and z(1.0, None, 1.0) is None and z(1.0, 0.0, 0.0) is None and z(1.0, 0.0, None) is None


def test_theoretical_sd(spark):
    assert value(spark, S.theoretical_sd(F.lit(0.1), F.lit(50))) == pytest.approx(math.sqrt(0.05))
    assert value(spark, S.theoretical_sd(F.lit(0.1), F.lit(0))) == 1.0


def test_confidence(spark):
    assert [value(spark, Q.confidence(F.lit(n))) for n in (0, 7, 8, 9, 10, 99, 100)] == ["none", "insufficient", "low", "low", "medium", "medium", "high"]


def test_quality_grows_with_its_parts(spark):
    def q(matched=500, total=1000, r2=0.1, empirical=True, z=1.0, genotyped=100):
        return value(spark, Q.quality_score(F.lit(matched), F.lit(total), F.lit(r2), F.lit(empirical), F.lit(z).cast("double"), F.lit(genotyped)))

    base = q()
    assert q(r2=0.2) > base and q(genotyped=300) > base and q(z=2.0) > base and q(matched=900, genotyped=180) > base
    assert q(empirical=False) == pytest.approx(base - 2.5) and q(z=6.0) == q(z=None) == q(z=0.0)
    assert q(matched=0) == 0 and q(total=0) == 0 and q(matched=10, genotyped=2) < base


def test_dosages(spark):
    d = lambda *a: value(spark, A.resolve_dosage(*[F.lit(x) for x in a]))
    assert d("A", "G", "A", "G", 2.0) == 2.0 and d("A", "G", "G", "A", 2.0) == 0.0 and d("A", "G", "A", "T", 1.0) is None
    c = lambda *a: value(spark, A.count_effect_alleles(*[F.lit(x) for x in a]))
    assert (c("A", "A", "A"), c("A", "G", "A"), c("G", "G", "A")) == (2, 1, 0)
    assert [value(spark, A.genotype_dosage(F.lit(g))) for g in ("1/1", "1|1", "0|1", "1/0", "0/0")] == [2, 2, 1, 1, 0]
    assert value(spark, A.string_dosage(F.lit("AGA"), F.lit("A"))) == 2 and value(spark, A.string_dosage(F.lit(""), F.lit("A"))) == 0
    assert value(spark, A.position_key(F.lit("1:100:A:G"))) == "1:100" and value(spark, A.position_key(F.lit("rs1"))) is None


def test_strand(spark):
    def call(a1, a2, ref):
        r = value(spark, A.ref_alt_gt(F.lit(a1), F.lit(a2), F.lit(ref).cast("string")))
        return r and (r["ref"], r["alt"], r["gt"], r["flipped"])

    assert call("A", "G", "A") == ("A", "G", "0/1", False) and call("A", "A", "A") == ("A", "C", "0/0", False)
    assert call("T", "T", "A") == ("A", "C", "0/0", True) and call("G", "G", "A") is None
    assert call("G", "A", None) == ("A", "G", "0/1", False) and call("-", "A", "A") is None


def test_chromosomes(spark):
    code = lambda c: value(spark, A.chromosome_code(F.lit(c)))
    assert [code(c) for c in ("1", "chr2", "X", "chrY", "MT", "1_random", "")] == [1, 2, 23, 24, 25, None, None]


def test_performance_weight(spark):
    w = lambda k, v, variant="catalog": value(spark, S.performance_weight(F.lit(k).cast("string"), F.lit(v).cast("double"), variant))
    assert w("AUROC", 0.75) == 0.5 and w("R²", 2.0) == 1.0 and w("OR", math.e) == pytest.approx(0.5) and w(None, None) == 0.5 and w("β", math.e) == pytest.approx(0.5)
    assert w("β", 2.0, "enhanced") == 0.5 and w("AUC", 1.2, "enhanced") == pytest.approx(1.4)


def test_texts(spark):
    assert [value(spark, D.ordinal(F.lit(n))) for n in (1, 2, 3, 11, 12, 21, 42)] == [f"{x} percentile" for x in ("1st", "2nd", "3rd", "11th", "12th", "21st", "42nd")]
    assert value(spark, D.z_text(F.lit(-1.234))) == "-1.23σ" and value(spark, D.score_text(F.lit(12.345))).startswith("+12.3") and value(spark, D.z_text(F.lit(None).cast("double"))) == "N/A"
    assert value(spark, D.bucket_label(F.lit(0.5), F.lit(1.0))) == "0.50 to 1.00" and value(spark, D.bucket_label(F.lit(0.001), F.lit(0.002))) == "1.0e-3 to 2.0e-3"
    assert value(spark, D.categories(F.lit('["a", "b"]'))) == ["a", "b"] and value(spark, D.categories(F.lit("a, b,"))) == ["a", "b"]
    assert value(spark, D.convert(F.lit(100.0), F.lit("°C"), F.lit("°F"))) == pytest.approx(212) and value(spark, D.convert(F.lit(5.0), F.lit("kg"), F.lit("cm"))) == 5.0
    assert value(spark, D.trait_unit(F.lit("EFO_0004340"))) == "kg/m²" and value(spark, D.trait_unit(F.lit("?"))) == "units"


def test_significant_digits(spark):
    assert value(spark, S.round_significant(F.lit(0.0123456))) == pytest.approx(0.0123) and value(spark, S.round_significant(F.lit(0.0))) == 0
    assert len(value(spark, S.density(F.lit(0.0), F.lit(1.0)))) == 25


def test_admixture(spark):
    norms = F.expr("map('EUR', named_struct('m', 1d, 's', 2d), 'AFR', named_struct('m', 3d, 's', 4d))")
    got = value(spark, S.admixed_norm(F.expr("map('EUR', 0.25d, 'AFR', 0.75d)"), norms))
    assert got["m"] == pytest.approx(2.5) and got["s"] == pytest.approx(math.sqrt(0.25 * 4 + 0.75 * 16))
