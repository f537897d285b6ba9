"""Results that must not depend on the order of addition or on made ids."""

import pytest

from pgsloom.operators import catalog, norms, report
from pgsloom.queries import QUERIES


def test_validate_score_knows_made_ids_only_when_told(spark):
    rows = spark.createDataFrame([("PGS002724", "LDpred2", "NR"), ("PGS000001", None, "beta")], "pgs_id string, method_name string, weight_type string")
    assert {r.pgs_id: r.reason for r in catalog.validate_score(rows).collect()} == {"PGS002724": "known", "PGS000001": "standard"}
    assert {r.pgs_id: r.reason for r in catalog.validate_score(rows, known=()).collect()} == {"PGS002724": "modern method", "PGS000001": "standard"}


def test_validate_score_query_on_many_suppliers(spark, tmp_path):
    spark.range(2720, 2730).selectExpr("id as s_suppkey", "cast(0 as int) as s_nationkey", "0d as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    assert "known" not in {r.reason for r in QUERIES["validate_score"](spark, str(tmp_path)).collect()}


def test_extremes_take_the_order_of_addition_for_a_tie(spark):
    z = 16.14415159817334
    up, rows = z + 4e-15, []
    assert up > z
    for person, value in (("IND0", z), ("IND3", up), ("IND1", 12.0)):
        rows.append((person, "T", "P", -value, 10, 20))
    found = report.extremes(spark.createDataFrame(rows, "individual_id string, trait_id string, pgs_id string, z_score double, matched_variants long, total_variants long"), most=2)
    assert [r.individual_id for r in found.collect()] == ["IND0", "IND3"]


def test_theoretical_norm_rounds_half_way_values_up(spark, monkeypatch):
    rows = spark.createDataFrame([("A", -0.1, 0.19817349999999992, 0.4), ("B", 0.1, 0.22079750000000004, 0.4)], "pgs_id string, mean double, variance double, sd double")
    monkeypatch.setattr(norms, "theoretical", lambda pack, af: rows)
    got = {r.pgs_id: r.variance for r in QUERIES["theoretical_norm"](spark, "/root/testdata/sf0.001").collect()}
    assert got == pytest.approx({"A": 0.198174, "B": 0.220798}, abs=1e-12)
