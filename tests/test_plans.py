"""Plans that must stay small: scans and exchanges of the heavier operators over stored tables."""

import re

import pytest
from pyspark.sql import functions as F

from pgsloom.operators import finalize, norms, report
from pgsloom.plans.fixtures import Inputs
from pgsloom.queries import scoring


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    t, root = Inputs(spark, sf_dir), str(tmp_path_factory.mktemp("stored"))
    for name, rows in {"results": scoring.results(t), "traits": t.view("traits"), "pack": t.view("pack"), "af": t.view("af")}.items():
        rows.write.parquet(f"{root}/{name}")
    finalize.trait_results(spark.read.parquet(f"{root}/results"), t.view("traits")).write.parquet(f"{root}/trait_results")
    return lambda name: spark.read.parquet(f"{root}/{name}")


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_validation(stored):
    text = plan(report.validation(stored("results"), stored("trait_results")))
    assert text.count("FileScan") <= 5 and len(re.findall(r"Exchange hashpartitioning", text)) <= 5
    assert text.count("Location: ") - text.count("/trait_results]") == 1  # results are read once


def test_trait_results_in_one_pass(stored):
    text = plan(finalize.trait_results(stored("results"), stored("traits")))
    assert text.count("/results]") == 1 and len(re.findall(r"Exchange hashpartitioning\(individual_id", text)) == 1 and "Window" not in text


def test_frequencies_are_joined_once(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(norms.norm_oriented(stored("pack"), stored("af")))
        assert text.count("FileScan") == 2 and len(re.findall(r"Exchange hashpartitioning", text)) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few = norms.norm_oriented(stored("pack"), stored("af")).select("pgs_id", "found", F.round("mean", 9).alias("m")).collect()
    counted = norms.join_frequencies(stored("pack"), stored("af"), few=10**6).groupBy("pgs_id").agg(F.count("af").alias("found")).collect()
    assert {r["pgs_id"]: r["found"] for r in few} == {r["pgs_id"]: r["found"] for r in counted}


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_places(spark, n):
    rows = spark.range(n).select((F.col("id") * 7919 % 1000).alias("k"), "id")
    got = report.places(rows.repartition(5), [F.col("k").desc()]).collect()
    assert [(r["k"], r["place"]) for r in sorted(got, key=lambda r: r["place"])] == [(k, i + 1) for i, k in enumerate(sorted((i * 7919 % 1000 for i in range(n)), reverse=True))]
