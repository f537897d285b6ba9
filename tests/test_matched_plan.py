"""Keys that a join compares are not computed a second time by a filter below it."""

import pytest

from pgsloom.operators import match
from pgsloom.plans import etl
from pgsloom.queries import QUERIES


@pytest.mark.parametrize("name", ["pgs_aggregate_oriented", "top_variants", "waterfall", "best_pgs"])
def test_no_hash_in_a_filter(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" in plan and not [line for line in plan.splitlines() if "Filter" in line and "md5(" in line]


def test_null_keys_match_nothing(spark):
    pack = spark.createDataFrame([(1, 5, None, "1:5:A:C", "A", 1.0, "P"), (1, 6, 7, "1:6:A:C", "A", 1.0, "P")], "chr int, pos int, allele_key long, variant_id string, effect_allele string, effect_weight double, pgs_id string")
    dna = spark.createDataFrame([("I", 1, 5, None, 1.0, False, 1.0, "1:5:A:C"), ("I", 1, 6, 7, 1.0, False, 1.0, "1:6:C:A")], "individual_id string, chr int, pos int, allele_key long, genotype_dosage double, imputed boolean, imputation_quality double, variant_id string")
    for orient in (False, True):
        got = match.variant_match(match.keyed(pack, -1), match.keyed(dna, -2), orient).collect()
        assert [(r["pos"], r["contribution"]) for r in got] == [(6, 1.0)]


def test_distinct_rows_by_tasks_of_bounded_size(spark):
    rows = spark.range(6_000).selectExpr("id % 2000 as a", "cast(id % 4 as double) as b")
    got = etl.deduplicated(rows, ["a"], 6_000, per_task=500)
    assert got.rdd.getNumPartitions() == 13 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.distinct().collect()))
