"""Queries beside their SQL on the smallest tables (a part of them; every one is compared by the driver)."""

import math

import duckdb
import pytest

from pgsloom.plans.fixtures import TABLES
from pgsloom.queries import QUERIES, SQL

NAMES = [
    "pgs_aggregate", "pgs_aggregate_oriented", "genotyped_match", "weight_buckets", "top_variants", "waterfall", "pgs_results", "trait_result", "zscore_percentile", "hwe_norm_oriented", "hwe_norm_plain",
    "ancestry_norm", "empirical_norm", "tiered_norm_raw", "density_bins", "percentile_grid", "merge_imputed", "liftover", "bake_metadata", "dr2", "ref_alt_gt", "standardize", "infer_other_allele", "enhanced_filter",
    "upsert_coalesce", "truth_pairs", "tiered_norm_imputed", "store_merge", "bed_dosages", "vcf_dosages", "vcf_genotypes", "vcf_panel_scores", "chain_blocks", "scoring_file_rows", "clicks_windows", "clicks_distinct_users", "queue_stream",
    "pc_fit", "pc_fit_residuals", "etl", "manifest", "trait_quality", "result_order", "visible_scores", "dashboard_categories", "theoretical_norm", "quality_breakdown", "queue_order", "dr2_stats", "trait_scores", "pgs_filter", "pgs_filter_params", "problematic_pgs", "problematic_pgs_methods", "gene_catalog", "catalog_totals", "value_text", "events_sliding", "audit_flags", "validation", "run_estimate", "events_session", "incremental_scoring",
]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    base = duckdb.connect()
    for t in [*TABLES, "clicks"]:
        base.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return base


def test_names():
    assert set(SQL) <= set(QUERIES) and set(NAMES) <= set(SQL) and len(QUERIES) > 100


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir)
    want = oracle.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
