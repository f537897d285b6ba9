"""Scores of a panel of few samples by a join, and random subsets dealt out by score."""

import pytest

from pgsloom.operators import blocks, norms
from pgsloom.operators.match import KEYS
from pgsloom.plans.fixtures import Inputs


def test_joined_scores_equal_blocks_on_odd_rows(spark):
    """Repeated genotypes and variants, several ALTs under one key, no calls, null weights and alleles."""
    matrix = spark.createDataFrame(
        [(1, 5, 7, "A", "s1", 1), (1, 5, 7, "A", "s2", None), (1, 5, 7, "A", "s1", 2), (1, 5, 7, "C", "s1", 2), (1, 5, 7, "C", "s3", 0), (2, 6, 8, "G", "s2", None), (2, 6, 8, "G", "s1", None), (3, 1, 1, "T", "s3", 2)],
        "chr int, pos int, allele_key long, alt string, sample string, dosage int",
    )
    pack = spark.createDataFrame(
        [("P", 1, 5, 7, "A", 0.5), ("P", 1, 5, 7, "A", 0.25), ("P", 1, 5, 7, "C", 1.0), ("Q", 2, 6, 8, "G", 3.0), ("R", 9, 9, 9, "G", 3.0), ("S", 3, 1, 1, "T", None), ("S", 3, 1, 1, None, 1.0), ("U", 3, 1, 1, "A", 2.0)],
        "pgs_id string, chr int, pos int, allele_key long, effect_allele string, effect_weight double",
    )
    samples = blocks.sample_names(matrix)
    plain = lambda df: {(r.pgs_id, i): round(x, 9) for r in df.collect() for i, x in enumerate(r.scores)}
    got = plain(blocks.joined_scores(pack, blocks.wide_panel(matrix, samples), 3))
    assert got == plain(blocks.block_scores(pack, blocks.panel_of(matrix, samples), 3)) and got["Q", 0] == 0.0 and got["P", 0] == pytest.approx(5.25)


def test_few_samples_need_no_python(spark, sf_dir):
    """Python's memory grew with the scores of a block: a panel of few samples is joined and added up by Spark itself."""
    t = Inputs(spark, sf_dir)
    plan = norms.empirical_scores(t.view("pack"), t.view("matrix"))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


def test_subsets_are_dealt_out_once(spark, sf_dir):
    """A variant of a score is one row of the shuffle by score, not one for each round."""
    t = Inputs(spark, sf_dir)
    plan = norms.imputed_tier(t.view("pack"), t.view("matrix"))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.split("FlatMapGroupsInArrow")[1].split("Join")[0]


def test_large_scores_by_ranges_agree(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    pack, matrix = t.view("pack").cache(), t.view("matrix").cache()
    plain = lambda df: {r.pgs_id: (round(r.s, 9), r.rounds) for r in df.collect()}
    want = plain(norms.imputed_tier(pack, matrix))
    sizes = [r["count"] for r in pack.join(matrix.select(*KEYS).distinct(), KEYS, "left_semi").groupBy("pgs_id").count().collect()]
    middle = sorted(sizes)[len(sizes) // 2]
    assert min(sizes) <= middle < max(sizes)
    assert plain(norms.imputed_tier(pack, matrix, whole=middle)) == want
