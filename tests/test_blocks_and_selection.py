"""Blockwise scores of a reference panel against a plain join; exact selection against sorted lists."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pgsloom.functions import alleles as A
from pgsloom.operators import blocks, norms, selection
from pgsloom.operators.match import KEYS
from pgsloom.plans.fixtures import Inputs


def joined(pack, matrix, by=("pgs_id",)):
    rows = pack.select(*KEYS, *by, "effect_allele", "effect_weight").join(matrix, KEYS)
    return rows.groupBy(*by, "sample").agg(F.sum(F.col("effect_weight") * norms.oriented(F.col("effect_allele"), F.col("alt"), F.col("dosage"))).alias("score"))


def plain(rows, *by):
    return {tuple(r[c] for c in (*by, "sample")): round(r["score"], 9) + 0.0 for r in rows}


@pytest.mark.parametrize("per_block", [2048, 7])
def test_blocks_equal_a_join(spark, sf_dir, per_block):
    t = Inputs(spark, sf_dir)
    pack, matrix = t.view("pack"), t.view("matrix").withColumn("sample", F.concat(F.lit("HG"), "sample"))
    samples = blocks.sample_names(matrix)
    panel = blocks.panel_of(matrix, samples)
    got = blocks.long_form(blocks.block_scores(pack, panel, len(samples), per_block=per_block), samples)
    assert plain(got.collect(), "pgs_id") == plain(joined(pack, matrix).collect(), "pgs_id") and len(samples) == 10


def test_blocks_with_odd_rows(spark):
    """Repeated genotypes and variants, several ALTs under one key, no calls, null weights, scores by two columns."""
    matrix = spark.createDataFrame(
        [(1, 5, 7, "A", "s1", 1), (1, 5, 7, "A", "s2", None), (1, 5, 7, "A", "s1", 2), (1, 5, 7, "C", "s1", 2), (1, 5, 7, "C", "s3", 0), (2, 6, 8, "G", "s2", None), (2, 6, 8, "G", "s1", None), (3, 1, 1, "T", "s3", 2)],
        "chr int, pos int, allele_key long, alt string, sample string, dosage int",
    )
    pack = spark.createDataFrame(
        [("P", 1, 1, 5, 7, "A", 0.5), ("P", 1, 1, 5, 7, "A", 0.25), ("P", 2, 1, 5, 7, "C", 1.0), ("Q", 1, 2, 6, 8, "G", 3.0), ("R", 1, 9, 9, 9, "G", 3.0), (None, 1, 3, 1, 1, "A", 2.0), ("S", 1, 3, 1, 1, "T", None), ("S", 1, 3, 1, 1, None, 1.0)],
        "pgs_id string, round int, chr int, pos int, allele_key long, effect_allele string, effect_weight double",
    )
    samples = blocks.sample_names(matrix)
    got = plain(blocks.long_form(blocks.block_scores(pack, blocks.panel_of(matrix, samples), 3, ("pgs_id", "round")), samples).collect(), "pgs_id", "round")
    want = plain(joined(pack.fillna({"effect_weight": 0.0, "effect_allele": "-"}), matrix, ("pgs_id", "round")).collect(), "pgs_id", "round")
    assert {k: v for k, v in got.items() if k in want and k[0]} == {k: v for k, v in want.items() if k[0]}
    assert all(v == 0 for k, v in got.items() if k not in want) and got[(None, 1, "s3")] == 0.0
    assert {k[:2] for k in got} == {("P", 1), ("P", 2), ("Q", 1), (None, 1), ("S", 1)}
    assert blocks.block_scores(pack.limit(0), blocks.panel_of(matrix, samples), 3).collect() == [] == blocks.block_scores(pack, blocks.panel_of(matrix.limit(0), samples), 3).collect()


def test_what_a_block_shuffles(spark, sf_dir, tmp_path):
    """From a stored panel: one row a variant, one row a score's variant, arrays by score; no row a variant and sample."""
    t = Inputs(spark, sf_dir)
    samples = blocks.sample_names(t.view("matrix"))
    blocks.panel_of(t.view("matrix"), samples).write.parquet(f"{tmp_path}/panel")
    t.view("pack").write.parquet(f"{tmp_path}/pack")
    scores = blocks.block_scores(spark.read.parquet(f"{tmp_path}/pack"), spark.read.parquet(f"{tmp_path}/panel"), len(samples))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(block", plan)) == 2 and len(re.findall(r"\bExchange\b", plan)) == 3
    assert "Generate" not in plan and "Join" not in plan


def test_quantiles(spark):
    rnd = random.Random(4)
    cases = [
        [rnd.gauss(0, 1) for _ in range(301)],
        [10.0 ** rnd.randint(-300, 300) * rnd.choice([-1, 1]) for _ in range(300)],
        [1.0] * 50 + [2.0] * 50,
        [float(rnd.randint(0, 3)) for _ in range(77)] + [None, math.nan] * 20,
        [-math.inf, -math.inf, 1.0, 2.0, math.inf],
        [1.7e308, -1.7e308, 0.0, 5e-324],
        [3.5],
    ]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for case, values in enumerate(cases):
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        kept = sorted(v for v in values if v is not None and not math.isnan(v))
        for bins, small in ((4096, 10_000), (16, 20))[: 1 if case == 1 else 2]:
            got = selection.quantiles(rows, "x", shares, bins, small)
            for s, g in zip(shares, got):
                p = s * (len(kept) - 1)
                a, b = kept[math.floor(p)], kept[math.ceil(p)]
                assert g == (a if a == b else a + (b - a) * (p - math.floor(p)))
    assert selection.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_quantiles_like_sql(spark, sf_dir):
    prices = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_extendedprice").cast("double").alias("x"))
    want = duckdb.connect().execute(f"select quantile_cont(l_extendedprice::double, [0.01, 0.5, 0.99]) from read_parquet('{sf_dir}/lineitem.parquet')").fetchone()[0]
    assert selection.quantiles(prices, "x", [0.01, 0.5, 0.99], small=100) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("bins", [4096, 3, 1])
def test_least_by_hash(spark, bins):
    """The exact subset of k, whatever the ranges; one group has most of the rows."""
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, "big").when(F.col("id") < 2990, "small").otherwise("few").alias("g"), "id")
    rows = rows.withColumn("k", F.when(F.col("g") == "big", 1700).when(F.col("g") == "small", 1).otherwise(99).cast("long"))
    hashed = A.md5_number(F.concat_ws(":", "g", F.col("id") % 1500))  # some hashes repeat
    got = {}
    chosen = selection.least_by_hash(rows, ["g"], "k", hashed, ["id"], bins=bins)
    for r in chosen.collect():
        got.setdefault(r["g"], set()).add(r["id"])
    every = {}
    for r in rows.withColumn("h", hashed).collect():
        every.setdefault((r["g"], r["k"]), []).append((r["h"], r["id"]))
    assert got == {g: {i for _, i in sorted(v)[:k]} for (g, k), v in every.items()}
    assert chosen.columns == rows.columns and "Window" not in chosen._jdf.queryExecution().executedPlan().toString()
