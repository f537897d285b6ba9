"""Operators on small inline fixtures, and properties on the derived views."""

import pytest
from pyspark.sql import functions as F

from pgsloom.operators import catalog, dna, finalize, match, norms, report, results, score
from pgsloom.plans import etl
from pgsloom.plans.fixtures import Inputs
from pgsloom.queries import scoring

MATCHED = "individual_id string, pgs_id string, variant_id string, effect_allele string, effect_weight double, dosage double, imputed boolean, chr int, pos int, contribution double, user_variant_id string"


def matched(spark, rows):
    return spark.createDataFrame([("I", p, f"{c}:{i}:A:G", "A", w, d, m, c, i, w * d, f"{c}:{i}:A:G") for i, (p, c, w, d, m) in enumerate(rows)], MATCHED)


def test_aggregate(spark):
    rows = matched(spark, [("PGS001", 1, 0.5, 2.0, False), ("PGS001", 1, -0.3, 1.0, False), ("PGS001", 2, 0.8, 1.0, True)])
    r = score.pgs_aggregate(rows).first()
    assert r["raw_score"] == pytest.approx(1.5) and (r["matched_variants"], r["genotyped_variants"], r["imputed_variants"], r["positive_count"], r["negative_count"]) == (3, 2, 1, 2, 1)
    assert score.chromosome_map(rows).first()["chromosomes"] == {1: 2, 2: 1}


def test_two_scores(spark):
    rows = matched(spark, [("A", 1, 0.4, 1.0, False), ("A", 1, 0.5, 1.0, False), ("B", 1, 0.3, 1.0, False)])
    assert {r["pgs_id"]: round(r["raw_score"], 6) for r in score.pgs_aggregate(rows).collect()} == {"A": 0.9, "B": 0.3}


def test_top_variants(spark):
    rows = matched(spark, [("P", 1, i * 0.1, 1.0, False) for i in range(25)])
    top = score.top_variants(rows).orderBy("rank").collect()
    assert len(top) == 20 and top[0]["effect_weight"] == pytest.approx(2.4) and [r["rank"] for r in top] == list(range(1, 21))


def test_histogram(spark):
    rows = matched(spark, [("P", 1, i * 0.1, 1.0, False) for i in range(11)] + [("Q", 1, 0.5, 1.0, False)] * 3)
    got = score.weight_buckets(rows).collect()
    assert sum(r["n"] for r in got if r["pgs_id"] == "P") == 11 and len([r for r in got if r["pgs_id"] == "P"]) == 10
    assert [r["n"] for r in got if r["pgs_id"] == "Q"] == [3]


def result(spark, **change):
    row = {"individual_id": "I", "trait_id": "T", "pgs_id": "P", "raw_score": 0.08, "matched_variants": 150, "imputed_variants": 0, "genotyped_variants": 100, "weight_sum_squared": 0.1, "total_variants": 1000, "norm_mean": 0.5, "norm_sd": 0.2, "r2": 0.1} | change
    kinds = "individual_id string, trait_id string, pgs_id string, raw_score double, matched_variants long, imputed_variants long, genotyped_variants long, weight_sum_squared double, total_variants long, norm_mean double, norm_sd double, r2 double"
    return finalize.normalized(spark.createDataFrame([tuple(row.values())], kinds))


def test_empirical_norm(spark):
    r = result(spark).first()
    assert r["z_score"] == pytest.approx(-2.1) and r["empirical"]


def test_theoretical_fallbacks(spark):
    r = result(spark, norm_mean=None, norm_sd=None, matched_variants=50).first()
    assert r["used_mean"] == 0 and r["used_sd"] == pytest.approx(0.05**0.5) and r["insufficient_empirical"]
    r = result(spark, matched_variants=300, total_variants=10_000).first()
    assert not r["empirical"] and r["insufficient_empirical"]
    r = result(spark, norm_mean=193.5, norm_sd=0.08, raw_score=0.79, matched_variants=790_000, total_variants=6_900_000).first()
    assert not r["empirical"] and not r["insufficient_empirical"] and abs(r["z_score"]) < 50
    r = result(spark, norm_mean=0.0, norm_sd=0.001, raw_score=9.0).first()
    assert r["empirical"]  # a mean of zero skips the far test


def test_no_match(spark):
    r = result(spark, matched_variants=0, genotyped_variants=0, raw_score=0.0, weight_sum_squared=0.0).first()
    assert r["quality_score"] == 0 and r["z_score"] is None and r["confidence"] == "none" and r["insufficient_data"]


def test_best_choice(spark):
    kinds = "individual_id string, trait_id string, pgs_id string, insufficient_data boolean, z_score double, quality_score double"
    rows = spark.createDataFrame([("I", "T", "A", False, 6.0, 90.0), ("I", "T", "B", False, 1.0, 50.0), ("I", "T", "C", True, 1.0, 70.0), ("I", "U", "A", True, 9.0, 10.0), ("I", "U", "B", True, None, 20.0), ("I", "V", "A", True, None, 5.0), ("I", "W", "B", False, 0.0, 5.0), ("I", "W", "A", False, 0.0, 5.0)], kinds)
    assert {r["trait_id"]: r["pgs_id"] for r in finalize.best_pgs(rows).collect()} == {"T": "B", "U": "A", "W": "A"}


def test_properties(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    rows = scoring.matched(t).cache()
    agg = score.pgs_aggregate(rows)
    assert agg.filter(F.abs(F.col("positive_sum") + F.col("negative_sum") - F.col("raw_score")) > 1e-9).count() == 0
    assert agg.join(score.pgs_totals(t.view("pack")), "pgs_id").filter("matched_variants > total_variants").count() == 0
    n = score.weight_buckets(rows).groupBy("individual_id", "pgs_id").agg(F.sum("n").alias("n"))
    assert n.join(agg, ["individual_id", "pgs_id"]).filter("n <> matched_variants").count() == 0
    again = score.pgs_aggregate(rows.repartition(7, "pos")).select("individual_id", "pgs_id", F.col("raw_score").alias("other"))
    assert agg.join(again, ["individual_id", "pgs_id"]).filter(F.abs(F.col("raw_score") - F.col("other")) > 1e-9).count() == 0


def test_plan_of_the_flagship(spark, sf_dir):
    plan = scoring.pgs_aggregate(Inputs(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan and "NestedLoop" in plan  # the nested loop makes the fixture of people


def test_genotyped_match(spark):
    pack = spark.createDataFrame([("1:100:A:G", "A", 0.5, "P"), ("1:200:T:C", "C", 0.2, "P"), ("3:999:X:Y", "X", 1.0, "P")], "variant_id string, effect_allele string, effect_weight double, pgs_id string")
    people = spark.createDataFrame([("I", "1", 100, "A", "G"), ("I", "1", 200, "T", "T"), ("I", "2", 300, "C", "G")], "individual_id string, chromosome string, position int, allele1 string, allele2 string")
    assert [(r["variant_id"], r["dosage"]) for r in match.genotyped_match(pack, people).collect()] == [("1:100:A:G", 1)]


@pytest.mark.parametrize(
    ("columns", "want"),
    [
        (["chr_name", "chr_position", "dosage_0_weight", "dosage_1_weight", "dosage_2_weight", "hm_chr", "hm_pos"], etl.DOSAGE),
        (["rsID", "chr_name", "chr_position", "hm_chr", "hm_pos"], etl.HARMONIZED), (["rsID", "is_haplotype", "chr_name", "chr_position"], etl.HLA), (["rsID", "chr_name", "chr_position"], etl.SNP),
        (["chr_name", "chr_position"], etl.SNP_NO_RSID), (["rsID"], etl.RSID), (["rsID", "chr_name"], etl.RSID_CHR), (["effect_allele"], None), ([], None),
    ],
)
def test_formats(columns, want):
    assert etl.detect_format(columns) == want


def test_liftover(spark):
    blocks = spark.createDataFrame([(1, 0, 100_000, 10), (1, 100_000, 100_500, -20), (2, 5, 6, 1)], "chr int, hg19_start int, hg19_end int, hg38_offset int")
    rows = spark.createDataFrame([(1, 0), (1, 99_999), (1, 100_000), (1, 100_500), (2, 5), (2, 6), (3, 5)], "chr int, pos int")
    assert sorted((r["chr"], r["pos"]) for r in dna.lift(rows, blocks).collect()) == [(1, 10), (1, 99_980), (1, 100_009), (2, 6)]


def test_merge_is_disjoint(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    merged = dna.merge_calls(t.view("dna").filter("not imputed"), t.view("dna").withColumn("imputed", F.lit(True)))
    assert merged.groupBy("individual_id", "chr", "pos").count().filter("count > 1").count() == 0


def test_dr2(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 1.0), (1, 2.0, 2.0), (2, 1.0, 0.0), (2, 1.0, 2.0), (3, 0.0, 2.0), (3, 2.0, 0.0)], "vid int, t double, d double")
    assert {r["vid"]: round(r["dr2"], 9) for r in dna.dr2(rows).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}


def test_missing_genotypes_count_as_none(spark):
    rows = spark.createDataFrame([("A", "A", None), ("A", "G", None), ("A", "A", 2), ("G", "A", 2)], "effect string, alt string, d int")
    assert [r["x"] for r in rows.select(norms.oriented(F.col("effect"), F.col("alt"), F.col("d")).alias("x")).collect()] == [0, 0, 2, 0]


def test_sampling_is_the_same_on_every_run(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    one, two = (sorted((r["pgs_id"], round(r["s"], 9)) for r in norms.imputed_tier(t.view("pack").repartition(n), t.view("matrix")).collect()) for n in (2, 5))
    assert one == two and one


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, None, 2), (3, "c", 2)], "k int, v string, t int")
    assert sorted(map(tuple, results.upsert_coalesce(old, new, ["k"], ("t",)).collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 2)]
    assert sorted(r["k"] for r in results.upsert(old, new, ["k"]).collect()) == [1, 2, 3]


def test_queue(spark):
    rows = spark.createDataFrame([("I", "A", 1, 5, 0), ("I", "A", 3, 6, 0), ("I", "B", 2, 1, 0), ("J", "A", 0, 9, 1)], "individual_id string, trait_id string, priority int, added int, running int")
    got = report.queue_order(rows).orderBy("place").collect()
    assert [(r["individual_id"], r["trait_id"]) for r in got] == [("J", "A"), ("I", "A"), ("I", "B")] and got[1]["priority"] == 3


def test_manifest_rules(spark):
    rows = spark.createDataFrame([("EFO_0000001", "n", "disease_risk", None), ("bad", "", "other", None), ("HP_0000001", "n", "quantitative", None)], "trait_id string, name string, trait_type string, phenotype_sd double")
    assert sorted((r["trait_id"], r["violation"]) for r in catalog.manifest_violations(rows).collect()) == [("HP_0000001", "phenotype_sd"), ("bad", "name"), ("bad", "trait_id"), ("bad", "trait_type")]


def test_genes_in_genome_order(spark):
    genes = spark.sql("select * from values (1, 9606, 'tumor protein', 'chr2', 5), (2, 9606, 'x', '1', 9), (3, 9606, 'x', 'X', 1), (4, 9606, 'x', '1', 3), (5, 9606, 'x', 'KI270', 1) as g(gene_id, tax_id, description, chr, start)")
    papers = spark.sql("select gene_id, 9606 as tax_id, pubmed_id from values (1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (5, 7) as p(gene_id, pubmed_id)")
    assert [r["gene_id"] for r in catalog.gene_catalog(genes, papers, least=1).collect()] == [4, 2, 1, 3, 5]
    assert [r["gene_id"] for r in catalog.gene_catalog(genes, papers, least=1, most=2).collect()] == [1, 3]
