"""Queries of matching, scoring and finalizing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pgsloom.functions import quality as Q
from pgsloom.functions import statistics as S
from pgsloom.operators import finalize, match, score
from pgsloom.plans.fixtures import Inputs
from pgsloom.queries.base import query, rounded, sql_percentile
from pgsloom.sources.shared import cut


def matched(t: Inputs, orient: bool = False) -> DataFrame:
    return match.variant_match(match.keyed(t.view("pack"), -1), match.keyed(t.view("dna"), -2), orient)


def results(t: Inputs) -> DataFrame:
    """Results of all people, traits and scores."""
    return finalize.pgs_results(score.pgs_aggregate(matched(t)), score.pgs_totals(t.view("pack")), t.view("pgs_scores"), finalize.best_r2(t.view("pgs_performance")), t.view("trait_pgs"), t.view("dna"))


def trait_results(t: Inputs) -> DataFrame:
    return finalize.trait_results(results(t), t.view("traits"))


AGG = ["raw_score", "positive_sum", "negative_sum", "weight_sum_squared", "weight_min", "weight_max"]
COUNTS = ["matched_variants", "imputed_variants", "genotyped_variants", "positive_count", "negative_count"]
ROUND_AGG = ", ".join(f"round({c}, 6) as {c}" for c in AGG)


@query("pgs_aggregate", f"select individual_id, pgs_id, {', '.join(COUNTS)}, {ROUND_AGG} from fx_agg")
def pgs_aggregate(t: Inputs) -> DataFrame:
    return score.pgs_aggregate(matched(t)).select("individual_id", "pgs_id", *COUNTS, *rounded(*AGG))


@query("pgs_aggregate_oriented", """with o as (select *, effect_allele <> split_part(user_variant_id, ':', 4) as swapped from fx_matched),
  c as (select *, effect_weight * (case when swapped then 2e0 - dosage else dosage end - case when not imputed then 0e0 when swapped then 2e0 - expected_dosage else expected_dosage end) * case when imputed then sqrt(imputation_quality) else 1e0 end as c2 from o)
  select individual_id, pgs_id, count(*) as matched_variants, round(sum(c2), 6) as raw_score from c group by individual_id, pgs_id""")
def pgs_aggregate_oriented(t: Inputs) -> DataFrame:
    return score.pgs_aggregate(matched(t, orient=True)).select("individual_id", "pgs_id", "matched_variants", *rounded("raw_score"))


@query("variant_match", "select individual_id, pgs_id, variant_id, dosage, imputed, round(contribution, 6) as contribution from fx_matched")
def variant_match(t: Inputs) -> DataFrame:
    return matched(t).select("individual_id", "pgs_id", "variant_id", "dosage", "imputed", *rounded("contribution"))


@query("genotyped_match", """with g as (select individual_id, concat(chromosome, ':', cast(position as string)) as k, max({'a': allele1, 'b': allele2}) as a from fx_genotyped group by all),
  m as (select g.individual_id, p.pgs_id, p.variant_id, p.effect_allele, p.effect_weight, cast(g.a.a = p.effect_allele as int) + cast(g.a.b = p.effect_allele as int) as dosage, g.a.a || g.a.b as genotype
  from fx_pack p join g on concat(split_part(p.variant_id, ':', 1), ':', split_part(p.variant_id, ':', 2)) = g.k)
  select individual_id, pgs_id, variant_id, effect_allele, round(effect_weight, 6) as effect_weight, dosage, genotype from m where dosage > 0""")
def genotyped_match(t: Inputs) -> DataFrame:
    return match.genotyped_match(t.view("pack"), t.view("genotyped")).withColumn("effect_weight", F.round("effect_weight", 6))


@query("legacy_match", """select p.pgs_id, d.individual_id, count(*) as n from fx_pack p join fx_dna d on concat(split_part(p.variant_id, ':', 1), ':', split_part(p.variant_id, ':', 2)) = concat(split_part(d.variant_id, ':', 1), ':', split_part(d.variant_id, ':', 2)) group by all""")
def legacy_match(t: Inputs) -> DataFrame:
    return match.legacy_match(t.view("pack"), t.view("dna")).groupBy("pgs_id", "individual_id").agg(F.count("*").alias("n"))


@query("position_probe", "select d.individual_id, p.pgs_id, p.chr, p.pos from fx_pack p join fx_dna d on p.chr = d.chr and p.pos = d.pos where (p.chr = 1 and p.pos = 2200) or (p.chr = 2 and p.pos = 100)")
def position_probe(t: Inputs) -> DataFrame:
    wanted = t.spark.sql("values (1, 2200), (2, 100) as w(chr, pos)")
    pack = t.view("pack").join(F.broadcast(wanted), ["chr", "pos"], "left_semi")
    return pack.join(t.view("dna").select("individual_id", "chr", "pos"), ["chr", "pos"]).select("individual_id", "pgs_id", "chr", "pos")


@query("chr_coverage", "select individual_id, pgs_id, chr, count(*) as n from fx_matched group by individual_id, pgs_id, chr")
def chr_coverage(t: Inputs) -> DataFrame:
    return score.chromosome_counts(matched(t))


@query("chr_coverage_percent", """with m as (select individual_id, pgs_id, count(*) as n from fx_matched group by all) select m.individual_id, m.pgs_id, round(m.n * 100e0 / t.total_variants, 6) as percent from m join fx_totals t on t.pgs_id = m.pgs_id""")
def chr_coverage_percent(t: Inputs) -> DataFrame:
    found = score.chromosome_map(matched(t))
    total = score.chromosome_map(t.view("pack"), ["pgs_id"]).withColumnRenamed("chromosomes", "all_chromosomes")
    return found.join(total, "pgs_id").select("individual_id", "pgs_id", F.round(score.coverage_percent(F.col("chromosomes"), F.col("all_chromosomes")), 6).alias("percent"))


HISTOGRAM = """select m.individual_id, m.pgs_id, cast(least(floor((m.effect_weight - a.weight_min) / ((a.weight_max - a.weight_min) / 10e0)) + 1, 10) as int) as bucket, count(*) as n
  from fx_matched m join fx_agg a on a.individual_id = m.individual_id and a.pgs_id = m.pgs_id where a.weight_min <> a.weight_max group by 1, 2, 3"""


@query("weight_histogram", HISTOGRAM)
def weight_histogram(t: Inputs) -> DataFrame:
    return score.weight_histogram(matched(t))


@query("weight_buckets", f"""with h as ({HISTOGRAM}), b as (select *, unnest(case when weight_min = weight_max then [1] else generate_series(1, 10) end) as bucket from fx_agg)
  select b.individual_id, b.pgs_id, cast(b.bucket as int) as bucket, round(weight_min + (b.bucket - 1) * ((weight_max - weight_min) / 10e0), 6) as low, round(case when weight_min = weight_max then weight_max else weight_min + b.bucket * ((weight_max - weight_min) / 10e0) end, 6) as high,
  case when weight_min = weight_max then matched_variants else coalesce(h.n, 0) end as n from b left join h on h.individual_id = b.individual_id and h.pgs_id = b.pgs_id and h.bucket = b.bucket""")
def weight_buckets(t: Inputs) -> DataFrame:
    return score.weight_buckets(matched(t)).select("individual_id", "pgs_id", "bucket", F.round("from", 6).alias("low"), F.round("to", 6).alias("high"), "n")


@query("pgs_totals", "select * from fx_totals")
def pgs_totals(t: Inputs) -> DataFrame:
    return score.pgs_totals(t.view("pack"))


@query("chr_totals", "select pgs_id, chr, count(*) as n from fx_pack where pgs_id in ('PGS000001', 'PGS000005') group by pgs_id, chr")
def chr_totals(t: Inputs) -> DataFrame:
    return score.chromosome_totals(t.view("pack"), t.spark.sql("values 'PGS000001', 'PGS000005' as w(pgs_id)"))


@query("pack_scan", "select pgs_id, count(*) as n, round(arg_min(effect_weight, {'a': chr, 'b': pos, 'c': allele_key}), 6) as first_weight from fx_pack group by pgs_id")
def pack_scan(t: Inputs) -> DataFrame:
    return score.pack_scan(t.view("pack")).select("pgs_id", "n", *rounded("first_weight"))


TOP = """select * from (select *, effect_weight * dosage as c, row_number() over (partition by individual_id, pgs_id order by abs(effect_weight * dosage) desc, variant_id) as rk from fx_matched where dosage > 0) q where rk <= 20"""


@query("top_variants", f"with o as ({TOP}) select individual_id, pgs_id, cast(rk as int) as rank, variant_id, effect_allele, round(c, 6) as contribution, concat(split_part(user_variant_id, ':', 3), split_part(user_variant_id, ':', 4)) as user_genotype from o")
def top_variants(t: Inputs) -> DataFrame:
    return score.top_variants(matched(t)).select("individual_id", "pgs_id", "rank", "variant_id", "effect_allele", F.round("contribution_display", 6).alias("contribution"), "user_genotype")


@query("waterfall", f"with o as ({TOP}), s as (select *, sum(c) over (partition by individual_id, pgs_id order by rk rows unbounded preceding) as e from o) select individual_id, pgs_id, cast(rk as int) as rank, round(e - c, 6) + 0e0 as start, round(e, 6) + 0e0 as stop from s")
def waterfall(t: Inputs) -> DataFrame:
    return score.waterfall(score.top_variants(matched(t))).select("individual_id", "pgs_id", "rank", (F.round("start", 6) + 0.0).alias("start"), (F.round("end", 6) + 0.0).alias("stop"))


@query("other_genotypes", f"with o as ({TOP}) select o.individual_id, o.pgs_id, cast(o.rk as int) as rank, d.individual_id as other_id, max(d.genotype_dosage) as other_dosage from o join fx_dna d on d.chr = o.chr and d.pos = o.pos and d.individual_id <> o.individual_id group by all")
def other_genotypes(t: Inputs) -> DataFrame:
    return score.other_genotypes(score.top_variants(matched(t)), t.view("dna"))


RESULT = ["raw_score", "coverage", "z_score", "percentile", "quality_score", "performance"]


@query("pgs_results", f"select individual_id, trait_id, pgs_id, matched_variants, total_variants, insufficient_data, insufficient_empirical, empirical, confidence, {', '.join(f'round({c}, 6) as {c}' for c in RESULT)} from fx_results")
def pgs_results(t: Inputs) -> DataFrame:
    return results(t).select("individual_id", "trait_id", "pgs_id", "matched_variants", "total_variants", "insufficient_data", "insufficient_empirical", "empirical", "confidence", *rounded(*RESULT))


@query("best_pgs", "select individual_id, trait_id, pgs_id, round(quality_score, 6) as quality_score, round(z_score, 6) as z_score from fx_best")
def best_pgs(t: Inputs) -> DataFrame:
    return finalize.best_pgs(results(t)).select("individual_id", "trait_id", "pgs_id", *rounded("quality_score", "z_score"))


@query("best_pgs_by_performance", "select individual_id, trait_id, pgs_id, round(performance, 6) as performance from (select *, row_number() over (partition by individual_id, trait_id order by performance desc nulls last, pgs_id) as rk from fx_results) q where rk = 1")
def best_pgs_by_performance(t: Inputs) -> DataFrame:
    return finalize.best_by_performance(results(t)).select("individual_id", "trait_id", "pgs_id", *rounded("performance"))


@query("top_pgs", "select individual_id, trait_id, cast(rk as int) as rank, pgs_id from (select *, row_number() over (partition by individual_id, trait_id order by quality_score desc, pgs_id) as rk from fx_results) q where rk <= 4")
def top_pgs(t: Inputs) -> DataFrame:
    return finalize.top_pgs(results(t)).select("individual_id", "trait_id", "rank", "pgs_id")


@query("runner_up", "select individual_id, trait_id, pgs_id, next_pgs, round(next_quality, 6) as next_quality from (select *, row_number() over w as rk, lead(pgs_id) over w as next_pgs, lead(quality_score) over w as next_quality from fx_results window w as (partition by individual_id, trait_id order by quality_score desc, pgs_id)) q where rk = 1")
def runner_up(t: Inputs) -> DataFrame:
    return finalize.runner_up(results(t)).select("individual_id", "trait_id", "pgs_id", "next_pgs", *rounded("next_quality"))


@query("trait_result", "select individual_id, trait_id, best_pgs_id, confidence, total_matched, total_expected, round(overall_z, 6) as overall_z, round(overall_percentile, 6) as overall_percentile, round(value, 6) as value from fx_trait_results")
def trait_result(t: Inputs) -> DataFrame:
    return trait_results(t).select("individual_id", "trait_id", "best_pgs_id", "confidence", "total_matched", "total_expected", *rounded("overall_z", "overall_percentile", "value"))


GRID = "select cast(s_suppkey as int) as k, (s_suppkey % 61 - 30) * 2e-1 as z from supplier"
PIECES = """case when abs(z) < 1 then 50 + abs(z) * 3413e-2 when abs(z) < 2 then 8413e-2 + (abs(z) - 1) * 1359e-2 when abs(z) < 3 then 9772e-2 + (abs(z) - 2) * 214e-2 else 9987e-2 end"""


@query("zscore_percentile", f"""with g as ({GRID}), p as (select k, z, {sql_percentile('z')} as p, case when z < 0 then 100 - ({PIECES}) else {PIECES} end as q from g)
  select k, round(z, 6) as z, round(p, 6) as percentile, cast(floor(greatest(1, least(99, p)) + 5e-1) as int) as shown, cast(floor(greatest(1, least(99, q)) + 5e-1) as int) as legacy,
  case when p >= 95 then 'Very high risk' when p >= 80 then 'High risk' when p >= 60 then 'Elevated risk' when p >= 40 then 'Average risk' when p >= 20 then 'Below average risk' when p >= 5 then 'Low risk' else 'Very low risk' end as label from p""")
def zscore_percentile(t: Inputs) -> DataFrame:
    z = F.col("z")
    return t.sql(GRID).select("k", F.round("z", 6).alias("z"), F.round(S.percentile(z), 6).alias("percentile"), S.display_percentile(z).alias("shown"), S.piecewise_percentile(z).alias("legacy"), S.interpretation(S.percentile(z)).alias("label"))


@query("quality_score", """select individual_id, trait_id, pgs_id, round(quality_score, 6) as quality_score, case when quality_score >= 70 then 'Excellent predictive power and highly informative' when quality_score >= 50 then 'Good reliability and informative'
  when quality_score >= 30 then 'Moderate predictive value' else 'Limited predictive value' end as explanation from fx_results""")
def quality_score(t: Inputs) -> DataFrame:
    return results(t).select("individual_id", "trait_id", "pgs_id", *rounded("quality_score"), Q.explanation(F.col("quality_score")).alias("explanation"))


@query("quality_breakdown", """with q as (select *, case when coverage < 5e-2 then power(coverage / 5e-2, 2) when coverage < 2e-1 then sqrt(coverage / 2e-1) else 1e0 end as penalty from fx_results where matched_variants > 0),
  p as (select individual_id, trait_id, pgs_id, performance * 35e0 * penalty as accuracy, case when performance > 5e-2 then least(performance / 44e-2, 1e0) * 15e0 else 0e0 end as validation, genotyped_variants * 15e0 / matched_variants as reliability, least(coverage, 1e0) * 10e0 as coverage,
    least(log10(greatest(matched_variants / 8e0, 1e0)) / 31e-1, 1e0) * 10e0 as size, case when insufficient_empirical then 25e-1 else 5e0 end as normalization, case when z_score is null or abs(z_score) > 5 then 0e0 else least(abs(z_score) / 3e0, 1e0) * 10e0 end as signal from q)
  select individual_id, trait_id, pgs_id, floor(accuracy * 10 + 5e-1) / 10 as accuracy, floor(validation * 10 + 5e-1) / 10 as validation, floor(reliability * 10 + 5e-1) / 10 as reliability, floor(coverage * 10 + 5e-1) / 10 as coverage, floor(size * 10 + 5e-1) / 10 as size, floor(normalization * 10 + 5e-1) / 10 as normalization, floor(signal * 10 + 5e-1) / 10 as signal from p""")
def quality_breakdown(t: Inputs) -> DataFrame:
    rows = results(t).filter("matched_variants > 0")
    parts = Q.quality_breakdown(F.col("matched_variants"), F.col("total_variants"), F.col("performance"), ~F.col("insufficient_empirical"), F.col("z_score"), F.col("genotyped_variants"))
    return rows.withColumn("parts", parts).select("individual_id", "trait_id", "pgs_id", *[F.col("parts")[i]["score"].alias(name) for i, name in enumerate(Q.PARTS)])


@query("confidence", "select individual_id, pgs_id, confidence, case when coverage >= 8e-1 then 'high' when coverage >= 5e-1 then 'medium' when coverage > 0 then 'low' else 'none' end as by_coverage from fx_results")
def confidence(t: Inputs) -> DataFrame:
    return results(t).select("individual_id", "pgs_id", "confidence", Q.coverage_confidence(F.col("coverage")).alias("by_coverage"))


@query("quantitative_value", "select individual_id, r.trait_id, pgs_id, round(phenotype_mean + z_score * sqrt(performance) * phenotype_sd, 6) as value from fx_results r join fx_traits t on t.trait_id = r.trait_id where trait_type = 'quantitative'")
def quantitative_value(t: Inputs) -> DataFrame:
    rows = results(t).join(t.view("traits").filter("trait_type = 'quantitative'"), "trait_id")
    return rows.select("individual_id", "trait_id", "pgs_id", F.round(Q.quantitative_value(F.col("phenotype_mean"), F.col("phenotype_sd"), F.col("z_score"), F.col("performance")), 6).alias("value"))


@query("margin_of_error", "select individual_id, r.trait_id, pgs_id, round(phenotype_sd * sqrt(1e0 - performance) * sqrt(1e0 - coverage), 6) as margin from fx_results r join fx_traits t on t.trait_id = r.trait_id where trait_type = 'quantitative'")
def margin_of_error(t: Inputs) -> DataFrame:
    rows = results(t).join(t.view("traits").filter("trait_type = 'quantitative'"), "trait_id")
    return rows.select("individual_id", "trait_id", "pgs_id", F.round(Q.margin_of_error(F.col("phenotype_sd"), F.col("performance"), F.col("coverage")), 6).alias("margin"))


@query("other_scores", "select a.individual_id, a.trait_id, b.individual_id as other_id, round(b.overall_z, 6) as other_z from fx_trait_results a join fx_trait_results b on a.trait_id = b.trait_id and a.individual_id <> b.individual_id")
def other_scores(t: Inputs) -> DataFrame:
    rows = cut(trait_results(t).select("individual_id", "trait_id", "overall_z"))  # both sides of the join
    others = rows.select(F.col("individual_id").alias("other_id"), "trait_id", F.round("overall_z", 6).alias("other_z"))
    return rows.join(others, "trait_id").filter("individual_id <> other_id").select("individual_id", "trait_id", "other_id", "other_z")
