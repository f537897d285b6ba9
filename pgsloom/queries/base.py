"""Registration of queries with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pgsloom.functions import statistics as S
from pgsloom.plans.fixtures import Inputs, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def sql_percentile(z: str) -> str:
    """The percentile of a z-score as an SQL expression."""
    x = f"(abs({z}) / sqrt(2e0))"
    t = f"(1e0 / (1e0 + {S.ERF_P:.17e} * {x}))"
    sum_of = f"{S.ERF_A[-1]:.17e}"
    for a in S.ERF_A[-2::-1]:
        sum_of = f"({sum_of} * {t} + {a:.17e})"
    y = f"(1e0 - {sum_of} * {t} * exp(-{x} * {x}))"
    return f"(50e0 * (1e0 + case when {z} >= 0 then {y} else -{y} end))"


_PENALTY = "case when coverage < 5e-2 then power(coverage / 5e-2, 2) when coverage < 2e-1 then sqrt(coverage / 2e-1) else 1e0 end"
_QUALITY = f"""case when matched_variants = 0 or total_variants = 0 then 0e0 else floor((performance * 35e0 * ({_PENALTY}) + case when performance > 5e-2 then least(performance / 44e-2, 1e0) * 15e0 else 0e0 end
  + genotyped_variants * 1e0 / nullif(matched_variants, 0) * 15e0 + least(coverage, 1e0) * 10e0 + least(log10(greatest(matched_variants / 8e0, 1e0)) / 31e-1, 1e0) * 10e0
  + case when insufficient_empirical then 25e-1 else 5e0 end + case when z_score is null or abs(z_score) > 5 then 0e0 else least(abs(z_score) / 3e0, 1e0) * 10e0 end) * 1e4 + 5e-1) / 1e4 end"""

#: Views that only the SQL side uses: the steps of scoring as plain SQL.
ORACLE = {
    "fx_matched": """select p.pgs_id, p.variant_id, p.effect_allele, p.effect_weight, p.chr, p.pos, d.individual_id, d.variant_id as user_variant_id, d.genotype_dosage as dosage, d.imputed, d.imputation_quality, d.expected_dosage,
  p.effect_weight * (d.genotype_dosage - case when d.imputed then d.expected_dosage else 0e0 end) * case when d.imputed then sqrt(d.imputation_quality) else 1e0 end as contribution
  from fx_pack p join fx_dna d on p.chr = d.chr and p.pos = d.pos and p.allele_key = d.allele_key""",
    "fx_agg": """select individual_id, pgs_id, sum(contribution) as raw_score, count(*) as matched_variants, count(*) filter (where imputed) as imputed_variants, count(*) filter (where not imputed) as genotyped_variants,
  count(*) filter (where contribution > 0) as positive_count, sum(case when contribution > 0 then contribution else 0e0 end) as positive_sum, count(*) filter (where contribution < 0) as negative_count,
  sum(case when contribution < 0 then contribution else 0e0 end) as negative_sum, sum(effect_weight * effect_weight) as weight_sum_squared, min(effect_weight) as weight_min, max(effect_weight) as weight_max
  from fx_matched group by individual_id, pgs_id""",
    "fx_totals": "select pgs_id, count(*) as total_variants from fx_pack group by pgs_id",
    "fx_r2": "select pgs_id, max(case when metric_value > 1 then metric_value / 100e0 else metric_value end) as r2 from fx_pgs_performance where metric_type in ('R²', 'PGS R2 (no covariates)') group by pgs_id",
    "fx_base": """select i.individual_id, t.trait_id, t.pgs_id, coalesce(a.raw_score, 0e0) as raw_score, coalesce(a.matched_variants, 0) as matched_variants, coalesce(a.imputed_variants, 0) as imputed_variants,
  coalesce(a.genotyped_variants, 0) as genotyped_variants, coalesce(a.weight_sum_squared, 0e0) as weight_sum_squared, coalesce(n.total_variants, 0) as total_variants, s.norm_mean, s.norm_sd, coalesce(case when r.r2 > 0 then r.r2 end, 5e-2) as performance
  from (select distinct individual_id from fx_dna) i cross join fx_trait_pgs t left join fx_agg a on a.individual_id = i.individual_id and a.pgs_id = t.pgs_id left join fx_totals n on n.pgs_id = t.pgs_id
  left join fx_pgs_scores s on s.pgs_id = t.pgs_id left join fx_r2 r on r.pgs_id = t.pgs_id""",
    "fx_cover": "select *, case when total_variants > 0 then matched_variants * 1e0 / total_variants else 0e0 end as coverage from fx_base",
    "fx_flags": """select *, not (coalesce(norm_sd > 0, false) and coverage >= 5e-2) as insufficient_empirical,
  coalesce(norm_sd > 0, false) and coverage >= 5e-2 and not (coverage < 8e-1 and coalesce(norm_mean, 0e0) <> 0 and coalesce(abs((raw_score - norm_mean) / nullif(norm_sd, 0)), 0e0) > 20) as empirical from fx_cover""",
    "fx_used": """select *, case when not empirical and matched_variants > 0 then 0e0 else norm_mean end as used_mean, case when not empirical and matched_variants > 0 then sqrt(weight_sum_squared * 5e-1) else norm_sd end as used_sd from fx_flags""",
    "fx_z": "select *, case when matched_variants > 0 and used_sd > 0 then (raw_score - used_mean) / used_sd end as z_score from fx_used",
    "fx_results": f"""select *, {sql_percentile('z_score')} as percentile, matched_variants < 8 as insufficient_data, {_QUALITY} as quality_score,
  case when matched_variants = 0 then 'none' when matched_variants < 8 then 'insufficient' when matched_variants < 10 then 'low' when matched_variants < 100 then 'medium' else 'high' end as confidence from fx_z""",
    "fx_best": """select * from (select *, row_number() over (partition by individual_id, trait_id order by class, quality_score desc, pgs_id) as rk from
  (select *, case when not insufficient_data and coalesce(abs(z_score), 0) <= 5 and quality_score > 0 then 0 when z_score is not null and quality_score > 0 then 1 else 2 end as class from fx_results) q) w where rk = 1 and class < 2""",
    "fx_trait_results": f"""select individual_id, trait_id, best_pgs_id, overall_z, coalesce(best_percentile, case when overall_z <> 0 then {sql_percentile('overall_z')} end) as overall_percentile, coalesce(best_confidence, 'medium') as confidence,
  best_performance, best_quality, total_matched, total_expected, case when trait_type = 'quantitative' then phenotype_mean + overall_z * sqrt(coalesce(best_performance, 5e-2)) * phenotype_sd end as value from (
  select w.*, t.trait_type, t.phenotype_mean, t.phenotype_sd, b.pgs_id as best_pgs_id, b.percentile as best_percentile, b.confidence as best_confidence, b.performance as best_performance, b.quality_score as best_quality, coalesce(b.z_score, w.zw / w.ww) as overall_z
  from (select individual_id, trait_id, cast(sum(matched_variants) as bigint) as total_matched, cast(sum(total_variants) as bigint) as total_expected,
    sum(case when not insufficient_data and not insufficient_empirical and abs(z_score) <= 5 then z_score * performance end) as zw, sum(case when not insufficient_data and not insufficient_empirical and abs(z_score) <= 5 then performance end) as ww
    from fx_results group by individual_id, trait_id) w join fx_traits t on t.trait_id = w.trait_id left join fx_best b on b.individual_id = w.individual_id and b.trait_id = w.trait_id) q""",
}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Inputs`` under a name, with its SQL where there is any."""

    def add(make: Callable[[Inputs], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: make(Inputs(spark, sf_dir))
        if sql:
            SQL[name] = text(sql, "duckdb", ORACLE)
        return make

    return add


def rounded(*names: str, digits: int = 6) -> list[Column]:
    """Doubles rounded for comparison, under their names."""
    return [F.round(F.col(n), digits).alias(n) for n in names]
