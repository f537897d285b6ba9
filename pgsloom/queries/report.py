"""Queries of reports, audits and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pgsloom.functions import display as D
from pgsloom.operators import finalize, report, results
from pgsloom.plans.fixtures import Inputs
from pgsloom.queries import scoring
from pgsloom.queries.base import query, rounded
from pgsloom.sources.shared import cut


@query("results_summary", """select r.individual_id, r.trait_id, t.name, t.category, r.best_pgs_id, round(r.overall_z, 4) as z_score, b.genotyped_variants as best_genotyped, b.imputed_variants as best_imputed, b.matched_variants as best_matched
  from fx_trait_results r join fx_traits t on t.trait_id = r.trait_id left join fx_results b on b.individual_id = r.individual_id and b.trait_id = r.trait_id and b.pgs_id = r.best_pgs_id""")
def results_summary(t: Inputs) -> DataFrame:
    done = cut(scoring.results(t))  # scored once, for the traits and for what their best scores are made of
    rows = report.results_summary(finalize.trait_results(done, t.view("traits")), t.view("traits"), done)
    return rows.select("individual_id", "trait_id", "name", "category", "best_pgs_id", F.round("overall_z", 4).alias("z_score"), "best_genotyped", "best_imputed", "best_matched")


@query("score_summary", """select count(distinct individual_id) as individuals, count(distinct trait_id) as traits, count(*) as total, count(*) filter (where abs(z_score) > 10) as extreme, count(*) filter (where abs(z_score) > 5) as high,
  count(*) filter (where matched_variants * 1e0 / nullif(total_variants, 0) < 5e-2) as low_coverage from fx_results where z_score is not null""")
def score_summary(t: Inputs) -> DataFrame:
    return report.score_summary(scoring.results(t))


@query("extremes", "select individual_id, trait_id, pgs_id, round(z_score, 6) as z_score, round(matched_variants * 100e0 / nullif(total_variants, 0), 1) as coverage_pct from fx_results where abs(z_score) > 2 order by abs(z_score) desc, individual_id, trait_id, pgs_id limit 50")
def extremes(t: Inputs) -> DataFrame:
    return report.extremes(scoring.results(t), above=2.0).select("individual_id", "trait_id", "pgs_id", *rounded("z_score"), "coverage_pct")


@query("small_sds", "select pgs_id, round(norm_sd, 6) as norm_sd from fx_pgs_scores where norm_sd > 0 and norm_sd < 1e-1 order by fx_pgs_scores.norm_sd, pgs_id limit 20")
def small_sds(t: Inputs) -> DataFrame:
    return report.small_sds(t.view("pgs_scores")).select("pgs_id", *rounded("norm_sd"))


@query("low_coverage", "with l as (select pgs_id, count(*) as affected, avg(matched_variants * 100e0 / total_variants) as mean_coverage, max(abs(z_score)) as max_z from fx_results where matched_variants * 1e0 / nullif(total_variants, 0) < 5e-2 group by pgs_id) select pgs_id, affected, round(mean_coverage, 6) as mean_coverage, round(max_z, 6) as max_z from l order by l.max_z desc nulls last, pgs_id limit 20")
def low_coverage(t: Inputs) -> DataFrame:
    return report.low_coverage(scoring.results(t)).select("pgs_id", "affected", *rounded("mean_coverage", "max_z"))


@query("audit_flags", """with r as (select *, row_number() over w as rk, lead(quality_score) over w as nq, lead(performance) over w as nr, max(performance) over (partition by individual_id, trait_id) as top from fx_results window w as (partition by individual_id, trait_id order by quality_score desc, pgs_id))
  select individual_id, trait_id, pgs_id, concat_ws(',', case when performance <= 5e-2 and top > 5e-2 then 'default_r2' end, case when nr > performance * 2 and nr > 5e-2 then 'runner_up_r2' end, case when round(matched_variants * 100e0 / nullif(total_variants, 0), 1) < 5 then 'low_coverage' end,
  case when genotyped_variants = 0 and matched_variants > 0 then 'all_imputed' end, case when abs(z_score) > 5 then 'extreme_z' end, case when quality_score - nq < 2 then 'tight_race' end, case when insufficient_data then 'insufficient' end) as flags from r where rk = 1""")
def audit_flags(t: Inputs) -> DataFrame:
    return report.audit_flags(scoring.results(t)).withColumn("flags", F.array_join("flags", ","))


@query("problematic_pgs", """with p as (select *, abs((raw_score - norm_mean) / norm_sd) as far from fx_results where coalesce(norm_mean, 0) <> 0 and coalesce(norm_sd, 0) <> 0) select trait_id, pgs_id, count(*) as occurrences, round(max(far), 6) as max_far, case when abs(any_value(norm_mean) / any_value(norm_sd)) > 15 then 'scale' else '' end as issues from p where far > 5 group by trait_id, pgs_id""")
def problematic_pgs(t: Inputs) -> DataFrame:
    return report.problematic(scoring.results(t), t.view("pgs_scores")).select("trait_id", "pgs_id", "occurrences", *rounded("max_far"), F.array_join("issues", ",").alias("issues"))


METHODS = "case when substring(pgs_id, 8, 1) <= '2' then 'Inverse variance' when substring(pgs_id, 8, 1) >= '8' then 'Sum of variant weights' else 'LDpred' end"


@query("problematic_pgs_methods", f"""with p as (select *, abs((raw_score - norm_mean) / norm_sd) as far from fx_results where coalesce(norm_mean, 0) <> 0 and coalesce(norm_sd, 0) <> 0)
  select trait_id, pgs_id, concat_ws(',', case when abs(any_value(norm_mean) / any_value(norm_sd)) > 15 then 'scale' end, case when any_value({METHODS}) <> 'LDpred' then 'method' end) as issues from p where far > 5 group by trait_id, pgs_id""")
def problematic_pgs_methods(t: Inputs) -> DataFrame:
    rows = report.problematic(scoring.results(t), t.view("pgs_scores").withColumn("method_name", F.expr(METHODS)))
    return rows.select("trait_id", "pgs_id", F.array_join("issues", ",").alias("issues"))


@query("validation", """with tr as (select * from fx_trait_results), n as (select count(distinct trait_id) as a from tr),
  s as (select count(*) filter (where abs(z_score) > 10) as extreme, count(z_score) as scored, count(*) filter (where total_variants = 0) as empty, count(*) filter (where matched_variants > total_variants and total_variants > 0) as over, count(*) filter (where insufficient_data) as poor, count(*) as rows from fx_results),
  m as (select count(*) filter (where best_pgs_id is null) as k from tr), d as (select count(*) filter (where sp > 10) as k from (select max(overall_z) - min(overall_z) as sp from tr group by trait_id) q)
  select individual_id || ' has all traits' as name, count(distinct trait_id) = max(n.a) as pass, count(distinct trait_id) || '/' || max(n.a) as detail from tr, n group by individual_id
  union all select 'extreme z below 5%', extreme * 1e0 / scored < 5e-2, extreme || '/' || scored from s union all select 'every trait has a best score', k = 0, cast(k as string) from m union all select 'z spread below 10', k = 0, cast(k as string) from d
  union all select 'no score without variants', empty = 0, cast(empty as string) from s union all select 'matched not above expected', over = 0, cast(over as string) from s union all select 'insufficient below 20%', poor * 1e0 / rows < 2e-1, poor || '/' || rows from s""")
def validation(t: Inputs) -> DataFrame:
    done = cut(scoring.results(t))  # stored results
    return report.validation(done, cut(finalize.trait_results(done, t.view("traits"))))


@query("category_report", "select category, count(distinct r.trait_id) as traits, round(avg(overall_percentile), 6) as mean_percentile, count(*) filter (where overall_percentile > 75) as elevated, count(*) filter (where overall_percentile < 25) as low from fx_trait_results r join fx_traits t on t.trait_id = r.trait_id group by category")
def category_report(t: Inputs) -> DataFrame:
    return report.category_report(scoring.trait_results(t), t.view("traits")).withColumn("mean_percentile", F.round("mean_percentile", 6))


@query("cross_individual_spread", "select trait_id, round(max(overall_z) - min(overall_z), 6) as spread, count(*) as people from fx_trait_results group by trait_id")
def cross_individual_spread(t: Inputs) -> DataFrame:
    return report.spread(scoring.trait_results(t)).withColumn("spread", F.round("spread", 6))


@query("dashboard", """with d as (select t.trait_id, t.name, round(r.overall_percentile, 6) as p from fx_traits t left join (select * from fx_trait_results where individual_id = 'IND1' and trait_id > 'EFO_0000004') r on r.trait_id = t.trait_id where contains(lower(t.name), 'a') or contains(lower(t.category), 'a'))
  select trait_id, name, p as percentile, cast(row_number() over (order by p is null, abs(p - 50) desc nulls last, name) as int) as place from d""")
def dashboard(t: Inputs) -> DataFrame:
    own = scoring.trait_results(t).filter("individual_id = 'IND1' and trait_id > 'EFO_0000004'").withColumn("overall_percentile", F.round("overall_percentile", 6))
    return report.dashboard(t.view("traits"), own, search="A").select("trait_id", "name", F.col("overall_percentile").alias("percentile"), "place")


@query("category_list", "select category, cast(row_number() over (order by category = 'Other Conditions', category) as int) as place from (select distinct coalesce(category, 'Other Conditions') as category from fx_traits) q")
def category_list(t: Inputs) -> DataFrame:
    return report.category_list(t.view("traits"))


@query("median_z", "select individual_id, trait_id, round(median(z_score), 6) as median_z, round(avg(z_score), 6) as mean_z from fx_results where z_score is not null group by individual_id, trait_id")
def median_z(t: Inputs) -> DataFrame:
    return report.z_by_trait(scoring.results(t)).select("individual_id", "trait_id", *rounded("median_z", "mean_z"))


@query("visible_scores", "select individual_id, trait_id, pgs_id, round(quality_score, 6) as quality_score, cast(row_number() over (partition by individual_id, trait_id order by coalesce(quality_score, 0) desc, pgs_id) as int) as place from fx_results where abs(raw_score) >= 5e-3")
def visible_scores(t: Inputs) -> DataFrame:
    return report.visible_scores(scoring.results(t)).select("individual_id", "trait_id", "pgs_id", *rounded("quality_score"), "place")


@query("result_order", """with r as (select individual_id, trait_id, pgs_id, insufficient_data, performance, round(raw_score, 6) as raw_score from fx_results)
  select individual_id, trait_id, pgs_id, cast(row_number() over (partition by individual_id, trait_id order by insufficient_data, performance desc nulls last, abs(raw_score) desc, pgs_id) as int) as best, cast(row_number() over (partition by individual_id, trait_id order by abs(raw_score) desc, pgs_id) as int) as effect from r""")
def result_order(t: Inputs) -> DataFrame:
    rows = scoring.results(t).select("individual_id", "trait_id", "pgs_id", "insufficient_data", "performance", *rounded("raw_score"))
    both = report.result_order(report.result_order(rows).withColumnRenamed("place", "best"), "effect")
    return both.select("individual_id", "trait_id", "pgs_id", "best", F.col("place").alias("effect"))


@query("dashboard_categories", """with t as (select *, concat('about ', lower(name), ' and more') as description, case when trait_id > 'EFO_0000012' then [category, 'EXTRA'] when trait_id > 'EFO_0000005' then [category] else [] end as categories from fx_traits)
  select trait_id, name from t where list_contains(categories, 'EXTRA') and (contains(description, 'an') or contains(lower(name), 'an'))""")
def dashboard_categories(t: Inputs) -> DataFrame:
    traits = t.view("traits").withColumn("description", F.concat(F.lit("about "), F.lower("name"), F.lit(" and more")))
    traits = traits.withColumn("categories", F.expr("case when trait_id > 'EFO_0000012' then array(category, 'EXTRA') when trait_id > 'EFO_0000005' then array(category) else array() end"))
    own = t.view("trait_pgs").select("trait_id").distinct().withColumn("overall_percentile", F.lit(50.0))
    return report.dashboard(traits, own, search="AN", category="EXTRA").select("trait_id", "name")


@query("progress", "select individual_id, count(*) as done, round(count(*) * 100e0 / 25, 2) as percent from fx_trait_results group by individual_id")
def progress(t: Inputs) -> DataFrame:
    return report.progress(scoring.trait_results(t), 25)


DONE = "select concat('IND', cast(n_regionkey as string)) as individual_id, concat('EFO_', lpad(cast(n_nationkey as string), 7, '0')) as trait_id from nation"


@query("skip_existing", f"select i.individual_id, t.trait_id from (select distinct individual_id from fx_dna) i cross join fx_traits t where not exists (select 1 from ({DONE}) d where d.individual_id = i.individual_id and d.trait_id = t.trait_id)")
def skip_existing(t: Inputs) -> DataFrame:
    return results.skip_existing(t.view("dna"), t.view("traits"), t.sql(DONE))


@query("nested_results", "select r.individual_id, r.trait_id, s.scores, s.first_pgs from fx_trait_results r left join (select individual_id, trait_id, count(*) as scores, arg_max(pgs_id, {'q': quality_score, 'p': pgs_id}) as first_pgs from fx_results group by 1, 2) s on s.individual_id = r.individual_id and s.trait_id = r.trait_id")
def nested_results(t: Inputs) -> DataFrame:
    rows = results.nested(scoring.trait_results(t), scoring.results(t))
    return rows.select("individual_id", "trait_id", F.size("scores").cast("long").alias("scores"), F.get("scores", F.lit(0))["pgs_id"].alias("first_pgs"))


UNITS = "select cast(c_custkey as int) as k, c_acctbal as v, case c_custkey % 5 when 0 then 'kg' when 1 then 'cm' when 2 then 'mg/dL' when 3 then '°C' else 'mmHg' end as u, case c_custkey % 5 when 0 then 'lbs' when 1 then 'in' when 2 then 'mmol/L' when 3 then '°F' else 'kg' end as w from customer"


@query("unit_convert", f"select k, round(case u when 'kg' then v * 220462e-5 when 'cm' then v / 254e-2 when 'mg/dL' then v / 180182e-4 when '°C' then v * 9 / 5 + 32 else v end, 4) as value, case u when 'kg' then 'lbs' when 'cm' then 'in' when 'mg/dL' then 'mg/dL' when '°C' then '°F' else u end as preferred from ({UNITS}) q")
def unit_convert(t: Inputs) -> DataFrame:
    return t.sql(UNITS).select("k", F.round(D.convert(F.col("v"), F.col("u"), F.col("w")), 4).alias("value"), D.default_unit(F.col("u")).alias("preferred"))


SHOWN = "select n_nationkey as k, n_nationkey * 13721e-2 + 3e-2 as v, case n_nationkey % 8 when 0 then 'mg/dL' when 1 then 'U/L' when 2 then 'g/cm²' when 3 then '%' when 4 then 'ratio' when 5 then 'kcal/day' when 6 then 'thousand/μL' else 'SNPs' end as u from nation"


@query("value_text", f"""select k, case u when 'mg/dL' then format('{{:,.1f}} mg/dL', v) when 'U/L' then format('{{:,.0f}} U/L', v) when 'g/cm²' then format('{{:,.3f}} g/cm²', v) when '%' then format('{{:,.1f}}%', v) when 'ratio' then format('{{:,.2f}}', v)
  when 'kcal/day' then format('{{:,.0f}} kcal/day', v) when 'thousand/μL' then format('{{:,.2f}} ×10³/μL', v) end as shown from ({SHOWN}) q""")
def value_text(t: Inputs) -> DataFrame:
    return t.sql(SHOWN).select("k", D.value_text(F.col("v"), F.col("u")).alias("shown"))


@query("texts", "select cast(n_nationkey as int) as n, concat(cast(n_nationkey as string), case when n_nationkey % 10 = 1 and n_nationkey <> 11 then 'st' when n_nationkey % 10 = 2 and n_nationkey <> 12 then 'nd' when n_nationkey % 10 = 3 and n_nationkey <> 13 then 'rd' else 'th' end, ' percentile') as ordinal from nation")
def texts(t: Inputs) -> DataFrame:
    return t.table("nation").select(F.col("n_nationkey").cast("int").alias("n"), D.ordinal(F.col("n_nationkey")).alias("ordinal"))


RUNS = "select o_orderkey as run_id, concat('T', cast(o_custkey % 20 as string)) as trait_id, o_orderdate as ended, 1e0 + o_orderkey % 50 as seconds, cast(floor(o_totalprice) as bigint) as variants from orders"


@query("run_estimate", f"""with r as ({RUNS}), l as (select *, row_number() over (order by ended desc, run_id) as n from r), t as (select sum(variants / seconds * (21 - n)) / sum(21 - n) as rate from l where n <= 20),
  o as (select trait_id, seconds, row_number() over (partition by trait_id order by ended desc, run_id) as n from r), k as (select *, count(*) over (partition by trait_id) + 1 - n as w from o where n <= 10), h as (select trait_id, sum(seconds * w) / sum(w) as own from k group by trait_id),
  j as (select 'T' || (n_nationkey % 25) as trait_id, n_nationkey * 1000000 as variants from nation) select j.trait_id, round(case when own is null then greatest(15e0, j.variants / t.rate) else greatest(15e0, j.variants / t.rate) * 6e-1 + own * 4e-1 end, 6) as estimate from j cross join t left join h on h.trait_id = j.trait_id""")
def run_estimate(t: Inputs) -> DataFrame:
    jobs = t.table("nation").select(F.concat(F.lit("T"), (F.col("n_nationkey") % 25).cast("string")).alias("trait_id"), (F.col("n_nationkey") * 1000000).alias("variants"))
    return report.run_estimate(t.sql(RUNS), jobs).withColumn("estimate", F.round("estimate", 6))


QUEUE = "select concat('IND', cast(c_nationkey % 3 as string)) as individual_id, concat('T', cast(c_custkey % 15 as string)) as trait_id, cast(c_custkey % 4 as int) as priority, c_custkey as added, case when c_custkey % 40 = 0 then 1 else 0 end as running from customer"


@query("queue_order", f"with j as (select individual_id, trait_id, max(priority) as priority, min(added) as added, max(running) as running from ({QUEUE}) q group by 1, 2) select individual_id, trait_id, priority, cast(row_number() over (order by running desc, priority desc, added, individual_id, trait_id) as int) as place from j")
def queue_order(t: Inputs) -> DataFrame:
    return report.queue_order(t.sql(QUEUE)).select("individual_id", "trait_id", "priority", "place")


PROFILE = "select event_type as phase, ts, cast(user_id % 8 as double) as cores, value as rss from events"


@query("phases", f"select phase, count(*) as samples, round(avg(cores), 6) as mean_cores, round(max(rss), 6) as peak_rss, cast(row_number() over (order by min(ts), phase) as int) as place from ({PROFILE}) p group by phase")
def phases(t: Inputs) -> DataFrame:
    return report.phases(t.sql(PROFILE)).select("phase", "samples", *rounded("mean_cores", "peak_rss"), "place")


@query("paged_traits", "select trait_id, name from fx_traits order by fx_traits.name, fx_traits.trait_id limit 10 offset 5")
def paged_traits(t: Inputs) -> DataFrame:
    return t.view("traits").orderBy("name", "trait_id").offset(5).limit(10).select("trait_id", "name")
