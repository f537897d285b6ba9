"""Queries of people's genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pgsloom.functions import alleles as A
from pgsloom.operators import dna
from pgsloom.plans.fixtures import Inputs
from pgsloom.queries.base import query, rounded

IMPUTED = "select * from fx_dna where imputed union all select individual_id, variant_id, genotype_dosage, true, 8e-1, expected_dosage, chr, pos, allele_key from fx_dna where not imputed and pos % 3 = 0"
MERGED = f"with i as ({IMPUTED}), g as (select * from fx_dna where not imputed and pos % 2 = 0), m as (select * from g union all select i.* from i where not exists (select 1 from g where g.individual_id = i.individual_id and g.chr = i.chr and g.pos = i.pos))"


def merged(t: Inputs) -> DataFrame:
    return dna.merge_calls(t.view("dna").filter("not imputed and pos % 2 = 0"), t.sql(IMPUTED))


@query("merge_imputed", f"{MERGED} select individual_id, variant_id, genotype_dosage, imputed, round(imputation_quality, 6) as imputation_quality from m")
def merge_imputed(t: Inputs) -> DataFrame:
    return merged(t).select("individual_id", "variant_id", "genotype_dosage", "imputed", *rounded("imputation_quality"))


@query("merge_counts", f"{MERGED} select individual_id, count(*) as total, count(*) filter (where imputed) as imputed, count(*) filter (where not imputed) as genotyped from m group by individual_id")
def merge_counts(t: Inputs) -> DataFrame:
    return dna.merge_counts(merged(t))


@query("liftover", "select d.individual_id, d.variant_id, d.chr, d.pos + b.hg38_offset as pos from fx_dna d join fx_blocks b on b.chr = d.chr and d.pos >= b.hg19_start and d.pos < b.hg19_end")
def liftover(t: Inputs) -> DataFrame:
    return dna.lift(t.view("dna").select("individual_id", "variant_id", "chr", "pos"), t.view("blocks"))


POSTERIORS = "select p_partkey as k, (p_partkey % 21) * 1e-1 as ds, (p_partkey % 5) * 25e-2 as gp1, (4 - p_partkey % 5) * 25e-2 as gp2, 0e0 as gp3 from part"


@query("imputation_quality", f"with p as ({POSTERIORS}) select k, round(greatest(0e0, 1e0 - (gp1 * ds * ds + gp2 * (1e0 - ds) * (1e0 - ds) + gp3 * (2e0 - ds) * (2e0 - ds))), 6) as imputation_quality from p where greatest(gp1, gp2, gp3) >= 5e-1")
def imputation_quality(t: Inputs) -> DataFrame:
    return dna.from_posteriors(t.sql(POSTERIORS)).select("k", *rounded("imputation_quality"))


DR2_BY_KEY = "select variant_id, chr, pos, allele_key, (pos / 100 % 10) * 1e-1 as dr2 from fx_af where pos % 700 <> 0"


@query("bake_metadata", f"with q as ({DR2_BY_KEY}) select d.individual_id, d.variant_id, round(case when d.imputed then coalesce(2e0 * a.af, 1e0) else 0e0 end, 6) as expected_dosage, round(coalesce(q.dr2, case when d.imputed then 5e-1 else 1e0 end), 6) as imputation_quality from fx_dna d left join fx_af a on a.chr = d.chr and a.pos = d.pos and a.allele_key = d.allele_key left join q on q.chr = d.chr and q.pos = d.pos and q.allele_key = d.allele_key")
def bake_metadata(t: Inputs) -> DataFrame:
    return dna.bake(t.view("dna"), t.view("af"), t.sql(DR2_BY_KEY)).select("individual_id", "variant_id", *rounded("expected_dosage", "imputation_quality"))


DR2 = "select vid, least(1e0, greatest(0e0, coalesce(case when var_pop(t) = 0 or var_pop(d) = 0 then 0e0 else power(covar_pop(t, d), 2) / (var_pop(t) * var_pop(d)) end, 0e0))) as dr2 from fx_truth group by vid"


@query("dr2", f"select vid, round(dr2, 6) as dr2 from ({DR2}) q")
def dr2(t: Inputs) -> DataFrame:
    return dna.dr2(t.view("truth")).select("vid", *rounded("dr2"))


GT = "select vid, sample, case cast(t as int) when 0 then '0/0' when 1 then case when sample % 2 = 0 then '0|1' else '1/0' end else '1|1' end as gt from fx_truth where (vid + sample) % 7 <> 0 union all select -1, 0, './.'"
DOSAGES = "select vid, sample, d as dosage from fx_truth where vid % 11 <> 0 union all select -1, 0, 5e-1"


@query("truth_pairs", f"""with g as ({GT}), d as ({DOSAGES}) select g.vid, g.sample, case when g.gt = './.' then 0e0 else cast(substr(g.gt, 1, 1) as double) + cast(substr(g.gt, 3, 1) as double) end as t, d.dosage as d from g join d on d.vid = g.vid and d.sample = g.sample""")
def truth_pairs(t: Inputs) -> DataFrame:
    return dna.truth_pairs(t.sql(GT), t.sql(DOSAGES))


@query("dr2_stats", f"with r as (select vid, round(dr2, 6) as dr2 from ({DR2}) q) select count(*) as variants, round(avg(dr2), 6) as mean, round(median(dr2), 6) as median, count(*) filter (where dr2 >= 8e-1) as high, count(*) filter (where dr2 < 3e-1) as low from r")
def dr2_stats(t: Inputs) -> DataFrame:
    found = dna.dr2(t.view("truth")).select("vid", *rounded("dr2"))
    return dna.dr2_stats(found).select("variants", *rounded("mean", "median"), "high", "low")


@query("chr_manifest", "select chr, count(*) as total, count(*) filter (where imputed) as imputed, count(*) filter (where not imputed) as genotyped from fx_dna group by chr")
def chr_manifest(t: Inputs) -> DataFrame:
    return dna.chromosome_manifest(t.view("dna"))


OBSERVED = "select p_partkey as k, 1 as chr, cast(p_partkey as int) as pos, substr('ACGT-', cast(p_partkey % 5 as int) + 1, 1) as allele1, substr('ACGT', cast(floor(p_partkey / 5) as int) % 4 + 1, 1) as allele2 from part"
PANEL = "select 1 as chr, cast(p_partkey as int) as pos, substr('ACGT', cast(floor(p_partkey / 20) as int) % 4 + 1, 1) as panel_ref from part where p_partkey % 6 <> 0"


@query("ref_alt_gt", f"""with j as (select o.*, p.panel_ref as r, coalesce(p.panel_ref in (o.allele1, o.allele2), false) as fits, coalesce(p.panel_ref in (translate(o.allele1, 'ACGT', 'TGCA'), translate(o.allele2, 'ACGT', 'TGCA')), false) as comp
    from ({OBSERVED}) o left join ({PANEL}) p on p.chr = o.chr and p.pos = o.pos where contains('ACGT', o.allele1) and contains('ACGT', o.allele2)),
  x as (select *, not fits and comp as flipped, case when not fits and comp then translate(allele1, 'ACGT', 'TGCA') else allele1 end as x, case when not fits and comp then translate(allele2, 'ACGT', 'TGCA') else allele2 end as y from j where r is null or fits or comp)
  select k, chr, pos, allele1, allele2, coalesce(r, least(allele1, allele2)) as ref, case when r is null and allele1 <> allele2 then greatest(allele1, allele2) when r is null then case when allele1 = 'A' then 'C' else 'A' end when x = r and y = r then case when r = 'A' then 'C' else 'A' end when x = r then y else x end as alt,
    case when r is null then case when allele1 = allele2 then '0/0' else '0/1' end when x = r and y = r then '0/0' when x = r or y = r then '0/1' else '1/1' end as gt, r is not null and flipped as flipped from x""")
def ref_alt_gt(t: Inputs) -> DataFrame:
    return dna.strands(t.sql(OBSERVED), t.sql(PANEL))


@query("allele_functions", """with v as (select pgs_id, variant_id, effect_allele, split_part(variant_id, ':', 3) as a, split_part(variant_id, ':', 4) as b, chr from fx_pack) select pgs_id, variant_id, concat(split_part(variant_id, ':', 1), ':', split_part(variant_id, ':', 2)) as position_key,
  cast(a = effect_allele as int) + cast(b = effect_allele as int) as effect_count, translate(a, 'ACGT', 'TGCA') as complement, case when a <> b then 1 else 0 end as legacy_dosage, case chr when 23 then 'X' else cast(chr as string) end as label from v""")
def allele_functions(t: Inputs) -> DataFrame:
    v, a, b, e = F.col("variant_id"), A.part(F.col("variant_id"), 3), A.part(F.col("variant_id"), 4), F.col("effect_allele")
    return t.view("pack").select("pgs_id", "variant_id", A.position_key(v).alias("position_key"), A.count_effect_alleles(a, b, e).alias("effect_count"), A.complement(a).alias("complement"), A.sorted_allele_dosage(a, b).alias("legacy_dosage"), A.chromosome_label(F.col("chr")).alias("label"))


@query("resolve_dosage", """select d.individual_id, p.pgs_id, p.variant_id, case when split_part(p.variant_id, ':', 3) = split_part(d.variant_id, ':', 3) and split_part(p.variant_id, ':', 4) = split_part(d.variant_id, ':', 4) then d.genotype_dosage
  when split_part(p.variant_id, ':', 3) = split_part(d.variant_id, ':', 4) and split_part(p.variant_id, ':', 4) = split_part(d.variant_id, ':', 3) then 2e0 - d.genotype_dosage end as dosage from fx_pack p join fx_dna d on d.chr = p.chr and d.pos = p.pos""")
def resolve_dosage(t: Inputs) -> DataFrame:
    rows = t.view("pack").join(t.view("dna").select("individual_id", "chr", "pos", "genotype_dosage", F.col("variant_id").alias("own_id")), ["chr", "pos"])
    p, d = F.col("variant_id"), F.col("own_id")
    return rows.select("individual_id", "pgs_id", "variant_id", A.resolve_dosage(A.part(p, 3), A.part(p, 4), A.part(d, 3), A.part(d, 4), F.col("genotype_dosage")).alias("dosage"))


@query("detect_build", """with l as (select concat('f', cast(p_partkey % 7 as string)) as file, case when p_partkey % 7 = 0 then '# build 37.1' when p_partkey % 7 = 1 then '# GRCh38' when p_partkey % 7 = 2 then concat('rs3131972', chr(9), '1', chr(9), '752721', chr(9), 'AG')
  when p_partkey % 7 = 3 then concat('rs3131972', chr(9), '1', chr(9), '817186', chr(9), 'AG') else concat('rs', cast(p_partkey as string), chr(9), '1', chr(9), '5', chr(9), 'AA') end as value from part)
  select file, case when bool_or(value like '# build 37%') then 'hg19' when bool_or(value like '%GRCh38%') then 'hg38' when bool_or(value like 'rs3131972%752721%') then 'hg19' when bool_or(value like 'rs3131972%817186%') then 'hg38' else 'hg19' end as build from l group by file""")
def detect_build(t: Inputs) -> DataFrame:
    lines = t.sql("""select concat('f', cast(p_partkey % 7 as string)) as file, case when p_partkey % 7 = 0 then '# build 37.1' when p_partkey % 7 = 1 then '# GRCh38' when p_partkey % 7 = 2 then concat('rs3131972', chr(9), '1', chr(9), '752721', chr(9), 'AG')
      when p_partkey % 7 = 3 then concat('rs3131972', chr(9), '1', chr(9), '817186', chr(9), 'AG') else concat('rs', cast(p_partkey as string), chr(9), '1', chr(9), '5', chr(9), 'AA') end as value from part""")
    return dna.detect_build(lines)
