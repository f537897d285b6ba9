"""Queries of harmonizing and standardizing scoring files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pgsloom.plans import etl
from pgsloom.plans.fixtures import VIEWS, Inputs
from pgsloom.queries.base import query, rounded

VIEWS["fx_raw"] = """select concat('PGS', lpad(cast(p_partkey % 9 as string), 6, '0')) as pgs_id, case when p_partkey % 8 = 0 then '' when p_partkey % 8 = 1 then null else concat('rs', cast(p_partkey as string)) end as "rsID",
  case when p_partkey % 30 = 7 then 'X' when p_partkey % 30 = 8 then '1_random' when p_partkey % 2 = 0 then concat('chr', cast(p_partkey % 22 + 1 as string)) else cast(p_partkey % 22 + 1 as string) end as chr_name,
  case when p_partkey % 13 = 0 then 'abc' when p_partkey % 13 = 1 then '' when p_partkey % 13 = 2 then null else cast(p_partkey * 100 as string) end as chr_position,
  case when p_partkey % 11 = 0 then ' ' when p_partkey % 11 = 1 then null else substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) end as effect_allele,
  case when p_partkey % 7 = 0 then '' when p_partkey % 7 = 1 then null else substr('ACGT', cast((p_partkey + 1) % 4 as int) + 1, 1) end as other_allele,
  case when p_partkey % 17 = 0 then '' when p_partkey % 17 = 1 then 'x' else cast(p_size * 1e-2 as string) end as effect_weight, cast(p_partkey % 22 + 1 as string) as hm_chr,
  case when p_partkey % 19 = 0 then '0' when p_partkey % 19 = 1 then null when p_partkey % 19 = 2 then '' else cast(p_partkey * 100 + 7 as string) end as hm_pos, case when p_partkey % 5 = 0 then '' else 'G' end as "hm_inferOtherAllele",
  '0' as dosage_0_weight, cast(p_size * 1e-1 as string) as dosage_1_weight, '1' as dosage_2_weight, 'True' as is_haplotype from part"""

COLUMNS = {
    etl.DOSAGE: ["chr_name", "chr_position", "effect_allele", "other_allele", "dosage_0_weight", "dosage_1_weight", "dosage_2_weight"],
    etl.HARMONIZED: ["rsID", "chr_name", "chr_position", "effect_allele", "effect_weight", "hm_chr", "hm_pos", "hm_inferOtherAllele"],
    etl.HLA: ["rsID", "effect_allele", "effect_weight", "is_haplotype"],
    etl.SNP: ["rsID", "chr_name", "chr_position", "effect_allele", "other_allele", "effect_weight"],
    etl.SNP_NO_RSID: ["chr_name", "chr_position", "effect_allele", "effect_weight"],
    etl.RSID: ["rsID", "effect_allele", "other_allele", "effect_weight"],
    etl.RSID_CHR: ["rsID", "chr_name", "effect_allele", "other_allele", "effect_weight"],
}


def raw(t: Inputs, layout: str) -> DataFrame:
    """Rows with the header of a layout."""
    return t.sql(VIEWS["fx_raw"].replace('"', "`")).select("pgs_id", *COLUMNS[layout])


BARE, FOUR = "replace(chr_name, 'chr', '')", "concat(replace(chr_name, 'chr', ''), ':', coalesce(chr_position, ''), ':', effect_allele, ':', coalesce(other_allele, ''))"
KEPT = "trim(coalesce(effect_allele, '')) <> '' and trim(coalesce({0}, '')) <> ''"
FORMS = {
    etl.DOSAGE: (FOUR, BARE, "try_cast(chr_position as bigint)", "other_allele", "dosage_1_weight", ""),
    etl.HARMONIZED: ("concat(hm_chr, ':', hm_pos, ':', effect_allele, ':', coalesce(nullif(\"hm_inferOtherAllele\", ''), ''))", "hm_chr", "try_cast(hm_pos as bigint)", "nullif(\"hm_inferOtherAllele\", '')", "effect_weight", " and coalesce(hm_pos, '') not in ('', '0')"),
    etl.HLA: ("case when coalesce(\"rsID\", '') <> '' then \"rsID\" else effect_allele end", "''", "cast(null as bigint)", "''", "effect_weight", ""),
    etl.SNP: (FOUR, BARE, "try_cast(chr_position as bigint)", "other_allele", "effect_weight", ""),
    etl.SNP_NO_RSID: ("concat(replace(chr_name, 'chr', ''), ':', coalesce(chr_position, ''), ':', effect_allele)", BARE, "try_cast(chr_position as bigint)", "''", "effect_weight", ""),
    etl.RSID: ('"rsID"', "''", "cast(null as bigint)", "other_allele", "effect_weight", ""),
    etl.RSID_CHR: ('"rsID"', BARE, "cast(null as bigint)", "other_allele", "effect_weight", ""),
}


def sql(layout: str) -> str:
    identity, chrom, pos, other, weight, more = FORMS[layout]
    return f"select pgs_id, {identity} as variant_id, {chrom} as chr_name, {pos} as chr_position, effect_allele, {other} as other_allele, round(try_cast({weight} as double), 6) as effect_weight from fx_raw where {KEPT.format(weight)}{more}"


def _register(layout: str) -> None:
    @query(f"harmonize_{layout.lower()}", sql(layout))
    def harmonized(t: Inputs) -> DataFrame:
        return etl.harmonize(raw(t, layout)).withColumn("effect_weight", F.round("effect_weight", 6))


for _layout in COLUMNS:
    _register(_layout)

STANDARD = f"""with h as ({sql(etl.SNP)}), s as (select *, split_part(variant_id, ':', 3) as a, split_part(variant_id, ':', 4) as b, split_part(variant_id, ':', 1) as c from h where effect_weight is not null and trim(variant_id) <> '')
  select distinct variant_id, effect_allele, effect_weight, pgs_id, case c when 'X' then 23 when 'Y' then 24 when 'MT' then 25 else try_cast(c as int) end as chr, try_cast(split_part(variant_id, ':', 2) as int) as pos,
  ('0x' || md5(concat(least(a, b), ':', greatest(a, b)))[:15])::bigint as allele_key from s where not contains(c, '_')"""


@query("standardize", STANDARD)
def standardize(t: Inputs) -> DataFrame:
    return etl.standardize(etl.harmonize(raw(t, etl.SNP)).withColumn("effect_weight", F.round("effect_weight", 6)))


@query("standardize_legacy", f"with h as ({sql(etl.RSID_CHR)}) select coalesce(variant_id, '') as variant_id, coalesce(chr_name, '') as chr_name, chr_position, effect_allele, coalesce(other_allele, '') as other_allele, effect_weight, pgs_id from h where effect_weight is not null")
def standardize_legacy(t: Inputs) -> DataFrame:
    return etl.standardize_legacy(etl.harmonize(raw(t, etl.RSID_CHR)).withColumn("effect_weight", F.round("effect_weight", 6)))


@query("dedupe", "select distinct pgs_id, chr, effect_allele, round(effect_weight, 6) as effect_weight from fx_pack")
def dedupe(t: Inputs) -> DataFrame:
    rows = t.view("pack").select("pgs_id", "chr", "effect_allele", *rounded("effect_weight"))
    return etl.deduplicated(rows, ["pgs_id", "chr", "effect_allele"], t.table("lineitem").count())  # as many rows at most


REFERENCE = "select chr, pos, split_part(variant_id, ':', 3) as ref, split_part(variant_id, ':', 4) as alt from fx_af"


@query("infer_other_allele", f"""with h as ({sql(etl.SNP_NO_RSID)}), r as ({REFERENCE}) select h.pgs_id, case when r.ref is not null then concat(h.chr_name, ':', h.chr_position, ':', r.ref, ':', r.alt) else concat_ws(':', h.chr_name, cast(h.chr_position as string), h.effect_allele) end as variant_id,
  coalesce(r.ref, h.other_allele) as other_allele from h left join r on h.chr_name = cast(r.chr as string) and h.chr_position = r.pos and h.effect_allele = r.alt""")
def infer_other_allele(t: Inputs) -> DataFrame:
    return etl.infer_other_allele(etl.harmonize(raw(t, etl.SNP_NO_RSID)), t.sql(REFERENCE)).select("pgs_id", "variant_id", "other_allele")


WHOLE = (etl.DOSAGE, etl.HARMONIZED, etl.SNP, etl.SNP_NO_RSID)


@query("etl", f"""with h as ({' union all '.join(f'select pgs_id, variant_id, effect_allele, effect_weight from ({sql(layout)}) q{i}' for i, layout in enumerate(WHOLE))}),
  s as (select *, split_part(variant_id, ':', 3) as a, split_part(variant_id, ':', 4) as b, split_part(variant_id, ':', 1) as c from h where effect_weight is not null and trim(coalesce(variant_id, '')) <> '' and trim(effect_allele) <> '')
  select distinct variant_id, effect_allele, effect_weight, pgs_id, case c when 'X' then 23 when 'Y' then 24 when 'MT' then 25 else try_cast(c as int) end as chr, try_cast(split_part(variant_id, ':', 2) as int) as pos,
  ('0x' || md5(concat(least(a, b), ':', greatest(a, b)))[:15])::bigint as allele_key from s where not contains(c, '_')""")
def whole_etl(t: Inputs) -> DataFrame:
    rows = etl.etl([raw(t, layout) for layout in WHOLE])
    return rows.withColumn("effect_weight", F.round("effect_weight", 6)).distinct()


@query("pack_manifest", "select chr, count(*) as variants, count(distinct pgs_id) as scores, min(pos) as first_pos, max(pos) as last_pos from fx_pack group by chr")
def pack_manifest(t: Inputs) -> DataFrame:
    return t.view("pack").groupBy("chr").agg(F.count("*").alias("variants"), F.countDistinct("pgs_id").alias("scores"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
