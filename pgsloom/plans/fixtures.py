"""Domain-shaped views over the generic test tables, in SQL that Spark and DuckDB both read.

Only the expression of the allele key differs between the engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()
_PAIR = "concat(least(split_part(variant_id,':',3),split_part(variant_id,':',4)),':',greatest(split_part(variant_id,':',3),split_part(variant_id,':',4)))"
ALLELE_KEY = {"spark": f"cast(conv(substr(md5({_PAIR}),1,15),16,10) as bigint)", "duckdb": f"('0x' || md5({_PAIR})[:15])::bigint"}
_SHIFT = "case when (l_suppkey % 20 = 5 and l_partkey % 25 <> 0) or (l_suppkey % 20 = 6 and l_partkey % 500 <> 0) then 1 else 0 end"

VIEWS = {
    "fx_pack": f"""select *, {{ALLELE_KEY}} as allele_key from (
  select concat(cast(l_partkey % 22 + 1 as string), ':', cast(l_partkey * 100 + {_SHIFT} as string), ':',
                substr('ACGT', cast(l_partkey % 4 as int) + 1, 1), ':', substr('ACGT', cast((l_partkey + 1) % 4 as int) + 1, 1)) as variant_id,
         substr('ACGT', cast(l_partkey % 4 as int) + 1, 1) as effect_allele,
         min(l_discount) - 5e-2 + (l_partkey % 7 - 3) * 1e-2 as effect_weight,
         concat('PGS', lpad(cast(l_suppkey as string), 6, '0')) as pgs_id,
         cast(l_partkey % 22 + 1 as int) as chr, cast(l_partkey * 100 + {_SHIFT} as int) as pos
  from lineitem group by l_partkey, l_suppkey) q""",
    "fx_dna": """select *, {ALLELE_KEY} as allele_key from (
  select concat('IND', cast(r_regionkey as string)) as individual_id,
         concat(cast(p_partkey % 22 + 1 as string), ':', cast(p_partkey * 100 as string), ':',
                substr('ACGT', cast((p_partkey + 1) % 4 as int) + 1, 1), ':', substr('ACGT', cast(p_partkey % 4 as int) + 1, 1)) as variant_id,
         (p_partkey * 7 + r_regionkey * 3 + p_size) % 3 * 1e0 as genotype_dosage,
         p_partkey % 5 <> 0 as imputed,
         case when p_partkey % 5 <> 0 then 5e-1 + p_size * 1e-2 else 1e0 end as imputation_quality,
         case when p_partkey % 5 <> 0 then 2e0 * (p_partkey % 10) * 1e-1 else 0e0 end as expected_dosage,
         cast(p_partkey % 22 + 1 as int) as chr, cast(p_partkey * 100 as int) as pos
  from part cross join region where (p_partkey + r_regionkey) % 3 <> 0) q""",
    "fx_pgs_scores": """select concat('PGS', lpad(cast(s_suppkey as string), 6, '0')) as pgs_id,
  case when s_suppkey % 10 = 0 then null else s_acctbal * 1e-4 end as norm_mean,
  case when s_suppkey % 10 = 0 then null when s_suppkey % 10 = 1 then 1e-2 else 5e-1 + (s_suppkey % 4) * 25e-2 end as norm_sd,
  case when s_suppkey % 3 = 0 then 'NR' else 'beta' end as weight_type from supplier""",
    "fx_trait_pgs": """select concat('EFO_', lpad(cast(s_nationkey as string), 7, '0')) as trait_id,
  concat('PGS', lpad(cast(s_suppkey as string), 6, '0')) as pgs_id from supplier""",
    "fx_traits": """select concat('EFO_', lpad(cast(n_nationkey as string), 7, '0')) as trait_id, n_name as name, r_name as category,
  case when n_nationkey % 2 = 0 then 'quantitative' else 'disease_risk' end as trait_type,
  case when n_nationkey % 2 = 0 then 100e0 + n_nationkey end as phenotype_mean,
  case when n_nationkey % 2 = 0 then 10e0 + n_nationkey % 5 end as phenotype_sd
  from nation join region on n_regionkey = r_regionkey""",
    "fx_pgs_performance": """select concat('PGS', lpad(cast(c_custkey % 100 as string), 6, '0')) as pgs_id,
  case c_custkey % 5 when 0 then 'R²' when 1 then 'AUROC' when 2 then 'OR' when 3 then 'HR' else 'PGS R2 (no covariates)' end as metric_type,
  case c_custkey % 5 when 0 then (c_custkey % 40) * 1e-2 when 1 then 5e-1 + (c_custkey % 45) * 1e-2 when 4 then 1e0 + c_custkey % 30 else 1e0 + (c_custkey % 20) * 1e-1 end as metric_value
  from customer""",
    "fx_af": """select *, {ALLELE_KEY} as allele_key from (
  select concat(cast(p_partkey % 22 + 1 as string), ':', cast(p_partkey * 100 as string), ':',
         substr('ACGT', cast((p_partkey + p_size % 2) % 4 as int) + 1, 1), ':', substr('ACGT', cast((p_partkey + 1 - p_size % 2) % 4 as int) + 1, 1)) as variant_id,
         (p_partkey % 97 + 1) * 1e-2 as af, cast(p_partkey % 22 + 1 as int) as chr, cast(p_partkey * 100 as int) as pos
  from part where p_partkey % 11 <> 0) q""",
    "fx_ancestry_af": """select variant_id, chr, pos, allele_key, af as af_eur, case when pos % 300 <> 0 then af * 5e-1 end as af_afr,
  case when pos % 4000 = 0 then af * 8e-1 end as af_eas from fx_af""",
    "fx_blocks": """select distinct cast(p_partkey % 22 + 1 as int) as chr, cast(floor(p_partkey / 50) * 5000 as int) as hg19_start,
  cast(floor(p_partkey / 50) * 5000 + 4000 as int) as hg19_end, cast((floor(p_partkey / 50) % 7 - 3) * 10 as int) as hg38_offset from part""",
    "fx_truth": """select p_partkey as vid, r_regionkey as sample, (p_partkey * 5 + r_regionkey * 2) % 3 * 1e0 as t,
  (p_partkey * 5 + r_regionkey * 2) % 3 * 8e-1 + (p_size + r_regionkey) % 5 * 1e-1 as d from part cross join region where p_partkey % 4 <> 0
  union all select p_partkey, r_regionkey, 1e0, (p_size + r_regionkey) % 3 * 1e0 from part cross join region where p_partkey % 4 = 0""",
    "fx_matrix": """select chr, pos, allele_key, split_part(variant_id, ':', 4) as alt, s as sample,
  case when (pos / 100 + s * 5) % 17 = 0 then null else cast((pos / 100 * 3 + s * 7 + chr) % 3 as int) end as dosage
  from fx_af cross join (select r_regionkey * 2 as s from region union all select r_regionkey * 2 + 1 from region) x""",
    "fx_genotyped": """select individual_id, split_part(variant_id, ':', 1) as chromosome, pos as position, split_part(variant_id, ':', 3) as allele1,
  case when genotype_dosage = 1 then split_part(variant_id, ':', 4) else split_part(variant_id, ':', 3) end as allele2 from fx_dna where not imputed""",
}


def text(sql: str, engine: str, more: dict[str, str] | None = None) -> str:
    """SQL with the views that it names (and those that they name) put before it."""
    views = VIEWS | (more or {})
    needed: list[str] = []

    def add(part: str) -> None:
        for name in re.findall(r"\bfx_\w+", part):
            if name not in needed:
                add(views[name])
                if name not in needed:
                    needed.append(name)

    add(sql)
    ctes = [f"{n} as ({views[n].replace('{ALLELE_KEY}', ALLELE_KEY[engine])})" for n in needed]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join([*ctes, body[5:]]) if ctes else body
    return "with " + ",\n".join(ctes) + "\n" + body if ctes else body


class Inputs:
    """The tables and views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, sql: str) -> DataFrame:
        """Run Spark SQL that names tables and views."""
        whole = text(sql, "spark")
        used = [t for t in TABLES if re.search(rf"\b{t}\b", whole)]
        for t in used:
            whole = re.sub(rf"(?<=from |join ){t}\b", f"{{{t}}}", whole)
        return self.spark.sql(whole, **{t: self.table(t) for t in used})

    def view(self, name: str) -> DataFrame:
        return self.sql(f"select * from fx_{name}")
