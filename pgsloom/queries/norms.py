"""Queries of population norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pgsloom.functions import statistics as S
from pgsloom.operators import norms, regression
from pgsloom.plans.fixtures import Inputs
from pgsloom.queries.base import query, rounded

JOINED = "from fx_pack p left join fx_af a on p.chr = a.chr and p.pos = a.pos and p.allele_key = a.allele_key"
EXPECTED = "case when p.effect_allele = split_part(a.variant_id, ':', 4) then 2e0 * a.af else 2e0 * (1e0 - a.af) end"


@query("hwe_norm_file", """select pgs_id, round(sum(effect_weight * 2e0 * coalesce(af, 5e-1)), 6) as mean, round(sqrt(sum(effect_weight * effect_weight * 2e0 * coalesce(af, 5e-1) * (1e0 - coalesce(af, 5e-1)))), 6) as sd
  from (select *, case when pos % 700 <> 0 then (pos / 100 % 90 + 5) * 1e-2 end as af from fx_pack) q group by pgs_id""")
def hwe_norm_file(t: Inputs) -> DataFrame:
    pack = t.view("pack").withColumn("af", F.expr("case when pos % 700 <> 0 then (pos / 100 % 90 + 5) * 1e-2 end"))
    return norms.norm_from_file(pack, "af").select("pgs_id", *rounded("mean", "sd"))


ORIENTED = f"select p.pgs_id, count(*) as total, count(a.af) as found, sum(case when a.af is not null then p.effect_weight * {EXPECTED} else 0e0 end) as mean, sqrt(sum(case when a.af is not null then p.effect_weight * p.effect_weight * 2e0 * a.af * (1e0 - a.af) else 0e0 end)) as sd {JOINED}"


@query("hwe_norm_oriented", f"with n as ({ORIENTED} group by p.pgs_id) select pgs_id, total, found, round(mean, 6) as mean, round(sd, 6) as sd, round(found * 100e0 / total, 2) as coverage from n")
def hwe_norm_oriented(t: Inputs) -> DataFrame:
    return norms.norm_oriented(t.view("pack"), t.view("af")).select("pgs_id", "total", "found", *rounded("mean", "sd"), "coverage")


@query("hwe_norm_plain", """with n as (select p.pgs_id, count(*) as total, count(a.af) as found, sum(case when a.af is not null then p.effect_weight * 2e0 * a.af else 0e0 end) as mean, sqrt(sum(case when a.af is not null then p.effect_weight * p.effect_weight * 2e0 * a.af * (1e0 - a.af) else 0e0 end)) as sd
  from fx_pack p left join fx_af a on p.variant_id = a.variant_id group by p.pgs_id) select pgs_id, total, found, round(nullif(mean, 0), 6) as mean, round(nullif(sd, 0), 6) as sd from n""")
def hwe_norm_plain(t: Inputs) -> DataFrame:
    return norms.norm_plain(t.view("pack"), t.view("af")).select("pgs_id", "total", "found", *rounded("mean", "sd"))


@query("best_coverage_norm", f"""with n as ({ORIENTED.replace('select p.pgs_id', 'select p.pgs_id, p.chr % 3 as pack')} group by p.pgs_id, p.chr % 3), r as (select *, round(found * 100e0 / total, 2) as coverage from n),
  k as (select *, row_number() over (partition by pgs_id order by coverage desc, pack) as rk from r) select pgs_id, pack, total, found, coverage, round(mean, 6) as mean from k where rk = 1""")
def best_coverage_norm(t: Inputs) -> DataFrame:
    pack = t.view("pack")
    parts = [norms.norm_oriented(pack.filter(F.col("chr") % 3 == i), t.view("af")).withColumn("pack", F.lit(i)) for i in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return norms.best_coverage(whole).select("pgs_id", "pack", "total", "found", "coverage", *rounded("mean"))


@query("theoretical_norm", f"""with n as (select p.pgs_id, sum(p.effect_weight * 2e0 * coalesce(a.af, 0e0)) as mean, sum(p.effect_weight * p.effect_weight * 2e0 * coalesce(a.af, 0e0) * (1e0 - coalesce(a.af, 0e0))) as variance {JOINED} group by p.pgs_id)
  select pgs_id, round(mean, 6) as mean, round(variance, 6) as variance, round(sqrt(variance), 6) as sd from n""")
def theoretical_norm(t: Inputs) -> DataFrame:
    # weights and frequencies have two digits, so a variance may lie half way: 12 digits first take away what the order of addition left
    rows = norms.theoretical(t.view("pack"), t.view("af")).withColumn("mean", F.round("mean", 12)).withColumn("variance", F.round("variance", 12))
    return rows.select("pgs_id", *rounded("mean", "variance", "sd"))


POPULATIONS = ["eur", "afr", "eas"]
ANCESTRY = " union all ".join(
    f"""select pgs_id, '{p}' as population, m, s, found, total from (select p.pgs_id, count(*) as total, count(a.af_{p}) as found,
  sum(case when a.af_{p} is not null then p.effect_weight * case when p.effect_allele = split_part(a.variant_id, ':', 4) then 2e0 * a.af_{p} else 2e0 * (1e0 - a.af_{p}) end end) as m,
  sqrt(nullif(sum(case when a.af_{p} is not null then p.effect_weight * p.effect_weight * 2e0 * a.af_{p} * (1e0 - a.af_{p}) end), 0)) as s
  from fx_pack p left join fx_ancestry_af a on p.chr = a.chr and p.pos = a.pos and p.allele_key = a.allele_key group by p.pgs_id) q_{p} where m is not null and s is not null and found >= total * 5e-2"""
    for p in POPULATIONS
)


@query("ancestry_norm", f"with n as ({ANCESTRY}) select pgs_id, population, round(m, 6) as m, round(s, 6) as s, found, total from n")
def ancestry_norm(t: Inputs) -> DataFrame:
    return norms.ancestry_long(t.view("pack"), t.view("ancestry_af"), POPULATIONS).select("pgs_id", "population", *rounded("m", "s"), "found", "total")


@query("ancestry_norm_map", f"with n as ({ANCESTRY}) select pgs_id, count(*) as populations, round(sum(m), 6) as total_mean from n group by pgs_id")
def ancestry_norm_map(t: Inputs) -> DataFrame:
    maps = norms.ancestry_norms(t.view("pack"), t.view("ancestry_af"), POPULATIONS)
    return maps.select("pgs_id", F.size("ancestry").cast("long").alias("populations"), F.round(F.aggregate(F.map_values("ancestry"), F.lit(0.0), lambda a, b: a + b["m"]), 6).alias("total_mean"))


@query("admixture_norm", f"""with n as ({ANCESTRY}), w as (select *, case population when 'eur' then 5e-1 when 'afr' then 3e-1 else 2e-1 end as p from n) select pgs_id, round(sum(p * m), 6) as m, round(sqrt(sum(p * s * s)), 6) as s from w group by pgs_id""")
def admixture_norm(t: Inputs) -> DataFrame:
    maps = norms.ancestry_norms(t.view("pack"), t.view("ancestry_af"), POPULATIONS)
    shares = F.create_map(*[F.lit(x) for x in ("eur", 0.5, "afr", 0.3, "eas", 0.2)])
    return maps.withColumn("n", S.admixed_norm(shares, F.col("ancestry"))).select("pgs_id", F.round("n.m", 6).alias("m"), F.round("n.s", 6).alias("s"))


PEOPLE = "select r_regionkey * 2 + k as sample, case when r_regionkey % 2 = 0 then 'EUR' else 'AFR' end as population from region cross join (select 0 as k union all select 1) x"


@query("population_af", f"select chr, pos, allele_key, population, round(sum(dosage) / (count(dosage) * 2e0), 6) as af from fx_matrix m join ({PEOPLE}) p on p.sample = m.sample where dosage is not null group by chr, pos, allele_key, population")
def population_af(t: Inputs) -> DataFrame:
    return norms.population_frequency(t.view("matrix"), t.sql(PEOPLE)).withColumn("af", F.round("af", 6))


SCORES = """select p.pgs_id, m.sample, sum(p.effect_weight * case when m.dosage is null then 0 when p.effect_allele = m.alt then m.dosage else 2 - m.dosage end) as score
  from fx_pack p join fx_matrix m on p.chr = m.chr and p.pos = m.pos and p.allele_key = m.allele_key"""


@query("empirical_scores", f"select pgs_id, sample, round(score, 6) as score from ({SCORES} group by p.pgs_id, m.sample) q")
def empirical_scores(t: Inputs) -> DataFrame:
    return norms.empirical_scores(t.view("pack"), t.view("matrix")).select("pgs_id", "sample", *rounded("score"))


@query("empirical_norm", f"select pgs_id, round(avg(score), 6) as m, round(stddev_pop(score), 6) as s, count(*) as n from ({SCORES} group by p.pgs_id, m.sample) q group by pgs_id having stddev_pop(score) > 0")
def empirical_norm(t: Inputs) -> DataFrame:
    return norms.empirical_norms(norms.empirical_scores(t.view("pack"), t.view("matrix"))).select("pgs_id", *rounded("m", "s"), "n")


@query("tiered_norm_raw", f"select pgs_id, round(stddev_pop(score), 6) as s from ({SCORES} where (p.chr, p.pos) in (select (chr, pos) from fx_dna where not imputed) group by p.pgs_id, m.sample) q group by pgs_id having stddev_pop(score) > 0")
def tiered_norm_raw(t: Inputs) -> DataFrame:
    return norms.raw_tier(t.view("pack"), t.view("matrix"), t.view("dna").filter("not imputed")).select("pgs_id", *rounded("s"))


@query("tiered_norm_imputed", """with p as (select * from fx_pack where (chr, pos, allele_key) in (select (chr, pos, allele_key) from fx_matrix)), n as (select pgs_id, count(*) as n from p group by pgs_id having count(*) >= 5),
  k as (select *, cast(least(10, greatest(3, floor(500000 / n))) as bigint) as rounds, cast(greatest(1, round(n * 6e-1)) as bigint) as k from n), e as (select p.*, k.k, unnest(generate_series(1, k.rounds)) as round from p join k on k.pgs_id = p.pgs_id where k.k < k.n),
  h as (select *, ('0x' || md5(concat_ws(':', '0', pgs_id, cast(round as string), cast(chr as string), cast(pos as string), cast(allele_key as string)))[:15])::bigint as h from e),
  c as (select *, row_number() over (partition by pgs_id, round order by h, chr, pos, allele_key) as rk from h),
  s as (select c.pgs_id, c.round, m.sample, sum(c.effect_weight * case when m.dosage is null then 0 when c.effect_allele = m.alt then m.dosage else 2 - m.dosage end) as score
    from c join fx_matrix m on c.chr = m.chr and c.pos = m.pos and c.allele_key = m.allele_key where c.rk <= c.k group by 1, 2, 3),
  r as (select pgs_id, round, stddev_pop(score) as s from s group by 1, 2) select pgs_id, round(avg(s), 6) as s, count(*) as rounds from r group by pgs_id""")
def tiered_norm_imputed(t: Inputs) -> DataFrame:
    return norms.imputed_tier(t.view("pack"), t.view("matrix")).select("pgs_id", *rounded("s"), "rounds")


DENSITY = "with s as (select pgs_id, norm_mean, norm_sd, unnest(generate_series(0, 24)) as i from fx_pgs_scores where norm_sd > 0), z as (select *, -4e0 + (i + 5e-1) * 32e-2 as z from s), d as (select *, exp(-5e-1 * z * z) / (norm_sd * sqrt(2e0 * pi())) as d from z)"


@query("density_bins", f"{DENSITY} select pgs_id, cast(i as int) as bin, round(floor(d * power(1e1, 2 - floor(log10(d))) + 5e-1) / power(1e1, 2 - floor(log10(d))), 9) as density from d")
def density_bins(t: Inputs) -> DataFrame:
    rows = t.view("pgs_scores").filter("norm_sd > 0")
    return rows.select("pgs_id", F.posexplode(S.density(F.col("norm_mean"), F.col("norm_sd"))).alias("bin", "density")).withColumn("density", F.round("density", 9))


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]:.17e}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c:.17e})"
    return out


def _sql_inverse(p: str) -> str:
    tail = lambda q: f"({_polynomial(q, S.INVERSE_C)} / {_polynomial(q, (*S.INVERSE_D, 1.0))})"
    q = f"({p} - 5e-1)"
    r = f"({q} * {q})"
    return f"(case when {p} < 2425e-5 then {tail(f'sqrt(-2e0 * ln({p}))')} when {p} <= 97575e-5 then {_polynomial(r, S.INVERSE_A)} * {q} / {_polynomial(r, (*S.INVERSE_B, 1.0))} else -{tail(f'sqrt(-2e0 * ln(1e0 - {p}))')} end)"


@query("percentile_grid", f"with g as (select pgs_id, norm_mean, norm_sd, unnest(generate_series(0, 98)) as i from fx_pgs_scores where norm_sd > 0) select pgs_id, cast(i as int) as p, round(norm_mean + {_sql_inverse('((i + 1) / 1e2)')} * norm_sd, 6) as score from g")
def percentile_grid(t: Inputs) -> DataFrame:
    rows = t.view("pgs_scores").filter("norm_sd > 0")
    return rows.select("pgs_id", F.posexplode(S.percentile_grid(F.col("norm_mean"), F.col("norm_sd"))).alias("p", "score")).withColumn("score", F.round("score", 6))


@query("theoretical_distribution", "select pgs_id, round(sqrt(weight_sum_squared * 5e-1), 6) as sd from (select pgs_id, sum(effect_weight * effect_weight) as weight_sum_squared from fx_pack group by pgs_id) q")
def theoretical_distribution(t: Inputs) -> DataFrame:
    return t.view("pack").groupBy("pgs_id").agg(F.sum(F.col("effect_weight") * F.col("effect_weight")).alias("w"), F.count("*").alias("n")).select("pgs_id", F.round(S.theoretical_sd(F.col("w"), F.col("n")), 6).alias("sd"))


@query("pc_residual", "select customer.c_custkey as k, round(c_acctbal * 1e-3 - (1e-1 + 2e-1 * (c_custkey % 7) - 3e-1 * (c_custkey % 5)), 6) as residual from customer")
def pc_residual(t: Inputs) -> DataFrame:
    k = F.col("c_custkey")
    return t.table("customer").select(k.alias("k"), F.round(S.residual(F.col("c_acctbal") * 1e-3, [k % 7, k % 5], [0.2, -0.3], 0.1), 6).alias("residual"))


PCS = "select c_nationkey as k, c_custkey as person, c_acctbal * 1e-3 as score, c_custkey % 7 * 1e0 as pc1, c_custkey % 5 * 1e0 + c_acctbal * 1e-4 as pc2 from customer"
FIT = f"""p as ({PCS}), m as (select k, count(*) as n, avg(score) as my, avg(pc1) as m1, avg(pc2) as m2, covar_pop(pc1, pc1) as v1, covar_pop(pc2, pc2) as v2, covar_pop(pc1, pc2) as v12, covar_pop(pc1, score) as c1, covar_pop(pc2, score) as c2 from p group by k),
  b as (select *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) as b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) as b2 from m)"""


@query("pc_fit", f"with {FIT} select k, n, round(my - b1 * m1 - b2 * m2, 6) as intercept, round(b1, 6) as b1, round(b2, 6) as b2 from b")
def pc_fit(t: Inputs) -> DataFrame:
    c = F.col("coefficients")
    return regression.fit(t.sql(PCS), ["k"], "score", ["pc1", "pc2"]).select("k", "n", *rounded("intercept"), F.round(c[0], 6).alias("b1"), F.round(c[1], 6).alias("b2"))


@query("pc_fit_residuals", f"with {FIT} select p.person, round(p.score - (my - b1 * m1 - b2 * m2) - b1 * p.pc1 - b2 * p.pc2, 5) as residual from p join b on b.k = p.k")
def pc_fit_residuals(t: Inputs) -> DataFrame:
    rows, xs = t.sql(PCS), ["pc1", "pc2"]
    return regression.residuals(rows, regression.fit(rows, ["k"], "score", xs), ["k"], "score", xs).select("person", F.round("residual", 5).alias("residual"))
