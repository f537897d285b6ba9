"""The catalog of traits, scores and their performance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pgsloom.functions import alleles as A
from pgsloom.functions import display as D
from pgsloom.functions import quality as Q
from pgsloom.functions import statistics as S

#: Words of integrative methods (the last two count for the filter only), methods that may leave weights unreported, excluded ids, bases of ontology URIs.
INTEGRATIVE = ("integrative", "meta-analysis", "meta analysis", "component", "composite", "combined", "ensemble", "multi-trait", "multitrait", "cross-trait", "crosstrait", "linear weight combination", "weighted combination")
UNREPORTED_OK = ("sparssnp", "snpnet", "penalized regression", "lasso", "ridge regression", "elastic net", "ldpred", "ldpred2", "prsice", "lassosum", "bigstatsr", "bigsnpr")
EXCLUDED_IDS = ("PGS002724",)
URIS = {"TRAIT": "https://monarchinitiative.org/disease/", "EFO": "https://www.ebi.ac.uk/efo/", "HP": "https://hpo.jax.org/app/browse/term/", "OBA": "http://purl.obolibrary.org/obo/", "PATO": "http://purl.obolibrary.org/obo/"}


def best_metric(performance: DataFrame, variant: str = "catalog") -> DataFrame:
    """The best metric of each score: by rank of its type, then value."""
    kind = S.metric_name(F.col("metric_type"))
    best = F.max_by(F.struct(kind.alias("kind"), F.col("metric_value").alias("value")), F.struct(S.metric_rank(kind, variant), F.col("metric_value"), kind))
    return performance.groupBy("pgs_id").agg(best.alias("b")).select("pgs_id", "b.kind", "b.value")


def performance_weights(scores: DataFrame, performance: DataFrame, variant: str = "catalog") -> DataFrame:
    rows = scores.select("pgs_id").join(best_metric(performance, variant), "pgs_id", "left")
    return rows.select("pgs_id", "kind", S.performance_weight(F.col("kind"), F.col("value"), variant).alias("weight"))


def integrative(*texts: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(t).contains(k), F.lit(False)) for t in texts for k in INTEGRATIVE])


def validate_score(scores: DataFrame, known: tuple[str, ...] = EXCLUDED_IDS) -> DataFrame:
    """The stricter check: (pgs_id, exclude, reason) by id (``known`` ones are excluded), method words and unreported weights."""
    method, weight = F.lower(F.coalesce("method_name", F.lit(""))), F.coalesce("weight_type", F.lit(""))
    any_of = lambda words: reduce(lambda a, b: a | b, [method.contains(w) for w in words])
    reason = (
        F.when(F.col("pgs_id").isin(*known), "known").when(any_of(INTEGRATIVE[:-2]), "integrative").when((weight == "NR") & any_of(UNREPORTED_OK), "modern method")
        .when((weight == "NR") & (F.trim(method) == ""), "no method").when(weight == "NR", "method specified").otherwise("standard")
    )
    return scores.select("pgs_id", reason.isin("known", "integrative", "no method").alias("exclude"), reason.alias("reason"))


def trait_uri(trait_id: Column) -> Column:
    """The canonical URI of a trait id."""
    out = F.lit(None).cast("string")
    for prefix, base in reversed(URIS.items()):
        out = F.when(trait_id.startswith("TRAIT:" if prefix == "TRAIT" else f"{prefix}_"), F.concat(F.lit(base), trait_id)).otherwise(out)
    return out


def pgs_filter(scores: DataFrame) -> DataFrame:
    """Scores of fewer than eight variants are excluded, integrative ones (by name or, where there are any, parameters of the method) are flagged."""
    out = F.coalesce((F.col("variants_number") > 0) & (F.col("variants_number") < Q.LEAST_VARIANTS), F.lit(False))
    flag = integrative(*[F.col(c) for c in ("method_name", "method_params") if c in scores.columns])
    reason = F.when(out, F.concat(F.lit("Too few variants: "), F.col("variants_number").cast("string"), F.lit(" (minimum 8 required)"))).when(flag, "Integrative PGS (flagged)").otherwise("Standard PGS score")
    return scores.withColumn("exclude", out).withColumn("integrative", flag & ~out).withColumn("reason", reason)


def frequency_sample(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Missing weights and frequencies over the first rows of each score; above half missing, frequencies stand in."""
    first = Window.partitionBy("pgs_id").orderBy("line")
    kept = rows.filter("eaf is not null").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most)
    out = kept.groupBy("pgs_id").agg(F.count("*").alias("sampled"), F.count_if(F.col("weight").isNull()).alias("missing"), F.avg("eaf").alias("mean_eaf"), F.min("eaf").alias("min_eaf"), F.max("eaf").alias("max_eaf"))
    return out.withColumn("use_eaf", F.col("missing") / F.col("sampled") > 0.5)


def weight_sample(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Spread of the first weights of each score; too large or constant ones are not valid."""
    first = Window.partitionBy("pgs_id").orderBy("line")
    kept = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most)
    out = kept.groupBy("pgs_id").agg(F.min("weight").alias("low"), F.max("weight").alias("high"), F.avg("weight").alias("mean"), F.var_pop("weight").alias("variance"))
    return out.withColumn("valid", (F.greatest(F.abs("low"), F.abs("high")) <= 100) & (F.col("variance") >= 0.001))


def enhanced_filter(filtered: DataFrame, weights: DataFrame, samples: DataFrame) -> DataFrame:
    """(pgs_id, include, strategy): unreported weights are recovered only if frequencies can be used and the score is validated."""
    rows = filtered.join(weights.select("pgs_id", "weight"), "pgs_id", "left").join(samples.select("pgs_id", "use_eaf"), "pgs_id", "left")
    unreported, usable = F.col("weight_type") == "NR", F.coalesce("use_eaf", F.lit(False))
    strategy = F.when(F.col("exclude") & ~unreported, "original_filter").when(unreported & usable, "nr_recovery").when(~F.col("exclude"), "standard").otherwise("excluded")
    include = F.when(strategy == "nr_recovery", F.col("weight") >= 0.3).otherwise(strategy == "standard")
    return rows.select("pgs_id", strategy.alias("strategy"), include.alias("include"))


def trait_config(trait_pgs: DataFrame, scores: DataFrame) -> DataFrame:
    """The scores of each trait as a sorted list, with how many are normalized."""
    rows = trait_pgs.join(scores, "pgs_id", "left")
    return rows.groupBy("trait_id").agg(F.sort_array(F.collect_list("pgs_id")).alias("pgs_ids"), F.count("norm_sd").alias("normalized"))


def trait_counts(traits: DataFrame, trait_pgs: DataFrame) -> DataFrame:
    return traits.join(trait_pgs, "trait_id", "left").groupBy("trait_id", "name").agg(F.count("pgs_id").alias("scores"))


def completed_traits(trait_pgs: DataFrame, done: DataFrame) -> DataFrame:
    """Traits all of whose scores are done."""
    rows = trait_pgs.join(done.select("pgs_id", F.lit(1).alias("ok")), "pgs_id", "left")
    return rows.groupBy("trait_id").agg(F.countDistinct("pgs_id").alias("scores"), F.countDistinct(F.when(F.col("ok") == 1, F.col("pgs_id"))).alias("done")).filter("scores = done")


def orphans(traits: DataFrame, trait_pgs: DataFrame) -> DataFrame:
    """Traits without any score."""
    return traits.join(trait_pgs.filter("trait_id is not null"), "trait_id", "left_anti")


def trait_totals(trait_pgs: DataFrame, totals: DataFrame) -> DataFrame:
    rows = trait_pgs.join(totals, "pgs_id")
    return rows.groupBy("trait_id").agg(F.sum("total_variants").alias("variants"), F.sum(F.floor(F.col("total_variants") * 0.7)).alias("expected_unique"))


def catalog_stats(traits: DataFrame) -> DataFrame:
    """Traits by the prefix of their id."""
    return traits.groupBy(F.get(F.split("trait_id", "[_:]"), F.lit(0)).alias("ontology")).agg(F.count("*").alias("traits"), F.countDistinct("category").alias("categories"))


def catalog_totals(traits: DataFrame, included: DataFrame, variants: DataFrame, excluded: DataFrame) -> DataFrame:
    """(kind, name, n): totals of the catalog, and its excluded scores by method (``Unknown`` where none is given)."""
    total = lambda df, name, n: df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    method = F.coalesce(F.nullif("method_name", F.lit("")), F.lit("Unknown"))
    by_method = excluded.groupBy(method.alias("name")).agg(F.count("*").alias("n")).select(F.lit("method").alias("kind"), "name", "n")
    totals = [total(traits, "traits", F.count("*")), total(included, "scores", F.count("*")), total(variants, "variants", F.sum("variants")), total(excluded, "excluded", F.count("*"))]
    return reduce(DataFrame.unionByName, [*totals, by_method])


def quality_analysis(filtered: DataFrame, weights: DataFrame) -> DataFrame:
    rows = filtered.join(weights.select("pgs_id", "kind", "weight"), "pgs_id", "left")
    reason = F.when(F.col("exclude"), "excluded").when(F.col("integrative"), "integrative").otherwise("standard")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("scores"), F.count("kind").alias("validated"), F.avg("weight").alias("mean_weight"))


def trait_quality(trait_pgs: DataFrame, decisions: DataFrame, weights: DataFrame) -> DataFrame:
    """For each trait how many of its scores are taken, left out or recovered, and how well those taken are validated.

    A score without a weight counts 0.5 in the mean; the mean is 0 where none is taken.
    """
    rows = trait_pgs.select("trait_id", "pgs_id").distinct().join(decisions, "pgs_id", "left").join(weights.select("pgs_id", "kind", "weight"), "pgs_id", "left")
    taken = F.coalesce("include", F.lit(False))
    mean = F.avg(F.when(taken, F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(0.5))))
    return rows.groupBy("trait_id").agg(
        F.count("*").alias("total"), F.count_if(taken).alias("included"), F.count_if(~taken).alias("excluded"), F.count_if(taken & (F.col("strategy") == "nr_recovery")).alias("recovered"),
        F.count_if(taken & F.col("kind").isNotNull()).alias("validated"), F.count_if(taken & F.col("kind").isNull()).alias("unvalidated"), F.coalesce(mean, F.lit(0.0)).alias("mean_weight"),
    )


def allowlist(traits: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Traits of a tier; without a list all of them."""
    return traits if allowed is None else traits.join(allowed, "trait_id", "left_semi")


def find_traits(traits: DataFrame, wanted: list[str]) -> DataFrame:
    return traits.filter(F.col("trait_id").isin(wanted) | F.col("name").isin(wanted))


def suggest_references(traits: DataFrame, references: DataFrame) -> DataFrame:
    """The first reference whose keyword is in a trait's name; references are a short fixed table."""
    rows = traits.join(references, F.contains(F.lower("name"), "keyword"))
    return rows.groupBy("trait_id").agg(F.min_by("reference", "priority").alias("reference"))


def overrides(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Values of ``changes`` where they are not null, else those of ``base``; no new rows."""
    rows = base.alias("b").join(changes.alias("c"), key, "left")
    return rows.select(key, *[F.coalesce(F.col(f"c.{c}"), F.col(f"b.{c}")).alias(c) if c in changes.columns else F.col(f"b.{c}") for c in base.columns if c != key])


def changed(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose metadata hash differs, or that are new."""
    rows = other.select(key, D.metadata_hash(*columns).alias("hash")).join(base.select(key, D.metadata_hash(*columns).alias("old")), key, "left")
    return rows.filter("old is null or hash <> old").select(key, "hash")


def manifest(traits: DataFrame, config: DataFrame, r2: DataFrame, trait_pgs: DataFrame) -> DataFrame:
    """(trait_id, document): one JSON document a trait with its scores and their R2."""
    entries = trait_pgs.join(r2, "pgs_id", "left").groupBy("trait_id").agg(F.sort_array(F.collect_list(F.struct("pgs_id", F.coalesce("r2", F.lit(Q.DEFAULT_R2)).alias("r2")))).alias("scores"))
    rows = traits.join(entries, "trait_id", "left").join(config.select("trait_id", "normalized"), "trait_id", "left")
    return rows.select("trait_id", F.to_json(F.struct("name", "category", "trait_type", "normalized", "scores")).alias("document"))


def manifest_violations(traits: DataFrame) -> DataFrame:
    """(trait_id, violation) for rows that a manifest may not hold."""
    rules = F.array_compact(F.array(F.when(D.trait_id_type(F.col("trait_id")).isNull(), "trait_id"), F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name"), F.when(~F.col("trait_type").isin("quantitative", "disease_risk"), "trait_type"), F.when((F.col("trait_type") == "quantitative") & F.col("phenotype_sd").isNull(), "phenotype_sd")))
    return traits.select("trait_id", F.explode(rules).alias("violation"))


#: Categories of measured traits, and words of gene descriptions with their category, in order.
MEASUREMENTS = ("Body measurement", "Cardiovascular measurement", "Lipid or lipoprotein measurement", "Hematological measurement", "Inflammatory measurement", "Other measurement")
GENE_RULES = (
    (("cancer", "tumor", "oncogene"), "Cancer Risk"),
    (("interleukin", "immune", "toll", "interferon"), "Immunity & Inflammation"),
    (("heart", "cardio", "angiotensin", "cholesterol"), "Heart & Cardiovascular"),
    (("dopamine", "serotonin", "neuro", "brain"), "Brain & Mood"),
    (("insulin", "glucose", "adipon", "metabol"), "Metabolism & Weight"),
    (("cytochrome", "transferase", "oxidase"), "Detox & Drug Metabolism"),
    (("hormone", "estrogen", "androgen", "receptor"), "Hormones & Fertility"),
    (("telomer", "sirtuin", "aging"), "Longevity"),
)


def trait_kind(categories: Column) -> Column:
    """``quantitative`` if a category is a measurement, else ``disease_risk``."""
    return F.when(F.arrays_overlap(D.categories(categories), F.array(*[F.lit(m) for m in MEASUREMENTS])), "quantitative").otherwise("disease_risk")


def gene_category(description: Column) -> Column:
    """The category of the first rule one of whose words is in the description."""
    low, out = F.lower(description), F.lit("Other")
    for words, label in reversed(GENE_RULES):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), label).otherwise(out)
    return out


def gene_catalog(genes: DataFrame, publications: DataFrame, curated: DataFrame | None = None, tax_id: int = 9606, least: int = 50, most: int = 500) -> DataFrame:
    """The genes with the most publications; curated descriptions win. In the order of the genome where chr and start are given, else by publications."""
    counts = publications.filter(F.col("tax_id") == tax_id).groupBy("gene_id").agg(F.countDistinct("pubmed_id").alias("publications")).filter(F.col("publications") >= least)
    rows = genes.filter(F.col("tax_id") == tax_id).join(counts, "gene_id")
    if curated is not None:
        rows = rows.join(curated.select("gene_id", F.col("description").alias("better")), "gene_id", "left").withColumn("description", F.coalesce("better", "description")).drop("better")
    top = rows.withColumn("category", gene_category(F.col("description"))).orderBy(F.col("publications").desc(), "gene_id").limit(most)
    return top.orderBy(A.chromosome_code(F.col("chr")).asc_nulls_last(), "start", "gene_id") if {"chr", "start"} <= set(genes.columns) else top


def detail(scores: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Scores with their evaluations as a nested list, and the sum of their samples."""
    nested = evaluations.groupBy("pgs_id").agg(F.sort_array(F.collect_list(F.struct("metric_type", "metric_value", "samples"))).alias("evaluations"))
    total = F.aggregate("evaluations", F.lit(0).cast("long"), lambda a, e: a + e["samples"])
    return scores.join(nested, "pgs_id", "left").withColumn("samples", F.coalesce(total, F.lit(0).cast("long")))


def trait_scores(traits: DataFrame) -> DataFrame:
    """(trait_id, pgs_id), each once: the scores of a trait and of the traits below it, from two lists that may be null."""
    both = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("associated_pgs_ids", "child_associated_pgs_ids")])
    return traits.select("trait_id", F.explode(F.array_distinct(both)).alias("pgs_id"))
