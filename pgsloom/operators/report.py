"""Reports, audits and validation over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pgsloom.sources.shared import cut

LAST_CATEGORY = "Other Conditions"


def coverage_percent(digits: int = 1) -> Column:
    return F.round(F.try_divide(F.col("matched_variants") * 100.0, F.nullif("total_variants", F.lit(0))), digits)


def score_summary(results: DataFrame) -> DataFrame:
    rows = results.filter("z_score is not null")
    low = F.try_divide(F.col("matched_variants"), F.nullif("total_variants", F.lit(0))) < 0.05
    return rows.agg(F.countDistinct("individual_id").alias("individuals"), F.countDistinct("trait_id").alias("traits"), F.count("*").alias("total"), F.count_if(F.abs("z_score") > 10).alias("extreme"), F.count_if(F.abs("z_score") > 5).alias("high"), F.count_if(low).alias("low_coverage"))


def extremes(results: DataFrame, above: float = 10.0, most: int = 50) -> DataFrame:
    """The farthest scores first, ties by id. Sums of the same numbers in another order are ties, so z counts to nine digits."""
    rows = results.filter(F.abs("z_score") > above).withColumn("coverage_pct", coverage_percent())
    return rows.orderBy(F.round(F.abs("z_score"), 9).desc(), "individual_id", "trait_id", "pgs_id").limit(most)


def small_sds(scores: DataFrame, below: float = 0.1, most: int = 20) -> DataFrame:
    return scores.filter((F.col("norm_sd") > 0) & (F.col("norm_sd") < below)).orderBy("norm_sd", "pgs_id").limit(most)


def low_coverage(results: DataFrame, below: float = 0.05, most: int = 20) -> DataFrame:
    share = F.try_divide(F.col("matched_variants"), F.nullif("total_variants", F.lit(0)))
    rows = results.filter(share < below).groupBy("pgs_id").agg(F.count("*").alias("affected"), F.avg(share * 100.0).alias("mean_coverage"), F.max(F.abs("z_score")).alias("max_z"))
    return rows.orderBy(F.col("max_z").desc_nulls_last(), "pgs_id").limit(most)


def audit_flags(results: DataFrame) -> DataFrame:
    """(individual_id, trait_id, pgs_id, flags): what is suspicious about the best score of each trait."""
    by = Window.partitionBy("individual_id", "trait_id")
    order = by.orderBy(F.col("quality_score").desc(), "pgs_id")
    rows = results.withColumn("rank", F.row_number().over(order)).withColumn("next_quality", F.lead("quality_score").over(order)).withColumn("next_r2", F.lead("performance").over(order)).withColumn("top_r2", F.max("performance").over(by)).filter("rank = 1")
    r2 = F.col("performance")
    rules = {
        "default_r2": (r2 <= 0.05) & (F.col("top_r2") > 0.05),
        "runner_up_r2": (F.col("next_r2") > r2 * 2) & (F.col("next_r2") > 0.05),
        "low_coverage": coverage_percent() < 5,
        "all_imputed": (F.col("genotyped_variants") == 0) & (F.col("matched_variants") > 0),
        "extreme_z": F.abs("z_score") > 5,
        "tight_race": F.col("quality_score") - F.col("next_quality") < 2,
        "insufficient": F.col("insufficient_data"),
    }
    return rows.select("individual_id", "trait_id", "pgs_id", F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()])).alias("flags"))


def problematic(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores beyond five sigma: how often, how far, and which issue rules apply."""
    rows = results.drop("norm_mean", "norm_sd").join(scores, "pgs_id").filter((F.coalesce("norm_mean", F.lit(0.0)) != 0) & (F.coalesce("norm_sd", F.lit(0.0)) != 0))
    rows = rows.withColumn("far", F.abs((F.col("raw_score") - F.col("norm_mean")) / F.col("norm_sd"))).filter("far > 5")
    method = F.lower(F.col("method_name") if "method_name" in rows.columns else F.lit(""))
    odd = method.contains("inverse") | method.contains("variant weights")
    issues = F.array_compact(F.array(F.when(F.abs(F.col("norm_mean") / F.col("norm_sd")) > 15, "scale"), F.when(F.col("weight_type") == "Inverse-variance weighting", "weighting"), F.when(F.abs("norm_mean") > 100, "mean"), F.when(odd, "method")))
    return rows.withColumn("issues", issues).groupBy("trait_id", "pgs_id").agg(F.count("*").alias("occurrences"), F.max("far").alias("max_far"), F.first("issues").alias("issues"))


def validation(results: DataFrame, traits: DataFrame) -> DataFrame:
    """(name, pass, detail) of seven checks over stored results.

    Results are summed up once; trait results once by trait, which gives the spread, the traits without a best score and
    their number, and once by person.
    """
    rate = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    total = results.agg(
        F.count_if(F.abs("z_score") > 10).alias("extreme"), F.count("z_score").alias("scored"), F.count_if(F.col("total_variants") == 0).alias("empty"),
        F.count_if((F.col("matched_variants") > F.col("total_variants")) & (F.col("total_variants") > 0)).alias("over"), F.count_if("insufficient_data").alias("poor"), F.count("*").alias("rows"),
    )
    by_trait = traits.groupBy("trait_id").agg((F.max("overall_z") - F.min("overall_z")).alias("spread"), F.count_if(F.col("best_pgs_id").isNull()).alias("without"))
    whole = by_trait.agg(F.count("trait_id").alias("all"), F.count_if(F.col("spread") > 10).alias("wide"), F.coalesce(F.sum("without"), F.lit(0)).alias("without"))
    check = lambda name, passed, detail: F.struct(F.lit(name).alias("name"), passed.alias("pass"), detail.cast("string").alias("detail"))
    checks = [
        check("extreme z below 5%", rate(F.col("extreme"), F.col("scored")) < 0.05, F.concat_ws("/", "extreme", "scored")),
        check("every trait has a best score", F.col("without") == 0, F.col("without")),
        check("z spread below 10", F.col("wide") == 0, F.col("wide")),
        check("no score without variants", F.col("empty") == 0, F.col("empty")),
        check("matched not above expected", F.col("over") == 0, F.col("over")),
        check("insufficient below 20%", rate(F.col("poor"), F.col("rows")) < 0.2, F.concat_ws("/", "poor", "rows")),
    ]
    people = traits.groupBy("individual_id").agg(F.countDistinct("trait_id").alias("n")).crossJoin(whole.select("all"))
    complete = people.select(F.concat("individual_id", F.lit(" has all traits")).alias("name"), (F.col("n") == F.col("all")).alias("pass"), F.concat_ws("/", "n", "all").alias("detail"))
    return complete.unionByName(total.crossJoin(whole).select(F.inline(F.array(*checks))))


def results_summary(trait_results: DataFrame, traits: DataFrame, results: DataFrame) -> DataFrame:
    """Trait results with their names and what the best score is made of."""
    best = results.select("individual_id", "trait_id", F.col("pgs_id").alias("best_pgs_id"), F.col("genotyped_variants").alias("best_genotyped"), F.col("imputed_variants").alias("best_imputed"), F.col("matched_variants").alias("best_matched"))
    return trait_results.join(traits.select("trait_id", "name", "category"), "trait_id").join(best, ["individual_id", "trait_id", "best_pgs_id"], "left")


def category_report(trait_results: DataFrame, traits: DataFrame) -> DataFrame:
    rows = trait_results.join(traits.select("trait_id", "category"), "trait_id")
    p = F.col("overall_percentile")
    return rows.groupBy("category").agg(F.countDistinct("trait_id").alias("traits"), F.avg(p).alias("mean_percentile"), F.count_if(p > 75).alias("elevated"), F.count_if(p < 25).alias("low"))


def spread(trait_results: DataFrame) -> DataFrame:
    return trait_results.groupBy("trait_id").agg((F.max("overall_z") - F.min("overall_z")).alias("spread"), F.count("*").alias("people"))


def dashboard(traits: DataFrame, results: DataFrame, search: str = "", category: str = "", state: str = "") -> DataFrame:
    """Traits that fit the search, with a person's results; calculated ones first, farthest from the middle first.

    The search looks into name, description and every category; a trait has one (``category``) or several (``categories``).
    """
    rows = traits.join(results.select("trait_id", "overall_percentile"), "trait_id", "left")
    every = F.coalesce("categories", F.array()) if "categories" in traits.columns else F.array_compact(F.array("category"))
    if search:
        texts = [c for c in ("name", "description") if c in traits.columns]
        found = F.exists(every, lambda c: F.lower(c).contains(search.lower()))
        for c in texts:
            found = found | F.coalesce(F.lower(c).contains(search.lower()), F.lit(False))
        rows = rows.filter(found)
    if category:
        rows = rows.filter(F.array_contains(every, category))
    if state:
        rows = rows.filter(F.col("overall_percentile").isNotNull() if state == "calculated" else F.col("overall_percentile").isNull())
    order = [F.col("overall_percentile").isNull(), F.abs(F.col("overall_percentile") - 50).desc_nulls_last(), F.col("name")]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def category_list(traits: DataFrame) -> DataFrame:
    """Distinct categories by name, the catch-all last."""
    rows = traits.select(F.coalesce("category", F.lit(LAST_CATEGORY)).alias("category")).distinct()
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("category") == LAST_CATEGORY, "category")))


def z_by_trait(results: DataFrame) -> DataFrame:
    """Median and mean z of each person and trait, nulls and NaN left out."""
    return results.filter("z_score is not null and not isnan(z_score)").groupBy("individual_id", "trait_id").agg(F.median("z_score").alias("median_z"), F.avg("z_score").alias("mean_z"))


def visible_scores(results: DataFrame, least: float = 0.005) -> DataFrame:
    """Scores that are shown, each with its place in its trait: highest quality first, none counts as 0."""
    order = Window.partitionBy("individual_id", "trait_id").orderBy(F.coalesce("quality_score", F.lit(0.0)).desc(), "pgs_id")
    return results.filter(F.abs("raw_score") >= least).withColumn("place", F.row_number().over(order))


def result_order(results: DataFrame, by: str = "best") -> DataFrame:
    """Results with their place in their trait: ``best`` (sufficient ones first, then performance, then effect), ``performance`` or ``effect``."""
    effect, performance = F.abs("raw_score").desc(), F.col("performance").desc_nulls_last()
    orders = {"best": [F.col("insufficient_data"), performance, effect], "performance": [performance], "effect": [effect]}
    return results.withColumn("place", F.row_number().over(Window.partitionBy("individual_id", "trait_id").orderBy(*orders[by], "pgs_id")))


def progress(trait_results: DataFrame, total: int) -> DataFrame:
    return trait_results.groupBy("individual_id").agg(F.count("*").alias("done")).withColumn("percent", F.round(F.col("done") * 100.0 / total, 2))


def run_estimate(runs: DataFrame, jobs: DataFrame, key: str = "trait_id", recent: int = 10, rates: int = 20, floor_s: float = 15.0) -> DataFrame:
    """Estimated seconds of jobs (key, variants): the rate of the last ``rates`` runs, blended 60/40 with the key's own.

    Later runs weigh more, linearly; the part from the rate is at least ``floor_s``.
    """

    def weighted(rows: DataFrame, by: list[str], most: int, value: Column) -> DataFrame:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("ended").desc(), "run_id"))).filter(F.col("n") <= most)
        rows = rows.withColumn("w", F.count("*").over(Window.partitionBy(*by)) + 1 - F.col("n"))
        return rows.groupBy(*by).agg((F.sum(value * F.col("w")) / F.sum("w")).alias("v"))

    # only the last runs of all are needed for the rate: a top-k, not a window over everything
    last = runs.orderBy(F.col("ended").desc(), "run_id").limit(rates).withColumn("all", F.lit(1))
    rate = weighted(last, ["all"], rates, F.col("variants") / F.col("seconds")).select(F.col("v").alias("rate"))
    own = weighted(runs, [key], recent, F.col("seconds")).withColumnRenamed("v", "own")
    base = F.greatest(F.lit(floor_s), F.col("variants") / F.col("rate"))
    return jobs.crossJoin(F.broadcast(rate)).join(own, key, "left").select(key, F.when(F.col("own").isNotNull(), base * 0.6 + F.col("own") * 0.4).otherwise(base).alias("estimate"))


def places(rows: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """Number rows from 1 in an order that has no ties, without one task that sorts them all.

    Ranges of the order are sorted where they are dealt to, written once, and numbered from the counts of the ranges before.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__range", F.spark_partition_id())
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # a row a range
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(before, "__range").withColumn(out, (F.col("__before") + inside).cast("int")).drop("__range", "__before")


def queue_order(queue: DataFrame) -> DataFrame:
    """One entry a job (the highest priority), running ones first, then by priority and age."""
    jobs = queue.groupBy("individual_id", "trait_id").agg(F.max("priority").alias("priority"), F.min("added").alias("added"), F.max("running").alias("running"))
    return places(jobs, [F.col("running").desc(), F.col("priority").desc(), F.col("added"), F.col("individual_id"), F.col("trait_id")])


def phases(samples: DataFrame) -> DataFrame:
    """Profile by phase in the order of first appearance."""
    rows = samples.groupBy("phase").agg(F.count("*").alias("samples"), F.avg("cores").alias("mean_cores"), F.max("rss").alias("peak_rss"), F.min("ts").alias("since"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("since", "phase")))
