"""Population norms of scores: theoretical, by ancestry, empirical, tiered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pgsloom.functions import alleles as A
from pgsloom.operators import blocks, selection
from pgsloom.operators.match import KEYS
from pgsloom.sources.shared import cut


def _two_sums(weight: Column, af: Column, expected: Column) -> tuple[Column, Column]:
    """Aggregates: mean and standard deviation of a score under Hardy-Weinberg equilibrium."""
    there = af.isNotNull()
    mean = F.sum(F.when(there, weight * expected).otherwise(0.0))
    sd = F.sqrt(F.sum(F.when(there, weight * weight * 2.0 * af * (1.0 - af)).otherwise(0.0)))
    return mean, sd


def expected_dosage(effect: Column, af_variant_id: Column, af: Column) -> Column:
    """Expected copies of the effect allele: the frequency is that of the frequency source's own ALT."""
    return F.when(effect == A.part(af_variant_id, 4), 2.0 * af).otherwise(2.0 * (1.0 - af))


def norm_from_file(pack: DataFrame, af_column: str | None = None) -> DataFrame:
    """Mean and sd from frequencies in the scoring file; a missing frequency is 0.5, without the column both are null."""
    if not af_column:
        return pack.groupBy("pgs_id").agg(F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("sd"))
    af = F.coalesce(F.col(af_column), F.lit(0.5))
    w = F.col("effect_weight")
    return pack.groupBy("pgs_id").agg(F.sum(w * 2.0 * af).alias("mean"), F.sqrt(F.sum(w * w * 2.0 * af * (1.0 - af))).alias("sd"))


def join_frequencies(pack: DataFrame, af: DataFrame, few: int = 0) -> DataFrame:
    """Pack rows with the frequency of their variant, if there is one.

    One join by integer keys. Where a pack has at most ``few`` rows, they are counted first and the frequencies are
    reduced to their positions before the join, so that a genome-wide table need not be dealt out.
    """
    if "allele_key" not in pack.columns:
        pack = pack.withColumn("allele_key", A.key_of_id(F.col("variant_id")))
    if few and pack.limit(few + 1).count() <= few:
        af = af.join(F.broadcast(pack.select(*KEYS).distinct()), KEYS, "left_semi")
    return pack.join(af.withColumnRenamed("variant_id", "af_variant_id"), KEYS, "left")


def norm_oriented(pack: DataFrame, af: DataFrame) -> DataFrame:
    """Norm whose expectation counts the effect allele, with totals and coverage in per cent."""
    rows = join_frequencies(pack, af)
    mean, sd = _two_sums(F.col("effect_weight"), F.col("af"), expected_dosage(F.col("effect_allele"), F.col("af_variant_id"), F.col("af")))
    out = rows.groupBy("pgs_id").agg(F.count("*").alias("total"), F.count("af").alias("found"), mean.alias("mean"), sd.alias("sd"))
    return out.withColumn("coverage", F.round(F.col("found") * 100.0 / F.col("total"), 2))


def norm_plain(pack: DataFrame, af: DataFrame) -> DataFrame:
    """Norm joined on chromosome, position, REF and ALT as they are written; zeros become null."""
    of = lambda c, n: A.part(F.col(c), n)
    left = pack.select("pgs_id", "effect_weight", F.concat(F.lit("chr"), of("variant_id", 1)).alias("c"), of("variant_id", 2).try_cast("int").alias("p"), of("variant_id", 3).alias("r"), of("variant_id", 4).alias("a")).filter("p is not null")
    right = af.select("af", F.concat(F.lit("chr"), of("variant_id", 1)).alias("c"), of("variant_id", 2).try_cast("int").alias("p"), of("variant_id", 3).alias("r"), of("variant_id", 4).alias("a"))
    mean, sd = _two_sums(F.col("effect_weight"), F.col("af"), 2.0 * F.col("af"))
    out = left.join(right, ["c", "p", "r", "a"], "left").groupBy("pgs_id").agg(F.count("*").alias("total"), F.count("af").alias("found"), mean.alias("mean"), sd.alias("sd"))
    return out.withColumn("mean", F.nullif("mean", F.lit(0.0))).withColumn("sd", F.nullif("sd", F.lit(0.0)))


def theoretical(pack: DataFrame, af: DataFrame) -> DataFrame:
    """(pgs_id, mean, sd, variance) of scores by frequencies as they stand, a missing one counting as 0, and variants independent."""
    f, w = F.coalesce("af", F.lit(0.0)), F.col("effect_weight")
    out = pack.select(*KEYS, "pgs_id", "effect_weight").join(af.select(*KEYS, "af"), KEYS, "left").groupBy("pgs_id").agg(F.sum(w * 2.0 * f).alias("mean"), F.sum(w * w * 2.0 * f * (1.0 - f)).alias("variance"))
    return out.withColumn("sd", F.sqrt("variance"))


def best_coverage(norms: DataFrame, pack: str = "pack") -> DataFrame:
    """Of the norms of one score in several packs the one with the highest coverage (then the first pack)."""
    rank = F.row_number().over(Window.partitionBy("pgs_id").orderBy(F.col("coverage").desc(), pack))
    return norms.withColumn("rank", rank).filter("rank = 1").drop("rank")


def ancestry_long(pack: DataFrame, af: DataFrame, populations: list[str], least: float = 0.05) -> DataFrame:
    """(pgs_id, population, m, s, found, total) for populations that cover enough variants."""
    rows = join_frequencies(pack, af)
    w, aggregates = F.col("effect_weight"), [F.count("*").alias("total")]
    for p in populations:
        f = F.col(f"af_{p}")
        exp = F.sum(F.when(f.isNotNull(), w * expected_dosage(F.col("effect_allele"), F.col("af_variant_id"), f)))
        sd = F.sqrt(F.nullif(F.sum(F.when(f.isNotNull(), w * w * 2.0 * f * (1.0 - f))), F.lit(0.0)))
        aggregates.append(F.struct(F.lit(p).alias("population"), exp.alias("m"), sd.alias("s"), F.count(f).alias("found")).alias(p))
    out = rows.groupBy("pgs_id").agg(*aggregates).select("pgs_id", "total", F.explode(F.array(*populations)).alias("n")).select("pgs_id", "n.*", "total")
    return out.filter((F.col("found") > 0) & F.col("m").isNotNull() & F.col("s").isNotNull() & (F.col("found") >= least * F.col("total"))).withColumn("m", F.round("m", 8)).withColumn("s", F.round("s", 8))


def ancestry_norms(pack: DataFrame, af: DataFrame, populations: list[str], least: float = 0.05) -> DataFrame:
    """(pgs_id, ancestry): a map from population to struct(m, s)."""
    entry = F.struct("population", F.struct("m", "s"))
    return ancestry_long(pack, af, populations, least).groupBy("pgs_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("ancestry"))


def population_frequency(matrix: DataFrame, samples: DataFrame) -> DataFrame:
    """Frequency of ALT for each variant and population, missing genotypes left out."""
    rows = matrix.filter("dosage is not null").join(samples, "sample")
    return rows.groupBy(*KEYS, "population").agg((F.sum("dosage") / (F.count("dosage") * 2.0)).alias("af"))


def population_frequency_wide(matrix: DataFrame, samples: DataFrame, populations: list[str]) -> DataFrame:
    return population_frequency(matrix, samples).groupBy(*KEYS).pivot("population", populations).agg(F.first("af"))


def oriented(effect: Column, alt: Column, dosage: Column) -> Column:
    """Copies of the effect allele; a missing genotype counts as 0 on either side."""
    return F.when(dosage.isNull(), 0).when(effect == alt, dosage).otherwise(2 - dosage)


def empirical_scores(pack: DataFrame, matrix: DataFrame) -> DataFrame:
    """(pgs_id, sample, score) over a reference panel in long form (``operators/blocks.py``).

    A sample whose genotypes are all missing has a score of 0 like one without copies.
    """
    samples = blocks.sample_names(matrix)
    if 0 < len(samples) <= blocks.FEW:
        return blocks.long_form(blocks.joined_scores(pack, blocks.wide_panel(matrix, samples), len(samples)), samples)
    return blocks.long_form(blocks.block_scores(pack, blocks.panel_of(matrix, samples), len(samples)), samples)


def empirical_norms(scores: DataFrame) -> DataFrame:
    """(pgs_id, m, s, n): mean and population standard deviation; scores that do not vary have none."""
    out = scores.groupBy("pgs_id").agg(F.round(F.avg("score"), 8).alias("m"), F.stddev_pop("score").alias("s"), F.count("*").alias("n"))
    return out.filter("s > 0").withColumn("s", F.round("s", 8))


def raw_tier(pack: DataFrame, matrix: DataFrame, positions: DataFrame) -> DataFrame:
    """Standard deviation of centred scores over the variants that an array measures."""
    return empirical_norms(empirical_scores(pack.join(positions.select("chr", "pos").distinct(), ["chr", "pos"], "left_semi"), matrix)).select("pgs_id", "s")


def imputed_tier(pack: DataFrame, matrix: DataFrame, share: float = 0.6, least: int = 5, budget: int = 500_000, seed: int = 0, whole: int = 500_000) -> DataFrame:
    """Mean standard deviation over random subsets of the variants of each score.

    A subset is the share of variants with the least MD5 of "seed:score:round:variant", so it is the same on every run and
    in every engine. The number of rounds is between 3 and 10, fewer for larger scores.

    With a panel of few samples a variant of a score is dealt out once, by its score, with its samples' copies; its hashes of
    all rounds are made where it arrives. Scores of more than ``whole`` variants, and all of a larger panel, are cut by counts
    of ranges instead, with no score held whole.
    """
    samples = blocks.sample_names(matrix)
    if not 0 < len(samples) <= blocks.FEW:
        return _tier_by_ranges(pack, matrix, samples, share, least, budget, seed)
    out = _tier_by_score(pack, matrix, samples, share, least, budget, seed, whole)
    large = pack.groupBy("pgs_id").agg(F.count("*").alias("n")).filter(F.col("n") > whole).select("pgs_id")
    if large.isEmpty():
        return out
    # the counts are of the pack: of those the panel may have fewer
    rest = _tier_by_ranges(pack.join(large, "pgs_id", "left_semi"), matrix, samples, share, least, budget, seed, whole)
    return out.unionByName(rest)


def _rounds(n: Column, share: float, budget: int) -> tuple[Column, Column]:
    """The rounds of a score of n variants, and the variants in each."""
    return F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.lit(budget) / n))).alias("rounds"), F.greatest(F.lit(1), F.round(n * share).cast("long")).alias("k")


def _tier_by_score(pack: DataFrame, matrix: DataFrame, samples: list, share: float, least: int, budget: int, seed: int, whole: int) -> DataFrame:
    w = F.coalesce(F.col("effect_weight"), F.lit(0.0)).cast("double").alias("w")
    rows = pack.select(*KEYS, "pgs_id", "effect_allele", w).join(blocks.wide_panel(matrix, samples), KEYS)
    rows = rows.select("pgs_id", *KEYS, "w", F.xxhash64("effect_allele").alias("tie"), blocks.copies(F.col("effect_allele"), F.col("alts"), len(samples)).alias("copies"))
    n = F.col("n")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("pgs_id"))).filter((n >= least) & (n <= whole))
    rows = rows.select("*", *_rounds(n, share, budget)).filter("k < n")
    hashes = F.transform(F.sequence(F.lit(1).cast("long"), F.col("rounds")), lambda r: A.md5_number(F.concat_ws(":", F.lit(seed), "pgs_id", r, *KEYS)))
    rows = rows.select("pgs_id", *KEYS, "w", "tie", "copies", "k", "rounds", hashes.alias("hashes"))

    def spread(of: pa.Table) -> pa.Table:
        of = of.combine_chunks()
        size, k, rounds = of.num_rows, of.column("k")[0].as_py(), of.column("rounds")[0].as_py()
        number = lambda c: of.column(c).to_numpy()
        lists = lambda c: of.column(c).combine_chunks().flatten().to_numpy().reshape(size, -1)
        order = np.lexsort((number("tie"), number("w"), number("allele_key"), number("pos"), number("chr")))
        first = np.argsort(lists("hashes")[order], axis=0, kind="stable")[:k]
        taken = np.zeros((rounds, size))
        taken[np.arange(rounds)[None, :], order[first]] = 1.0
        scores = taken @ (number("w")[:, None] * lists("copies"))
        return pa.table({"pgs_id": of.column("pgs_id").slice(0, 1), "s": [float(scores.std(axis=1).mean())], "rounds": [int(rounds)]})

    return rows.groupBy("pgs_id").applyInArrow(spread, "pgs_id string, s double, rounds long")


def _tier_by_ranges(pack: DataFrame, matrix: DataFrame, samples: list, share: float, least: int, budget: int, seed: int, above: int = 0) -> DataFrame:
    """The same of scores of more than ``above`` variants that the panel has."""
    panel = cut(blocks.panel_of(matrix, samples))
    there = cut(pack.select(*KEYS, "pgs_id", "effect_allele", "effect_weight").join(panel.select(*KEYS).distinct(), KEYS, "left_semi"))
    n = there.groupBy("pgs_id").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("n") > above))
    n = n.select("*", *_rounds(F.col("n"), share, budget)).filter("k < n")
    rows = there.join(n, "pgs_id").withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rounds"))))
    chosen = selection.least_by_hash(rows, ["pgs_id", "round"], "k", A.md5_number(F.concat_ws(":", F.lit(seed), "pgs_id", "round", *KEYS)), [*KEYS, "effect_allele", "effect_weight"])
    scored = blocks.long_form(blocks.block_scores(chosen, panel, len(samples), ("pgs_id", "round")), samples)
    return scored.groupBy("pgs_id", "round").agg(F.stddev_pop("score").alias("s")).groupBy("pgs_id").agg(F.avg("s").alias("s"), F.count("*").alias("rounds"))
