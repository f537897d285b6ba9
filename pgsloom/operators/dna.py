"""People's genotypes: builds, liftover, merging of measured and imputed calls, imputation metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pgsloom.functions import alleles as A
from pgsloom.functions import statistics as S
from pgsloom.operators import selection
from pgsloom.operators.match import KEYS
from pgsloom.sources.shared import cut

#: A variant whose position tells the build.
PROBE = "rs3131972"
PROBE_WINDOWS = {"hg19": (752_000, 753_000), "hg38": (817_000, 818_000)}


def detect_build(lines: DataFrame) -> DataFrame:
    """(file, build): from the header comments, else from the position of the probe, else hg19."""
    text, low = F.col("value"), F.lower("value")
    comment = text.startswith("#")
    header = F.when(low.contains("build 37") | low.contains("build37"), "hg19").when(low.contains("build 38") | low.contains("build38") | low.contains("grch38"), "hg38")
    fields = F.split(text, "\t")
    at = F.get(fields, F.lit(2)).try_cast("int")
    probe = F.when(~comment & (F.get(fields, F.lit(0)) == PROBE), F.when(at.between(*PROBE_WINDOWS["hg19"]), "hg19").when(at.between(*PROBE_WINDOWS["hg38"]), "hg38"))
    return lines.groupBy("file").agg(F.coalesce(F.min(F.when(comment, header)), F.min(probe), F.lit("hg19")).alias("build"))


def lift(positions: DataFrame, blocks: DataFrame, bin_bits: int = 14) -> DataFrame:
    """Positions moved by the offset of the block [start, end) that holds them; others are dropped.

    A range join as an equality join: blocks are repeated for each bin of 2^bin_bits bases that they touch, positions
    have one bin, and the range is checked within the bin. Nothing is compared across bins, on any scale.
    """
    width = 1 << bin_bits
    cut = blocks.select("chr", "hg19_start", "hg19_end", "hg38_offset", F.explode(F.sequence((F.col("hg19_start") / width).cast("int"), ((F.col("hg19_end") - 1) / width).cast("int"))).alias("bin"))
    here = positions.withColumn("bin", (F.col("pos") / width).cast("int"))
    found = here.join(cut, ["chr", "bin"]).filter("pos >= hg19_start and pos < hg19_end")
    return found.withColumn("pos", F.col("pos") + F.col("hg38_offset")).drop("bin", "hg19_start", "hg19_end", "hg38_offset")


def merge_calls(genotyped: DataFrame, imputed: DataFrame, by: tuple[str, ...] = ("individual_id", "chr", "pos")) -> DataFrame:
    """Measured calls, and the imputed calls of positions without a measured one."""
    rest = imputed.join(genotyped.select(*by).distinct(), list(by), "left_anti")
    return genotyped.unionByName(rest, allowMissingColumns=True)


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("individual_id").agg(F.count("*").alias("total"), F.count_if("imputed").alias("imputed"), F.count_if(~F.col("imputed")).alias("genotyped"))


def from_posteriors(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Imputed calls whose likeliest genotype is likely enough, with their quality."""
    kept = rows.filter(F.greatest("gp1", "gp2", "gp3") >= least)
    return kept.withColumn("imputed", F.lit(True)).withColumn("imputation_quality", A.posterior_quality(F.col("ds"), F.col("gp1"), F.col("gp2"), F.col("gp3")))


def genotyped_calls(rows: DataFrame) -> DataFrame:
    """Measured calls from genotype strings; homozygous reference is dropped."""
    return rows.filter(~F.col("gt").isin("0/0", "0|0")).withColumn("genotype_dosage", A.genotype_dosage(F.col("gt"))).withColumn("imputed", F.lit(False)).withColumn("imputation_quality", F.lit(1.0))


def strands(observed: DataFrame, panel: DataFrame) -> DataFrame:
    """REF, ALT and genotype of observed allele pairs by a panel's reference; those that do not fit are dropped."""
    rows = observed.join(panel.select("chr", "pos", "panel_ref"), ["chr", "pos"], "left")
    return rows.withColumn("call", A.ref_alt_gt(F.col("allele1"), F.col("allele2"), F.col("panel_ref"))).filter("call is not null").select(*observed.columns, "call.*")


def default_quality(imputed: Column) -> Column:
    return F.when(imputed, 0.5).otherwise(1.0)


def bake(dna: DataFrame, af: DataFrame, dr2: DataFrame) -> DataFrame:
    """Imputation quality from DR2 and expected dosage from the frequency, on all three keys."""
    rows = dna.drop("expected_dosage", "imputation_quality").join(af.select(*KEYS, "af"), KEYS, "left").join(dr2.select(*KEYS, "dr2"), KEYS, "left")
    expected = F.when(F.col("imputed"), F.coalesce(2.0 * F.col("af"), F.lit(1.0))).otherwise(0.0)
    return rows.withColumn("expected_dosage", expected).withColumn("imputation_quality", F.coalesce("dr2", default_quality(F.col("imputed")))).drop("af", "dr2")


def truth_pairs(truth: DataFrame, dosages: DataFrame) -> DataFrame:
    """(vid, sample, t, d): true genotypes beside imputed dosages, of the variants and samples that both have.

    A genotype is text as in a VCF; one that is not called counts as no copies, as in ``alleles.gt_dosage``.
    """
    copies = F.aggregate(F.transform(F.split("gt", r"[/|]"), lambda a: F.coalesce(a.try_cast("int"), F.lit(0))), F.lit(0), lambda a, b: a + b)
    return truth.select("vid", "sample", copies.cast("double").alias("t")).join(dosages.select("vid", "sample", F.col("dosage").alias("d")), ["vid", "sample"])


def dr2(pairs: DataFrame) -> DataFrame:
    """(vid, dr2) from true and imputed dosages of samples."""
    return pairs.groupBy("vid").agg(S.dr2(F.col("t"), F.col("d")).alias("dr2"))


def dr2_stats(found: DataFrame) -> DataFrame:
    """Counts, mean and exact median of DR2 over all variants; the median comes from counts by ranges."""
    found, v = cut(found.select("dr2")), F.col("dr2")
    median = selection.quantiles(found, "dr2", [0.5])[0]
    return found.agg(F.count("*").alias("variants"), F.avg(v).alias("mean"), F.lit(median).cast("double").alias("median"), F.count_if(v >= 0.8).alias("high"), F.count_if(v < 0.3).alias("low"))


def chromosome_manifest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chr").agg(F.count("*").alias("total"), F.count_if("imputed").alias("imputed"), F.count_if(~F.col("imputed")).alias("genotyped"))
