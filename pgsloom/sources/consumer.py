"""Consumer genotype files: text of several vendors, VCF, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pgsloom.functions import alleles as A

#: What a vendor's header says, in order of trial.
VENDORS = {"vcf": r"^##fileformat=VCF", "23andme": r"(?i)23andme", "ancestrydna": r"(?i)ancestrydna", "myheritage": r"(?i)myheritage", "ftdna": r"(?i)family ?tree|^\"?RSID\"?,\"?CHROMOSOME\"?"}
COLUMNS = ["rsid", "chromosome", "position", "allele1", "allele2"]


def vendor(spark: SparkSession, path: str, lines: int = 50) -> str | None:
    """The vendor by the first lines of a file."""
    first = [r["value"] for r in spark.read.text(path).limit(lines).collect()]
    import re

    return next((v for v, form in VENDORS.items() if any(re.search(form, x) for x in first)), None)


def _calls(rsid: Column, chromosome: Column, position: Column, a1: Column, a2: Column) -> list[Column]:
    return [rsid.alias("rsid"), F.replace(F.upper(chromosome), F.lit("CHR"), F.lit("")).alias("chromosome"), position.try_cast("int").alias("position"), a1.alias("allele1"), a2.alias("allele2")]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of four fields (genotype) or five (two alleles), by tab or comma; comments, headers and no-calls are dropped.

    A genotype of one character (a haploid call) counts twice.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.replace(F.col("value"), F.lit('"'), F.lit("")), "[\t,]")
    rows = lines.select(*[F.get(f, F.lit(i)).alias(f"f{i}") for i in range(5)]).filter(F.lower("f0") != "rsid")
    g = F.upper(F.col("f3"))
    a1 = F.when(F.col("f4").isNotNull(), g).otherwise(F.substring(g, 1, 1))
    a2 = F.when(F.col("f4").isNotNull(), F.upper("f4")).when(F.length(g) == 1, g).otherwise(F.substring(g, 2, 1))
    out = rows.select(*_calls(F.col("f0"), F.col("f1"), F.col("f2"), a1, a2))
    return out.filter("allele1 not in ('-', '0', '') and allele2 not in ('-', '0', '') and position is not null")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a list of variants."""
    v = F.col("v")
    rows = spark.read.json(path, multiLine=True).select(F.explode("variants").alias("v"))
    return rows.select(*_calls(v["rsid"], v["chromosome"].cast("string"), v["position"].cast("string"), v["allele1"], v["allele2"]))


def vcf_lines(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, ref, alt, format, samples) of each record: FORMAT keys and the texts of the samples; several ALT alleles are dropped."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    rows = lines.select(A.chromosome_code(F.get(f, F.lit(0))).alias("chr"), F.get(f, F.lit(1)).try_cast("int").alias("pos"), F.get(f, F.lit(3)).alias("ref"), F.get(f, F.lit(4)).alias("alt"), F.split(F.get(f, F.lit(8)), ":").alias("format"), F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("samples"))
    return rows.filter(~F.col("alt").contains(","))


def vcf_value(text: Column, key: str) -> Column:
    """A sample's value of a FORMAT key; null where the record or the sample lacks it."""
    return F.get(F.split(text, ":"), (F.array_position("format", key) - 1).cast("int"))


def read_vcf(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(chr, pos, ref, alt, sample, a column a key) for the FORMAT keys of each sample, GT alone under the name ``value`` by default.

    One scan for any number of keys; a record that has none of them is left out. Samples are numbered as in the header line.
    """
    names = dict.fromkeys(keys) if len(keys) > 1 else {(keys or ("GT",))[0]: "value"}
    there = F.lit(False)
    for k in names:
        there = there | F.array_contains("format", k)
    rows = vcf_lines(spark, path).filter(there).select("chr", "pos", "ref", "alt", "format", F.posexplode("samples").alias("sample", "text"))
    return rows.select("chr", "pos", "ref", "alt", "sample", *[vcf_value(F.col("text"), k).alias(name or k.lower()) for k, name in names.items()])


def read_dosages(spark: SparkSession, path: str) -> DataFrame:
    """Imputed calls of a VCF: dosage and genotype posteriors, of records that have both."""
    rows = vcf_lines(spark, path).filter(F.array_contains("format", "DS") & F.array_contains("format", "GP"))
    rows = rows.select("chr", "pos", "ref", "alt", "format", F.posexplode("samples").alias("sample", "text"))
    p = F.split(vcf_value(F.col("text"), "GP"), ",")
    return rows.select("chr", "pos", "ref", "alt", "sample", vcf_value(F.col("text"), "DS").try_cast("double").alias("ds"), *[F.get(p, F.lit(i)).try_cast("double").alias(f"gp{i + 1}") for i in range(3)])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, allele_key, alt, at, dosages): genotypes of a VCF as arrays, a row a record, for scoring by blocks.

    Samples that are not called are not in the arrays.
    """
    call = lambda text, i: F.when(~vcf_value(text, "GT").contains("."), F.struct(i.alias("at"), A.genotype_dosage(vcf_value(text, "GT")).cast("double").alias("dosage")))
    rows = vcf_lines(spark, path).filter(F.array_contains("format", "GT")).withColumn("c", F.array_compact(F.transform("samples", call)))
    return rows.select("chr", "pos", A.allele_key(F.col("ref"), F.col("alt")).alias("allele_key"), "alt", F.col("c.at").alias("at"), F.col("c.dosage").alias("dosages"))


def unified(calls: DataFrame, individual_id: str) -> DataFrame:
    """Measured calls as genotypes of a person, keyed for matching; the second allele stands for ALT."""
    ref, alt = F.least("allele1", "allele2"), F.greatest("allele1", "allele2")
    rows = calls.select(F.lit(individual_id).alias("individual_id"), F.concat_ws(":", "chromosome", "position", ref, alt).alias("variant_id"), A.sorted_allele_dosage(F.col("allele1"), F.col("allele2")).cast("double").alias("genotype_dosage"), F.lit(False).alias("imputed"), F.lit(1.0).alias("imputation_quality"), A.chromosome_code(F.col("chromosome")).alias("chr"), F.col("position").alias("pos"))
    return rows.withColumn("allele_key", A.key_of_id(F.col("variant_id"))).filter("chr is not null")
