"""Scoring files of several layouts into one table of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pgsloom.functions import alleles as A

DOSAGE, HARMONIZED, HLA, SNP, SNP_NO_RSID, RSID, RSID_CHR = "DOSAGE_WEIGHTS", "RSID_HARMONIZED", "HLA_ALLELE", "STANDARD_SNP", "STANDARD_SNP_NO_RSID", "RSID_ONLY", "RSID_CHR"
#: Layouts in order of priority, as (columns that must be there, columns that must not).
LAYOUTS = {
    DOSAGE: ({"chr_name", "chr_position", "dosage_0_weight", "dosage_1_weight", "dosage_2_weight"}, set()),
    HARMONIZED: ({"hm_chr", "hm_pos"}, set()),
    HLA: ({"rsID", "is_haplotype"}, set()),
    SNP: ({"chr_name", "chr_position", "rsID"}, set()),
    SNP_NO_RSID: ({"chr_name", "chr_position"}, {"rsID"}),
    RSID: ({"rsID"}, {"chr_name", "is_haplotype"}),
    RSID_CHR: ({"rsID", "chr_name"}, {"chr_position"}),
}


def detect_format(columns: list[str]) -> str | None:
    """The first layout that the columns fit."""
    have = set(columns)
    return next((name for name, (must, never) in LAYOUTS.items() if must <= have and not never & have), None)


def harmonize(rows: DataFrame, layout: str | None = None) -> DataFrame:
    """(variant_id, chr_name, chr_position, effect_allele, other_allele, effect_weight) of a table of strings.

    Rows without an effect allele or a raw weight are dropped; other columns of the table stay.
    """
    layout = layout or detect_format(rows.columns)
    col = lambda c: F.col(c) if c in rows.columns else F.lit("")
    bare = lambda c: F.replace(col(c), F.lit("chr"), F.lit(""))
    raw = "dosage_1_weight" if layout == DOSAGE else "effect_weight"
    keep = (F.trim(F.coalesce(col("effect_allele"), F.lit(""))) != "") & (F.trim(F.coalesce(col(raw), F.lit(""))) != "")
    effect, other, chrom, pos = col("effect_allele"), col("other_allele"), F.lit(""), F.lit(None).cast("bigint")

    def joined(*fields: Column) -> Column:
        return F.concat_ws(":", *[F.coalesce(f, F.lit("")) for f in fields])

    if layout in (DOSAGE, SNP, SNP_NO_RSID):
        chrom, pos = bare("chr_name"), col("chr_position").try_cast("bigint")
        four = layout == DOSAGE or "other_allele" in rows.columns
        identity = joined(chrom, col("chr_position"), effect, *([other] if four else []))
    elif layout == HLA:
        identity, other = F.when(F.coalesce(col("rsID"), F.lit("")) != "", col("rsID")).otherwise(effect), F.lit("")
    elif layout == HARMONIZED:
        chrom, pos = bare("hm_chr"), col("hm_pos").try_cast("bigint")
        other = F.nullif(col("other_allele") if "other_allele" in rows.columns else col("hm_inferOtherAllele"), F.lit(""))
        identity = joined(chrom, col("hm_pos"), effect, other)
        keep = keep & ~F.coalesce(col("hm_pos"), F.lit("")).isin("", "0")
    else:
        identity = col("rsID")
        chrom = bare("chr_name") if layout == RSID_CHR else chrom
    made = {"variant_id": identity, "chr_name": chrom, "chr_position": pos, "effect_allele": effect, "other_allele": other, "effect_weight": col(raw).try_cast("double")}
    more = [c for c in ("pgs_id",) if c in rows.columns]
    return rows.filter(keep).select(*more, *[v.alias(k) for k, v in made.items()])


def infer_other_allele(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Ids with the reference allele where a panel has the effect allele as its ALT at the position, else three fields."""
    panel = reference.select(F.col("chr").alias("r_chr"), F.col("pos").alias("r_pos"), "ref", "alt")
    on = (F.col("chr_name") == F.col("r_chr").cast("string")) & (F.col("chr_position") == F.col("r_pos")) & (F.col("effect_allele") == F.col("alt"))
    base = F.concat_ws(":", "chr_name", "chr_position")
    identity = F.when(F.col("ref").isNotNull(), F.concat_ws(":", base, "ref", "alt")).otherwise(F.concat_ws(":", base, "effect_allele"))
    return rows.join(panel, on, "left").withColumn("variant_id", identity).withColumn("other_allele", F.coalesce("ref", "other_allele")).drop("r_chr", "r_pos", "ref", "alt")


def standardize(rows: DataFrame) -> DataFrame:
    """Pack rows: integer keys, blanks and contigs dropped, duplicates dropped."""
    v = F.col("variant_id")
    out = rows.filter((F.trim(F.coalesce(v, F.lit(""))) != "") & F.col("effect_weight").isNotNull() & (F.trim(F.coalesce("effect_allele", F.lit(""))) != "") & ~A.part(v, 1).contains("_"))
    out = out.select("variant_id", "effect_allele", "effect_weight", "pgs_id", A.chromosome_code(A.part(v, 1)).alias("chr"), A.part(v, 2).try_cast("int").alias("pos"), A.key_of_id(v).alias("allele_key"))
    return out.distinct()


def standardize_legacy(rows: DataFrame) -> DataFrame:
    """The older seven columns, with defaults for what is missing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.filter(F.col("effect_weight").isNotNull()).select(text("variant_id").alias("variant_id"), text("chr_name").alias("chr_name"), F.col("chr_position").cast("bigint").alias("chr_position"), text("effect_allele").alias("effect_allele"), text("other_allele").alias("other_allele"), F.col("effect_weight").cast("double").alias("effect_weight"), text("pgs_id").alias("pgs_id"))


def etl(groups: list[DataFrame]) -> DataFrame:
    """Tables of strings, one for each header layout, into one pack; no batches, no per-file loop."""
    out = None
    for rows in groups:
        part = standardize(harmonize(rows))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def deduplicated(rows: DataFrame, by: list[str], count: int, per_task: int = 500_000) -> DataFrame:
    """Distinct rows, a task for each ``per_task`` of the ``count`` that there may be: what a task holds does not grow with the table.

    Rows hardly repeat, so they are shuffled by ``by`` as they are instead of being gathered in the tasks before the shuffle too.
    """
    return rows.repartition(count // per_task + 1, *by).distinct()
