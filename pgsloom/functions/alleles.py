"""Column functions over variant ids, alleles and genotypes; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the chromosomes that have no number.
CHROMOSOMES = {"X": 23, "Y": 24, "MT": 25, "M": 25}


def part(variant_id: Column, n: int) -> Column:
    """The n-th field (from 1) of a ``chr:pos:a:b`` id; '' where there is none."""
    return F.split_part(variant_id, F.lit(":"), F.lit(n))


def md5_number(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text as a number: the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def allele_key(a: Column, b: Column) -> Column:
    """60-bit key of an unordered pair of alleles. Materialize it when data is written: joins are on integers then."""
    return md5_number(F.concat(F.least(a, b), F.lit(":"), F.greatest(a, b)))


def key_of_id(variant_id: Column) -> Column:
    return allele_key(part(variant_id, 3), part(variant_id, 4))


def position_key(variant_id: Column) -> Column:
    """``chr:pos`` of an id; null if it has no colon."""
    return F.when(F.instr(variant_id, ":") > 0, F.substring_index(variant_id, ":", 2))


def chromosome_code(name: Column) -> Column:
    """1-25, null for anything else (contigs, blanks)."""
    bare = F.upper(F.regexp_replace(name, "^(?i)chr", ""))
    code = bare.try_cast("int")
    for label, value in CHROMOSOMES.items():
        code = F.when(bare == label, F.lit(value)).otherwise(code)
    return code


def chromosome_label(code: Column) -> Column:
    return F.when(code == 23, "X").when(code == 24, "Y").when(code == 25, "MT").otherwise(code.cast("string"))


def count_effect_alleles(a1: Column, a2: Column, effect: Column) -> Column:
    return F.coalesce(a1 == effect, F.lit(False)).cast("int") + F.coalesce(a2 == effect, F.lit(False)).cast("int")


def string_dosage(genotype: Column, effect: Column) -> Column:
    """How many characters of a genotype string are the effect allele; 0 without either."""
    n = F.char_length(genotype) - F.char_length(F.replace(genotype, effect, F.lit("")))
    return F.when(F.coalesce(F.char_length(effect), F.lit(0)) == 1, F.coalesce(n, F.lit(0))).otherwise(0)


def resolve_dosage(pack_ref: Column, pack_alt: Column, dna_ref: Column, dna_alt: Column, dosage: Column) -> Column:
    """Dosage seen from the pack: as it is, flipped if the alleles are swapped, null if they differ."""
    return F.when((pack_ref == dna_ref) & (pack_alt == dna_alt), dosage).when((pack_ref == dna_alt) & (pack_alt == dna_ref), 2 - dosage)


def complement(allele: Column) -> Column:
    return F.translate(allele, "ACGT", "TGCA")


def genotype_dosage(gt: Column) -> Column:
    """Copies of ALT in a VCF genotype, phased or not: 2, 1 or 0."""
    bare = F.replace(gt, F.lit("|"), F.lit("/"))
    return F.when(bare == "1/1", 2.0).when(bare.isin("0/1", "1/0"), 1.0).otherwise(0.0)


def sorted_allele_dosage(a1: Column, a2: Column) -> Column:
    """Legacy dosage against the alphabetically second allele."""
    return F.when(a1 != a2, 1).otherwise(0)


def ref_alt_gt(a1: Column, a2: Column, panel_ref: Column) -> Column:
    """struct(ref, alt, gt, flipped) of two observed alleles, null if they do not fit the panel.

    With a panel: alleles that only fit as complements are flipped. Without: alphabetical order.
    """
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    other = lambda ref: F.element_at(F.filter(bases, lambda b: b != ref), 1)
    valid = a1.isin(*"ACGT") & a2.isin(*"ACGT")
    fits = (panel_ref == a1) | (panel_ref == a2)
    flips = ~fits & ((panel_ref == complement(a1)) | (panel_ref == complement(a2)))
    x, y = F.when(flips, complement(a1)).otherwise(a1), F.when(flips, complement(a2)).otherwise(a2)
    made = lambda ref, alt, gt, flipped: F.struct(ref.alias("ref"), alt.alias("alt"), F.lit(gt).alias("gt"), flipped.alias("flipped"))
    no = F.lit(False)
    with_panel = F.when((x == panel_ref) & (y == panel_ref), made(panel_ref, other(panel_ref), "0/0", flips)).when(x == panel_ref, made(panel_ref, y, "0/1", flips)).when(y == panel_ref, made(panel_ref, x, "0/1", flips)).otherwise(made(panel_ref, x, "1/1", flips))
    without = F.when(a1 == a2, made(a1, other(a1), "0/0", no)).otherwise(made(F.least(a1, a2), F.greatest(a1, a2), "0/1", no))
    return F.when(valid & panel_ref.isNotNull() & (fits | flips), with_panel).when(valid & panel_ref.isNull(), without)


def posterior_quality(dosage: Column, gp1: Column, gp2: Column, gp3: Column) -> Column:
    """One less the variance of the dosage under the genotype posteriors, at least 0."""
    spread = gp1 * F.pow(0.0 - dosage, F.lit(2.0)) + gp2 * F.pow(1.0 - dosage, F.lit(2.0)) + gp3 * F.pow(2.0 - dosage, F.lit(2.0))
    return F.greatest(F.lit(0.0), 1.0 - spread)


def user_genotype(user_variant_id: Column, imputed: Column, dosage: Column) -> Column:
    """Text of a person's genotype: both alleles, else the dosage (with ~ where imputed)."""
    fields = F.split(user_variant_id, ":")
    return F.when(F.size(fields) >= 4, F.concat(F.get(fields, F.lit(2)), F.get(fields, F.lit(3)))).when(imputed, F.concat(F.lit("~"), F.format_string("%.1f", dosage))).otherwise(F.format_string("%.0f", dosage))
