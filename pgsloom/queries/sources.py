"""Queries of the file sources: Spark writes files of each format from the tables, the source reads them back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pgsloom.operators import blocks, results
from pgsloom.plans.fixtures import Inputs
from pgsloom.queries.base import query, rounded
from pgsloom.sources import bed, binary, consumer, scoring_files
from pgsloom.sources.shared import cut, new_folder
from pgsloom.sources.store import ResultStore

CODES = "(p_partkey * 7 + s * 3 + p_size) % 4"


def write_beds(codes: DataFrame, folder: str) -> None:
    """(variant, codes: array of two-bit codes) as .bed files, one for each partition, variants by number.

    A task writes under a name of its own and renames, so one that runs again leaves no second file.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.bed"
        own, n = f"{path}/.{uuid.uuid4().hex}", 0
        with store.open_output_stream(own) as out:
            out.write(bed.MAGIC)
            for part in parts:
                if part.num_rows:
                    rows = np.array(part.column(1).to_pylist(), np.uint8)
                    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).reshape(len(rows), -1, 4)
                    out.write((rows << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2, dtype=np.uint8).tobytes())
                    n += part.num_rows
        store.move(own, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    codes.mapInArrow(write, "n bigint").collect()  # a row a task


@query("bed_dosages", f"select c as code, s as sample, count(*) as n from (select {CODES} as c, s from part cross join (select unnest(generate_series(0, 9)) as s) x) q group by 1, 2")
def bed_dosages(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark, "bed")
    codes = t.table("part").select(F.col("p_partkey").alias("variant"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda s: (F.col("p_partkey") * 7 + s * 3 + F.col("p_size")) % 4).alias("codes"))
    write_beds(codes.repartition(3, "variant"), folder)
    rows = bed.read_bed(t.spark, folder, 10, rangeBytes=3000)
    code = F.when(F.col("dosage") == 2, 0).when(F.col("dosage") == 1, 2).when(F.col("dosage") == 0, 3).otherwise(1)
    return rows.groupBy(code.cast("long").alias("code"), F.col("sample").cast("long").alias("sample")).agg(F.count("*").alias("n"))


VCF = "select *, cast(p_partkey % 22 + 1 as int) as chr, cast(p_partkey * 10 as int) as pos, substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) as ref, substr('ACGT', cast((p_partkey + 1) % 4 as int) + 1, 1) as alt from part"


def vcf_folder(t: Inputs) -> str:
    """A record for each part with three samples; one in nine has no DS, one in seven has two ALT alleles."""
    folder = new_folder(t.spark, "vcf")
    ds = lambda s: f"cast(((p_partkey + p_size * {s}) % 21) as string)"
    sample = lambda s: f"""concat(case (p_partkey + {s}) % 4 when 0 then '0/0' when 1 then '0|1' when 2 then '1/1' else './.' end, case when p_partkey % 9 = 0 then '' else concat(':', {ds(s)}, ':0.25,0.5,', cast({s} as string)) end)"""
    line = f"concat_ws('\\t', concat('chr', cast(chr as string)), cast(pos as string), '.', ref, case when p_partkey % 7 = 0 then concat(alt, ',N') else alt end, '.', 'PASS', '.', case when p_partkey % 9 = 0 then 'GT' else 'GT:DS:GP' end, {sample(0)}, {sample(1)}, {sample(2)})"
    t.sql(VCF).selectExpr(f"{line} as value").write.text(folder)
    return folder


SAMPLES = f"select v.*, s from ({VCF}) v cross join (select unnest(generate_series(0, 2)) as s) x where p_partkey % 7 <> 0"


@query("vcf_dosages", f"select chr, pos, ref, alt, cast(s as int) as sample, (p_partkey + p_size * s) % 21 * 1e0 as ds, 25e-2 as gp1, 5e-1 as gp2, s * 1e0 as gp3 from ({SAMPLES}) q where p_partkey % 9 <> 0")
def vcf_dosages(t: Inputs) -> DataFrame:
    return consumer.read_dosages(t.spark, vcf_folder(t))


@query("vcf_genotypes", f"select chr, pos, ref, alt, cast(s as int) as sample, case (p_partkey + s) % 4 when 0 then '0/0' when 1 then '0|1' when 2 then '1/1' else './.' end as gt, case when p_partkey % 9 <> 0 then cast((p_partkey + p_size * s) % 21 as string) end as ds from ({SAMPLES}) q")
def vcf_genotypes(t: Inputs) -> DataFrame:
    return consumer.read_vcf(t.spark, vcf_folder(t), "GT", "DS")


@query("vcf_panel_scores", f"select s as sample, round(sum(case (p_partkey + s) % 4 when 3 then 0 else (case when p_size % 2 = 0 then (p_partkey + s) % 4 else 2 - (p_partkey + s) % 4 end) end * p_size * 1e-2), 6) as score from ({SAMPLES}) q group by s")
def vcf_panel_scores(t: Inputs) -> DataFrame:
    panel = consumer.read_panel(t.spark, vcf_folder(t))
    pack = t.sql(VCF).filter("p_partkey % 7 <> 0").selectExpr("'P' as pgs_id", "chr", "pos", "case when p_size % 2 = 0 then alt else ref end as effect_allele", "p_size * 1e-2 as effect_weight", "ref", "alt")
    from pgsloom.functions import alleles as A

    pack = pack.withColumn("allele_key", A.allele_key(F.col("ref"), F.col("alt")))
    return blocks.long_form(blocks.block_scores(pack, panel, 3, per_block=500), [0, 1, 2]).select(F.col("sample").cast("long").alias("sample"), *rounded("score"))


@query("chain_blocks", """with c as (select cast(p_partkey % 22 + 1 as int) as chr, cast(p_partkey * 100 as int) as a, cast(p_partkey * 100 + p_size as int) as b, cast(p_size as int) as n from part where p_partkey % 5 <> 0)
  select chr, a as hg19_start, a + n as hg19_end, b - a as hg38_offset from c union all select chr, a + n + 5, a + n + 15, b - a + 2 from c""")
def chain_blocks(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark, "chain")
    c = "concat('chr', cast(p_partkey % 22 + 1 as string))"
    to = f"case when p_partkey % 5 = 0 then 'chrUn' else {c} end"  # a chain to another chromosome is left out
    first = f"concat_ws(' ', 'chain 1', {c}, '1000 +', cast(p_partkey * 100 as string), '9', {to}, '1000 +', cast(p_partkey * 100 + p_size as string), '9', '1')"
    t.table("part").selectExpr(f"concat({first}, '\\n', cast(p_size as string), '\\t5\\t7\\n10\\n') as value").write.text(folder)
    return binary.read_chain(t.spark, folder)


@query("scoring_file_rows", "select concat('rs', cast(p_partkey as string)) as rsID, cast(p_size as string) as effect_weight, case when p_partkey % 3 = 0 then null else substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) end as effect_allele from part")
def scoring_file_rows(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark, "scoring")
    rows = t.table("part").selectExpr("concat('rs', cast(p_partkey as string)) as rsID", "cast(p_size as string) as effect_weight", "case when p_partkey % 3 = 0 then null else substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) end as effect_allele")
    rows.repartition(3, "rsID").write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(folder)
    found = scoring_files.headers(t.spark, f"{folder}/*.gz").select("file", "header").collect()  # a row a file
    names = {r["header"] for r in found}
    if names != {"\t".join(rows.columns)}:
        raise ValueError(f"headers {names}")
    return scoring_files.read_strings(t.spark, [r["file"] for r in found]).select("rsID", "effect_weight", "effect_allele")


STORED = "select individual_id, trait_id, pgs_id, round(raw_score, 6) as raw_score, matched_variants from fx_results"


@query("store_merge", f"with r as ({STORED}) select individual_id, trait_id, pgs_id, case when individual_id = 'IND2' then raw_score + 1e0 else raw_score end as raw_score, matched_variants from r where individual_id <> 'IND4'")
def store_merge(t: Inputs) -> DataFrame:
    """Three merges and a deletion: some people, all others, one with other scores; one person goes."""
    from pgsloom.queries import scoring

    # scored once: three merges and the deletion read it
    rows = cut(scoring.results(t).select("individual_id", "trait_id", "pgs_id", *rounded("raw_score"), "matched_variants"))
    store = ResultStore(t.spark, new_folder(t.spark, "store"), ["individual_id", "trait_id", "pgs_id"], "trait_id", "changed_at")
    store.merge(rows.filter("individual_id in ('IND1', 'IND2')"))
    store.merge(rows.filter("individual_id not in ('IND1', 'IND2')"))
    store.merge(rows.filter("individual_id = 'IND2'").withColumn("raw_score", F.col("raw_score") + 1.0))
    store.delete(results.delete_keys(rows, rows.filter("individual_id <> 'IND4'"), ["individual_id"]).select("individual_id").distinct())
    return store.read().drop("changed_at")
