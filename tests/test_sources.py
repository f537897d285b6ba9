"""Readers, writers, the engine and streams on files made here."""

import gzip

import numpy as np
import pytest

from pgsloom.engine import Engine, open_dna
from pgsloom.operators import match, score
from pgsloom.plans.fixtures import Inputs
from pgsloom.sources import binary, consumer, scoring_files, tables
from pgsloom.streaming import events, scoring


def test_scoring_files(spark, tmp_path):
    one = "#format\n# more\nrsID\tchr_name\tchr_position\teffect_allele\tother_allele\teffect_weight\nrs1\tchr1\t100\tA\tG\t0.5\nrs2\tX\t7\tC\t\t0.1\nrs3\t1_alt\t9\tC\tT\t0.1\nrs4\t2\t9\t\tT\t0.1\n"
    two = "hm_chr\thm_pos\teffect_allele\tother_allele\teffect_weight\n3\t30\tT\tC\t-1e-2\n3\t0\tT\tC\t1\n3\t30\tT\tC\t-1e-2\n"
    for name, text in (("PGS000001_x.txt.gz", one), ("PGS000002.txt.gz", two)):
        (tmp_path / name).write_bytes(gzip.compress(text.encode()))
    assert scoring_files.header(spark, str(tmp_path / "PGS000001_x.txt.gz"))[0] == "rsID"
    pack = scoring_files.read_scores(spark, str(tmp_path / "*.gz"))
    assert sorted((r["pgs_id"], r["variant_id"], r["chr"], r["pos"], r["effect_weight"]) for r in pack.collect()) == [("PGS000001", "1:100:A:G", 1, 100, 0.5), ("PGS000001", "X:7:C:", 23, 7, 0.1), ("PGS000002", "3:30:T:C", 3, 30, -0.01)]
    tables.write_pack(pack, str(tmp_path / "pack"), partitions=2)
    assert tables.manifest(spark, str(tmp_path / "pack"))["chromosomes"] == {1: 1, 3: 1, 23: 1}
    plan = tables.chromosome(tables.read_packs(spark, str(tmp_path / "pack")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chr" in plan


def test_headerless_and_lenient(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("chr1:5:A:G\t0.1\nchr1:6:A:G\t0.2\n")
    assert scoring_files.read_headerless(spark, str(tmp_path / "a.tsv"), ["variant_id", "af"]).count() == 2
    (tmp_path / "b.tsv").write_text("a\tb\n1\t2\n1\t2\t3\n")
    assert len(scoring_files.read_lenient(spark, str(tmp_path / "b.tsv")).collect()) == 1


def test_consumer_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# This data file generated by 23andMe\n# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t100\tAG\nrs2\tX\t5\tC\nrs3\t1\t7\t--\n")
    (tmp_path / "b.txt").write_text("#AncestryDNA raw data\nrsid\tchromosome\tposition\tallele1\tallele2\nrs1\t1\t100\tA\tG\nrs9\t2\t3\t0\t0\n")
    (tmp_path / "c.csv").write_text('"RSID","CHROMOSOME","POSITION","RESULT"\n"rs1","1","100","AG"\n')
    read = lambda n: [tuple(r) for r in consumer.read_text(spark, str(tmp_path / n)).orderBy("rsid").collect()]
    assert read("a.txt") == [("rs1", "1", 100, "A", "G"), ("rs2", "X", 5, "C", "C")]
    assert read("b.txt") == [("rs1", "1", 100, "A", "G")] == read("c.csv")
    assert [consumer.vendor(spark, str(tmp_path / n)) for n in ("a.txt", "b.txt", "c.csv")] == ["23andme", "ancestrydna", "ftdna"]


def test_json(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"variants": [{"rsid": "rs1", "chromosome": "1", "position": 5, "allele1": "A", "allele2": "G"}], "metadata": {"build": "hg19"}}')
    assert [tuple(r) for r in consumer.read_json(spark, str(tmp_path / "v.json")).collect()] == [("rs1", "1", 5, "A", "G")]


def test_vcf(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
    (tmp_path / "a.vcf").write_text(head + "chr1\t5\t.\tA\tG\t.\t.\t.\tGT:DS:GP\t0|1:1.1:0,0.9,0.1\t1|1:2:0,0,1\nchrX\t6\t.\tA\tG,T\t.\t.\t.\tGT\t0|1\t0|0\n")
    assert [tuple(r) for r in consumer.read_vcf(spark, str(tmp_path / "a.vcf")).orderBy("sample").collect()] == [(1, 5, "A", "G", 0, "0|1"), (1, 5, "A", "G", 1, "1|1")]
    r = consumer.read_dosages(spark, str(tmp_path / "a.vcf")).orderBy("sample").first()
    assert (r["ds"], r["gp2"]) == (1.1, 0.9)


def test_bed(spark, tmp_path):
    calls = np.array([[0, 1, 2, 3, 2], [3, 3, 0, 1, 2], [2, 2, 2, 2, 2]])  # codes: 0 -> 2, 1 -> missing, 2 -> 1, 3 -> 0
    raw = bytearray(b"\x6c\x1b\x01")
    for row in calls:
        padded = [*row, 0, 0, 0]
        raw += bytes(sum(int(padded[4 * b + k]) << 2 * k for k in range(4)) for b in range(2))
    (tmp_path / "x.bed").write_bytes(raw)
    got = {(r["variant"], r["sample"]): r["dosage"] for r in binary.read_bed(spark, str(tmp_path / "x.bed"), 5).collect()}
    assert got == {(i, j): {0: 2, 1: None, 2: 1, 3: 0}[int(c)] for i, row in enumerate(calls) for j, c in enumerate(row)}


def test_chain(spark, tmp_path):
    (tmp_path / "c.chain").write_text("chain 1 chr1 1000 + 10 100 chr1 1000 + 20 120 1\n30 5 10\n20\n\nchain 2 chr1 1000 + 500 600 chr2 1000 + 5 9 2\n100\n\nchain 3 chrX 9 + 0 9 chrX 9 - 0 9 3\n9\n")
    got = sorted((r["chr"], r["hg19_start"], r["hg19_end"], r["hg38_offset"]) for r in binary.read_chain(spark, str(tmp_path / "c.chain")).collect())
    assert got == [(1, 10, 40, 10), (1, 45, 65, 15)]


def test_bucketed_tables_join_without_a_shuffle(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    for name in ("pack", "dna"):
        tables.write_bucketed(t.view(name), f"bucketed_{name}", 4)
    plan = spark.table("bucketed_pack").hint("merge").join(spark.table("bucketed_dna"), ["chr", "pos", "allele_key"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_engine(spark, sf_dir, tmp_path):
    t, root = Inputs(spark, sf_dir), str(tmp_path)
    for name in ("traits", "trait_pgs", "pgs_scores", "pgs_performance", "pack"):
        t.view(name).write.parquet(f"{root}/{name}")
    t.view("dna").write.partitionBy("individual_id").parquet(f"{root}/unified")
    (tmp_path / "a.txt").write_text("# 23andMe\nrs1\t1\t2200\tAC\nrs2\t2\t100\tCC\n")
    engine = Engine(spark, root)
    assert engine.import_dna(str(tmp_path / "a.txt"), "NEW").count() == 2
    scores, traits = engine.calculate(["IND0", "IND1", "NEW"])
    assert scores.select("individual_id").distinct().count() == 3 and traits.count() == 30
    assert engine.top_variants("IND1", traits.filter("best_pgs_id is not null and individual_id = 'IND1'").first()["trait_id"]).count() > 0
    assert engine.export(f"{root}/copy") == 30 and engine.dashboard("IND1", category="ASIA").count() == 5 and engine.categories().count() == 5 and engine.summary().count() == 30
    with pytest.raises(FileNotFoundError):
        open_dna(spark, root, "NOBODY")


def test_streams_replay(spark, sf_dir, tmp_path):
    t = Inputs(spark, sf_dir)
    t.view("dna").repartition(2).write.parquet(f"{tmp_path}/dna")
    stream = lambda: events.read_stream(spark, f"{tmp_path}/dna", 100)
    first = scoring.score_stream(stream(), t.view("pack"), str(tmp_path)).count()
    again = scoring.score_stream(stream(), t.view("pack"), str(tmp_path)).count()  # nothing new: nothing is added
    assert first == again == 48


def test_a_person_in_two_batches(spark, sf_dir, tmp_path):
    """Files that come one a batch, each with a part of every person's genotypes, give the scores of the whole."""
    t = Inputs(spark, sf_dir)
    t.view("dna").repartition(3, "pos").write.parquet(f"{tmp_path}/dna")
    got = scoring.score_stream(events.read_stream(spark, f"{tmp_path}/dna", 1), t.view("pack"), str(tmp_path)).collect()
    want = score.pgs_aggregate(match.variant_match(t.view("pack"), t.view("dna"))).collect()
    plain = lambda rows: sorted((r["individual_id"], r["pgs_id"], *[round(r[c], 6) for c in sorted(r.asDict()) if c not in score.BY]) for r in rows)
    assert plain(got) == plain(want) and len(got) == 48
    assert spark.read.parquet(f"{tmp_path}/scores").select("batch").distinct().count() == 3


def test_event_streams(spark, sf_dir, tmp_path):
    tumbled = events.drain(events.tumbling(events.read_stream(spark, f"{sf_dir}/events.parquet")), str(tmp_path / "w"))
    assert tumbled.count() <= 977  # windows that may still change are held back
