"""Readers that take files by ranges: many partitions, files beyond 2 GB, and no more bytes than needed."""

import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pgsloom.operators import blocks
from pgsloom.queries.sources import write_beds
from pgsloom.sources import bed, binary, consumer, scoring_files


def test_bed_by_ranges(spark, tmp_path):
    rnd = random.Random(1)
    codes = {v: [rnd.randrange(4) for _ in range(7)] for v in range(50)}
    write_beds(spark.createDataFrame(sorted(codes.items()), "variant long, codes array<int>").coalesce(1), f"file://{tmp_path}/b")
    want = {(v, s): {0: 2, 1: None, 2: 1, 3: 0}[c] for v, row in codes.items() for s, c in enumerate(row)}
    rows = bed.read_bed(spark, f"{tmp_path}/b", 7, rangeBytes=9)
    assert rows.rdd.getNumPartitions() == 13
    assert {(r["variant"], r["sample"]): r["dosage"] for r in rows.collect()} == want
    some = bed.read_bed(spark, f"file://{tmp_path}/b", 7, from_=10, to=20, only=[2, 5])
    assert {(r["variant"], r["sample"]): r["dosage"] for r in some.collect()} == {k: v for k, v in want.items() if 10 <= k[0] < 20 and k[1] in (2, 5)}
    panel = bed.read_bed(spark, f"{tmp_path}/b", 7, form="panel")
    assert {(r["variant"], s): d for r in panel.collect() for s, d in zip(r["at"], r["dosages"])} == {k: v for k, v in want.items() if v is not None}


def test_bed_filters_are_pushed(spark, tmp_path):
    write_beds(spark.createDataFrame([(v, [v % 4] * 5) for v in range(40)], "variant long, codes array<int>").coalesce(1), f"file://{tmp_path}/b")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = bed.read_bed(spark, f"{tmp_path}/b", 5, rangeBytes=2).filter("variant >= 4 and variant < 8 and sample in (1, 3) and dosage is not null")
        assert rows.rdd.getNumPartitions() == 4  # of 40
        assert sorted((r["variant"], r["sample"], r["dosage"]) for r in rows.collect()) == [(v, s, {0: 2, 2: 1, 3: 0}[v % 4]) for v in (4, 6, 7) for s in (1, 3)]
        assert bed.read_bed(spark, f"{tmp_path}/b", 5).filter("variant = 3 and variant > 5").count() == 0
        assert bed.read_bed(spark, f"{tmp_path}/b", 5).filter("sample = 9").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bed_beyond_2_gb(spark, tmp_path):
    """A file of 3 GB (sparse on disk): no task or row holds it, and a range of variants reads its own bytes."""
    n, width = 4000, 1000
    variants = 3_000_000
    with open(tmp_path / "big.bed", "wb") as file:
        file.write(bed.MAGIC)
        file.truncate(3 + variants * width)
        file.seek(3 + (variants - 1) * width)
        file.write(b"\xff" * width)
    whole = bed.read_bed(spark, str(tmp_path / "big.bed"), n, rangeBytes=64 << 20, only=[0, 3999])
    assert whole.rdd.getNumPartitions() == 45
    last = bed.read_bed(spark, str(tmp_path / "big.bed"), n, only=[0, 3999], from_=variants - 2)
    assert sorted((r["variant"], r["sample"], r["dosage"]) for r in last.collect()) == [(variants - 2, 0, 2), (variants - 2, 3999, 2), (variants - 1, 0, 0), (variants - 1, 3999, 0)]


def test_bed_errors(spark, tmp_path):
    (tmp_path / "a.bed").write_bytes(bed.MAGIC + b"123")
    with pytest.raises(Exception, match="no matrix of 8 samples"):
        bed.read_bed(spark, str(tmp_path / "a.bed"), 8).collect()
    (tmp_path / "b.bed").write_bytes(b"xyz" + b"1234")
    with pytest.raises(Exception, match="not a variant-major"):
        bed.read_bed(spark, str(tmp_path / "b.bed"), 8).collect()
    (tmp_path / "c.bed").write_bytes(bed.MAGIC)
    assert bed.read_bed(spark, str(tmp_path / "c.bed"), 8).collect() == []


VCF = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n1\t5\t.\tA\tG\t.\t.\t.\tGT:DS\t0|1:0.9\t./.:.\n1\t5\t.\tA\tG\t.\t.\t.\tGT:DS\t1|1:1.9\t0/0:0\n2\t6\t.\tC\tT\t.\t.\t.\tDS:GT\t1\n2\t7\t.\tC\tT,G\t.\t.\t.\tGT\t0|1\t0|1\nX\t8\t.\tC\tT\t.\t.\t.\tHDS\t1\t1\n"


def test_vcf_in_one_scan(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    rows = consumer.read_vcf(spark, str(tmp_path / "a.vcf"), "GT", "DS")
    got = sorted((tuple(r) for r in rows.collect()), key=repr)
    assert got == sorted([(1, 5, "A", "G", 0, "0|1", "0.9"), (1, 5, "A", "G", 1, "./.", "."), (1, 5, "A", "G", 0, "1|1", "1.9"), (1, 5, "A", "G", 1, "0/0", "0"), (2, 6, "C", "T", 0, None, "1")], key=repr)
    plan = consumer.read_dosages(spark, str(tmp_path / "a.vcf"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan  # records that repeat do not multiply
    panel = consumer.read_panel(spark, str(tmp_path / "a.vcf")).filter("pos = 5").collect()
    assert sorted((list(r["at"]), list(r["dosages"])) for r in panel) == [([0], [1.0]), ([0, 1], [2.0, 0.0])]
    pack = panel[0]
    weights = spark.createDataFrame([("P", 1, 5, pack["allele_key"], "A", 0.5)], "pgs_id string, chr int, pos int, allele_key long, effect_allele string, effect_weight double")
    assert [list(r["scores"]) for r in blocks.block_scores(weights, consumer.read_panel(spark, str(tmp_path / "a.vcf")), 2).collect()] == [[0.5, 1.0]]


def chain_file(chains, rnd):
    """The text of chains and the blocks that they stand for."""
    text, want = "# a comment\n", []
    for k in range(chains):
        name = rnd.choice(["chr1", "chrX", "chr2"])
        other, strand = rnd.choice([name, name, "chrUn"]), rnd.choice("++-")
        at, to = rnd.randrange(1000), rnd.randrange(1000)
        text += f"chain 1 {name} 9999 + {at} 9 {other} 9999 {strand} {to} 9 {k}\n"
        for i in range(rnd.randint(1, 12)):
            size, gap, other_gap = rnd.randint(1, 50), rnd.randint(0, 9), rnd.randint(0, 9)
            if other == name and strand == "+":
                want.append(({"chr1": 1, "chr2": 2, "chrX": 23}[name], at, at + size, to - at))
            at, to = at + size + gap, to + size + other_gap
            text += f"{size}\t{gap} {other_gap}\n"
        text += rnd.choice([f"{3}\n\n", "3\n\n", "3\n"])
        if other == name and strand == "+":
            want.append(({"chr1": 1, "chr2": 2, "chrX": 23}[name], at, at + 3, to - at))
    return text, want


@pytest.mark.parametrize("split", ["64m", "200b"])
def test_chain_in_splits(spark, tmp_path, split):
    rnd, want = random.Random(5), []
    for k in range(2):
        text, blocks_ = chain_file(12, rnd)
        (tmp_path / f"{k}.chain").write_text(text)
        want += blocks_
    for key, value in (("spark.sql.files.maxPartitionBytes", split), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(key, value)
    try:
        rows = binary.read_chain(spark, f"{tmp_path}/*.chain")
        if split == "200b":
            assert binary.lines_in_order(spark, f"{tmp_path}/*.chain").select("file", "block").distinct().count() > 10
        assert sorted(map(tuple, rows.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_headers_read_no_more_than_they_need(spark, tmp_path):
    rnd = np.random.default_rng(1)
    body = "\n".join(f"rs{i}\t{x}" for i, x in enumerate(rnd.random(200_000)))
    (tmp_path / "a.txt").write_text("#c\n\n  \nrsID\tw\n" + body)
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"## " + b"x" * 200_000 + b"\n") + gzip.compress(("a\tb\r\n" + body).encode()))
    (tmp_path / "c.txt").write_text("only")
    (tmp_path / "d.txt").write_text("# nothing\n")
    (tmp_path / "e.txt").write_text("")
    got = {re.sub(r".*/", "", r["file"]): (r["header"], r["bytes_read"]) for r in scoring_files.headers(spark, f"{tmp_path}/*", step=4096).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.txt": "rsID\tw", "b.txt.gz": "a\tb", "c.txt": "only"}
    assert got["a.txt"][1] == 4096 and got["b.txt.gz"][1] <= 8192 and (tmp_path / "b.txt.gz").stat().st_size > 1_000_000
    assert scoring_files.headers(spark, f"{tmp_path}/*").filter(F.col("header") == "only").count() == 1
