"""Packs, genotypes and results as Parquet, laid out for the joins that read them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pack(pack: DataFrame, path: str, codec: str = "zstd", partitions: int | None = None) -> None:
    """One folder a chromosome, files sorted by position, so that filters skip files and row groups.

    Rows are dealt by chromosome and ranges of positions: a large chromosome is many files.
    """
    rows = pack.repartitionByRange(partitions, "chr", "pos") if partitions else pack.repartitionByRange("chr", "pos")
    rows.sortWithinPartitions("chr", "pos", "allele_key").write.mode("overwrite").option("compression", codec).partitionBy("chr").parquet(path)


def write_bucketed(rows: DataFrame, name: str, buckets: int = 64) -> None:
    """A table bucketed by the match keys: two such tables join without a shuffle."""
    rows.repartition(buckets, "chr", "pos", "allele_key").write.mode("overwrite").format("parquet").bucketBy(buckets, "chr", "pos", "allele_key").sortBy("chr", "pos", "allele_key").saveAsTable(name)


def read_packs(spark: SparkSession, *paths: str) -> DataFrame:
    """Packs by path, list or glob; ``chr`` and ``pgs_id`` filters reach the scan."""
    return spark.read.parquet(*paths)


def chromosome(pack: DataFrame, chr_code: int) -> DataFrame:
    """One chromosome of a pack: a partition filter."""
    return pack.filter(F.col("chr") == chr_code)


def manifest(spark: SparkSession, path: str) -> dict:
    """Counts by chromosome of a written pack."""
    counts = {r["chr"]: r["count"] for r in spark.read.parquet(path).groupBy("chr").count().collect()}  # 25 rows at most
    return {"format": "pack-v1", "total": sum(counts.values()), "chromosomes": dict(sorted(counts.items()))}


def concat(spark: SparkSession, paths: list[str], out: str, codec: str = "snappy") -> None:
    spark.read.parquet(*paths).write.mode("overwrite").option("compression", codec).parquet(out)


def validate(spark: SparkSession, path: str, least_rows: int = 1) -> int:
    """Row count of what was written; an error if there is too little."""
    n = spark.read.parquet(path).count()
    if n < least_rows:
        raise ValueError(f"{path} has {n} rows")
    return n


def write_documents(rows: DataFrame, path: str, column: str = "document") -> None:
    """JSON documents, one a line."""
    rows.select(column).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def norm_document(norms: DataFrame) -> DataFrame:
    """(pgs_id, document) of norm parameters, with the ancestry map where there is one."""
    fields = [c for c in ("m", "s", "n", "ancestry", "d") if c in norms.columns]
    return norms.select("pgs_id", F.to_json(F.struct(*fields)).alias("document"))


def read_manifest(text: str) -> dict:
    return json.loads(text)
