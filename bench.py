"""Headline queries, one JSON line.

Each time is of the whole query from the Parquet tables to the last row (written to a sink that drops rows), the better of
two runs (the first also compiles code). ``pack_scoring`` scores against packs that are already
laid out as the engine writes them, which is what the published single-node figures measure.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = ["pgs_aggregate", "variant_match", "pgs_results", "trait_result", "top_variants", "weight_histogram", "hwe_norm_oriented", "ancestry_norm", "empirical_norm", "merge_imputed", "liftover", "bake_metadata", "dr2", "standardize", "validation"]


def main() -> None:
    from pgsloom.operators import match, score
    from pgsloom.plans.fixtures import Inputs
    from pgsloom.queries import QUERIES
    from pgsloom.sources import tables

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", f"{work}/warehouse").config("spark.local.dir", f"{work}/local").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make) -> float:
        best = float("inf")
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return round(best, 3)

    t = Inputs(spark, sf_dir)
    tables.write_pack(t.view("pack"), f"{work}/pack", partitions=int(cpus))
    t.view("dna").write.partitionBy("individual_id").parquet(f"{work}/dna")
    t.view("pack").coalesce(1).sortWithinPartitions("chr", "pos").write.parquet(f"{work}/flat")
    one = spark.read.parquet(f"{work}/dna").filter("individual_id = 'IND1'")
    times = {
        "pack_scoring_one_person": timed(lambda: score.pgs_aggregate(match.variant_match(spark.read.parquet(f"{work}/flat"), one))),
        "pack_scoring_all_people": timed(lambda: score.pgs_aggregate(match.variant_match(spark.read.parquet(f"{work}/pack"), spark.read.parquet(f"{work}/dna")))),
    }
    for name in HEADLINE:
        times[name] = timed(lambda name=name: QUERIES[name](spark, sf_dir))
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
