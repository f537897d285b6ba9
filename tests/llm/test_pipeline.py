"""The pipeline's stages, one after the other, against what each must do to its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from pgsloom.llm import common, decontam, mixing, simhash

SF = "/root/testdata/sf0.01"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    good, exact, near, clean, mixed = seen
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = [labels[r["doc_id"]] for r in good if r["doc_id"] in labels]
    assert sum(left) / len(left) > 0.98 and sum(left) > 0.97 * sum(labels.values())
    bare = lambda t: re.sub("[\x20\x09-\x0d]", "", t)
    best = {}
    for r in good:
        k = bare(r["text"])
        best[k] = min(best.get(k, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in exact} == {d for _, d in best.values()}
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in exact}
    kept = {r["doc_id"] for r in near}
    for d in set(sets) - kept:  # whatever goes is like something
        assert any(len(sets[d] & s) >= 0.8 * len(sets[d] | s) for o, s in sets.items() if o != d)
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r["doc_id"] for r in near if any(i in decontam.normal(r["text"]) for i in items)}
    assert {r["doc_id"] for r in clean} == kept - hit
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in clean}
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_links_that_are_done_take_no_round(spark, monkeypatch):
    """What the driver has to plan is in proportion to the rounds that links need."""
    written, write = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: written.append(1) or write(df))
    stars = spark.createDataFrame([(1, 2), (3, 1), (1, 1), (7, 8), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in common.components(stars).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} and len(written) == 1
    # a node with two roots, and a chain: neither is done
    for links, root in (([(1, 3), (2, 3)], 1), ([(5, 4), (4, 3)], 3)):
        nodes = {n for link in links for n in link}
        assert {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()} == dict.fromkeys(nodes, root)
    assert common.components(stars.limit(0)).count() == 0


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    """Spark takes the keys of fingerprints for as many rows as there are fingerprints, so it must not choose by their size."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    fps = spark.range(400).select(F.xxhash64(F.col("id") % 300).alias("fp"))
    assert "SortMergeJoin" in plan(simhash.links(fps.distinct())) and "Broadcast" not in plan(simhash.links(fps.distinct()))
    links, write = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: links.append(plan(df)) or write(df))
    near = spark.range(400).selectExpr("cast(id % 8 as bigint) as fp")
    assert simhash.component_links(near).count() >= 7
    stars = [p for p in links if "Generate explode(some" in p]
    assert len(stars) == 1 and "SortMergeJoin" in stars[0] and "Broadcast" not in stars[0]


def test_mixing_has_no_plan_of_many_shuffles(spark):
    """The driver renders the whole plan again for each of its stages."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mix(docs).taken()._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange |BroadcastExchange ", plan)) <= 4
