"""The store of results: merges keep what is there, change nothing twice, and leave the old state when they break off."""

import os

import pytest
from pyspark.sql import functions as F

from pgsloom.__main__ import main
from pgsloom.engine import Engine
from pgsloom.plans.fixtures import Inputs
from pgsloom.sources import store
from pgsloom.sources.store import Conflict, ResultStore

SCHEMA = "person string, trait string, score string, z double"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def held(s, version=None):
    return sorted((tuple(r) for r in s.read(version).select("person", "trait", "score", "z").collect()), key=repr)


@pytest.fixture
def some(spark, tmp_path):
    return ResultStore(spark, f"file://{tmp_path}/s", ["person", "trait", "score"], "trait")


def test_merge_keeps_the_rest(spark, some):
    assert not some.exists()
    with pytest.raises(FileNotFoundError):
        some.read()
    assert some.merge(rows(spark, ("a", "T1", "p", 1.0), ("a", "T2", "p", 2.0), ("a", "T/3 =é", "p", 3.0), ("a", None, "p", 4.0))) == 1
    before = some.manifest()["parts"]
    assert some.merge(rows(spark, ("b", "T1", "p", 5.0), ("a", "T1", "p", 6.0), ("a", "T2", "p", 2.0))) == 2
    assert held(some) == sorted([("a", "T1", "p", 6.0), ("a", "T2", "p", 2.0), ("a", "T/3 =é", "p", 3.0), ("a", None, "p", 4.0), ("b", "T1", "p", 5.0)], key=repr)
    after = some.manifest()["parts"]
    assert {p for p in before if before[p] != after[p]} == {"trait=T1"}  # a part in which nothing differs keeps its files
    assert held(some, 1)[0] == ("a", "T/3 =é", "p", 3.0) and len(held(some, 1)) == 4
    assert some.merge(rows(spark, ("a", None, "p", float("nan")), ("a", "T/3 =é", "q", None))) == 3
    assert some.merge(rows(spark, ("a", None, "p", float("nan")), ("a", "T/3 =é", "q", None))) is None
    assert some.merge(rows(spark)) is None and some.versions() == [1, 2, 3]


def test_repeated_keys_and_columns(spark, some):
    some.merge(rows(spark, ("a", "T1", "p", 1.0), ("a", "T1", "p", 3.0), ("a", "T1", "p", None)))
    assert held(some) == [("a", "T1", "p", 3.0)]
    some.merge(spark.createDataFrame([("b", "T1", "p", 7)], "person string, trait string, score string, extra int"))
    assert sorted(map(tuple, some.read().select("person", "z", "extra").collect())) == [("a", 3.0, None), ("b", None, 7)]


def test_delete(spark, some):
    some.merge(rows(spark, ("a", "T1", "p", 1.0), ("b", "T1", "p", 2.0), ("a", "T2", "p", 3.0)))
    assert some.delete(spark.createDataFrame([("z",)], "person string")) is None
    assert some.delete(spark.createDataFrame([("a",)], "person string")) == 2
    assert held(some) == [("b", "T1", "p", 2.0)] and list(some.manifest()["parts"]) == ["trait=T1"]
    assert some.delete(spark.createDataFrame([("b",)], "person string")) == 3 and held(some) == []
    assert some.merge(rows(spark, ("c", "T1", "p", 1.0))) == 4 and held(some) == [("c", "T1", "p", 1.0)]


def test_a_broken_merge_leaves_the_old_state(spark, some, monkeypatch, tmp_path):
    some.merge(rows(spark, ("a", "T1", "p", 1.0)))
    # a task that fails while parts are written
    bad = rows(spark, ("a", "T1", "p", 2.0)).withColumn("z", F.when(F.lit(True), F.raise_error(F.lit("lost"))).cast("double"))
    with pytest.raises(Exception, match="lost"):
        some.merge(bad)
    assert held(some) == [("a", "T1", "p", 1.0)]

    def broken(self, manifest):
        raise OSError("before the rename")

    monkeypatch.setattr(store.ResultStore, "_commit", broken)
    with pytest.raises(OSError):
        some.merge(rows(spark, ("a", "T1", "p", 2.0)))
    assert held(some) == [("a", "T1", "p", 1.0)] and os.listdir(tmp_path / "s" / "batch") == []
    monkeypatch.undo()
    assert some.vacuum() == 1 and held(some) == [("a", "T1", "p", 1.0)]  # what the broken merge wrote


def test_two_writers(spark, some, monkeypatch):
    some.merge(rows(spark, ("a", "T1", "p", 1.0)))
    first, commit = [], store.ResultStore._commit

    def other_first(self, manifest):
        if not first:
            first.append(1)
            ResultStore(spark, self.folder, self.keys, self.by).merge(rows(spark, ("b", "T1", "p", 9.0)))
        commit(self, manifest)

    monkeypatch.setattr(store.ResultStore, "_commit", other_first)
    with pytest.raises(Conflict):
        some.merge(rows(spark, ("c", "T1", "p", 2.0)))
    assert held(some) == [("a", "T1", "p", 1.0), ("b", "T1", "p", 9.0)]


def test_vacuum_and_pruning(spark, some):
    for k in range(4):
        some.merge(rows(spark, ("a", "T1", "p", float(k)), ("a", "T2", "p", 0.0)))
    assert some.vacuum(keep=2) == 1 and some.versions() == [3, 4] and len(held(some)) == 2  # the first folder still has T2
    plan = some.read().filter("trait = 'T2'")
    assert len(plan.inputFiles()) == 1 or "PartitionFilters: [isnotnull(trait" in plan._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def engine(spark, sf_dir, tmp_path):
    t, root = Inputs(spark, sf_dir), str(tmp_path)
    for name in ("traits", "trait_pgs", "pgs_scores", "pgs_performance", "pack"):
        t.view(name).write.parquet(f"{root}/{name}")
    t.view("dna").write.partitionBy("individual_id").parquet(f"{root}/unified")
    t.view("dna").filter("not imputed").write.partitionBy("individual_id").parquet(f"{root}/genotyped")
    return Engine(spark, root)


def test_engine_keeps_other_people(spark, engine):
    assert engine.pending().count() == 5 * 25
    one = sorted(engine.calculate(["IND1"])[0].collect())
    two, traits = engine.calculate(["IND2"])
    assert sorted(two.filter("individual_id = 'IND1'").collect()) == one
    assert {(r["individual_id"], r["count"]) for r in two.groupBy("individual_id").count().collect()} == {("IND1", 10), ("IND2", 10)}
    assert {r["individual_id"] for r in traits.collect()} == {"IND1", "IND2"}
    names = ("pgs_results", "trait_results")
    versions, everything = [engine.store(n).versions() for n in names], [sorted(engine.store(n).read().collect(), key=repr) for n in names]
    engine.calculate(["IND2"])
    engine.calculate(["IND1", "IND2"])
    assert [engine.store(n).versions() for n in names] == versions == [[1, 2], [1, 2]]  # again: nothing differs, stamps neither
    assert [sorted(engine.store(n).read().collect(), key=repr) for n in names] == everything
    assert engine.pending().filter("individual_id in ('IND1', 'IND2')").count() == 2 * 25 - traits.count()
    some = [r["trait_id"] for r in traits.select("trait_id").distinct().limit(2).collect()]
    engine.calculate(["IND3"], some)
    assert {r["trait_id"] for r in engine.store("trait_results").read().filter("individual_id = 'IND3'").collect()} == set(some)
    engine.forget(["IND1"])
    assert {r["individual_id"] for r in engine.store("pgs_results").read().collect()} == {"IND2", "IND3"}


def test_command_line(spark, engine, capsys):
    def said(*words):
        main([words[0], engine.root, *words[1:]])
        return capsys.readouterr().out

    trait = engine.scores().first()["trait_id"]
    assert said("traits").count("EFO_") == 25 and trait in said("pgs", "--trait", trait) and said("pending").count("IND1") == 25
    assert said("score", "--people", "IND1,IND2", "--traits", trait).strip() == "2" == str(engine.store("trait_results").read().count())
    assert said("traits", "--individual", "IND1", "--state", "calculated").count("EFO_") == 1
    said("forget", "IND1")
    assert engine.store("trait_results").read().count() == 1 and said("report").count("IND2") == 1
    main(["list"])
    assert "store_merge" in capsys.readouterr().out
