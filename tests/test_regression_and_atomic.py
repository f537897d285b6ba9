"""Fits against NumPy; outputs that replace others as a whole."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pgsloom.operators import regression
from pgsloom.sources import atomic


def test_fits_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(600, 4)) * [1, 100, 1e-3, 1] + [0, 1e4, 5, 0], rng.integers(0, 3, 600)
    y = x @ [1.0, -0.02, 300.0, 0.5] + g * 7 + rng.normal(size=600)
    data = [(f"P{k}", *map(float, row), float(v)) for k, row, v in zip(g, x, y)]
    rows = spark.createDataFrame([*data, ("P0", None, 1.0, 1.0, 1.0, 1.0), ("P0", float("nan"), 1.0, 1.0, 1.0, 1.0), ("P9", 1.0, 1.0, 1.0, 1.0, None)], "g string, a double, b double, c double, d double, y double").repartition(5)
    fits = {r["g"]: r for r in regression.fit(rows, ["g"], "y", ["a", "b", "c", "d"]).collect()}
    assert set(fits) == {"P0", "P1", "P2"}
    for k in range(3):
        some = g == k
        want = np.linalg.lstsq(np.column_stack([np.ones(some.sum()), x[some]]), y[some], rcond=None)[0]
        assert fits[f"P{k}"]["n"] == some.sum()
        assert [fits[f"P{k}"]["intercept"], *fits[f"P{k}"]["coefficients"]] == pytest.approx(want, rel=1e-6)
    left = regression.residuals(rows, regression.fit(rows, ["g"], "y", ["a", "b", "c", "d"]), ["g"], "y", ["a", "b", "c", "d"])
    by = {r["g"]: r for r in left.filter("not isnan(a)").groupBy("g").agg(F.avg("residual").alias("m"), F.corr("residual", "b").alias("r")).collect()}
    assert abs(by["P1"]["m"]) < 1e-8 and abs(by["P1"]["r"]) < 1e-8 and by["P9"]["m"] is None and left.columns == [*rows.columns, "residual"]


def test_fits_that_have_no_single_solution(spark):
    """A constant component, one that is twice another, one row alone, a score that does not vary."""
    rows = spark.createDataFrame([("A", float(i), 2.0 * i, 5.0, 3.0 * i + 1) for i in range(6)] + [("B", 1.0, 2.0, 3.0, 4.0), ("C", 1.0, 2.0, 3.0, 7.0), ("C", 2.0, 1.0, 3.0, 7.0)], "g string, a double, b double, c double, y double")
    left = regression.residuals(rows, regression.fit(rows, ["g"], "y", ["a", "b", "c"]), ["g"], "y", ["a", "b", "c"]).collect()
    assert all(abs(r["residual"]) < 1e-9 for r in left)
    got = {r["g"]: r for r in regression.fit(rows, ["g"], "y", ["a", "b", "c"]).collect()}
    assert got["A"]["coefficients"][2] == 0 and got["A"]["r2"] == pytest.approx(1) and got["C"]["r2"] == 0 and got["B"]["intercept"] == 4.0
    plan = regression.fit(rows, ["g"], "y", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") == 1 and "partial_covar_pop" in plan


def held(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(path).collect())


def test_replace(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    assert atomic.replace(spark.range(5), path)["rows"] == 5
    with pytest.raises(atomic.Refused, match="0 rows"):
        atomic.replace(spark.range(0), path)
    with pytest.raises(atomic.Refused, match="3 rows"):
        atomic.replace(spark.range(3), path, least_rows=4)
    with pytest.raises(atomic.Refused, match="bytes"):
        atomic.replace(spark.range(3), path, least_bytes=1_000_000)
    with pytest.raises(Exception, match="lost"):
        atomic.replace(spark.range(9).withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))), path)
    assert held(spark, path) == [0, 1, 2, 3, 4] and os.listdir(tmp_path) == ["t"]
    assert atomic.replace(spark.range(2), path)["rows"] == 2 and held(spark, path) == [0, 1]


def test_a_crash_between_the_renames(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    atomic.replace(spark.range(5), path)
    os.rename(tmp_path / "t", tmp_path / "t.old-1")  # where a process died
    spark.range(7).write.parquet(f"{path}.new-1")
    assert atomic.recover(spark, path) and held(spark, path) == [0, 1, 2, 3, 4] and os.listdir(tmp_path) == ["t"]
    os.mkdir(tmp_path / "t.old-2")
    assert not atomic.recover(spark, path) and os.listdir(tmp_path) == ["t"]
    assert not atomic.recover(spark, f"{path}/none/at/all")


def test_documents(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/m.json"
    atomic.write_document(spark, {"a": "é", "b": [1]}, path)
    with pytest.raises(atomic.Refused, match="name"):
        atomic.write_document(spark, {}, path, ["name"])
    with pytest.raises(TypeError):
        atomic.write_document(spark, {"x": object()}, path)
    assert atomic.read_document(spark, path) == {"a": "é", "b": [1]}
    atomic.write_document(spark, {"c": 1}, path)
    assert atomic.read_document(spark, path) == {"c": 1} and [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == ["m.json"]
