"""Scores of a reference panel, by a join for few samples and by blocks of variants for many.

A panel of up to ``FEW`` samples is a row a variant with the copies of every sample (``wide_panel``). Scores are then a join
and one sum a sample, combined before the shuffle: nothing but Spark's own join and aggregate, whatever the number of scores.

A larger panel goes by blocks, one product of weights and dosages a block. The panel has a row for each variant, with the places of the samples that are called and their dosages. Variants fall into
blocks by a hash, so that a block is a bounded part of the panel wherever its scores' variants lie. Each block multiplies
its weights (scores by variants) with its dosages (variants by samples); the arrays of scores that come out, one number a
sample, are added up in the task first and then by score. What is shuffled is a row for each variant of the panel, a row for
each variant of a score, and an array for each score and task: nothing that has a row for each variant and sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pgsloom.operators.match import KEYS

#: Samples that a row of a joined variant carries, at most.
FEW = 32
#: Products that a block holds at once, and arrays that a task adds up before it sends them on, in numbers.
AT_ONCE, HELD = 1 << 21, 1 << 21


def sample_names(matrix: DataFrame) -> list:
    """The samples of a panel in long form, in order; a few thousand, whatever the number of variants."""
    return sorted(r[0] for r in matrix.select("sample").filter("sample is not null").distinct().collect())


def panel_of(matrix: DataFrame, samples: list) -> DataFrame:
    """A panel (chr, pos, allele_key, alt, at, dosages) from one in long form; missing genotypes are not in the arrays."""
    index = matrix.sparkSession.createDataFrame(list(enumerate(samples)), f"at int, sample {matrix.schema['sample'].dataType.simpleString()}")
    called = F.when(F.col("dosage").isNotNull(), F.struct("at", F.col("dosage").cast("double").alias("dosage")))
    return matrix.join(index, "sample").groupBy(*KEYS, "alt").agg(F.collect_list(called).alias("c")).select(*KEYS, "alt", F.col("c.at").alias("at"), F.col("c.dosage").alias("dosages"))


def dosages(panel: pa.Table, n_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Copies of ALT, and of the other allele, of each variant and sample; none where the genotype is missing."""
    lists = panel.column("at").combine_chunks()
    row = np.repeat(np.arange(panel.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = lists.flatten().to_numpy()
    value = panel.column("dosages").combine_chunks().flatten().to_numpy()
    one, two = np.zeros((panel.num_rows, n_samples)), np.zeros((panel.num_rows, n_samples))
    np.add.at(one, (row, at), value)
    np.add.at(two, (row, at), 2.0 - value)
    return one, two


def wide_panel(matrix: DataFrame, samples: list) -> DataFrame:
    """(chr, pos, allele_key, alts): for each ALT the copies of it, and of the other allele, that each of few samples has; none where the genotype is missing."""
    n, d, aggregates = len(samples), F.col("dosage").cast("double"), []
    for i, s in enumerate(samples):
        aggregates += [F.sum(F.when(F.col("sample") == F.lit(s), d)).alias(f"d{i}"), F.count(F.when(F.col("sample") == F.lit(s), d)).alias(f"c{i}")]
    rows = matrix.filter("sample is not null").groupBy(*KEYS, "alt").agg(*aggregates)
    one = [F.coalesce(f"d{i}", F.lit(0.0)) for i in range(n)]
    two = [2.0 * F.col(f"c{i}") - one[i] for i in range(n)]
    alts = F.collect_list(F.struct("alt", F.array(*one).alias("one"), F.array(*two).alias("two"))).alias("alts")
    return rows.groupBy(*KEYS).agg(alts)


def copies(effect: Column, alts: Column, n_samples: int) -> Column:
    """Copies of an effect allele by sample, over all ALTs of its key."""
    of = lambda a: F.when(effect == a["alt"], a["one"]).otherwise(a["two"])
    zero = F.array(*[F.lit(0.0)] * n_samples)
    return F.when(F.size(alts) == 1, of(F.get(alts, F.lit(0)))).otherwise(F.aggregate(alts, zero, lambda t, a: F.zip_with(t, of(a), lambda x, y: x + y)))


def joined_scores(pack: DataFrame, panel: DataFrame, n_samples: int, by: tuple[str, ...] = ("pgs_id",)) -> DataFrame:
    """What ``block_scores`` gives, of a panel of few samples in wide form."""
    w = F.coalesce(F.col("effect_weight"), F.lit(0.0)).cast("double").alias("w")
    rows = pack.select(*KEYS, *by, "effect_allele", w).join(panel, KEYS).select(*by, "w", copies(F.col("effect_allele"), F.col("alts"), n_samples).alias("c"))
    sums = rows.groupBy(*by).agg(*[F.sum(F.col("w") * F.get("c", F.lit(i))).alias(f"s{i}") for i in range(n_samples)])
    return sums.select(*by, F.array(*[F.col(f"s{i}") for i in range(n_samples)]).alias("scores"))


def block_scores(pack: DataFrame, panel: DataFrame, n_samples: int, by: tuple[str, ...] = ("pgs_id",), per_block: int = 2048) -> DataFrame:
    """(by, scores): an array with the score of each sample, for each score that has a variant of the panel.

    A variant whose effect allele is ALT counts its dosage, another one the rest of two; a missing genotype counts
    nothing. Null weights count as 0.
    """
    names = list(by)
    blocks = panel.count() // per_block + 1
    block = F.pmod(F.xxhash64(*KEYS), F.lit(blocks)).alias("block")
    left = pack.select(*KEYS, *names, "effect_allele", F.coalesce(F.col("effect_weight"), F.lit(0.0)).cast("double").alias("w"), block)
    right = panel.select(*KEYS, "alt", "at", "dosages", block)
    types = [left.schema[c].dataType.simpleString() for c in names]
    schema = ", ".join([*(f"{c} {t}" for c, t in zip(names, types)), "scores array<double>"])

    def product(weights: pa.Table, variants: pa.Table) -> pa.Table:
        index = variants.select([*KEYS, "alt"]).append_column("row", pa.array(np.arange(variants.num_rows)))
        met = weights.join(index, KEYS, join_type="inner").combine_chunks()
        if not met.num_rows:
            return pa.table([*[met.column(c) for c in names], pa.array([], pa.list_(pa.float64()))], names=[*names, "scores"])
        of = np.zeros(met.num_rows, np.int64)
        for c in names:  # null is a value
            code = met.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            _, of = np.unique(of * (int(code.max()) + 1) + code, return_inverse=True)
        scores = met.select(names).take(pa.array(np.unique(of, return_index=True)[1]))
        row, w = met.column("row").to_numpy(), met.column("w").to_numpy()
        direct = np.array(met.column("effect_allele").to_pylist(), object) == np.array(met.column("alt").to_pylist(), object)
        one, two = dosages(variants, n_samples)
        # most scores have few variants of a block: products of the pairs that are there, added up by score
        order = np.argsort(of, kind="stable")
        out, step = np.zeros((scores.num_rows, n_samples)), max(1, AT_ONCE // max(n_samples, 1))
        for low in range(0, len(order), step):
            some = order[low : low + step]
            products = np.where(direct[some, None], one[row[some]], two[row[some]]) * w[some, None]
            starts = np.flatnonzero(np.r_[True, np.diff(of[some]) != 0])
            out[of[some][starts]] += np.add.reduceat(products, starts, axis=0)
        ends = pa.array(np.arange(scores.num_rows + 1) * n_samples, pa.int32())
        return pa.table([*[scores.column(c) for c in names], pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[*names, "scores"])

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrays of the same score in this task as one, as long as they are few enough to be held."""
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held), key_types)] if held else [pa.array([], t) for t in key_types]
            flat = np.concatenate(list(held.values())) if held else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * n_samples, pa.int32()), pa.array(flat))
            return pa.RecordBatch.from_arrays([*columns, lists], names=[*names, "scores"])

        key_types = None
        for part in parts:
            key_types = part.schema.types[:-1]
            keys = zip(*[c.to_pylist() for c in part.columns[:-1]])
            for key, scores in zip(keys, part.column(len(names))):
                values = scores.values.to_numpy()
                held[key] = held[key] + values if key in held else values.copy()  # a view would keep its whole batch
                if len(held) * n_samples >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def total(key: tuple, parts: pa.Table) -> pa.Table:
        whole = np.sum([x.values.to_numpy() for x in parts.column("scores")], axis=0)
        return parts.slice(0, 1).select(names).append_column("scores", pa.array([whole], pa.list_(pa.float64())))

    met = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(product, schema)
    return met.mapInArrow(added, schema).groupBy(*names).applyInArrow(total, schema)


def long_form(scores: DataFrame, samples: list) -> DataFrame:
    """A row for each score and sample."""
    names = [c for c in scores.columns if c != "scores"]
    index = scores.sparkSession.createDataFrame(list(enumerate(samples)), ["at", "sample"])
    rows = scores.select(*names, F.posexplode("scores").alias("at", "score"))
    return rows.join(index, "at").select(*names, "sample", "score")
