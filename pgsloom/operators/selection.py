"""Exact order statistics without a sort of the whole: counts by ranges decide where to look, a filter does the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096


def quantiles(rows: DataFrame, column: str, shares: list[float], bins: int = BINS, small: int = 10_000) -> list[float | None]:
    """Exact quantiles of a column, interpolated between neighbours as SQL's continuous percentile does; nulls and NaN are left out.

    A pass counts the values in ``bins`` equal ranges between the least and the greatest value and keeps, for each rank
    that is wanted, the range that it falls in with its own least and greatest value; the next pass looks into those. It
    ends when a range has one value, or at most ``small`` values, which are sorted. The driver sees no more than
    ``bins`` counts or ``small`` values for each rank, whatever the table's size. Without values every quantile is None.
    """
    v = F.col("v")
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    infinite = F.lit(math.inf)
    finite = F.when(F.abs("v") < infinite, v)
    n, below, above, low, high = values.agg(F.count("*"), F.count_if(v == -infinite), F.count_if(v == infinite), F.min(finite), F.max(finite)).first()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    wanted = sorted({math.floor(p) for p in places} | {math.ceil(p) for p in places})
    found: dict[int, float] = {r: -math.inf for r in wanted if r < below} | {r: math.inf for r in wanted if r >= n - above}
    # (least, greatest, number of values before, wanted ranks) of ranges that are still open
    open_ranges = [(low, high, below, [r for r in wanted if r not in found])] if len(found) < len(wanted) else []
    few: list[tuple[float, float, int, list[int]]] = []
    while open_ranges:
        k = bin_of = None
        for i, (low, high, *_) in enumerate(open_ranges):
            inside = v.between(low, high)
            half = 0.5 if math.isinf(high - low) else 1.0  # the difference of two large values may not be a number
            share = F.lit(0.0) if low == high else (v * half - low * half) / (high * half - low * half)
            at = F.least(F.floor(share * bins), F.lit(bins - 1).cast("long"))
            k = F.when(inside, i) if k is None else k.when(inside, i)
            bin_of = F.when(inside, at) if bin_of is None else bin_of.when(inside, at)
        counts = values.select(k.alias("k"), bin_of.alias("b"), "v").filter("k is not null").groupBy("k", "b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        again = []
        for i, (_, _, before, ranks) in enumerate(open_ranges):
            for r in sorted((r for r in counts if r["k"] == i), key=lambda r: r["b"]):
                mine = [x for x in ranks if before <= x < before + r["n"]]
                if mine and r["low"] == r["high"]:
                    found |= dict.fromkeys(mine, r["low"])
                elif mine:
                    (few if r["n"] <= small else again).append((r["low"], r["high"], before, mine))
                before += r["n"]
        open_ranges = again
    if few:
        near = F.lit(False)
        for low, high, *_ in few:
            near = near | v.between(low, high)
        rest = sorted(r["v"] for r in values.filter(near).collect())
        for low, high, before, ranks in few:
            own = [x for x in rest if low <= x <= high]
            found |= {r: own[r - before] for r in ranks}
    out = []
    for p in places:
        a, b = found[math.floor(p)], found[math.ceil(p)]
        out.append(a if a == b else a + (b - a) * (p - math.floor(p)))
    return out


def least_by_hash(rows: DataFrame, by: list[str], k: str, hashed: Column, ties: list[str], bits: int = 60, bins: int = BINS) -> DataFrame:
    """Of each group the ``k`` rows (a column, equal within a group) with the least hash, a long of ``bits`` bits, then by ``ties``.

    Rows are counted in ranges of the hash; the range that the k-th falls in is gathered alone (one row in ``bins``) and
    gives the k-th hash, and a filter takes what is not above it. Nothing sorts or gathers a group: each pass joins the
    rows with one row a group. Rows alike in all of these are taken together; groups without a k are left out.
    """
    rows = rows.withColumn("__h", hashed)
    rows = rows.withColumn("__b", F.least(F.floor(F.col("__h") / F.lit(2.0**bits) * bins), F.lit(bins - 1).cast("long")))
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("n"), F.max(k).alias("k"))
    state = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"))

    def step(s: Column, x: Column) -> Column:
        here = s["bin"].isNull() & (s["seen"] + x["n"] >= F.col("k"))
        return F.struct((s["seen"] + x["n"]).alias("seen"), F.when(here, x["__b"]).otherwise(s["bin"]).alias("bin"), F.when(here, s["seen"]).otherwise(s["before"]).alias("before"))

    cuts = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__b", "n"))).alias("ranges"), F.max("k").alias("k"))
    cuts = cuts.withColumn("cut", F.aggregate("ranges", state, step)).select(*by, F.col("cut.bin").alias("__cut"), (F.col("k") - F.col("cut.before")).cast("int").alias("__nth"))
    one = F.struct("__h", *ties)
    edge = rows.join(cuts, by).filter(F.col("__b") == F.col("__cut")).groupBy(*by, "__nth").agg(F.sort_array(F.collect_list(one)).alias("near"))
    last = edge.filter("__nth > 0").select(*by, F.get("near", F.col("__nth") - 1).alias("__last"))
    # a group of fewer than k rows has no range that holds the k-th: all of it is taken
    whole = cuts.filter("__cut is null").select(*by, F.lit(True).alias("__all"))
    taken = rows.join(last.join(whole, by, "full_outer"), by).filter(F.coalesce(F.col("__all"), one <= F.col("__last")))
    return taken.drop("__h", "__b", "__last", "__all")
