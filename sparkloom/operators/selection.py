"""Exact percentiles of groups of any size.

A percentile aggregate keeps a group's distinct values in one buffer, which a dashboard's single row over all runs can't afford. Here a group
with more than `limit` values is narrowed first: its range is cut into BINS, counts a bin come back (map-side sums, at most BINS rows a group),
and only the bin that holds the wanted rank is looked at again, until few enough values are left to be sorted, or the rank is found at a bin's edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import forget, stored

#: Values that may stand in one buffer, and the bins that a larger group is cut into.
LIMIT, BINS = 100_000, 1024


def percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], limit: int = LIMIT) -> DataFrame:
    """by and a double for each name of wanted (value, share): the linearly interpolated percentile of the group's values.

    Null and NaN values are left out; a group without values has a null, and an empty table without by gives no row. Null keys are a group.
    """
    value = lambda v: F.when(~F.isnan(v.cast("double")), v.cast("double"))
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    sizes = rows.groupBy(*by).agg(*(F.count(value(v)).alias(f"_{i}") for i, (v, _) in enumerate(wanted.values())))
    largest = sizes.agg(F.max(F.greatest(F.lit(0), *(f"_{i}" for i in range(len(wanted)))))).first()[0]
    if (largest or 0) <= limit:
        out = rows.groupBy(*by).agg(F.count("*").alias("_rows"), *(F.percentile(value(v), F.lit(share)).alias(name) for name, (v, share) in wanted.items()))
        return out.where("_rows > 0").drop("_rows")
    measured = F.array(*(F.struct(F.lit(i).alias("m"), value(v).alias("v")) for i, (v, _) in enumerate(wanted.values())))
    # read once more for each cut: written, so that what rows are made of isn't worked out and shuffled again
    values = stored(rows.select(key.alias("g"), F.explode(measured).alias("x")).select("g", "x.m", "x.v").where("v is not null"), "selection-values")
    share = F.element_at(F.create_map(*(F.lit(x) for i, (_, s) in enumerate(wanted.values()) for x in (i, float(s)))), F.col("m"))
    at = share * (F.col("n") - 1)
    # first and second: the ranks to interpolate between; a, b: their values once known; n: values in lo..hi, before: values under lo
    state = values.groupBy("g", "m").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = state.select("g", "m", "n", "lo", "hi", F.lit(0).cast("long").alias("before"), F.floor(at).alias("first"), F.ceil(at).alias("second"), (at - F.floor(at)).alias("part"))
    known = F.col("lo") == F.col("hi")
    state = stored(state.withColumn("a", F.when(known, F.col("lo"))).withColumn("b", F.when(known, F.col("lo"))), "selection")
    open_ = F.col("a").isNull()
    while not state.where(open_ & (F.col("n") > limit)).isEmpty():
        narrowed = stored(_narrowed(values, state.where(open_ & (F.col("n") > limit))).unionByName(state.where(~open_ | (F.col("n") <= limit))), "selection")
        forget(state)
        state = narrowed
    left = values.join(state.where(open_), ["g", "m"]).where("v between lo and hi").groupBy("g", "m").agg(F.sort_array(F.collect_list("v")).alias("vs"), *(F.first(c).alias(c) for c in ("before", "first", "second", "part")))
    pick = lambda c: F.element_at("vs", (F.col(c) - F.col("before") + 1).cast("int"))
    done = left.select("g", "m", "part", pick("first").alias("a"), pick("second").alias("b")).unionByName(state.where(~open_).select("g", "m", "part", "a", "b"))
    done = done.withColumn("p", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")))
    found = done.groupBy("g").agg(*(F.max(F.when(F.col("m") == i, F.col("p"))).alias(name) for i, name in enumerate(wanted)))
    every = sizes.select(key.alias("g"))
    return every.join(found, "g", "left").select(*(F.col("g")[c].alias(c) for c in by), *wanted)


def _narrowed(values: DataFrame, state: DataFrame) -> DataFrame:
    """state after one cut: of each group the bin of both ranks, or their values where they fall into two."""
    width = F.col("hi") / 2 - F.col("lo") / 2
    number = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * BINS), F.lit(BINS - 1))
    bins = values.join(state.select("g", "m", "lo", "hi"), ["g", "m"]).where("v between lo and hi").groupBy("g", "m", number.alias("bin")).agg(F.count("*").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
    below = F.coalesce(F.sum("k").over(Window.partitionBy("g", "m").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("below", below).join(state, ["g", "m"]).withColumn("below", F.col("below") + F.col("before"))
    holds = lambda rank: (F.col("below") <= F.col(rank)) & (F.col(rank) < F.col("below") + F.col("k"))
    bins = bins.where(holds("first") | holds("second"))
    of = bins.groupBy("g", "m").agg(
        F.count("*").alias("two"), F.min("below").alias("under"), F.max("k").alias("inside"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("most").alias("end"), F.max("least").alias("begin"),
        *(F.first(c).alias(c) for c in ("first", "second", "part")),
    )
    split, flat = F.col("two") == 2, F.col("least") == F.col("most")
    return of.select(
        "g", "m", F.col("inside").alias("n"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("under").alias("before"), "first", "second", "part",
        F.when(split, F.col("end")).when(flat, F.col("least")).alias("a"), F.when(split, F.col("begin")).when(flat, F.col("least")).alias("b"),
    )
