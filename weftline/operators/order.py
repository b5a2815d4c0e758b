"""Ranks and exact percentiles of large groups, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import cut

#: Accuracy of the percentile sketch that narrows a selection, and how far around a percentile it looks.
ACCURACY, AROUND = 2000, 0.002


def running(df: DataFrame, group: str, order: Sequence[Column], weight: Column, name: str = "before") -> DataFrame:
    """``df`` with the summed weight of the rows of its group that come before a row; the order must be total.

    Rows are dealt into ranges of (group, order), a group of any size over many ranges.  A window runs
    inside a range; what the ranges before it hold comes from one row per group and range.
    """
    rows = df.withColumn("__w", weight)
    for i, o in enumerate(order):
        rows = rows.withColumn(f"__o{i}", o)
    names = [f"__o{i}" for i in range(len(order))]
    ranged = cut(rows.repartitionByRange(*[F.col(group), *names]).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "__part").agg(F.sum("__w").alias("__s"))
    base = sizes.select(group, "__part", F.coalesce(F.sum("__s").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(group, "__part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0))).join(F.broadcast(base), [group, "__part"])
    return out.withColumn(name, F.col("__base") + F.col("__in")).drop("__w", "__part", "__in", "__base", *names)


def top_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], most: int, name: str = "rank") -> DataFrame:
    """The first ``most`` rows of each group; the limit is applied before the shuffle, so a task gets few rows of a group."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= most)


def percentiles(df: DataFrame, group: str, value: str, qs: Sequence[float], interpolate: bool = True) -> DataFrame:
    """``group, n`` and one column ``q0, q1, ...`` per percentile, exactly; nulls do not count.

    A sketch narrows each percentile to a short range of values; one pass counts what lies below the
    range and the values in it, and the rank is found among these.  With ``interpolate`` the percentile
    lies at ``q * (n - 1)`` of the order, else it is the value of rank ``ceil(q * n)``.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    near = [min(1.0, max(0.0, q + d)) for q in qs for d in (-AROUND, AROUND)]
    bounds = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", near, ACCURACY).alias("a"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = lambda i, q: (F.col("lo") if q - AROUND <= 0 else F.col("a")[2 * i], F.col("hi") if q + AROUND >= 1 else F.col("a")[2 * i + 1])
    ranges = [F.struct(F.lit(i).alias("i"), ends(i, q)[0].alias("low"), ends(i, q)[1].alias("high"), _place(q, interpolate).alias("place")) for i, q in enumerate(qs)]
    table = cut(bounds.select("g", "n", F.array(*ranges).alias("r")))
    # Few rows: one per group.
    met = rows.join(F.broadcast(table.select(F.col("g").alias("h"), "r")), F.col("g").eqNullSafe(F.col("h")))
    hit = met.select("g", F.explode(F.filter("r", lambda x: F.col("v") <= x["high"])).alias("x"), "v")
    # What lies below a range is counted as one value.
    below = F.col("v") < F.col("x.low")
    counted = hit.groupBy("g", F.col("x.i").alias("i"), F.when(below, F.lit(None).cast("double")).otherwise(F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("g", "i").orderBy(F.col("v").asc_nulls_first())
    upto = counted.withColumn("end", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("c"))
    wanted = table.select(F.col("g").alias("h"), "n", F.explode("r").alias("x")).select("h", "n", F.col("x.i").alias("j"), F.col("x.place").alias("place"))
    joined = upto.join(F.broadcast(wanted), F.col("g").eqNullSafe(F.col("h")) & (F.col("i") == F.col("j")))
    at = lambda k: F.max(F.when((F.col("start") <= k) & (k < F.col("end")), F.col("v")))
    low, high, part = F.floor("place"), F.ceil("place"), F.max(F.col("place") - F.floor("place"))
    each = joined.groupBy("g", "n", "i").agg((at(low) + (at(high) - at(low)) * part).alias("q"))
    pick = lambda i: F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}")
    return each.groupBy("g", "n").agg(*[pick(i) for i in range(len(qs))]).withColumnRenamed("g", group)


def _place(q: float, interpolate: bool) -> Column:
    """Position in the order, from 0."""
    return F.lit(q) * (F.col("n") - 1) if interpolate else F.greatest(F.ceil(F.lit(q) * F.col("n")) - 1, F.lit(0)).cast("double")
