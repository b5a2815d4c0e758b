"""Evaluation metrics over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import order


def percentile_block(df: DataFrame, by: str, value: str) -> DataFrame:
    """Interpolated percentiles, mean, maximum and population deviation of a value per group."""
    v, qs = F.col(value), (25, 50, 75, 95, 99)
    exact = order.percentiles(df, by, value, [q / 100 for q in qs]).select(F.col(by).alias("__by"), *[F.round(f"q{i}", 6).alias(f"p{q}") for i, q in enumerate(qs)])
    plain = df.groupBy(by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("max"), F.round(F.stddev_pop(v), 6).alias("std"))
    # One row per group on both sides.
    return plain.join(exact, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "n", *[f"p{q}" for q in qs], "mean", "max", "std")


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    """Zero where both are; null where one is."""
    b = beta * beta
    down = b * precision + recall
    return F.when(down > 0, (1 + b) * precision * recall / down).when(down == 0, F.lit(0.0))


def recall(selected: Column, gold: Column) -> Column:
    """Share of the gold set that a selected set holds; null for an empty gold set."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(selected, gold)) / F.size(gold))


def holm(p: DataFrame) -> DataFrame:
    """Step-down Holm adjustment of ``test, p``."""
    w = Window.orderBy("p", "test")
    n = F.count("*").over(Window.partitionBy())
    raw = F.least(F.lit(1.0), (n - F.row_number().over(w) + 1) * F.col("p"))
    return p.withColumn("raw", raw).select("test", "p", F.round(F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0)), 8).alias("holm"))


def bh(p: DataFrame) -> DataFrame:
    """Step-up Benjamini-Hochberg adjustment of ``test, p``."""
    w = Window.orderBy("p", "test")
    n = F.count("*").over(Window.partitionBy())
    raw = F.least(F.lit(1.0), n * F.col("p") / F.row_number().over(w))
    down = Window.orderBy(F.desc("p"), F.desc("test")).rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("raw", raw).select("test", "p", F.round(F.min("raw").over(down), 8).alias("bh"))


def bootstrap_ci(values: DataFrame, by: str, value: str, samples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean and its bootstrap interval per group.

    A group is first reduced to counts of its rounded values, so the resampling works on a small
    multinomial and not on the rows.
    """
    counted = values.filter(F.col(value).isNotNull()).select(F.col(by).alias("grp"), F.round(value, 4).alias("v")).groupBy("grp", "v").agg(F.count("*").alias("n"))

    def run(pdf: object) -> object:
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("v")
        v, n = pdf["v"].to_numpy(), pdf["n"].to_numpy()
        rng = np.random.default_rng(seed)
        means = rng.multinomial(n.sum(), n / n.sum(), size=samples) @ v / n.sum()
        tail = (1 - level) / 2
        return pd.DataFrame([(pdf["grp"].iloc[0], int(n.sum()), float(v @ n / n.sum()), *np.quantile(means, [tail, 1 - tail]))], columns=["grp", "n", "mean", "low", "high"])

    return counted.groupBy("grp").applyInPandas(run, "grp string, n bigint, mean double, low double, high double")


def wilcoxon(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Signed-rank statistic and normal p value of paired values per group, from counts of differences."""
    counted = pairs.select(F.col(by).alias("grp"), F.round(F.col(a) - F.col(b), 6).alias("d")).filter("d is not null and d <> 0").groupBy("grp", "d").agg(F.count("*").alias("n"))

    def run(pdf: object) -> object:
        from math import erfc, sqrt

        import pandas as pd

        sizes = pdf.assign(m=pdf["d"].abs()).groupby("m")["n"].sum().sort_index()
        before = sizes.cumsum() - sizes
        rank = before + (sizes + 1) / 2
        plus = float(sum(n * rank[abs(d)] for d, n in zip(pdf["d"], pdf["n"]) if d > 0))
        n = int(sizes.sum())
        mean, ties = n * (n + 1) / 4, float((sizes**3 - sizes).sum()) / 48
        var = n * (n + 1) * (2 * n + 1) / 24 - ties
        z = (plus - mean) / sqrt(var) if var > 0 else 0.0
        return pd.DataFrame([(pdf["grp"].iloc[0], n, plus, z, erfc(abs(z) / sqrt(2)))], columns=["grp", "n", "w_plus", "z", "p"])

    return counted.groupBy("grp").applyInPandas(run, "grp string, n bigint, w_plus double, z double, p double")
