"""Scores of a selection against gold: fragments, lines, allowed and forbidden items, held-out files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import fragmenting as TG


def merged(ranges: DataFrame, key: str) -> DataFrame:
    """``key, s, e``: ranges of a key joined where they touch."""
    numbered = ranges.select(F.col(key).alias("k"), "s", "e", F.xxhash64("s", "e").alias("id"))
    return TG.merged_ranges(numbered.select("k", F.col("s").alias("start_line"), F.col("e").alias("end_line"), "id"), "k").select(F.col("k").alias(key), F.col("start_line").alias("s"), F.col("end_line").alias("e"))


def line_scores(selected: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """``key``, fragment recall and precision, line precision, recall and F1 of two sets of ranges ``key, s, e``.

    A gold range is hit if a selected one overlaps it, and the other way round.  Lines are counted by
    the lengths of merged ranges and of their overlaps; none is written out.  Keys without gold have no
    row; without a selection all is 0 and precision null.
    """
    n = lambda df, name: df.groupBy(key).agg(F.sum(F.col("e") - F.col("s") + 1).cast("long").alias(name))
    s, g = selected.select(key, "s", "e").distinct(), gold.select(key, "s", "e").distinct()
    both = g.select(key, F.col("s").alias("gs"), F.col("e").alias("ge")).join(s, key).filter("s <= ge and gs <= e")
    found = both.groupBy(key).agg(F.countDistinct("gs", "ge").alias("gold_hit"), F.countDistinct("s", "e").alias("sel_hit"))
    ms, mg = merged(s, key), merged(g, key)
    inter = mg.select(key, F.col("s").alias("gs"), F.col("e").alias("ge")).join(ms, key).filter("s <= ge and gs <= e").groupBy(key).agg(F.sum(F.least("e", "ge") - F.greatest("s", "gs") + 1).cast("long").alias("common"))
    rows = g.groupBy(key).agg(F.count("*").alias("gold_n")).join(s.groupBy(key).agg(F.count("*").alias("sel_n")), key, "left").join(found, key, "left").join(n(mg, "gold_lines"), key).join(n(ms, "sel_lines"), key, "left").join(inter, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    p, r = zero("common") / F.nullif("sel_lines", F.lit(0)), zero("common") / F.col("gold_lines")
    f1 = F.when(zero("common") > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    six = lambda x, name: F.round(x, 6).alias(name)
    return rows.select(key, six(zero("gold_hit") / F.col("gold_n"), "fragment_recall"), six(zero("sel_hit") / F.nullif("sel_n", F.lit(0)), "fragment_precision"), six(p, "line_precision"), six(r, "line_recall"), six(f1, "line_f1"))


def oracle_score(selected: Column, required: Column, forbidden: Column) -> Column:
    """100 times recall of the required items times the share of forbidden ones that were left out."""
    recall = F.when(F.size(required) > 0, F.size(F.array_intersect(selected, required)) / F.size(required)).otherwise(F.lit(1.0))
    rate = F.when(F.size(forbidden) > 0, F.size(F.array_intersect(selected, forbidden)) / F.size(forbidden)).otherwise(F.lit(0.0))
    return 100 * recall * (1 - rate)


def real_world_score(selected: Column, required: Column, forbidden: Column) -> Column:
    """The same with the forbidden items as a share of what was selected; an empty selection scores 0."""
    recall = F.when(F.size(required) > 0, F.size(F.array_intersect(selected, required)) / F.size(required)).otherwise(F.lit(1.0))
    rate = F.size(F.array_intersect(selected, forbidden)) / F.nullif(F.size(selected), F.lit(0))
    return F.coalesce(100 * recall * (1 - rate), F.lit(0.0))


def held_out(cases: DataFrame, by: str) -> DataFrame:
    """``by``, cases, found and distractor rate of ``by, gold, selected``: each gold item is hidden once.

    A hidden item is found if it is selected; distractors are selected items that are not gold, as a
    share of what is selected.
    """
    each = cases.filter(F.size("gold") > 0).select(by, F.explode(F.array_distinct("gold")).alias("hidden"), "gold", "selected")
    found = F.array_contains("selected", F.col("hidden")).cast("int")
    wrong = F.size(F.array_except("selected", "gold")) / F.nullif(F.size(F.array_distinct("selected")), F.lit(0))
    return each.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(found, F.lit(0))), 6).alias("found_rate"), F.round(F.avg(wrong), 6).alias("distractor_rate"))


def paired_bootstrap(pairs: DataFrame, by: str, a: str, b: str, samples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """``grp, n, mean, low, high, p``: mean difference of paired values, its interval and two-sided p, per group.

    A group is first reduced to counts of its rounded differences, so the resampling works on a small
    multinomial and not on the rows.
    """
    diff = F.round(F.col(a) - F.col(b), 4)
    counted = pairs.select(F.col(by).alias("grp"), diff.alias("d")).filter("d is not null").groupBy("grp", "d").agg(F.count("*").alias("n"))

    def run(pdf: object) -> object:
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("d")
        d, n = pdf["d"].to_numpy(), pdf["n"].to_numpy()
        means = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=samples) @ d / n.sum()
        tail = (1 - level) / 2
        p = min(1.0, 2 * min(float((means <= 0).mean()), float((means >= 0).mean())))
        return pd.DataFrame([(pdf["grp"].iloc[0], int(n.sum()), float(d @ n / n.sum()), *np.quantile(means, [tail, 1 - tail]), p)], columns=["grp", "n", "mean", "low", "high", "p"])

    return counted.groupBy("grp").applyInPandas(run, "grp string, n bigint, mean double, low double, high double, p double")


def signed_ranks(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """``grp, n, w_plus, z`` of the signed-rank test; equal sizes share their mean rank, zeros do not count.

    Ranks come from counts per size of difference, so a window runs over distinct sizes only.
    """
    from pyspark.sql import Window

    counted = pairs.select(F.col(by).alias("grp"), F.round(F.col(a) - F.col(b), 6).alias("d")).filter("d is not null and d <> 0").groupBy("grp", F.abs("d").alias("m")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    w = Window.partitionBy("grp").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("rank", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    got = ranked.groupBy("grp").agg(F.sum("t").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return got.select("grp", "n", F.round("w_plus", 4).alias("w_plus"), F.round(F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)).otherwise(F.lit(0.0)), 6).alias("z"))
