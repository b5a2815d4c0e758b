"""What leaves a selection again: noise around hubs, files linked by one generic key, budgets of emission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X

# Edges that refer from one file to another, and dependents that make a hub.
REFERENCE = ("semantic", "config", "key_match", "test_edge")
HUB = 2
CODE = ("py", "js", "jsx", "ts", "tsx", "go", "rs", "java", "kt", "scala", "c", "h", "cpp", "cc", "hpp", "cs", "rb", "php", "swift", "sh")


def boundary(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``inside, other, category, weight, outward``: edges with exactly one end in a changed file.

    ``edges`` are ``src, dst, weight, category`` of files; ``outward`` if the changed file is the source.
    """
    c = changed.select("file").distinct()
    a = edges.join(c.select(F.col("file").alias("src"), F.lit(True).alias("a")), "src", "left").join(c.select(F.col("file").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    crossing = a.filter(F.col("a").isNotNull() != F.col("b").isNotNull())
    out = F.col("a").isNotNull()
    return crossing.select(F.when(out, F.col("src")).otherwise(F.col("dst")).alias("inside"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other"), "category", "weight", out.alias("outward"))


def hub_noise(edges: DataFrame, changed: DataFrame, least: int = HUB) -> DataFrame:
    """``file`` of dependents of a hub beside the change: not linked with a changed file and in no changed folder.

    A hub is an unchanged neighbour of a changed file that ``least`` other unchanged files depend on; of
    two files the one with the stronger edge depends on the other (ties: the source).
    """
    refs = edges.filter(F.col("category").isin(*REFERENCE)).groupBy("src", "dst").agg(F.max("weight").alias("w"))
    back = refs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("r"))
    depends = refs.join(back, ["src", "dst"], "left").filter(F.col("w") >= F.coalesce("r", F.lit(0.0))).select(F.col("src").alias("dependent"), F.col("dst").alias("hub"))
    c = changed.select("file").distinct()
    near = boundary(refs.select("src", "dst", F.col("w").alias("weight"), F.lit("semantic").alias("category")), changed).select(F.col("other").alias("file")).distinct()
    outside = depends.join(c.withColumnRenamed("file", "dependent"), "dependent", "left_anti").filter("dependent <> hub")
    hubs = near.withColumnRenamed("file", "hub").join(outside, "hub").groupBy("hub").agg(F.countDistinct("dependent").alias("n")).filter(F.col("n") >= least).select("hub")
    noise = outside.join(hubs, "hub").select(F.col("dependent").alias("file")).distinct().join(near, "file", "left_anti")
    folders = c.select(X.directory(F.col("file")).alias("dir")).distinct()
    return noise.withColumn("dir", X.directory(F.col("file"))).join(folders, "dir", "left_anti").select("file")


def generic_only(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``file`` of code files that only one generic key links with the change, and whose stem no changed file has.

    The set of files linked by a key, less the set linked by a reference or a declared path.
    """
    e = boundary(edges, changed)
    keyed = e.filter("category = 'key_match'").groupBy(F.col("other").alias("file")).agg(F.count("*").alias("n")).filter("n <= 1").select("file")
    real = e.filter("category in ('semantic', 'config')").select(F.col("other").alias("file"))
    stems = changed.select(F.lower(X.stem(F.col("file"))).alias("stem")).distinct()
    left = keyed.join(real, "file", "left_anti").filter(X.extension(F.col("file")).isin(*CODE))
    return left.withColumn("stem", F.lower(X.stem(F.col("file")))).join(stems, "stem", "left_anti").select("file")


def capped_contributions(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The strongest ``most`` contributions of a run, and one row ``emitted, kept, partial`` that says what was left out.

    The cut is by weight and ends in a total order; a run within the limit loses nothing and is not sorted.
    """
    total = edges.count()
    cover = edges.sparkSession.createDataFrame([(total, min(total, most), total > most)], "emitted long, kept long, partial boolean")
    return (edges.orderBy(F.desc("weight"), "src", "dst", "category").limit(most) if total > most else edges), cover


def dangling(selected: DataFrame, edges: DataFrame, frags: DataFrame, scores: DataFrame) -> DataFrame:
    """``symbol, id`` that complete a selection: the best definition of each symbol a selected fragment refers to.

    ``selected`` is ``id``; the reference neighbours of selected fragments that are not selected give the
    symbols, of which those a selected fragment already defines are no gap; of the candidates with the
    symbol the best score counts, then the cheapest, then the least id.
    """
    refs = edges.filter(F.col("category").isin(*REFERENCE)).select("src", "dst")
    out = refs.join(selected.select(F.col("id").alias("src")), "src", "left_semi").join(selected.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("id")).distinct()
    named = frags.filter("symbol is not null").select("id", F.lower("symbol").alias("symbol"), "tokens")
    wanted = out.join(named, "id").select("symbol").distinct().join(named.join(selected, "id", "left_semi").select("symbol"), "symbol", "left_anti")
    pool = named.join(wanted, "symbol").join(scores, "id", "left")
    return pool.groupBy("symbol").agg(F.min_by("id", F.struct(-F.coalesce("score", F.lit(0.0)), F.col("tokens"), F.col("id"))).alias("id"))


def admitted(edges: DataFrame, cores: DataFrame, spans: DataFrame) -> DataFrame:
    """``file``: those that hold a core or are linked with one by a reference; others are not offered to graph scorers."""
    c = cores.select("id").distinct()
    refs = edges.filter(F.col("category").isin(*REFERENCE))
    near = refs.join(c.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).unionByName(refs.join(c.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")))
    return spans.select("id", "file").join(near.unionByName(c).distinct(), "id", "left_semi").select("file").distinct()
