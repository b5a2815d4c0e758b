"""The engine's base relations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.runtime import table


def latest(df: DataFrame, key: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, the delivery ingested last; ties by the columns named, then by each value itself.

    Every column is an aggregate of its own, so that a query which needs few of them reads and shuffles only these.
    """
    at = [F.col("ingested_at"), *(F.col(c) for c in ties)]
    plain = [f.name for f in df.schema if f.name not in (key, "ingested_at")]
    orderable = lambda c: df.schema[c].dataType.typeName() != "map"
    return df.groupBy(key).agg(*[F.max_by(c, F.struct(*at, *([F.col(c).alias("__own")] if orderable(c) else []))).alias(c) for c in plain])


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fragment id: its last delivery, ``end_line`` clamped, ``file`` as ``repo:path``."""
    return (
        latest(table(spark, sf_dir, "fragments"), "fragment_id", ("path", "start_line", "end_line"))
        .select(
            F.col("fragment_id").alias("id"),
            "repo",
            "path",
            F.concat_ws(":", "repo", "path").alias("file"),
            "start_line",
            F.greatest("end_line", "start_line").alias("end_line"),
            F.lower("kind").alias("kind"),
            "symbol",
            "language",
            "content",
            "identifiers",
        )
    )


FRAGMENTS_SQL = """f AS (
    SELECT DISTINCT ON (fragment_id) fragment_id AS id, repo, path, repo || ':' || path AS file, start_line, greatest(end_line, start_line) AS end_line,
           lower(kind) AS kind, symbol, language, content, identifiers
    FROM fragments ORDER BY fragment_id, ingested_at DESC NULLS LAST, path DESC NULLS LAST, start_line DESC NULLS LAST
)"""


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per instance id, the last delivery."""
    return latest(table(spark, sf_dir, "instances"), "instance_id")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per result id, the last delivery, NaN as null."""
    df = latest(table(spark, sf_dir, "results"), "result_id")
    return df.withColumn("elapsed_seconds", F.when(~F.isnan("elapsed_seconds"), F.col("elapsed_seconds")))


RESULTS_SQL = """r AS (
    SELECT DISTINCT ON (result_id) * REPLACE (CASE WHEN isnan(elapsed_seconds) THEN NULL ELSE elapsed_seconds END AS elapsed_seconds) FROM results ORDER BY result_id, ingested_at DESC NULLS LAST
)"""


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits over files: orders over parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("node")).distinct()


BASKETS_SQL = "b AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS node FROM lineitem)"


def hunks(frags: DataFrame) -> DataFrame:
    """A change inside every function: up to three lines after its first."""
    return frags.filter("kind = 'function' and end_line > start_line").select(
        F.col("id").alias("hunk"), "file", (F.col("start_line") + 1).alias("hs"), F.least(F.col("start_line") + 3, F.col("end_line")).alias("he")
    )


HUNKS_SQL = "h AS (SELECT id AS hunk, file, start_line + 1 AS hs, least(start_line + 3, end_line) AS he FROM f WHERE kind = 'function' AND end_line > start_line)"
