"""Relevance: term statistics, BM25, rank and percentile fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import order

# BM25 and fusion parameters.
K1, B, SMOOTH, MIN_TERM = 2.5, 0.75, 0.5, 3
RRF_K = 60
BLEND, AGREEMENT, AGREE_TOP = 0.65, 0.10, 20


def tokens(docs: DataFrame, key: str, text: str, least: int = MIN_TERM) -> DataFrame:
    """``doc, term, tf``."""
    return docs.select(F.col(key).alias("doc"), F.explode(X.identifiers(F.col(text), least)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def bm25(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, doc, score`` of ``corpus(doc, term, tf)`` and ``queries(query, term)``; terms of a query count once."""
    lengths = corpus.groupBy("doc").agg(F.sum("tf").alias("dl"))
    facts = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = corpus.groupBy("term").agg(F.count("*").alias("df"))
    # Terms nobody asks for are dropped before the lengths are joined.
    wanted = corpus.join(queries.select("term").distinct(), "term", "left_semi").join(df, "term").join(lengths, "doc").join(F.broadcast(facts))
    idf = F.log(1 + (F.col("n") - F.col("df") + SMOOTH) / (F.col("df") + SMOOTH))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = wanted.select("doc", "term", part.alias("s"))
    return queries.select("query", "term").distinct().join(scored, "term").groupBy("query", "doc").agg(F.round(F.sum("s"), 6).alias("score"))


def ranked(scores: DataFrame, group: str = "query", item: str = "doc") -> DataFrame:
    """``rank`` by descending score inside each group, found by ranges of the order: a group is in no one task."""
    rows = order.running(scores, group, [-F.col("score"), F.col(item)], F.lit(1))
    return rows.withColumn("rank", (F.col("before") + 1).cast("int")).drop("before")


def percent_ranked(scores: DataFrame) -> DataFrame:
    """Scores with ``p``, the share of a query's other documents that score less."""
    levels = scores.groupBy("query", "score").agg(F.count("*").alias("c"))
    below = order.running(levels, "query", [F.col("score")], F.col("c")).select("query", "score", "before")
    sizes = levels.groupBy("query").agg(F.sum("c").alias("all"))
    share = F.when(F.col("all") > 1, F.col("before") / (F.col("all") - 1)).otherwise(F.lit(0.0))
    return scores.join(below.join(sizes, "query").select("query", "score", share.alias("p")), ["query", "score"])


def rrf(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reciprocal ranks of two score tables ``query, doc, score`` added over their union."""
    x, y = ranked(a).select("query", "doc", F.col("rank").alias("ra")), ranked(b).select("query", "doc", F.col("rank").alias("rb"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    return x.join(y, ["query", "doc"], "full").select("query", "doc", F.round(part("ra") + part("rb"), 8).alias("score"))


def pit(structural: DataFrame, lexical: DataFrame) -> DataFrame:
    """Percentiles of two scores blended, with a bonus where both have the document near their top."""

    def side(df: DataFrame, p: str, top: str) -> DataFrame:
        best = order.top_per_group(df, "query", [F.desc("score"), F.asc("doc")], AGREE_TOP).select("query", "doc", F.lit(True).alias(top))
        return percent_ranked(df).join(best, ["query", "doc"], "left").select("query", "doc", F.col("p").alias(p), top)

    both = side(structural, "ps", "ts").join(side(lexical, "pl", "tl"), ["query", "doc"], "full")
    bonus = F.when(F.col("ts") & F.col("tl"), F.lit(AGREEMENT)).otherwise(F.lit(0.0))
    return both.select("query", "doc", F.round(BLEND * F.coalesce("ps", F.lit(0.0)) + (1 - BLEND) * F.coalesce("pl", F.lit(0.0)) + bonus, 8).alias("score"))
