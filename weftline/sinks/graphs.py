"""Graph exports.  Elements are rendered in parallel as rows; only a chosen top goes through one string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escape(x: Column) -> Column:
    """XML text."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\r", "&#13;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def graphml_rows(edges: DataFrame) -> DataFrame:
    """``ord, line`` of a GraphML document: head, nodes, edges, foot; sort by ord and line to write it."""
    spark = edges.sparkSession
    head = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "ord int, line string")
    nodes = edges.select(F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("n")).distinct()
    a = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), escape(F.col("n")), F.lit('"/>')).alias("line"))
    b = edges.select(
        F.lit(2).alias("ord"),
        F.concat(
            F.lit('<edge source="'), escape(F.col("src").cast("string")), F.lit('" target="'), escape(F.col("dst").cast("string")), F.lit('"><data key="weight">'),
            F.round("weight", 4).cast("string"), F.lit('</data><data key="category">'), escape(F.col("category")), F.lit("</data></edge>"),
        ).alias("line"),
    )
    return head.unionByName(a).unionByName(b)


def json_rows(edges: DataFrame) -> DataFrame:
    """One JSON object per edge, weights rounded to four places."""
    return edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.round("weight", 4).alias("weight"), "category")).alias("value"))


def mermaid(edges: DataFrame, top: int = 20) -> str:
    """A diagram of the strongest ``top`` edges, labelled with their share of the greatest."""
    best = edges.orderBy(F.desc("weight"), "src", "dst").limit(top).withColumn("share", F.col("weight") / F.max("weight").over(Window.partitionBy()))
    rows = best.orderBy(F.desc("weight"), "src", "dst").collect()
    label = lambda s: "<1%" if s < 0.01 else f"{round(100 * s)}%"
    return "\n".join(["graph LR", *(f'  n{r["src"]}["{r["src"]}"] -->|{label(r["share"])}| n{r["dst"]}["{r["dst"]}"]' for r in rows)])


def json_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``ord, line`` of one JSON document: nodes in order, edges in order, a summary; sort by ord and line to write it.

    ``nodes`` are ``id, file, kind``.  Elements are rendered in parallel; commas are put before all but the
    first of each list, found by the least line.
    """
    spark = edges.sparkSession
    weight = F.round("weight", 4)
    n = nodes.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "file", "kind")).alias("x"))
    e = edges.select(F.to_json(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), weight.alias("weight"), "category")).alias("x"))

    def listed(df: DataFrame, at: int) -> DataFrame:
        first = df.agg(F.min("x").alias("first"))
        return df.join(F.broadcast(first)).select(F.lit(at).alias("ord"), F.when(F.col("x") == F.col("first"), F.col("x")).otherwise(F.concat(F.lit(","), F.col("x"))).alias("line"), F.col("x").alias("key"))

    counts = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))
    foot = counts.select(F.lit(5).alias("ord"), F.concat(F.lit('],"summary":'), F.to_json(F.struct("nodes", "edges")), F.lit("}")).alias("line"), F.lit("").alias("key"))
    head = spark.createDataFrame([(1, '{"schema":"graph.v1","nodes":[', ""), (3, '],"edges":[', "")], "ord int, line string, key string")
    return head.unionByName(listed(n, 2)).unionByName(listed(e, 4)).unionByName(foot)
