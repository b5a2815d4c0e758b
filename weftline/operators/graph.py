"""Graph operators: expansion, personalised PageRank, hops, roll-ups, coupling, cycles.

Iterations run a fixed or converging number of rounds; each is written to the shared checkpoint
folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import cut


def ego(edges: DataFrame, seeds: DataFrame, depth: int = 2, decay: float = 0.5) -> DataFrame:
    """``node, score``: the best path of at most ``depth`` hops from a seed (score 1), each hop decayed times its weight."""
    reached = seeds.select("node", F.lit(1.0).alias("score"))
    front = reached
    for _ in range(depth):
        front = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("weight") * decay).alias("score"))
        reached = reached.unionByName(front)
    return reached.groupBy("node").agg(F.max("score").alias("score"))


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 10, alpha: float = 0.60, forward: float = 0.4, tolerance: float | None = None) -> DataFrame:
    """``node, score`` after power rounds on the forward and the reversed graph, blended.

    There are ``rounds`` of them, or fewer where the scores move by less than ``tolerance`` in all.
    Seeds carry ``node, mass`` with a sum of 1; a node without out-edges lets its mass go.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    def one(directed: DataFrame) -> DataFrame:
        # Sums are made before the shuffle, so a hub's edges never meet in one task.
        out = directed.groupBy("src").agg(F.sum("weight").alias("out"))
        steps = cut(directed.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")))
        score = seeds.select("node", F.col("mass").alias("score"))
        restart = seeds.select("node", ((1 - alpha) * F.col("mass")).alias("score"))
        for k in range(rounds):
            moved = score.join(steps, score["node"] == steps["src"]).groupBy(F.col("dst").alias("node")).agg((alpha * F.sum(F.col("score") * F.col("p"))).alias("score"))
            nxt = moved.unionByName(restart).groupBy("node").agg(F.sum("score").alias("score"))
            if k % 4 == 3:
                nxt = cut(nxt)
                if tolerance is not None:
                    gap = nxt.join(score.withColumnRenamed("score", "was"), "node", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
                    if gap is None or gap < tolerance:
                        return nxt
            score = nxt
        return score

    a = one(edges).withColumn("score", F.col("score") * forward)
    b = one(back).withColumn("score", F.col("score") * (1 - forward))
    return a.unionByName(b).groupBy("node").agg(F.sum("score").alias("score"))


def hops(edges: DataFrame, seeds: DataFrame, most: int = 50) -> DataFrame:
    """``node, hops``: undirected distance from the seeds; unreachable nodes of the edges get -1."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct())
    known = front = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    for k in range(1, most + 1):
        front = both.join(front, both["src"] == front["node"]).select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti").withColumn("hops", F.lit(k))
        front = cut(front)
        if front.isEmpty():
            break
        known = known.unionByName(front)
        if k % 5 == 0:
            known = cut(known)
    nodes = both.select(F.col("src").alias("node")).unionByName(seeds.select("node")).distinct()
    return nodes.join(known, "node", "left").select("node", F.coalesce("hops", F.lit(-1)).alias("hops"))


def incoming(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Mass a node gets per category, and the source that gives most (ties: the greater)."""
    flow = edges.join(scores, edges["src"] == scores["node"]).select("dst", "category", "src", (F.col("weight") * F.col("score")).alias("m"))
    return flow.groupBy(F.col("dst").alias("node"), "category").agg(F.round(F.sum("m"), 6).alias("mass"), F.max_by("src", F.struct(F.round("m", 9), F.col("src"))).alias("strongest"))


def quotient(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between groups with counts and the dominant category; ``groups`` is ``node, grp``."""
    a = groups.select(F.col("node").alias("src"), F.col("grp").alias("gs"))
    b = groups.select(F.col("node").alias("dst"), F.col("grp").alias("gd"))
    counted = edges.join(a, "src").join(b, "dst").filter("gs <> gd").groupBy("gs", "gd", "category").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return counted.groupBy("gs", "gd").agg(F.sum("n").alias("n_edges"), F.round(F.sum("w"), 4).alias("weight"), F.max_by("category", F.struct("n", "category")).alias("category"))


def summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges and density of a graph, in one pass over its end points."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count("*").alias("nodes"))
    return edges.agg(F.count("*").alias("edges")).join(ends).select("nodes", "edges", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 8).alias("density"))


def coupling(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: inner and outer edges, fan-in, fan-out, cohesion and instability."""
    a = groups.select(F.col("node").alias("src"), F.col("grp").alias("gs"))
    b = groups.select(F.col("node").alias("dst"), F.col("grp").alias("gd"))
    pairs = edges.join(a, "src").join(b, "dst").groupBy("gs", "gd").agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.explode(F.array(F.struct(F.col("gs").alias("grp"), F.col("gd").alias("other"), F.lit(1).alias("out")), F.struct(F.col("gd").alias("grp"), F.col("gs").alias("other"), F.lit(0).alias("out")))).alias("s"), "n"
    ).select("s.*", "n")
    inner, outer = F.col("grp") == F.col("other"), F.col("grp") != F.col("other")
    got = sides.groupBy("grp").agg(
        F.coalesce(F.sum(F.when(inner & (F.col("out") == 1), F.col("n"))), F.lit(0)).alias("inner_edges"),
        F.coalesce(F.sum(F.when(outer & (F.col("out") == 1), F.col("n"))), F.lit(0)).alias("out_edges"),
        F.coalesce(F.sum(F.when(outer & (F.col("out") == 0), F.col("n"))), F.lit(0)).alias("in_edges"),
        F.countDistinct(F.when(outer & (F.col("out") == 1), F.col("other"))).alias("fan_out"),
        F.countDistinct(F.when(outer & (F.col("out") == 0), F.col("other"))).alias("fan_in"),
    )
    whole = F.col("inner_edges") + F.col("out_edges") + F.col("in_edges")
    return got.select(
        "*",
        F.round(F.col("inner_edges") / whole, 6).alias("cohesion"),
        F.round(F.when(F.col("out_edges") + F.col("in_edges") > 0, F.col("out_edges") / (F.col("out_edges") + F.col("in_edges"))).otherwise(F.lit(0.0)), 6).alias("instability"),
    )


def dominant(edges: DataFrame, share: float = 0.8) -> DataFrame:
    """Edges kept where they weigh at least ``share`` of the opposing one."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("opposed"))
    return edges.join(back, ["src", "dst"], "left").filter(F.col("weight") >= share * F.coalesce("opposed", F.lit(0.0))).select("src", "dst", "weight")


def cycles(edges: DataFrame, most: int = 100) -> DataFrame:
    """``node, scc``: strongly connected components of more than one node, named by their least node.

    Forward-backward colouring: every unsettled node takes the least label that reaches it; the nodes
    that reach their label's owner back are its component and leave the graph.
    """
    left = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    found: DataFrame | None = None
    for _ in range(most):
        if left.isEmpty():
            break
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        label = cut(nodes.withColumn("c", F.col("node")))
        while True:
            pushed = left.join(label, left["src"] == label["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            nxt = cut(label.join(pushed, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")))
            label = nxt.select("node", "c")
            if nxt.filter("moved").isEmpty():
                break
        a, b = label.select(F.col("node").alias("src"), F.col("c").alias("ca")), label.select(F.col("node").alias("dst"), F.col("c").alias("cb"))
        same = cut(left.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst", F.col("ca").alias("c")))
        reach = front = cut(label.filter("node = c"))
        while True:
            front = cut(same.join(front.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct().join(reach, ["node", "c"], "left_anti"))
            if front.isEmpty():
                break
            reach = cut(reach.unionByName(front))
        found = reach if found is None else found.unionByName(reach)
        done = reach.select("node")
        left = cut(left.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if found is None:
        return left.select(F.col("src").alias("node"), F.col("src").alias("scc"))
    sizes = found.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1")
    return found.join(sizes, "c").select("node", F.col("c").alias("scc"))


def hotspots(degree: DataFrame, churn: DataFrame) -> DataFrame:
    """Half the share of the greatest out-degree, half that of the greatest churn."""
    both = degree.join(churn, "node", "full").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("churn", F.lit(0)).alias("churn"))
    top = both.agg(F.max("degree").alias("md"), F.max("churn").alias("mc"))
    # One row of maxima: a single-row side, whatever the size of the data.
    return both.join(F.broadcast(top)).select(
        "node", "degree", "churn", F.round(0.5 * F.coalesce(F.col("degree") / F.nullif("md", F.lit(0)), F.lit(0.0)) + 0.5 * F.coalesce(F.col("churn") / F.nullif("mc", F.lit(0)), F.lit(0.0)), 4).alias("score")
    )
