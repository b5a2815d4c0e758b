"""Mixing sources to target weights (problem 8).

Sizes are tokens of a public tokenizer.  The mix is as large as the target shares allow: the source
that runs out first, all its allowed repeats used, sets the total.  Each source's documents are laid
out in a hashed order, epoch after epoch.  The documents that begin within one stretch of ``step``
tokens of a source are a block, which has the size of its documents and is a job of a Pfair
schedule: with share w of the mix, tokens a to b of a source are released at a / w and due at b / w
of the mix's length, and among the released blocks the one with the earliest deadline comes next.

A block is below ``step`` plus the longest document.  No source is ever ahead of its share by as
much, as a block begins only once its source is not ahead; none is ever as far behind, as the demand
of all sources never exceeds the mix, so a deadline is missed by less than the block under way.
As long as a mix has fewer than BLOCKS stretches of one document, every document is a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import cut, small

#: The driver schedules at most about this many blocks; a larger mix has longer ones, 1 / BLOCKS of it.
BLOCKS = 131_072
#: A source's hashed order is cut into so many ranges, so that no task sorts a whole source.
RANGES = 4096
#: Largest number of sources a mix may have: bounds what the driver holds; more are refused.
MAX_SOURCES = 4096


def pfair(blocks: Mapping[str, Sequence[int]]) -> list[tuple[str, int]]:
    """The order of the blocks of each source, given by their sizes; shares are the sums of the sizes.

    With ``t`` tokens given, the next block is the one with the earliest deadline among those whose
    source is not ahead of its share; ties go by name.
    """
    whole = {s: sum(sizes) for s, sizes in blocks.items()}
    total = sum(whole.values())
    waiting = [(0.0, s) for s, n in whole.items() if n > 0]
    heapq.heapify(waiting)
    ready: list[tuple[float, str]] = []
    given, at = dict.fromkeys(blocks, 0), dict.fromkeys(blocks, 0)
    order, t = [], 0
    while waiting or ready:
        # Some source is always not ahead; rounding may hide it, then the least ahead one goes.
        while waiting and (waiting[0][0] <= t or not ready):
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, ((given[s] + blocks[s][at[s]]) * total / whole[s], s))
        _, s = heapq.heappop(ready)
        order.append((s, at[s]))
        t += blocks[s][at[s]]
        given[s] += blocks[s][at[s]]
        at[s] += 1
        if at[s] < len(blocks[s]):
            heapq.heappush(waiting, (given[s] * total / whole[s], s))
    return order


def plan(held: dict[str, int], targets: Sequence[tuple[str, float, int]], total: int | None = None) -> dict[str, tuple[float, int]]:
    """``source -> (share, tokens)`` of the mix from the tokens each source holds.

    Shares are the weights of the sources that hold anything, divided by their sum.  With no
    ``total`` the mix is the largest in which every source has its share; with one, a source that
    cannot reach its share within its repeats gives all it may, and the report shows the gap.
    """
    usable = {s: (w, held[s] * r) for s, w, r in targets if held.get(s, 0) > 0 and w and w > 0 and r and r > 0}
    whole = sum(w for w, _ in usable.values())
    if not usable:
        return {}
    size = min(cap * whole / w for w, cap in usable.values()) if total is None else total
    return {s: (w / whole, min(cap, max(1, int(size * w / whole)))) for s, (w, cap) in usable.items()}


def bounded(rows: list) -> list:
    """What was fetched with a limit of one more than MAX_SOURCES; an error if that is reached."""
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return rows


def mix(counted: DataFrame, targets: DataFrame, seed: int = 42, total: int | None = None) -> DataFrame:
    """``slot, position, source, doc_id, repeat_no, n_tokens`` from ``doc_id, source, n_tokens``.

    Documents without tokens (null and empty texts) and sources without a target are left out.  The
    last document of a source is taken if at least half of it lies within the source's target.  No
    document is used more than ``max_repeats`` times.  Order by (slot, position, doc_id, repeat_no)
    to read the mix.  A source that appears more than once in the targets counts with its largest
    weight.  More than MAX_SOURCES sources with a target are an error.
    """
    spark = counted.sparkSession
    wanted = targets.filter("source is not null and target_weight > 0 and max_repeats > 0").groupBy("source").agg(
        F.max_by(F.struct("target_weight", "max_repeats"), F.struct("target_weight", "max_repeats")).alias("t")
    ).select("source", "t.*")
    goals_of = bounded(wanted.limit(MAX_SOURCES + 1).collect())
    used = cut(
        counted.filter("n_tokens > 0").join(small(wanted.select("source")), "source", "left_semi")
        .select("source", "doc_id", "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
        .withColumn("range", F.shiftrightunsigned("h", 52).cast("int"))
    )
    ranges = used.groupBy("source", "range").agg(F.sum("n_tokens").alias("size"))
    held = {r["source"]: int(r["size"]) for r in bounded(ranges.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect())}
    goals = plan(held, [(r["source"], r["target_weight"], r["max_repeats"]) for r in goals_of], total)
    schema = "source string, goal bigint, held bigint, epochs int"
    step = max(1, sum(g for _, g in goals.values()) // BLOCKS)
    facts = spark.createDataFrame([(s, g, held[s], -(-g // held[s])) for s, (_, g) in goals.items()], schema)
    # Offsets in two steps: ranges of the hashed order first, then rows inside a range.
    before = ranges.withColumn("base", F.sum("size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        used.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(before.select("source", "range", F.coalesce("base", F.lit(0)).alias("base")), ["source", "range"])
        .join(small(facts), "source")
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
        .withColumn("offset", (F.col("repeat_no") - 1) * F.col("held") + F.col("base") + F.col("inner"))
        .filter(F.col("offset") + F.col("n_tokens") / 2 <= F.col("goal"))
        .withColumn("block_no", F.floor(F.col("offset") / step))
    )
    placed = cut(placed.select("source", "doc_id", "n_tokens", "repeat_no", "offset", "block_no"))
    # At most BLOCKS blocks and one more for each source.
    sizes = placed.groupBy("source", "block_no").agg(F.sum("n_tokens").alias("size")).toPandas().sort_values(["source", "block_no"])
    groups = {s: part for s, part in sizes.groupby("source", sort=True)}
    order = pfair({s: part["size"].tolist() for s, part in groups.items()})
    numbers = {s: part["block_no"].tolist() for s, part in groups.items()}
    slots = spark.createDataFrame([(s, numbers[s][j], t) for t, (s, j) in enumerate(order)], "source string, block_no bigint, slot bigint")
    return placed.join(small(slots), ["source", "block_no"]).select("slot", (F.col("offset") % step).alias("position"), "source", "doc_id", F.col("repeat_no").cast("int"), "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: the share of its weight, the tokens and documents used, the share reached.

    A source without documents contributes nothing, takes no share and is reported with zeros.
    """
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("uses"), F.countDistinct("doc_id").alias("docs"), F.max("repeat_no").alias("most_repeats"))
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_weight").alias("target_weight"))
    whole = Window.partitionBy()
    return wanted.join(got, "source", "left").select(
        "source",
        F.round(F.coalesce(F.when(F.col("n_tokens") > 0, F.col("target_weight")) / F.sum(F.when(F.col("n_tokens") > 0, F.col("target_weight"))).over(whole), F.lit(0.0)), 6).alias("target_share"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.round(F.coalesce(F.col("n_tokens") / F.sum("n_tokens").over(whole), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("docs", F.lit(0)).alias("docs"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
