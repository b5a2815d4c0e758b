"""Selection under a token budget.

Packing and the submodular greedy are sequential inside one query by definition; queries run in
parallel, and what one query looks at is bounded by its candidates.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import order
from weftline.runtime import cut, small

# Budget, selection and utility parameters.
CORE_CLAMP, BUDGET_FACTOR, BUDGET_LOW, BUDGET_HIGH = 1500, 3, 8000, 48000
CORE_FRACTION, FILE_FRACTION, TAU = 0.4, 0.25, 0.05
ETA, BONUS = 0.20, 0.10
RESCUE_BUDGET, RESCUE_PERCENTILE = 0.05, 0.80


def auto_budget(core_tokens: Column) -> Column:
    """Budget from the summed core tokens, each clamped before."""
    return F.greatest(F.least(BUDGET_FACTOR * core_tokens, F.lit(BUDGET_HIGH)), F.lit(BUDGET_LOW))


#: Rows of a query that one round of packing looks at.
ROUND = 256


def greedy_pack(ranked: DataFrame, budget: int) -> DataFrame:
    """Walks each query's list and takes what still fits: ``query, doc, score, cost`` to the taken rows.

    Documents of no positive score are left out before.  A round takes, of what comes after the last
    row seen and fits what is left of the budget, the first ROUND rows of each query and folds over
    them inside the JVM; what does not fit now never will.  The cheapest document bounds the number
    of picks and so of rounds, and no task holds the list of a query.
    """
    rows = ranked.filter("score > 0 and cost is not null").select("query", "doc", (-F.col("score")).alias("neg"), F.col("cost").cast("long").alias("cost"))
    state = rows.select("query").distinct().select("query", F.lit(0).cast("long").alias("used"), F.lit(None).cast("double").alias("at_neg"), F.lit(None).cast("long").alias("at_doc"), F.lit(0).alias("picks"))
    state, taken = cut(state), None
    while True:
        later = F.col("at_neg").isNull() | (F.col("neg") > F.col("at_neg")) | ((F.col("neg") == F.col("at_neg")) & (F.col("doc") > F.col("at_doc")))
        # One row of state per query.
        open_rows = rows.join(small(state), "query").filter(later & (F.col("used") + F.col("cost") <= budget))
        seen = order.top_per_group(open_rows, "query", [F.asc("neg"), F.asc("doc")], ROUND)
        listed = seen.groupBy("query", "used", "picks").agg(F.array_sort(F.collect_list(F.struct("neg", F.col("doc").cast("long").alias("doc"), "cost"))).alias("l"))
        start = F.struct(F.col("used").alias("used"), F.array().cast("array<struct<doc:bigint,used:bigint>>").alias("took"))
        fold = F.aggregate(
            "l",
            start,
            lambda s, x: F.when(
                s["used"] + x["cost"] <= budget,
                F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["took"], F.array(F.struct(x["doc"].alias("doc"), (s["used"] + x["cost"]).alias("used")))).alias("took")),
            ).otherwise(s),
        )
        walked = cut(listed.select("query", "picks", fold.alias("w"), F.element_at("l", -1).alias("last"), F.size("l").alias("rows")))
        if walked.isEmpty():
            break
        got = walked.select("query", "picks", F.posexplode("w.took").alias("pos", "t")).select("query", (F.col("picks") + F.col("pos") + 1).alias("pick"), "t.doc", F.col("t.used").alias("used_tokens"))
        taken = got if taken is None else taken.unionByName(got)
        # A query whose round was not full has seen all its rows.
        state = cut(walked.filter(F.col("rows") == ROUND).select("query", F.col("w.used").alias("used"), F.col("last.neg").alias("at_neg"), F.col("last.doc").alias("at_doc"), (F.col("picks") + F.size("w.took")).alias("picks")))
        if state.isEmpty():
            break
    kind = ranked.schema["query"].dataType.simpleString()
    return taken if taken is not None else ranked.sparkSession.createDataFrame([], f"query {kind}, pick int, doc bigint, used_tokens bigint")


def lazy_greedy(
    items: Sequence[tuple[int, str, int, int, int, float]], strengths: Mapping[int, Mapping[str, float]], priority: Mapping[str, float], budget: int, core: Sequence[int] = (), tau: float = TAU
) -> tuple[list[int], float]:
    """Submodular cover of needs: picked ids in order, and the utility.

    ``items`` are ``(id, file, start, end, tokens, relevance)``.  Gain of an item: per need,
    priority times the growth of the square root of the best augmented strength, plus a bonus for
    its relevance where it serves any.  Core items come first within their share of the budget, by
    tokens; then the densest item, never overlapping a picked one of its file, within the file's
    share until nothing else fits, until density falls below ``tau`` of the first.
    """
    by_id = {i[0]: i for i in items}
    top = max((i[5] for i in items), default=0.0) or 1.0
    best: dict[str, float] = {}
    spans: dict[str, list[tuple[int, int]]] = {}
    spent: dict[str, int] = {}
    picked: list[int] = []
    used = 0

    def gain(i: int) -> float:
        extra = ETA * min(by_id[i][5] / top, 1.0)
        serves = strengths.get(i, {})
        total = sum(priority.get(n, 1.0) * (sqrt(max(best.get(n, 0.0), m + extra)) - sqrt(best.get(n, 0.0))) for n, m in serves.items() if m > 0)
        return total + (BONUS * min(by_id[i][5] / top, 1.0) if any(m > 0 for m in serves.values()) else 0.0)

    def fits(i: int, limit: float) -> bool:
        _, file, start, end, tokens, _ = by_id[i]
        return used + tokens <= limit and all(e < start or s > end for s, e in spans.get(file, []))

    def take(i: int) -> float:
        nonlocal used
        g = gain(i)
        _, file, start, end, tokens, rel = by_id[i]
        extra = ETA * min(rel / top, 1.0)
        for n, m in strengths.get(i, {}).items():
            if m > 0:
                best[n] = max(best.get(n, 0.0), m + extra)
        spans.setdefault(file, []).append((start, end))
        spent[file] = spent.get(file, 0) + tokens
        used += tokens
        picked.append(i)
        return g

    utility = 0.0
    for i in sorted((c for c in core if c in by_id), key=lambda i: (by_id[i][4], i)):
        if fits(i, CORE_FRACTION * budget):
            utility += take(i)
    peak = None
    for ceiling in (FILE_FRACTION * budget, float(budget)):
        heap = [(-gain(i) / by_id[i][4], i) for i in by_id if i not in set(picked) and by_id[i][4] > 0]
        heapq.heapify(heap)
        while heap:
            bound, i = heapq.heappop(heap)
            if not fits(i, budget) or spent.get(by_id[i][1], 0) + by_id[i][4] > ceiling:
                continue
            now = -gain(i) / by_id[i][4]
            if heap and now > heap[0][0]:
                heapq.heappush(heap, (now, i))
                continue
            if now >= 0 or (peak is not None and -now < tau * peak):
                break
            peak = -now if peak is None else peak
            utility += take(i)
    return picked, utility


def submodular_select(candidates: DataFrame, matches: DataFrame, budget: int) -> DataFrame:
    """The greedy for every query: ``candidates(query, id, file, start_line, end_line, tokens, rel, core)`` and
    ``matches(query, id, need, priority, strength)`` to ``query, pick, id, used_tokens``."""

    def run(c: object, m: object) -> object:
        import pandas as pd

        items = [(int(r.id), r.file, int(r.start_line), int(r.end_line), int(r.tokens), float(r.rel)) for r in c.itertuples()]
        strengths: dict[int, dict[str, float]] = {}
        for r in m.itertuples():
            strengths.setdefault(int(r.id), {})[r.need] = float(r.strength)
        priority = {r.need: float(r.priority) for r in m.itertuples()}
        picked, _ = lazy_greedy(items, strengths, priority, budget, [int(i) for i in c.loc[c["core"], "id"]])
        cost = {i[0]: i[4] for i in items}
        used, out = 0, []
        for k, i in enumerate(picked, 1):
            used += cost[i]
            out.append((c["query"].iloc[0], k, i, used))
        return pd.DataFrame(out, columns=["query", "pick", "id", "used_tokens"])

    kind = candidates.schema["query"].dataType.simpleString()
    return candidates.groupBy("query").cogroup(matches.groupBy("query")).applyInPandas(run, f"query {kind}, pick int, id bigint, used_tokens bigint")


def boltzmann(items: Sequence[tuple], budget: int, beta: float, core: Sequence[int] = ()) -> list[int]:
    """Ids in the order taken: ``(id, tokens, rel)``, or ``(id, tokens, rel, file, start, end)`` with lines.

    Core items come first, by ascending tokens; then the others by relevance times exp(-beta tokens).
    What does not fit, or overlaps a taken item of its file, is skipped.
    """
    from math import exp

    used, out, held, first = 0, [], {}, set(core)
    ranked = sorted((x for x in items if x[0] in first), key=lambda x: (x[1], x[0])) + sorted((x for x in items if x[0] not in first), key=lambda x: (-x[2] * exp(-beta * x[1]), x[0]))
    for x in ranked:
        if used + x[1] > budget or (len(x) > 3 and any(e >= x[4] and s <= x[5] for s, e in held.get(x[3], ()))):
            continue
        used += x[1]
        out.append(x[0])
        if len(x) > 3:
            held.setdefault(x[3], []).append((x[4], x[5]))
    return out


def calibrate_beta(items: Sequence[tuple], budget: int, steps: int = 24, slack: float = 0.05, core: Sequence[int] = ()) -> float:
    """The largest beta in [1e-6, 1] that still fills the budget up to the slack, by geometric bisection."""
    cost = {x[0]: x[1] for x in items}
    full = lambda b: sum(cost[i] for i in boltzmann(items, budget, b, core)) >= (1 - slack) * budget
    low, high = 1e-6, 1.0
    if full(high):
        return high
    for _ in range(steps):
        mid = sqrt(low * high)
        low, high = (mid, high) if full(mid) else (low, mid)
    return low


def contenders(ranked: DataFrame, budget: int) -> DataFrame:
    """The rows that a greedy which prefers a higher score and a lower cost can take at all.

    Let k be one more than the budget holds of the cheapest document.  A row with k others of its query
    that score no less and cost no more is never taken: had all of these been taken they would not
    have fitted, and had one not fitted this one would not either.  Within one cost these are the rows
    beyond the first k, which leave before the shuffle; a query has at most budget times k rows left.
    """
    rows = ranked.filter((F.col("score") > 0) & (F.col("cost") > 0) & (F.col("cost") <= budget))
    least = rows.agg(F.min("cost")).first()[0] or 1
    return order.top_per_group(rows, ["query", "cost"], [F.desc("score"), F.asc("doc")], budget // int(least) + 1).drop("rank")


def boltzmann_select(ranked: DataFrame, budget: int) -> DataFrame:
    """The calibrated Boltzmann selection of every query, of its contenders."""

    def run(pdf: object) -> object:
        import pandas as pd

        items = [(int(r.doc), int(r.cost), float(r.score)) for r in pdf.itertuples()]
        beta = calibrate_beta(items, budget)
        out = [(pdf["query"].iloc[0], k, i, beta) for k, i in enumerate(boltzmann(items, budget, beta), 1)]
        return pd.DataFrame(out, columns=["query", "pick", "doc", "beta"])

    kind = ranked.schema["query"].dataType.simpleString()
    return contenders(ranked, budget).groupBy("query").applyInPandas(run, f"query {kind}, pick int, doc bigint, beta double")
