"""Splits that keep related records together (problem 5).

Repositories are named in many ways and move; connected components over normalised names and moves
are found by alternating large-star and small-star rounds.  Components of identical size and label
profile are a bundle; the largest ones, which no other equals, are bundles of their own, and what is
left beyond the bundles the driver holds goes by size class and most frequent label.  Each bundle
carries the counts of all its labels.  A min-cost flow with deviation costs divides every bundle over the splits, the flow
is rounded to whole members, moves and exchanges of members bring the labels nearer to their quotas,
and members take their split by the rank of their hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import cut, small

SPLITS = ("calibration", "validation", "test")
#: So many components, the largest with more than one record, are bundles of their own.
OWN = 1000
#: So many label profiles, those most components share, are bundles; the members of a bundle are then exactly alike.
PROFILES = 1000
#: Rounds of moves and exchanges over all bundles.
BETTER_ROUNDS = 20
#: Ratio between the size classes of the other bundles.
SIZE_STEP = 1.25
#: Cost of a record beyond a split's quota, against 1 for one beyond a label's quota within it.
OVERALL_COST = 20
#: Hash ranges of a bundle, so that no task ranks a whole bundle.
RANGES = 256


def repo_name(raw: Column) -> Column:
    """``owner/name`` in lower case from any way of writing a repository.

    Scheme, user, host, ``.git``, further path and slashes at the ends go; what has no owner and
    name stays as it is, trimmed and in lower case.  Null and blank give null.
    """
    x = F.lower(F.trim(F.regexp_replace(raw, r"\s+", "")))
    x = F.regexp_replace(x, r"^[a-z][a-z0-9+.-]*://", "")
    x = F.regexp_replace(x, r"^[^/@]*@", "")
    x = F.regexp_replace(x, r"^(?:[a-z0-9-]+\.)+[a-z0-9-]+(?::\d+)?[:/]+(?=[^/]+/)", "")
    x = F.regexp_replace(x, r"^/+|[?#].*$", "")
    x = F.regexp_replace(x, r"^([^/]+/[^/]+)/.*$", "$1")
    x = F.regexp_replace(x, r"(?:\.git)?/*$", "")
    return F.when(x != "", x)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges ``(a, b)``; the root is the least node of its component.

    Large-star and small-star rounds: a hub's edges are spread over its neighbours, so a component
    of n nodes needs O(log n) rounds.  Every round is written to the shared folder.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    links = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        links = cut(star(star(links, True), False))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("the components did not settle")


def repo_roots(instances: DataFrame, moves: DataFrame) -> DataFrame:
    """``repo, name, root`` of every distinct non-null spelling in ``instances.repo``.

    A spelling that no move mentions is its own root; a blank one means no repository and is left out.
    """
    edges = moves.select(repo_name(F.col("old_repo")).alias("a"), repo_name(F.col("new_repo")).alias("b"))
    roots = components(edges)
    spelled = instances.select("repo").filter("repo is not null").distinct().withColumn("name", repo_name(F.col("repo"))).filter("name is not null")
    return spelled.join(roots, spelled["name"] == roots["node"], "left").select("repo", "name", F.coalesce("root", "name").alias("root"))


def same_repo_pairs(roots: DataFrame) -> DataFrame:
    """Pairs of different spellings of one repository, ``repo_a < repo_b``."""
    a, b = roots.select(F.col("repo").alias("repo_a"), "root"), roots.select(F.col("repo").alias("repo_b"), "root")
    return a.join(b, "root").filter("repo_a < repo_b").select("repo_a", "repo_b")


def min_cost_flow(n: int, arcs: Sequence[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc ``(from, to, capacity, cost)`` of a cheapest maximum flow; costs are not negative."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        out[u].append(len(to))
        to.append(v), cap.append(c), cost.append(w)
        out[v].append(len(to))
        to.append(u), cap.append(0), cost.append(-w)
    height = [0] * n
    while True:
        dist, via = [None] * n, [-1] * n
        dist[source] = 0
        queue = [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in out[u]:
                if cap[e]:
                    v, nd = to[e], d + cost[e] + height[u] - height[to[e]]
                    if dist[v] is None or nd < dist[v]:
                        dist[v], via[v] = nd, e
                        heapq.heappush(queue, (nd, v))
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        far = max(d for d in dist if d is not None)
        height = [h + (far if d is None else d) for h, d in zip(height, dist)]
        # Blocking flow along arcs of reduced cost zero, so that one search serves many paths.
        nxt = [0] * n
        pushed = True
        while pushed:
            pushed, path, u, seen = 0, [], source, {source}
            while u != sink:
                while nxt[u] < len(out[u]):
                    e = out[u][nxt[u]]
                    v = to[e]
                    if cap[e] and v not in seen and cost[e] + height[u] - height[v] == 0:
                        break
                    nxt[u] += 1
                if nxt[u] < len(out[u]):
                    path.append(out[u][nxt[u]])
                    u = to[path[-1]]
                    seen.add(u)
                elif path:
                    e = path.pop()
                    seen.discard(u)
                    u = to[e ^ 1]
                    nxt[u] += 1
                else:
                    break
            if u == sink:
                pushed = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= pushed
                    cap[e ^ 1] += pushed


def quotas(total: int, fractions: Sequence[float]) -> list[int]:
    """Whole parts of a total by largest remainder."""
    exact = [total * f for f in fractions]
    parts = [int(x) for x in exact]
    for i in sorted(range(len(exact)), key=lambda i: parts[i] - exact[i])[: total - sum(parts)]:
        parts[i] += 1
    return parts


Bundles = Mapping[str, tuple[int, int, Mapping[str, int]]]


def flows(bundles: Bundles, wanted: Mapping[tuple[str, int], float], room: Sequence[float]) -> dict[str, list[int]]:
    """Records of each bundle per split by a cheapest flow.

    It goes from a bundle to the (label, split) nodes of all its labels, as many records as it has of
    each, on to the splits and to the sink; what a (label, split) takes beyond ``wanted`` or a split
    beyond ``room`` costs.
    """
    names, k = sorted(bundles), len(room)
    labels = sorted({x for b in bundles.values() for x in b[2]})
    # A bundle's records of one label are a node, so that each label keeps its number.
    parts = [(i, x, n) for i, name in enumerate(names) for x, n in sorted(bundles[name][2].items())]
    at = {x: 1 + len(parts) + i * k for i, x in enumerate(labels)}
    sink = 1 + len(parts) + len(labels) * k + k
    total = sum(b[1] for b in bundles.values())
    arcs, first = [], []
    for j, (_, label, n) in enumerate(parts, 1):
        arcs.append((0, j, n, 0))
        first.append(len(arcs))
        arcs += [(j, at[label] + s, n, 0) for s in range(k)]
    for x in labels:
        for s in range(k):
            arcs += [(at[x] + s, sink - k + s, max(0, round(wanted[x, s])), 0), (at[x] + s, sink - k + s, total, 1)]
    for s in range(k):
        arcs += [(sink - k + s, sink, max(0, round(room[s])), 0), (sink - k + s, sink, total, OVERALL_COST)]
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    out = {x: [0] * k for x in names}
    for (i, *_), j in zip(parts, first):
        for s in range(k):
            out[names[i]][s] += flow[j + s]
    return out


def improve(bundles: Bundles, given: dict[str, list[int]], wanted: Mapping[tuple[str, int], float], room: Sequence[float]) -> None:
    """Moves and exchanges single members while that lowers the cost of all deviations; ``wanted`` and ``room`` are what is left."""
    import numpy as np

    names = sorted(bundles, key=lambda x: (-bundles[x][1] / bundles[x][0], x))
    labels = {x: i for i, x in enumerate(sorted({x for b in bundles.values() for x in b[2]}))}
    k = len(room)
    # A member's records per label; the last column is all of them, which weigh more.
    each = np.zeros((len(names) + 1, len(labels) + 1))
    for i, x in enumerate(names):
        for label, n in bundles[x][2].items():
            each[i, labels[label]] = n / bundles[x][0]
    each[:, -1] = each.sum(axis=1)
    weight = np.r_[np.ones(len(labels)), OVERALL_COST]
    left = np.array([[*(wanted[x, s] for x in labels), room[s]] for s in range(k)])
    held = np.array([given[x] for x in names] + [[1] * k])  # The last one is the member without records, for moves.
    for _ in range(BETTER_ROUNDS):
        changed = False
        for i in range(len(names)):
            for s in range(k):
                for t in range(k):
                    if s == t or not held[i, s]:
                        continue
                    other = np.flatnonzero(held[:, t] > 0)
                    d = each[i] - each[other]
                    cost = (np.abs(left[s] + d) + np.abs(left[t] - d)) @ weight
                    j = int(cost.argmin())
                    if cost[j] < (np.abs(left[s]) + np.abs(left[t])) @ weight - 1e-6:
                        left[s] += d[j]
                        left[t] -= d[j]
                        held[i, s] -= 1
                        held[i, t] += 1
                        if other[j] < len(names):
                            held[other[j], t] -= 1
                            held[other[j], s] += 1
                        changed = True
        if not changed:
            break
    for i, x in enumerate(names):
        given[x] = held[i].tolist()


def allocate(bundles: Bundles, fractions: Sequence[float]) -> dict[str, list[int]]:
    """Members of each bundle per split; a bundle is ``(members, records, records of each label)``.

    The flow is rounded in two steps: bundles of one member from the largest down, then, after a
    second flow over the quotas that are left, the others member by member; ``improve`` follows.
    """
    total, k = sum(b[1] for b in bundles.values()), len(fractions)
    weight: dict[str, int] = {}
    for _, _, held in bundles.values():
        for label, n in held.items():
            weight[label] = weight.get(label, 0) + n
    room = [float(q) for q in quotas(total, fractions)]
    wanted = {(x, s): float(q) for x in weight for s, q in enumerate(quotas(weight[x], fractions))}
    given: dict[str, list[int]] = {}
    single = {x: b for x, b in bundles.items() if b[0] == 1}
    for part in (single, {x: b for x, b in bundles.items() if b[0] > 1}):
        flow = flows(part, wanted, room) if part else {}
        for x in sorted(part, key=lambda x: (-part[x][1] / part[x][0], x)):
            members, records, held = part[x]
            each = records / members
            profile = {label: n / members for label, n in held.items()}
            exact = [f / each for f in flow[x]]
            parts = [int(e) for e in exact] if members > 1 else [0] * k

            def take(s: int, n: int, each: float = each, profile: Mapping[str, float] = profile) -> None:
                room[s] -= n * each
                for label, c in profile.items():
                    wanted[label, s] -= n * c

            for s in range(k):
                take(s, parts[s])
            for _ in range(members - sum(parts)):
                fits = lambda s: min(room[s], each) * OVERALL_COST + sum(min(wanted[label, s], c) for label, c in profile.items())  # noqa: B023, E731
                s = max(range(k), key=lambda s: (fits(s), exact[s] - parts[s], -s))
                parts[s] += 1
                take(s, 1)
            given[x] = parts
    if bundles:
        improve(bundles, given, wanted, room)
    return given


def grouped_split(instances: DataFrame, moves: DataFrame, config: DataFrame, name: str = "release", seed: int | None = None) -> DataFrame:
    """``instance_id, split`` with the fractions of a row of ``split_config``.

    All instances of one repository share a split.  An instance without a repository stands for
    itself; deliveries of one id count once (the last); a null benchmark or language is a label like
    any other.  Deterministic for given rows and seed.
    """
    spark = instances.sparkSession
    row = config.filter(F.col("config_name") == name).orderBy("seed").first()
    if row is None:
        raise ValueError(f"split_config has no row {name!r}")
    fractions = [1 - row["validation_fraction"] - row["test_fraction"], row["validation_fraction"], row["test_fraction"]]
    seed = int(row["seed"] if seed is None else seed)
    once = instances.groupBy("instance_id").agg(
        F.max_by(F.struct("repo", "source_benchmark", "language"), F.struct("ingested_at", "repo", "source_benchmark", "language")).alias("r")
    ).select("instance_id", "r.*")
    roots = repo_roots(instances, moves).select("repo", "root")
    keyed = once.join(roots, "repo", "left").select(
        "instance_id",
        F.coalesce(F.concat(F.lit("r:"), "root"), F.concat(F.lit("i:"), F.coalesce("instance_id", F.lit("")))).alias("grp"),
        F.concat_ws("|", F.coalesce("source_benchmark", F.lit("?")), F.coalesce("language", F.lit("?"))).alias("label"),
    )
    keyed = cut(keyed)
    counts = cut(keyed.groupBy("grp", "label").count())
    # A component has at most as many labels as there are; their list is its profile.
    groups = counts.groupBy("grp").agg(
        F.sum("count").alias("size"), F.max_by("label", F.struct("count", "label")).alias("main"), F.xxhash64(F.sort_array(F.collect_list(F.struct("label", "count")))).alias("profile")
    )
    alike = groups.groupBy("profile").agg(F.count("*").alias("members")).filter("members > 1").orderBy(F.desc("members"), "profile").limit(PROFILES).select("profile", F.lit(True).alias("alike"))
    largest = groups.filter("size > 1").orderBy(F.desc("size"), "grp").limit(OWN).select("grp", F.lit(True).alias("own"))
    size_class = F.floor(F.log(SIZE_STEP, F.col("size"))).cast("string")
    bundle = (
        F.when(F.col("alike"), F.concat(F.lit("same:"), F.col("profile").cast("string")))
        .when(F.col("own"), F.concat(F.lit("own:"), "grp"))
        .otherwise(F.concat(F.lit("all:"), size_class, F.lit(":"), "main"))
    )
    # Both sides have at most OWN and PROFILES rows.
    groups = groups.join(F.broadcast(largest), "grp", "left").join(F.broadcast(alike), "profile", "left").withColumn("bundle", bundle).drop("own", "alike", "profile", "main")
    groups = cut(groups.withColumn("h", F.xxhash64(F.lit(seed), "grp")).withColumn("range", F.pmod("h", F.lit(RANGES))))
    # Bounded by OWN big ones, PROFILES alike ones and (size classes x labels) of the others, times the labels.
    table = groups.groupBy("bundle").agg(F.count("*").alias("members"), F.sum("size").alias("records")).collect()
    profiles: dict[str, dict[str, int]] = {}
    for r in groups.select("grp", "bundle").join(counts, "grp").groupBy("bundle", "label").agg(F.sum("count").alias("n")).collect():
        profiles.setdefault(r["bundle"], {})[r["label"]] = r["n"]
    given = allocate({r["bundle"]: (r["members"], r["records"], profiles[r["bundle"]]) for r in table}, fractions)
    ends = spark.createDataFrame([(b, p[0], p[0] + p[1]) for b, p in given.items()], "bundle string, first_end bigint, second_end bigint") if given else spark.createDataFrame([], "bundle string, first_end bigint, second_end bigint")
    ranges = groups.groupBy("bundle", "range").agg(F.count("*").alias("n"))
    before = ranges.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("bundle").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("bundle", "range").orderBy("h", "grp")
    rank = F.col("base") + F.row_number().over(inside) - 1
    placed = groups.join(before.select("bundle", "range", "base"), ["bundle", "range"]).withColumn("rank", rank).join(small(ends), "bundle")
    split = F.when(F.col("rank") < F.col("first_end"), SPLITS[0]).when(F.col("rank") < F.col("second_end"), SPLITS[1]).otherwise(SPLITS[2])
    return keyed.select("instance_id", "grp").join(placed.select("grp", split.alias("split")), "grp").select("instance_id", "split")


def split_report(assigned: DataFrame, instances: DataFrame) -> DataFrame:
    """Shares of each split overall (null label columns), per benchmark and per language."""
    once = instances.groupBy("instance_id").agg(F.max_by(F.struct("source_benchmark", "language"), F.struct("ingested_at", "source_benchmark", "language")).alias("r")).select("instance_id", "r.*")
    rows = assigned.join(once, "instance_id")
    sets = rows.cube("source_benchmark", "language", "split").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    per = sets.filter("g in (6, 2, 4)")
    whole = F.sum("n").over(Window.partitionBy("g", "source_benchmark", "language"))
    return per.select("source_benchmark", "language", "split", "n", F.round(F.col("n") / whole, 6).alias("share"), F.when(F.col("g") == 6, "all").when(F.col("g") == 2, "benchmark").otherwise("language").alias("level"))
