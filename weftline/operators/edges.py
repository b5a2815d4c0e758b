"""Edge builders: extract keys, bound their ambiguity, join on them, weigh.

Every builder gives ``src, dst, weight, category``.  Keys held by more than a bounded number of
files are left out before any join: that bound is part of the edges' meaning (an ambiguous name
says nothing) and keeps every pair expansion linear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X

#: Fixed value: names defined in more files than this are ambiguous.
AMBIGUOUS = 8
BIN = 256


def both_ways(edges: DataFrame, forward: float | Column, reverse: float, category: str) -> DataFrame:
    """Edges of ``src, dst`` and their reverse, without a second join."""
    w = F.lit(forward) if isinstance(forward, (int, float)) else forward
    pair = F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), w.alias("w")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"), (w * reverse).alias("w"))))
    return edges.select(pair.alias("e")).select(F.col("e.s").alias("src"), F.col("e.d").alias("dst"), F.col("e.w").alias("weight")).withColumn("category", F.lit(category)).filter("src <> dst")


def binned(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bin of lines that a range touches; equi-joins on the bin replace range joins."""
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN))))


def containment(spans: DataFrame) -> DataFrame:
    """Innermost enclosing span of the same file, by length then id; spans are ``id, file, start_line, end_line``."""
    inner = spans.select(F.col("id").alias("src"), "file", F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.floor(F.col("start_line") / BIN).alias("bin"))
    outer = binned(spans.select(F.col("id").alias("dst"), "file", F.col("start_line").alias("os"), F.col("end_line").alias("oe")), "os", "oe")
    inside = inner.join(outer, ["file", "bin"]).filter("os <= s and e <= oe and src <> dst and (oe - os > e - s or dst < src)")
    best = inside.groupBy("src").agg(F.min_by("dst", F.struct(F.col("oe") - F.col("os"), F.col("dst"))).alias("dst"))
    return both_ways(best, 0.50, 0.70, "structural")


def siblings(files: DataFrame, most: int = 20) -> DataFrame:
    """All pairs among the first files of each directory, ``dir, node`` in order of node."""
    w = Window.partitionBy("dir").orderBy("node")
    held = files.distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).groupBy("dir").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return both_ways(pairs_of(held, "nodes"), 0.05, 1.0, "sibling")


def pairs_of(df: DataFrame, members: str, keep: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs ``src < dst`` of a sorted array whose size is bounded."""
    out = df.select(*keep, F.col(members), F.posexplode(members).alias("i", "src"))
    return out.select(*keep, "src", F.explode(F.slice(members, F.col("i") + 2, F.size(members))).alias("dst"))


def cochange(baskets: DataFrame, most: int = 30, least: int = 2) -> DataFrame:
    """Pairs that change together in at least ``least`` commits of at most ``most`` files."""
    groups = baskets.groupBy("commit_id").agg(F.sort_array(F.collect_set("node")).alias("nodes")).filter(F.size("nodes").between(2, most))
    counted = pairs_of(groups, "nodes").groupBy("src", "dst").count().filter(F.col("count") >= least)
    weight = F.least(F.lit(0.40), 0.1 * F.log1p(F.col("count").cast("double")))
    return both_ways(counted, weight, 1.0, "history")


def lexical(tokens: DataFrame, total: int, floor: float = 0.30, top: int = 5, postings: int = 100) -> DataFrame:
    """TF-IDF cosine pairs of ``doc, term, tf``: rare terms only, bounded postings, the best neighbours of each document.

    Terms in more than 15 % of the documents, of low idf or with more postings than the bound are
    no evidence, by definition of the similarity.
    """
    df = tokens.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1
    weighed = tokens.join(df.withColumn("idf", idf).filter((F.col("idf") >= 2) & (F.col("df") <= F.floor(F.greatest(F.lit(0.15 * total), F.lit(1.0))))), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighed.filter((F.col("df") >= 2) & (F.col("df") <= postings)).join(norms, "doc").select("term", "doc", (F.col("w") / F.col("norm")).alias("u"))
    posts = unit.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc", "u"))).alias("p"))
    pairs = pairs_of(posts, "p").groupBy(F.col("src.doc").alias("a"), F.col("dst.doc").alias("b")).agg(F.round(F.sum(F.col("src.u") * F.col("dst.u")), 5).alias("sim")).filter(F.col("sim") >= floor)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "sim").select("e.*", "sim")
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return ends.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def adjacency(frags: DataFrame) -> DataFrame:
    """Consecutive fragments of a file."""
    nxt = F.lead("id").over(Window.partitionBy("file").orderBy("start_line", "end_line", "id"))
    return both_ways(frags.select(F.col("id").alias("src"), nxt.alias("dst")).filter("dst is not null"), 0.30, 0.83, "document")


def star(keyed: DataFrame, category: str = "document", weight: float = 0.25, most: int | None = None) -> DataFrame:
    """Each key's least holder linked with its others; ``key, node``."""
    groups = keyed.distinct().groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter(F.col("n") >= 2)
    if most is not None:
        groups = groups.filter(F.col("n") <= most)
    links = keyed.distinct().join(groups, "key").filter("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst")).distinct()
    return both_ways(links, weight, 1.0, category)


def shared_keys(keyed: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """Cross-file pairs of the few fragments that share a key: ``key, node, file``."""
    groups = keyed.distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "file"))).alias("m")).filter(F.size("m").between(low, high))
    pairs = pairs_of(groups, "m").filter(F.col("src.file") != F.col("dst.file")).select(F.col("src.node").alias("src"), F.col("dst.node").alias("dst")).distinct()
    return both_ways(pairs, 0.30, 0.70, "key_match")


def name_links(defs: DataFrame, uses: DataFrame, forward: float, reverse: float, category: str = "semantic") -> DataFrame:
    """Users linked with the definers of a name: ``name, node, file`` on both sides.

    Names defined in more than AMBIGUOUS files link nothing; nor does a fragment to itself or to a
    name it defines.
    """
    few = defs.groupBy("name").agg(F.countDistinct("file").alias("n")).filter(F.col("n") <= AMBIGUOUS).select("name")
    d = defs.join(few, "name").select("name", F.col("node").alias("dst")).distinct()
    u = uses.join(defs.select("name", "node"), ["name", "node"], "left_anti").select("name", F.col("node").alias("src")).distinct()
    return both_ways(u.join(d, "name").filter("src <> dst").select("src", "dst").distinct(), forward, reverse, category)


def test_links(files: DataFrame) -> DataFrame:
    """Test files linked with the sources their stem names: same directory first, else at most AMBIGUOUS files."""
    stem = X.stem(F.col("path"))
    target = F.regexp_replace(F.regexp_replace(stem, r"^(test|spec)[_.\-]", ""), r"[_.\-](test|tests|spec|specs)$", "")
    rows = files.select("file", "repo", "path", X.directory(F.col("path")).alias("dir"), X.extension(F.col("path")).alias("ext"), stem.alias("stem"), target.alias("target"), X.is_test(F.col("path")).alias("t"))
    tests = rows.filter("t and target <> stem").select(F.col("file").alias("src"), "repo", F.col("dir").alias("tdir"), F.col("target").alias("stem"), "ext")
    sources = rows.filter("not t").select(F.col("file").alias("dst"), "repo", "dir", "stem", "ext")
    near = tests.join(sources, ["repo", "stem", "ext"]).withColumn("same", (F.col("tdir") == F.col("dir")).cast("int"))
    w = Window.partitionBy("src")
    picked = near.withColumn("best", F.max("same").over(w)).withColumn("n", F.count("*").over(w)).filter(((F.col("best") == 1) & (F.col("same") == 1)) | ((F.col("best") == 0) & (F.col("n") <= AMBIGUOUS)))
    return both_ways(picked.select("src", "dst"), 0.50, 0.50, "test_edge")


def merged(edges: DataFrame) -> DataFrame:
    """The strongest edge of each pair, with its category (ties: the greater name)."""
    return edges.groupBy("src", "dst").agg(F.max_by(F.struct("weight", "category"), F.struct("weight", "category")).alias("e")).select("src", "dst", "e.weight", "e.category")


def out_capped(edges: DataFrame, most: int) -> DataFrame:
    """The strongest out-edges of each node; pruned before the shuffle by a window group limit."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("rank")


def cores(spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """For each hunk the smallest span that covers it; ``hunk, core``."""
    h = hunks.withColumn("bin", F.floor(F.col("hs") / BIN))
    s = binned(spans.select("id", "file", "start_line", "end_line"), "start_line", "end_line")
    return h.join(s, ["file", "bin"]).filter("start_line <= hs and he <= end_line").groupBy("hunk").agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), F.col("id"))).alias("core"))


def changed_lines(spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """Lines of each span that hunks touch, clipped to the span, and the hunks' whole lines."""
    h = binned(hunks, "hs", "he")
    s = binned(spans.select("id", "file", "start_line", "end_line"), "start_line", "end_line")
    hit = h.join(s, ["file", "bin"]).filter("start_line <= he and hs <= end_line").select("hunk", "id", "hs", "he", "start_line", "end_line").distinct()
    return hit.groupBy("id").agg(
        F.sum(F.least("he", "end_line") - F.greatest("hs", "start_line") + 1).cast("long").alias("changed"), F.sum(F.col("he") - F.col("hs") + 1).cast("long").alias("seed")
    )


def nearest_gap(frags: DataFrame, hunks: DataFrame) -> DataFrame:
    """``id, kind, gap``: lines between each fragment and the nearest hunk of its file other than its own.

    An as-of join by sorting: fragments and hunks of a file in one order, the last hunk end before
    and the first hunk start after a fragment by running extremes.  Overlap counts as 0.  Files
    without another hunk have no row.
    """
    both = frags.select("file", "id", "kind", F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.lit(0).alias("is_hunk")).unionByName(
        hunks.select("file", F.col("hunk").alias("id"), F.lit(None).cast("string").alias("kind"), F.col("hs").alias("s"), F.col("he").alias("e"), F.lit(1).alias("is_hunk"))
    )
    w = Window.partitionBy("file").orderBy("s", "is_hunk", "id")
    # The two best of each side, in case the best is the fragment's own hunk.
    top = lambda f, c, frame: f(F.when(F.col("is_hunk") == 1, F.struct(F.col(c), F.col("id")))).over(w.rowsBetween(*frame))
    past, ahead = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    lag = both.withColumn("p1", top(F.max, "e", past)).withColumn("n1", top(F.min, "s", ahead))
    held = lag.withColumn("own", F.when(F.col("is_hunk") == 1, F.col("id")))
    # A function's own hunk starts right after it; what follows that one is the next candidate.
    after = F.min(F.when(F.col("is_hunk") == 1, F.col("n1"))).over(w.rowsBetween(1, 1))
    rows = held.withColumn("n2", F.when(F.col("n1")["id"] == F.col("id"), after).otherwise(F.col("n1"))).filter("is_hunk = 0")
    gap = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0), x))
    before, behind = gap(F.col("s") - F.col("p1")["e"]), gap(F.col("n2")["s"] - F.col("e"))
    return rows.withColumn("gap", F.least(before, behind)).filter("gap is not null").select("id", "kind", "gap")
