"""Path and key links of configuration, build and pipeline files, excerpts, signatures, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.edges import AMBIGUOUS, both_ways

#: A file named in a text: at least one folder, a known extension.
PATH_REFERENCE = r"(?:\.{0,2}/)?(?:[\w.-]+/)+[\w.-]+\.(?:py|js|ts|java|go|rs|c|sh|sql|md|yaml|json|toml|env|properties)\b"


def resolved(base: Column, reference: Column) -> Column:
    """A reference as a path: ``./`` and ``../`` from the declaring folder, anything else from the root.

    Absolute paths, URLs, variables and paths that leave the root give null.
    """
    whole = F.when(reference.rlike(r"^\.{1,2}/"), F.concat_ws("/", base, reference)).otherwise(reference)
    walked = F.aggregate(
        F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != ".")),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array(F.lit("\x00"))),
    )
    return F.when(~reference.rlike(r"^/|://|[${}]") & ~F.array_contains(walked, "\x00"), F.array_join(walked, "/"))


def path_links(frags: DataFrame, forward: float = 0.55, reverse: float = 0.35, category: str = "config") -> DataFrame:
    """Fragments linked with the files of their repo that they name: by path, else by a file name few files have."""
    refs = frags.filter("repo is not null and content is not null").select(
        "repo", F.col("file").alias("own"), X.directory(F.col("path")).alias("dir"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(PATH_REFERENCE), F.lit(0)))).alias("ref")
    )
    refs = refs.select("repo", "own", resolved(F.col("dir"), F.col("ref")).alias("path")).filter("path is not null").distinct()
    files = frags.filter("repo is not null and path is not null").select("repo", "path", "file").distinct()
    exact = refs.join(files, ["repo", "path"]).select(F.col("own").alias("src"), F.col("file").alias("dst"))
    named = files.select("repo", X.file_name(F.col("path")).alias("name"), "file")
    few = named.groupBy("repo", "name").agg(F.count("*").alias("n")).filter(F.col("n") <= AMBIGUOUS).select("repo", "name")
    loose = refs.join(files, ["repo", "path"], "left_anti").select("repo", "own", X.file_name(F.col("path")).alias("name")).distinct()
    by_name = loose.join(few, ["repo", "name"]).join(named, ["repo", "name"]).select(F.col("own").alias("src"), F.col("file").alias("dst"))
    return both_ways(exact.unionByName(by_name).filter("src <> dst").distinct(), forward, reverse, category)


def longest_prefix(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """Each dotted use with the longest defined prefix of it: ``id, key`` and ``key`` to ``id, key, defined``."""
    parts = F.split("key", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    tried = uses.select("id", "key", F.explode(prefixes).alias("defined"))
    return tried.join(defs.select(F.col("key").alias("defined")).distinct(), "defined").groupBy("id", "key").agg(F.max_by("defined", F.length("defined")).alias("defined"))


def discovered(edges: DataFrame, seeds: DataFrame, rounds: int = 2) -> DataFrame:
    """``node, round``: what the seeds reach in so many steps along edges; unrolled, as the depth is fixed."""
    found = seeds.select("node", F.lit(0).alias("round"))
    front = found
    for k in range(1, rounds + 1):
        front = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().withColumn("round", F.lit(k))
        found = found.unionByName(front)
    return found.groupBy("node").agg(F.min("round").alias("round"))


def excerpts(spans: DataFrame, hunks: DataFrame, radius: int = 3, least: int = 12, share: float = 0.70) -> DataFrame:
    """A window around each hunk inside its fragment, where the fragment is long and the window a part of it."""
    own = hunks.select(F.col("hunk").alias("id"), "hs", "he").join(spans, "id")
    n = F.col("end_line") - F.col("start_line") + 1
    window = own.withColumn("from_line", F.greatest(F.col("hs") - radius, F.col("start_line"))).withColumn("to_line", F.least(F.col("he") + radius, F.col("end_line")))
    return window.filter((n >= least) & (F.col("to_line") - F.col("from_line") + 1 <= share * n)).select("id", "from_line", "to_line")


def signatures(frags: DataFrame, least: int = 5) -> DataFrame:
    """The lines of a definition up to the first that opens its body."""
    l = F.split("content", "\n")
    opens = F.array_position(F.transform(l, lambda x: F.when(x.rlike(r"[{:]\s*$"), 1).otherwise(0)), 1)
    kept = frags.filter(F.col("kind").isin("function", "class", "struct", "interface", "enum") & F.col("content").isNotNull()).filter(F.size(l) >= least)
    return kept.select("id", "start_line", opens.cast("int").alias("n")).filter("n > 0").select("id", "start_line", (F.col("start_line") + F.col("n") - 1).alias("end_line"))


def layout_only(hunks: DataFrame) -> DataFrame:
    """Runs whose sides are equal up to blank lines and white space at line ends."""
    clean = lambda c: F.filter(F.transform(c, lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    return hunks.withColumn("layout", clean(F.col("removed")) == clean(F.col("added")))
