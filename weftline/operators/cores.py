"""Which fragments a change is in, and how much of it each of them carries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.edges import BIN, binned

# Kinds a hunk prefers, and kinds that enclose cores.
SEMANTIC = ("function", "class", "struct", "impl", "interface", "enum", "module", "type", "variable", "record", "property", "declaration", "definition", "section")
CONTAINERS = ("class", "interface", "struct")


def identify(spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """``hunk, core, tier`` of ``id, file, kind, start_line, end_line`` and ``hunk, file, hs, he``.

    A hunk is in the fragment that covers it (semantic kinds first, then the shortest, then the least
    line and id); where none does, in all that overlap it; where none does, in the nearest before and
    the nearest after it.  A container around a core is a core too.
    """
    s = binned(spans.select("id", "file", "kind", "start_line", "end_line"), "start_line", "end_line")
    h = binned(hunks.select("hunk", "file", "hs", "he"), "hs", "he")
    met = h.join(s, ["file", "bin"]).filter("start_line <= he and end_line >= hs").drop("bin").distinct()
    size = F.col("end_line") - F.col("start_line")
    order = F.struct((~F.col("kind").isin(*SEMANTIC)).cast("int"), size, F.col("start_line"), F.col("id"))
    covering = met.filter("start_line <= hs and he <= end_line").groupBy("hunk").agg(F.min_by("id", order).alias("core")).withColumn("tier", F.lit("covering"))
    overlapping = met.join(covering.select("hunk"), "hunk", "left_anti").select("hunk", F.col("id").alias("core"), F.lit("overlapping").alias("tier"))
    alone = hunks.select("hunk", "file", "hs", "he").join(met.select("hunk").distinct(), "hunk", "left_anti")
    # An as-of join by one sort of a file's fragments and lonely hunks; fragments that touch no hunk end before or start after it.
    ends = spans.select("file", F.col("end_line").alias("at"), F.struct(F.col("end_line").alias("x"), (-F.col("start_line")).alias("y"), (-F.col("id")).alias("i")).alias("f"), F.lit(None).cast("long").alias("hunk"))
    starts = spans.select("file", F.col("start_line").alias("at"), F.struct(F.col("start_line").alias("x"), F.col("end_line").alias("y"), F.col("id").alias("i")).alias("f"), F.lit(None).cast("long").alias("hunk"))
    mark = lambda at: alone.select("file", F.col(at).alias("at"), F.lit(None).cast(ends.schema["f"].dataType).alias("f"), F.col("hunk").cast("long").alias("hunk"))
    w = Window.partitionBy("file").orderBy("at", F.col("hunk").isNull().cast("int"))
    before = ends.unionByName(mark("hs")).withColumn("b", F.max("f").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("hunk is not null and b is not null").select("hunk", (-F.col("b.i")).alias("core"))
    v = Window.partitionBy("file").orderBy(F.desc("at"), F.col("hunk").isNull().cast("int"))
    after = starts.unionByName(mark("he")).withColumn("b", F.min("f").over(v.rowsBetween(Window.unboundedPreceding, -1))).filter("hunk is not null and b is not null").select("hunk", F.col("b.i").alias("core"))
    nearest = before.unionByName(after).withColumn("tier", F.lit("nearest"))
    found = covering.unionByName(overlapping).unionByName(nearest)
    inner = found.join(spans.select(F.col("id").alias("core"), "file", F.col("start_line").alias("cs"), F.col("end_line").alias("ce")), "core").withColumn("bin", F.floor(F.col("cs") / BIN))
    boxes = binned(spans.filter(F.col("kind").isin(*CONTAINERS)).select("id", "file", "start_line", "end_line"), "start_line", "end_line")
    around = inner.join(boxes, ["file", "bin"]).filter("id <> core and start_line <= cs and ce <= end_line").select("hunk", F.col("id").alias("core"), F.lit("container").alias("tier"))
    rank = F.expr("array_position(array('covering', 'overlapping', 'nearest', 'container'), tier)")
    return found.unionByName(around).groupBy("hunk", "core").agg(F.min_by("tier", rank).alias("tier"))


def seed_weights(spans: DataFrame, hunks: DataFrame, cores: DataFrame) -> DataFrame:
    """``core, seed, changed``: hunk lines of every core, whole and clipped to it.

    A core no hunk overlaps takes, if it is a container, the sum of the cores inside it, else the
    size of the largest hunk of its file.
    """
    c = spans.join(cores.select(F.col("core").alias("id")).distinct(), "id").select("id", "file", "kind", "start_line", "end_line")
    met = binned(hunks.select("hunk", "file", "hs", "he"), "hs", "he").join(binned(c, "start_line", "end_line"), ["file", "bin"]).filter("start_line <= he and hs <= end_line").drop("bin").distinct()
    own = met.groupBy("id").agg(F.sum(F.col("he") - F.col("hs") + 1).cast("double").alias("seed"), F.sum(F.least("he", "end_line") - F.greatest("hs", "start_line") + 1).cast("double").alias("changed"))
    missing = c.join(own.select("id"), "id", "left_anti")
    inner = c.join(own, "id").select("file", F.col("start_line").alias("cs"), F.col("end_line").alias("ce"), F.floor(F.col("start_line") / BIN).alias("bin"), "seed", "changed")
    boxes = binned(missing.filter(F.col("kind").isin(*CONTAINERS)), "start_line", "end_line")
    summed = boxes.join(inner, ["file", "bin"]).filter("start_line <= cs and ce <= end_line").groupBy("id").agg(F.sum("seed").alias("seed"), F.sum("changed").alias("changed"))
    best = hunks.groupBy("file").agg(F.max(F.col("he") - F.col("hs") + 1).cast("double").alias("best"))
    rest = missing.join(summed.select("id"), "id", "left_anti").join(best, "file").select("id", F.col("best").alias("seed"), F.col("best").alias("changed"))
    return own.unionByName(summed).unionByName(rest).select(F.col("id").alias("core"), "seed", "changed")
