"""Text to fragments: blocks, sections, gaps, truncation, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^#{1,6}\s+\S"
TOML_BOUNDARY = r"^\["


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no (from 1), line``."""
    return df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def line_blocks(df: DataFrame, key: str, text: str, size: int = 200) -> DataFrame:
    """Fixed blocks of lines with their range and text; one pass, no shuffle."""
    parts = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / size))
    cut = df.filter(F.col(text).isNotNull()).select(key, parts.alias("l"), F.explode(starts).alias("block_no"))
    return cut.select(
        key,
        F.col("block_no").cast("long"),
        (F.col("block_no") * size + 1).cast("long").alias("start_line"),
        F.least((F.col("block_no") + 1) * size, F.size("l")).cast("long").alias("end_line"),
        F.array_join(F.slice("l", (F.col("block_no") * size + 1).cast("int"), size), "\n").alias("content"),
    )


def sections(df: DataFrame, key: str, text: str, boundary: str = HEADING, least: int = 1) -> DataFrame:
    """Runs of lines that begin at a boundary line; what comes before the first is dropped.

    A text with fewer than ``least`` boundaries has no sections.  Sections are found inside the row,
    so a text of any number of sections costs no shuffle.
    """
    parts = F.split(text, "\n")
    marks = F.filter(F.transform(F.col("l"), lambda x, i: F.when(x.rlike(boundary), i + 1).otherwise(F.lit(0))), lambda x: x > 0)
    ends = F.concat(F.slice("m", 2, F.size("m")), F.array(F.size("l") + 1))
    held = df.filter(F.col(text).isNotNull()).select(key, parts.alias("l")).withColumn("m", marks).filter(F.size("m") >= least)
    pairs = held.select(key, "l", F.posexplode(F.arrays_zip(F.col("m").alias("s"), ends.alias("e"))).alias("section_no", "z"))
    return pairs.select(
        key,
        F.col("section_no").cast("long"),
        F.element_at("l", F.col("z.s")).alias("title"),
        F.col("z.s").cast("long").alias("start_line"),
        (F.col("z.e") - 1).cast("long").alias("end_line"),
    )


def islands(numbered: DataFrame, key: str, filled: str) -> DataFrame:
    """Maximal runs of consecutive filled lines of ``lines()``: gaps and islands."""
    w = Window.partitionBy(key).orderBy("line_no")
    runs = numbered.filter(filled).withColumn("g", F.col("line_no") - F.row_number().over(w))
    return runs.groupBy(key, "g").agg(F.min("line_no").cast("long").alias("start_line"), F.max("line_no").cast("long").alias("end_line")).drop("g")


def truncated(df: DataFrame, key: str, text: str, most: int = 30) -> DataFrame:
    """Texts above ``most`` lines cut there, with a note of how many more there are."""
    parts = F.split(text, "\n")
    n = F.size(parts)
    note = F.concat(F.lit("# ... ["), (n - most).cast("string"), F.lit(" more lines]"))
    return df.filter(F.col(text).isNotNull()).select(key, F.when(n > most, F.concat_ws("\n", F.array_join(F.slice(parts, 1, most), "\n"), note)).otherwise(F.col(text)).alias("content"))


def capped(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first rows of each group in a total order."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def merged_ranges(df: DataFrame, key: str) -> DataFrame:
    """Ranges of a key joined where they touch or overlap, contained ones dropped."""
    w = Window.partitionBy(key).orderBy("start_line", "end_line", "id")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("new", F.when(F.col("start_line") <= before + 1, 0).otherwise(1))
    numbered = opened.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "g").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("parts")).drop("g")
