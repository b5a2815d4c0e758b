"""Rendered documents: fenced Markdown, YAML, text and the three artifact documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fence(text: Column) -> Column:
    """A fence longer than any run of backticks in the text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def json_string(text: Column) -> Column:
    """A text as a JSON string with its quotes; YAML reads it too.  Line separators YAML would break at are escaped."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("c"))), r'(?s)^\{"c":(.*)\}$', 1)
    for c in ("\x7f", "\x85", "\u2028", "\u2029"):
        quoted = F.replace(quoted, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return quoted


def markdown(fragments: DataFrame) -> DataFrame:
    """``path, start_line, block``: one fenced block per fragment of ``path, start_line, end_line, content``."""
    f = fence(F.col("content"))
    head = F.format_string("### %s:%d-%d\n", "path", "start_line", "end_line")
    return fragments.select("path", "start_line", F.concat(head, f, F.lit("\n"), F.col("content"), F.when(F.col("content").endswith("\n"), "").otherwise("\n"), f).alias("block"))


def yaml(fragments: DataFrame) -> DataFrame:
    """``path, start_line, block``: one YAML item per fragment, the content as a block scalar.

    The chomping mark keeps line feeds at the end as they are; a text with control characters or
    leading blanks is quoted as JSON, which YAML reads.
    """
    body = F.regexp_replace(F.regexp_replace("content", "\n$", ""), "(?m)^(?=.)", "    ")
    chomp = F.when(F.col("content").rlike("\n\n$"), "|+").when(F.col("content").endswith("\n"), "|").otherwise("|-")
    plain = ~F.col("content").rlike("[\\x00-\\x08\\x0b-\\x1f\\x7f\\x85\\u2028\\u2029]") & ~F.col("content").rlike("^\\s")
    scalar = F.when(plain, F.concat(chomp, F.lit("\n"), body)).otherwise(json_string(F.col("content")))
    return fragments.select("path", "start_line", F.concat(F.lit("- path: "), json_string(F.col("path")), F.lit("\n  content: "), scalar).alias("block"))


def context_document(selected: DataFrame, totals: DataFrame) -> DataFrame:
    """The pack document of each query as JSON: schema, fragments in order, coverage."""
    items = selected.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pick", "path", "start_line", "end_line", "content"))).alias("fragments"))
    doc = F.to_json(F.struct(F.lit("context.v1").alias("schema"), "fragments", F.struct(F.size("fragments").alias("selected"), F.col("total")).alias("coverage")))
    return items.join(totals, "query").select("query", doc.alias("document"))


def locate_document(ranked: DataFrame, most: int = 50) -> DataFrame:
    """The locate document: items and overflow with their true number."""
    items = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "doc", "score")))).alias("items"), F.count("*").alias("total"))
    return items.select("query", F.to_json(F.struct(F.lit("locate.v1").alias("schema"), "items", F.col("total"))).alias("document"))


def json_items(fragments: DataFrame) -> DataFrame:
    """``path, start_line, block``: one JSON object per fragment."""
    return fragments.select("path", "start_line", F.to_json(F.struct("path", "start_line", "end_line", "content")).alias("block"))


def text(fragments: DataFrame) -> DataFrame:
    """``path, start_line, block``: a line with the place, then the content with its lines indented."""
    body = F.regexp_replace(F.regexp_replace("content", "\n$", ""), "(?m)^(?=.)", "  ")
    return fragments.select("path", "start_line", F.concat(F.format_string("%s:%d-%d\n", "path", "start_line", "end_line"), body, F.lit("\n")).alias("block"))


def impact_document(callers: DataFrame, tests: DataFrame, coverage: DataFrame, most: int = 200) -> DataFrame:
    """One row ``document``: callers, reaching tests and how the files were read; ``empty`` only if all of them were resolved.

    At most ``most`` items of each list are named, with their true number.
    """
    order = F.struct("name", "file", "line", "is_test")
    c = callers.orderBy("name", "file", "line").limit(most).agg(F.array_sort(F.collect_list(order)).alias("callers"))
    t = tests.orderBy("file").limit(most).agg(F.array_sort(F.collect_list(F.struct("file", "hops"))).alias("tested_by"))
    sizes = callers.agg(F.count("*").alias("n_callers")).join(tests.agg(F.count("*").alias("n_tests")))
    cover = coverage.agg(F.array_sort(F.collect_list(F.struct("model", "files", "unresolved"))).alias("coverage"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("open"))
    whole = c.join(t).join(sizes).join(cover)
    empty = (F.col("n_callers") == 0) & (F.col("n_tests") == 0) & (F.col("open") == 0)
    return whole.select(F.to_json(F.struct(F.lit("impact.v1").alias("schema"), empty.alias("empty"), "callers", "tested_by", F.struct("n_callers", "n_tests").alias("totals"), "coverage")).alias("document"))


def provenance(candidates: DataFrame, hops: DataFrame, incoming: DataFrame, selected: DataFrame) -> DataFrame:
    """``id, line``: per candidate its relevance, hops from a core, mass by category and whether it was selected, as JSON.

    ``candidates`` are ``id, rel``, ``hops`` ``node, hops``, ``incoming`` ``node, category, mass``, ``selected`` ``id``.
    """
    mass = incoming.groupBy(F.col("node").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.round("mass", 4).alias("mass"))))).alias("incoming"))
    rows = candidates.select("id", "rel").join(hops.select(F.col("node").alias("id"), "hops"), "id", "left").join(mass, "id", "left").join(selected.select("id", F.lit(True).alias("selected")), "id", "left")
    empty = F.create_map().cast("map<string,double>")
    return rows.select("id", F.to_json(F.struct("id", F.round("rel", 6).alias("relevance"), F.coalesce("hops", F.lit(-1)).alias("hops"), F.coalesce("incoming", empty).alias("incoming"), F.coalesce("selected", F.lit(False)).alias("selected"))).alias("line"))
