"""The training-data queries pN_..., each a function of (session, data directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe_encode, grouped_split, mojibake, piece_cut, quantile_sketch, secret_scan, source_filter, source_mix, split_overlap
from weftline.runtime import cut, spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_filter.not_hand_written(table(spark, sf_dir, "fragments")).select("repo", "path")


def p1_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_filter.hand_written(table(spark, sf_dir, "fragments")).select("fragment_id", "repo", "path", "content")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per benchmark (``run_day`` null) and per benchmark and day, with their error bound."""
    days = cut(quantile_sketch.day_sketches(table(spark, sf_dir, "results")))
    keys = ["source_benchmark", "run_day", "measure"]
    whole = quantile_sketch.over_days(days).withColumn("run_day", F.lit(None).cast("string"))
    return quantile_sketch.percentiles_of(whole.select(*days.columns).unionByName(days), keys)


def p2_day_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches themselves: what is kept of a day to combine it with others later."""
    return quantile_sketch.day_sketches(table(spark, sf_dir, "results"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.found_pairs(split_overlap.overlaps(table(spark, sf_dir, "instances"), table(spark, sf_dir, "split_manifest")))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, sf_dir, "instances"), table(spark, sf_dir, "split_manifest"))


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.record_overlap(table(spark, sf_dir, "instances"), table(spark, sf_dir, "split_manifest"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "fragments"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.redact(table(spark, sf_dir, "fragments"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split.same_repo_pairs(grouped_split.repo_roots(table(spark, sf_dir, "instances"), table(spark, sf_dir, "repo_moves")))


def p5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split.grouped_split(table(spark, sf_dir, "instances"), table(spark, sf_dir, "repo_moves"), table(spark, sf_dir, "split_config"))


def p5_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split.split_report(p5_split(spark, sf_dir), table(spark, sf_dir, "instances"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = piece_cut.oversized(table(spark, sf_dir, "fragments"), table(spark, sf_dir, "piece_limits"), "default")
    return piece_cut.cut_pieces(over).filter("piece_no = 1").select("fragment_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_cut.cut_pieces(piece_cut.oversized(table(spark, sf_dir, "fragments"), table(spark, sf_dir, "piece_limits")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode.encode_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    counted = bpe_encode.encode_column(docs, keep=("doc_id", "source"), counts_only=True)
    return source_mix.mix(counted, table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.shares(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mojibake.garbled(docs, mojibake.shared_model(docs)).select("doc_id")


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mojibake.repaired(docs, mojibake.shared_model(docs))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_hand_written": p1_hand_written,
    "p2_percentiles": p2_percentiles,
    "p2_day_sketches": p2_day_sketches,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_coverage": p3_coverage,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p5_split": p5_split,
    "p5_split_report": p5_split_report,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_repaired": p9_repaired,
}

ORACLE: dict[str, str] = {
    "p6_found": """
        SELECT DISTINCT fragment_id FROM fragments
        WHERE greatest(strlen(content) // 4, 1) > (SELECT max(max_tokens) FROM piece_limits WHERE profile = 'default')
    """,
}
