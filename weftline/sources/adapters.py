"""Rows of any benchmark as instances: one table of names, one schema for all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSTANCE = {
    "instance_id": "string", "source_benchmark": "string", "repo": "string", "base_commit": "string", "gold_patch": "string", "gold_files": "array<string>", "language": "string", "problem_statement": "string",
    "gold_fragments": "array<struct<path:string,start_line:int,end_line:int,kind:string>>",
}
#: Column names under which benchmarks hold a field, in order of preference.
NAMES = {
    "instance_id": ("instance_id", "id", "task_id"), "repo": ("repo", "repository", "repo_name", "project"), "base_commit": ("base_commit", "base_sha", "commit", "parent_commit"), "gold_patch": ("gold_patch", "patch", "diff"),
    "gold_files": ("gold_files", "files", "modified_files"), "language": ("language", "lang"), "problem_statement": ("problem_statement", "issue", "description", "text"), "gold_fragments": ("gold_fragments", "gold_spans"),
}


def repository(raw: Column) -> Column:
    """``owner/name`` of a repository however it is written; null stays null."""
    x = F.regexp_replace(F.trim(raw), r"^(?:[a-z+]+://)?(?:[^@/]+@)?(?:[\w-]+\.)+[\w-]+(?::\d+)?[:/]", "")
    return F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("__"), F.lit("/")), r"(?:\.git)?/*$", ""), r"^([^/]+/[^/]+)/.*$", "$1")


def adapt(rows: DataFrame, benchmark: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of one benchmark as instances; ``names`` says where a field is that has another name here.

    A field no column holds is null.  Gold files are those of the patch where none are given; ids get the
    benchmark's name in front, so that instances of several benchmarks never clash.
    """
    columns = set(rows.columns)

    def field(name: str) -> Column:
        found = (names or {}).get(name) or next((c for c in NAMES.get(name, ()) if c in columns), None)
        return F.col(found).cast(INSTANCE[name]) if found else F.lit(None).cast(INSTANCE[name])

    of_patch = F.array_distinct(F.regexp_extract_all(F.coalesce(field("gold_patch"), F.lit("")), F.lit(r"(?m)^diff --git a/(\S+)"), F.lit(1)))
    out = {n: field(n) for n in INSTANCE} | {"source_benchmark": F.lit(benchmark), "repo": repository(field("repo")), "gold_files": F.coalesce(field("gold_files"), of_patch), "language": F.lower(field("language"))}
    bare = field("instance_id")
    out["instance_id"] = F.when(bare.startswith(f"{benchmark}::"), bare).otherwise(F.concat(F.lit(f"{benchmark}::"), bare))
    return rows.select(*[c.alias(n) for n, c in out.items()])


def pooled(adapted: list[DataFrame]) -> DataFrame:
    """Instances of several benchmarks, once per id (the one with the longest patch counts; ties: the greater patch)."""
    whole = adapted[0]
    for df in adapted[1:]:
        whole = whole.unionByName(df)
    rest = [c for c in INSTANCE if c != "instance_id"]
    return whole.groupBy("instance_id").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(F.length("gold_patch"), F.lit(0)), "gold_patch", "repo", "base_commit")).alias("r")).select("instance_id", "r.*")
