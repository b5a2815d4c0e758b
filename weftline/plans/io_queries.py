"""Queries of readers, sinks and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import edges as E
from weftline.operators import impact
from weftline.operators import relations as R
from weftline.plans.edge_queries import COCHANGE_EDGES, COCHANGE_SQL
from weftline.plans.registry import query
from weftline.runtime import cut, table
from weftline.sinks import documents, graphs
from weftline.sources import diffs, trees


@query()
def patch_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.patch_hunks(R.instances(spark, sf_dir), "instance_id", "gold_patch")


@query(r"""WITH i AS (SELECT DISTINCT ON (instance_id) instance_id, gold_patch FROM instances ORDER BY instance_id, ingested_at DESC NULLS LAST), l AS (SELECT instance_id, unnest(string_split(gold_patch, chr(10))) AS line FROM i)
    SELECT instance_id, count(*) FILTER (regexp_matches(line, '^\+') AND NOT regexp_matches(line, '^\+\+\+ ')) AS added, count(*) FILTER (regexp_matches(line, '^-') AND NOT regexp_matches(line, '^--- ')) AS removed
    FROM l GROUP BY 1 HAVING added + removed > 0""")
def hunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the parsed runs: as many as the patch marks."""
    h = patch_hunks(spark, sf_dir)
    return h.groupBy("instance_id").agg(F.sum("new_len").alias("added"), F.sum("old_len").alias("removed"))


@query(r"""WITH f AS (SELECT repo || '/' || path AS path, sum(strlen(content))::BIGINT AS size FROM (SELECT DISTINCT ON (fragment_id) * FROM fragments ORDER BY fragment_id, ingested_at DESC NULLS LAST) WHERE repo IS NOT NULL AND path IS NOT NULL GROUP BY 1),
    p AS (SELECT string_split(path, '/') AS parts, size FROM f), u AS (SELECT array_to_string(list_slice(parts, 1, k), '/') AS node, k AS depth, k = len(parts) AS is_file, size FROM (SELECT parts, size, unnest(range(1, len(parts) + 1)) AS k FROM p))
    SELECT node, depth, is_file, count(*) AS files, sum(size)::BIGINT AS bytes FROM u GROUP BY 1, 2, 3""")
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fragments").select("fragment_id", "repo", "path", F.octet_length("content").alias("n")).dropDuplicates(["fragment_id"]).filter("repo is not null and path is not null")
    return trees.directory_tree(f.groupBy(F.concat_ws("/", "repo", "path").alias("path")).agg(F.sum("n").alias("size")))


@query("SELECT DISTINCT repo, path FROM fragments WHERE path IS NOT NULL AND (regexp_matches(path, '(?:^|/)[^/]*\\.lock(?:/.*)?$') OR regexp_matches(path, '(?:^|/)node_modules/.*$') OR regexp_matches(path, '(?:^|/)[^/]*\\.env(?:/.*)?$'))")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fragments").filter("path is not null").select("repo", "path").distinct()
    return f.filter(trees.ignored(F.col("path"), ["# tools", "*.lock", "node_modules/", "*.env"]))


@query(f"""WITH {COCHANGE_SQL}, ed AS ({COCHANGE_EDGES}), n AS (SELECT src FROM ed UNION SELECT dst FROM ed) SELECT 1 AS ord, '<node id="' || src || '"/>' AS line FROM n
    UNION ALL SELECT 2, '<edge source="' || src || '" target="' || dst || '"><data key="weight">' || round(weight, 4) || '</data><data key="category">' || category || '</data></edge>' FROM ed
    UNION ALL SELECT 0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">' UNION ALL SELECT 3, '</graph></graphml>'""")
def graphml_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.graphml_rows(E.cochange(R.baskets(spark, sf_dir)))


@query()
def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.json_rows(E.cochange(R.baskets(spark, sf_dir)))


@query(f"""WITH {R.FRAGMENTS_SQL}, w AS (SELECT *, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda x: length(x))), 0) + 1)::INT) AS fence FROM f WHERE content IS NOT NULL AND path IS NOT NULL)
    SELECT id, md5('### ' || path || ':' || start_line || '-' || end_line || chr(10) || fence || chr(10) || content || CASE WHEN ends_with(content, chr(10)) THEN '' ELSE chr(10) END || fence) AS block FROM w""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fragments(spark, sf_dir).filter("content is not null and path is not null")
    fence = documents.fence(F.col("content"))
    head = F.format_string("### %s:%d-%d\n", "path", "start_line", "end_line")
    return f.select("id", F.md5(F.concat(head, fence, F.lit("\n"), F.col("content"), F.when(F.col("content").endswith("\n"), "").otherwise("\n"), fence)).alias("block"))


def impact_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files with their facts, and the least path of each repo as what changes."""
    f = R.fragments(spark, sf_dir).filter("repo is not null and path is not null and content is not null").select("repo", "path", "file", "content")
    return f, cut(impact.facts(f)), f.groupBy("repo").agg(F.min("file").alias("file")).select("file")


@query()
def impact_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of what each repo's least path defines, elsewhere in the corpus."""
    _, facts, changed = impact_parts(spark, sf_dir)
    return impact.callers(facts, changed)


@query()
def impact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files that reach what each repo's least path defines."""
    _, facts, changed = impact_parts(spark, sf_dir)
    return impact.reaching_tests(facts, changed)


@query()
def impact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, facts, _ = impact_parts(spark, sf_dir)
    return impact.coverage(facts, f)


# Go definitions and imports alone, as SQL can read them line by line.
@query(r"""WITH f AS (SELECT DISTINCT ON (fragment_id) * FROM fragments ORDER BY fragment_id, ingested_at DESC NULLS LAST), l AS (SELECT repo || ':' || path AS file, string_split(content, chr(10)) AS l FROM f WHERE repo IS NOT NULL AND path IS NOT NULL AND content IS NOT NULL AND lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) = 'go'),
    n AS (SELECT file, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM l), c AS (SELECT * FROM n WHERE NOT regexp_matches(line, '^\s*(?://|#[^\[]|#$|\*|/\*)'))
    SELECT file, 'def' AS fact, CASE WHEN regexp_extract(line, '^func\s+(?:\([^)]*\)\s*)?(\w+)', 1) <> '' THEN regexp_extract(line, '^func\s+(?:\([^)]*\)\s*)?(\w+)', 1) ELSE regexp_extract(line, '^type\s+(\w+)', 1) END AS name, no AS line FROM c
      WHERE regexp_matches(line, '^func\s+(?:\([^)]*\)\s*)?\w+|^type\s+\w+')""")
def go_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fragments(spark, sf_dir).filter("repo is not null and path is not null and content is not null").select("path", "file", "content")
    return impact.facts(f.filter(X.extension(F.col("path")) == "go")).filter("fact = 'def'").select("file", "fact", "name", "line")
