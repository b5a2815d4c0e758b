"""Queries of path links, excerpts, signatures, discovery and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import edges as E
from weftline.operators import links as L
from weftline.operators import relations as R
from weftline.plans.edge_queries import COCHANGE_EDGES, COCHANGE_SQL, both_sql
from weftline.plans.graph_queries import SEED_SQL, seeds
from weftline.plans.io_queries import patch_hunks
from weftline.plans.registry import query
from weftline.runtime import cut, table

REF = L.PATH_REFERENCE.replace("'", "''")


@query(
    rf"""WITH {R.FRAGMENTS_SQL}, x AS (SELECT DISTINCT repo, file AS own, regexp_replace(path, '/?[^/]*$', '') AS dir, unnest(regexp_extract_all(content, '{REF}')) AS ref FROM f WHERE repo IS NOT NULL AND content IS NOT NULL),
    rf AS (SELECT DISTINCT repo, own, array_to_string(list_filter(string_split(ref, '/'), lambda q: q <> '' AND q <> '.'), '/') AS path FROM x WHERE NOT regexp_matches(ref, '^/') AND NOT contains(ref, '..')),
    fl AS (SELECT DISTINCT repo, path, file FROM f WHERE repo IS NOT NULL AND path IS NOT NULL), ex AS (SELECT own AS src, file AS dst FROM rf JOIN fl USING (repo, path)),
    nm AS (SELECT repo, list_extract(string_split(path, '/'), -1) AS name, file FROM fl), fw AS (SELECT repo, name FROM nm GROUP BY 1, 2 HAVING count(*) <= 8),
    lo AS (SELECT DISTINCT repo, own, list_extract(string_split(path, '/'), -1) AS name FROM rf ANTI JOIN fl USING (repo, path)),
    p AS (SELECT src, dst FROM ex UNION SELECT own AS src, file AS dst FROM lo JOIN fw USING (repo, name) JOIN nm USING (repo, name)) """
    + both_sql("SELECT src, dst FROM p", "0.55", "0.35", "config")
)
def path_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.path_links(cut(R.fragments(spark, sf_dir).select("repo", "path", "file", "content")))


@query(r"""WITH d AS (SELECT DISTINCT ON (fragment_id) fragment_id AS id, language, content FROM fragments ORDER BY fragment_id, ingested_at DESC NULLS LAST), k AS (SELECT DISTINCT unnest(regexp_extract_all(content, '(?m)^([a-z]+(?:\.[a-z]+)*)=', 1)) AS key FROM d WHERE language = 'properties'),
    u AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '\b[a-z]+(?:\.[a-z]+)+\b')) AS key FROM d WHERE language <> 'properties'), s AS (SELECT id, key, string_split(key, '.') AS p FROM u),
    t AS (SELECT id, key, array_to_string(list_slice(p, 1, n), '.') AS defined FROM (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM s))
    SELECT id, t.key, arg_max(defined, length(defined)) AS defined FROM t JOIN k ON t.defined = k.key GROUP BY 1, 2""")
def prefix_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fragments(spark, sf_dir).select("id", "language", "content")
    defs = f.filter("language = 'properties'").select(F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^([a-z]+(?:\.[a-z]+)*)="), F.lit(1))).alias("key"))
    uses = f.filter("language <> 'properties'").select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b[a-z]+(?:\.[a-z]+)+\b"), F.lit(0)))).alias("key"))
    return L.longest_prefix(uses, defs)


@query(f"""WITH {COCHANGE_SQL}, ed AS ({COCHANGE_EDGES}), {SEED_SQL}, r1 AS (SELECT DISTINCT dst AS node FROM sd JOIN ed ON sd.node = ed.src), r2 AS (SELECT DISTINCT dst AS node FROM r1 JOIN ed ON r1.node = ed.src)
    SELECT node, min(round) AS round FROM (SELECT node, 0 AS round FROM sd UNION ALL SELECT node, 1 FROM r1 UNION ALL SELECT node, 2 FROM r2) GROUP BY 1""")
def discovered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.discovered(cut(E.cochange(R.baskets(spark, sf_dir))), seeds(spark, sf_dir))


@query(f"""WITH {R.FRAGMENTS_SQL}, {R.HUNKS_SQL}, x AS (SELECT id, greatest(hs - 3, start_line) AS from_line, least(he + 3, end_line) AS to_line, end_line - start_line + 1 AS n FROM h JOIN f ON hunk = id)
    SELECT id, from_line, to_line FROM x WHERE n >= 12 AND to_line - from_line + 1 <= 0.70 * n""")
def core_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fragments(spark, sf_dir).select("id", "file", "kind", "start_line", "end_line")
    return L.excerpts(f.select("id", "start_line", "end_line"), R.hunks(f))


@query(rf"""WITH {R.FRAGMENTS_SQL}, l AS (SELECT id, start_line, string_split(content, chr(10)) AS l FROM f WHERE kind IN ('function', 'class', 'struct', 'interface', 'enum') AND content IS NOT NULL),
    n AS (SELECT id, start_line, list_position(list_transform(l, lambda x: regexp_matches(x, '[{{:]\s*$')), true) AS n FROM l WHERE len(l) >= 5) SELECT id, start_line, start_line + n - 1 AS end_line FROM n WHERE n > 0""")
def signature_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.signatures(R.fragments(spark, sf_dir))


@query()
def layout_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.layout_only(patch_hunks(spark, sf_dir)).select("instance_id", "path", "new_start", "new_len", "layout")


@query("""WITH i AS (SELECT DISTINCT ON (instance_id) instance_id, gold_files FROM instances ORDER BY instance_id, ingested_at DESC NULLS LAST) SELECT instance_id, 8000 - (24 + 4 * coalesce(len(gold_files), 0)) AS budget FROM i""")
def envelope_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a budget once the document's envelope is charged: 24 tokens and 4 an entry."""
    return R.instances(spark, sf_dir).select("instance_id", (8000 - (24 + 4 * F.coalesce(F.size("gold_files"), F.lit(0)))).alias("budget"))


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment)")
def level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several levels of a hierarchy in one pass."""
    return table(spark, sf_dir, "customer").rollup("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"), F.count("*").alias("n"))
