"""Queries of imports, references and language edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import references as RF
from weftline.operators import relations as R
from weftline.operators import rules
from weftline.plans.edge_queries import both_sql
from weftline.plans.registry import ORACLE, QUERIES, query
from weftline.runtime import cut

IMPORT_EDGES_SQL = """e AS (SELECT src, dst, max(struct_pack(w := weight, r := reverse)) AS w FROM imp GROUP BY 1, 2), b AS (SELECT src, dst, w.w AS weight FROM e UNION ALL SELECT dst, src, w.w * w.r FROM e)
    SELECT src, dst, max(weight) AS weight, 'semantic' AS category FROM b GROUP BY 1, 2"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fragments(spark, sf_dir).select("id", "repo", "path", "file", "language", "content", "start_line")


@query(f"WITH {R.FRAGMENTS_SQL}, {RF.imports_sql()}, {IMPORT_EDGES_SQL}")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, includes, sources and references of build and deployment files, all languages in one pass."""
    return RF.import_edges(cut(sources(spark, sf_dir).drop("id", "start_line")))


#: Languages whose name links an import confirms, with the weight and reverse factor of a call.
CONFIRM = {"python": (0.55, 0.40), "javascript": (0.50, 0.50), "typescript": (0.70, 0.50)}
PACKAGES = {"go": 0.05, "rust": 0.05, "java": 0.05, "kotlin": 0.05, "scala": 0.05, "csharp": 0.05}
#: Languages of the tables with a query of their own.
LANGUAGES = ("python", "javascript", "typescript", "go", "rust", "java", "c", "shell", "sql", "css", "yaml", "hcl")


def of(language: str) -> tuple:
    return tuple(r for r in RF.REFERENCES if r[0] == language)


def confirmed(language: str) -> tuple:
    """The query and twin of the calls of a language, weighed by its imports."""
    weight, reverse = CONFIRM[language]
    _, _, _, _, defs, uses = next(r for r in rules.RULES if r[0] == language and r[1] == "call")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = cut(sources(spark, sf_dir).filter((F.col("language") == language) & F.col("repo").isNotNull()))
        found = lambda p: F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(1)))).alias("x")
        names = lambda p: f.select("repo", "id", "file", found(p)).select(F.concat_ws("|", "repo", "x").alias("name"), F.col("id").alias("node"), "file")
        return RF.confirmed_links(names(defs), names(uses), RF.file_imports(f, of(language)), weight, reverse)

    side = lambda p: f"SELECT repo || '|' || unnest(list_distinct(regexp_extract_all(content, '{p}', 1))) AS name, id, file FROM f"
    base = R.FRAGMENTS_SQL.replace("f AS (", "f0 AS (", 1)
    sql = f"""WITH {base}, f AS (SELECT * FROM f0 WHERE language = '{language}' AND repo IS NOT NULL), {RF.imports_sql(of(language))},
    d AS ({side(defs)}), u AS ({side(uses)}), few AS (SELECT name FROM d GROUP BY 1 HAVING count(DISTINCT file) <= 8),
    h AS (SELECT u.id AS src, d.id AS dst, least(1.0, {weight}::DOUBLE * CASE WHEN imp.src IS NOT NULL THEN 1.5 WHEN u.file = d.file THEN 1.0 ELSE 0.2 END) AS w
      FROM u JOIN few USING (name) JOIN d USING (name) LEFT JOIN (SELECT DISTINCT src, dst FROM imp) imp ON imp.src = u.file AND imp.dst = d.file
      WHERE u.id <> d.id AND NOT EXISTS (SELECT 1 FROM d x WHERE x.name = u.name AND x.id = u.id)),
    m AS (SELECT src, dst, max(w) AS w FROM h GROUP BY 1, 2), p AS ({both_sql("SELECT src, dst, w FROM m", "w", str(reverse), "semantic")})
    SELECT src, dst, category, max(weight) AS weight FROM p GROUP BY 1, 2, 3"""
    return run, sql


for _language in CONFIRM:
    QUERIES[f"{_language}_call_edges"], ORACLE[f"{_language}_call_edges"] = confirmed(_language)


def imported(language: str) -> tuple:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = cut(sources(spark, sf_dir).filter(F.col("language") == language))
        return RF.file_imports(f, of(language)).select("src", "dst", "role", "weight", "reverse")

    base = R.FRAGMENTS_SQL.replace("f AS (", "f0 AS (", 1)
    return run, f"WITH {base}, f AS (SELECT * FROM f0 WHERE language = '{language}'), {RF.imports_sql(of(language))} SELECT DISTINCT src, dst, role, weight, reverse FROM imp"


for _language in LANGUAGES:
    if of(_language):
        QUERIES[f"{_language}_imports"], ORACLE[f"{_language}_imports"] = imported(_language)


@query(
    rf"""WITH {R.FRAGMENTS_SQL}, d AS (SELECT DISTINCT repo, regexp_replace(path, '/?[^/]*$', '') AS dir, language, file FROM f WHERE repo IS NOT NULL AND path IS NOT NULL AND language IN ('{"', '".join(PACKAGES)}')),
    k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY repo, dir, language ORDER BY file) <= 20),
    p AS (SELECT a.file AS src, b.file AS dst FROM k a JOIN k b ON a.repo = b.repo AND a.dir = b.dir AND a.language = b.language AND a.file < b.file) """
    + both_sql("SELECT src, dst FROM p", "0.05", "0.40", "semantic")
)
def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one package: of one language in one folder."""
    f = R.fragments(spark, sf_dir).filter("repo is not null and path is not null").select("repo", "path", "file", "language")
    return RF.package_edges(f, PACKAGES)
