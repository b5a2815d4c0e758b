"""Queries of the text layer: projections, predicates, fragmenting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import fragmenting as TG
from weftline.operators import relations as R
from weftline.plans.registry import query
from weftline.runtime import small, table

WORD = r"[A-Za-z_][\p{L}\p{M}\p{Nd}\p{Pc}]*"


def sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


DIRS_SQL = "list_transform(list_filter(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), lambda x: x <> ''), lambda x: lower(x))"
STEM_SQL = r"regexp_replace(list_extract(string_split(path, '/'), -1), '\.[^.]*$', '')"
FILES_SQL = "files AS (SELECT DISTINCT repo, path FROM fragments)"
#: Words that name nothing in code.
STOPWORDS = ("the", "and", "for", "not", "with", "this", "that", "from", "self", "return", "import", "def", "class", "none", "true", "false", "null", "var", "let", "const", "function", "string", "int")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fragments").select("repo", "path").distinct()


@query(rf"""
    WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{WORD}'))) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t WHERE strlen(term) >= 3 GROUP BY term
""")
def ident_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.identifiers(F.col("text"), 3)).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(rf"""
    WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{WORD}'))) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df FROM t
    WHERE strlen(term) >= 3 AND term NOT IN (SELECT unnest({sql_list(STOPWORDS)})) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY term
""")
def stopword_filtered_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(X.identifiers(F.col("text"), 3))).alias("term"))
    stop = spark.createDataFrame([(w,) for w in STOPWORDS], "term string")
    return words.join(small(stop), "term", "left_anti").filter(~F.col("term").rlike("^[0-9]+$")).groupBy("term").agg(F.count("*").alias("df"))


@query(r"""
    WITH f AS (SELECT DISTINCT fragment_id, symbol FROM fragments WHERE symbol IS NOT NULL),
    a AS (SELECT lower(regexp_replace(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')) AS x FROM f)
    SELECT regexp_replace(regexp_replace(x, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, count(*) AS n FROM a GROUP BY 1
""")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fragments").filter("symbol is not null").select("fragment_id", "symbol").distinct()
    return f.groupBy(X.canonical_key(F.col("symbol")).alias("key")).agg(F.count("*").alias("n"))


@query(r"""
    WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+'))) AS key FROM documents),
    p AS (SELECT doc_id, string_split(key, '.') AS parts FROM d),
    s AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p),
    r AS (SELECT doc_id, parts, i, unnest(range(1, least(6, len(parts) - i + 1) + 1)) AS n FROM s)
    SELECT array_to_string(list_slice(parts, i, i + n - 1), '.') AS run, count(*) AS n FROM r GROUP BY 1
""")
def dotted_subkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+"), F.lit(0)))
    d = table(spark, sf_dir, "documents").select(F.explode(keys).alias("key"))
    return d.select(F.explode(X.dotted_runs(F.col("key"))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


@query(rf"""
    WITH {FILES_SQL}, m AS (SELECT unnest({sql_list(tuple(X.LANGUAGES))}) AS ext, unnest({sql_list(tuple(X.LANGUAGES.values()))}) AS lang),
    e AS (SELECT *, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM files)
    SELECT coalesce(lang, 'other') AS language, count(*) AS n_files FROM e LEFT JOIN m USING (ext) GROUP BY 1
""")
def path_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(X.language(F.col("path")).alias("language")).agg(F.count("*").alias("n_files"))


@query(rf"""
    WITH {FILES_SQL}
    SELECT repo, path FROM files WHERE list_has_any({DIRS_SQL}, {sql_list(X.TEST_DIRS)})
      OR regexp_matches(lower({STEM_SQL}), '(^|[_.\-])(test|tests|spec|specs|selftest|selftests)([_.\-]|$)')
      OR regexp_matches({STEM_SQL}, '(Test|Tests|Spec|Specs)$|^(Test|Tests|Spec|Specs)\p{{Lu}}')
""")
def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(X.is_test(F.col("path")))


@query(rf"""
    WITH f AS (SELECT DISTINCT ON (fragment_id) fragment_id, repo, path, content FROM fragments ORDER BY fragment_id, ingested_at DESC NULLS LAST),
    h AS (SELECT fragment_id, repo, path, lower(array_to_string(list_slice(string_split(content, chr(10)), 1, 10), chr(10))) AS head FROM f)
    SELECT fragment_id, repo, path FROM h WHERE (contains(head, 'do not edit') AND contains(head, 'generat')) OR regexp_matches(head, '@generated([^a-z]|$)')
      OR regexp_matches(head, 'code generated by|auto-generated|autogenerated|this file is generated|automatically generated|auto generated')
""")
def generated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fragments").select("fragment_id", "repo", "path", "content").filter(X.generated_header(F.col("content")))
    return f.select("fragment_id", "repo", "path").dropDuplicates(["fragment_id"])


@query(rf"""
    WITH {FILES_SQL}
    SELECT repo, path, CASE WHEN list_has_any({DIRS_SQL}, {sql_list(X.GENERATED_DIRS)}) THEN 0.1::DOUBLE
      WHEN list_has_any({DIRS_SQL}, {sql_list(X.PERIPHERAL_DIRS)}) OR regexp_matches(lower({STEM_SQL}), '{X.PERIPHERAL_STEM}') THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END AS importance FROM files
""")
def file_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("importance", X.importance(F.col("path")))


PATCH_LINES_SQL = """i AS (SELECT DISTINCT ON (instance_id) instance_id, gold_patch FROM instances ORDER BY instance_id, ingested_at DESC NULLS LAST),
    l AS (SELECT instance_id, unnest(string_split(gold_patch, chr(10))) AS line FROM i)"""


@query(rf"""
    WITH {PATCH_LINES_SQL}
    SELECT instance_id, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS added,
           count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS removed FROM l GROUP BY 1
""")
def patch_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = F.split("gold_patch", "\n")
    added = F.size(F.filter(l, lambda x: x.startswith("+") & ~x.startswith("+++")))
    removed = F.size(F.filter(l, lambda x: x.startswith("-") & ~x.startswith("---")))
    return R.instances(spark, sf_dir).filter("gold_patch is not null").select("instance_id", added.cast("long").alias("added"), removed.cast("long").alias("removed"))


# A patch as one mark per line, so that runs of changed lines are runs of marks.
MARK_SQL = "CASE WHEN starts_with(x, '+') AND NOT starts_with(x, '+++') THEN '+' WHEN starts_with(x, '-') AND NOT starts_with(x, '---') THEN '-' ELSE ' ' END"
SIDE_SQL = "list_filter(list_transform(list_filter(l, lambda x: starts_with(x, '{0}') AND NOT starts_with(x, '{0}{0}{0}')), lambda x: regexp_replace(substr(x, 2), '\\s+$', '')), lambda x: x <> '')"


@query(rf"""
    WITH i AS (SELECT DISTINCT ON (instance_id) instance_id, gold_patch FROM instances ORDER BY instance_id, ingested_at DESC NULLS LAST),
    l AS (SELECT instance_id, coalesce(string_split(gold_patch, chr(10)), []) AS l, list_distinct(regexp_extract_all(coalesce(gold_patch, ''), '(?m)^diff --git a/(\S+)', 1)) AS paths FROM i),
    m AS (SELECT instance_id, paths, array_to_string(list_transform(l, lambda x: {MARK_SQL}), '') AS marks, {SIDE_SQL.format("-")} AS gone, {SIDE_SQL.format("+")} AS came,
      list_transform(list_filter(l, lambda x: {MARK_SQL} <> ' '), lambda x: substr(x, 2)) AS changed FROM l),
    k AS (SELECT instance_id, CASE WHEN len(paths) > 0 AND len(list_filter(paths, lambda x: NOT (regexp_matches(x, '{X.GENERATED_NAMES}')
        OR list_has_any(list_transform(string_split(regexp_replace(x, '/?[^/]*$', ''), '/'), lambda y: lower(y)), {sql_list(X.GENERATED_DIRS)})))) = 0 THEN 'generated'
      WHEN NOT regexp_matches(marks, '[+-]') THEN 'unknown' WHEN gone = came THEN 'layout' WHEN regexp_matches(marks, '\+\+|--') THEN 'content'
      WHEN len(list_filter(changed, lambda x: NOT regexp_matches(x, '{X.MECHANICAL_LINE}'))) = 0 THEN 'mechanical' ELSE 'unknown' END AS change_class FROM m)
    SELECT instance_id, change_class, CASE change_class WHEN 'generated' THEN 2 WHEN 'mechanical' THEN 1 WHEN 'layout' THEN 1 ELSE 0 END AS priority FROM k
""")
def change_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of change a patch is, and its place when evidence competes for a budget."""
    i = R.instances(spark, sf_dir).select("instance_id", F.coalesce("gold_patch", F.lit("")).alias("p")).withColumn("l", F.split("p", "\n"))
    rows = i.select("instance_id", F.array_distinct(F.regexp_extract_all("p", F.lit(r"(?m)^diff --git a/(\S+)"), F.lit(1))).alias("paths"), "l")
    return rows.select("instance_id", X.change_class(F.col("l"), F.col("paths")).alias("change_class")).withColumn("priority", X.evidence_priority(F.col("change_class")))


@query("WITH f AS (SELECT DISTINCT ON (fragment_id) fragment_id, content FROM fragments ORDER BY fragment_id, ingested_at DESC NULLS LAST) SELECT category, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS category, len(regexp_extract_all(content, '{p}')) AS n FROM f" for c, p in X.SHAPES.items()) + ") WHERE n > 0 GROUP BY 1")
def redacted_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fragments").select("fragment_id", "content").dropDuplicates(["fragment_id"])
    counts = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.regexp_count("content", F.lit(p)).alias("n")) for c, p in X.SHAPES.items()]))
    return f.select(counts.alias("s")).select("s.*").filter("n > 0").groupBy("category").agg(F.sum("n").alias("n"))


def sanitized_sql() -> str:
    expr = "content"
    for c, p in X.SHAPES.items():
        expr = f"regexp_replace({expr}, '{p}', '[REDACTED:{c}]', 'g')"
    return f"SELECT DISTINCT ON (fragment_id) fragment_id, md5({expr}) AS clean FROM fragments WHERE content IS NOT NULL"


@query(sanitized_sql())
def sanitized_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fragments").filter("content is not null").select("fragment_id", F.md5(X.redacted(F.col("content"))).alias("clean"))
    return f.dropDuplicates(["fragment_id"])


@query(rf"""
    WITH f AS (SELECT DISTINCT ON (fragment_id) fragment_id, language, content FROM fragments ORDER BY fragment_id, ingested_at DESC NULLS LAST), l AS (SELECT language, unnest(string_split(content, chr(10))) AS line FROM f)
    SELECT language, count(*) AS lines, count(*) FILTER (regexp_matches(line, '{X.COMMENT_LINE.replace("'", "''")}')) AS comments FROM l GROUP BY 1
""")
def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = F.split("content", "\n")
    f = table(spark, sf_dir, "fragments").select("fragment_id", "language", "content").dropDuplicates(["fragment_id"]).filter("content is not null")
    n = f.select("language", F.size(l).alias("n"), F.size(F.filter(l, lambda x: x.rlike(X.COMMENT_LINE))).alias("c"))
    return n.groupBy("language").agg(F.sum("n").alias("lines"), F.sum("c").alias("comments"))


@query(r"""
    WITH d AS (SELECT DISTINCT repo, regexp_replace(path, '/?[^/]*$', '') AS dir FROM fragments),
    c AS (SELECT DISTINCT repo, regexp_replace(unnest(gold_files), '/?[^/]*$', '') AS dir FROM instances WHERE repo IS NOT NULL),
    dp AS (SELECT repo, dir, string_split(dir, '/') AS p FROM d), cp AS (SELECT repo, string_split(dir, '/') AS p FROM c),
    du AS (SELECT repo, dir, unnest(range(0, len(p) + 1)) AS k, p FROM dp), cu AS (SELECT repo, unnest(range(0, len(p) + 1)) AS k, p FROM cp),
    m AS (SELECT repo, array_to_string(list_slice(p, 1, k), '/') AS prefix, k, min(len(p) - k) AS up FROM cu GROUP BY 1, 2, 3)
    SELECT du.repo, du.dir, min(len(du.p) - du.k + m.up) AS distance, round(1 / (1 + 0.30::DOUBLE * min(len(du.p) - du.k + m.up)), 6) AS factor
    FROM du JOIN m ON du.repo = m.repo AND du.k = m.k AND array_to_string(list_slice(du.p, 1, du.k), '/') = m.prefix GROUP BY 1, 2
""")
def dir_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least tree distance from each directory to a changed one of its repo, by joining on common prefixes.

    The changed side is reduced to the least climb per prefix first, so no pairs of directories arise.
    """
    climbs = F.sequence(F.lit(0), F.size("p"))
    d = table(spark, sf_dir, "fragments").select("repo", X.directory(F.col("path")).alias("dir")).distinct().withColumn("p", F.split("dir", "/"))
    c = table(spark, sf_dir, "instances").filter("repo is not null").select("repo", F.explode("gold_files").alias("g")).select("repo", X.directory(F.col("g")).alias("dir")).distinct().withColumn("p", F.split("dir", "/"))
    prefix = F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("prefix")
    du = d.withColumn("k", F.explode(climbs)).select("repo", "dir", "k", prefix, (F.size("p") - F.col("k")).alias("down"))
    cu = c.withColumn("k", F.explode(climbs)).select("repo", "k", prefix, (F.size("p") - F.col("k")).alias("up")).groupBy("repo", "k", "prefix").agg(F.min("up").alias("up"))
    near = du.join(cu, ["repo", "k", "prefix"]).groupBy("repo", "dir").agg(F.min(F.col("down") + F.col("up")).cast("long").alias("distance"))
    return near.withColumn("factor", F.round(1 / (1 + 0.30 * F.col("distance")), 6))


@query(r"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 200 + 1)) AS k FROM d)
    SELECT doc_id, k AS block_no, k * 200 + 1 AS start_line, least((k + 1) * 200, len(l)) AS end_line, array_to_string(list_slice(l, k * 200 + 1, k * 200 + 200), chr(10)) AS content FROM b
""")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.line_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")


def sections_sql(boundary: str, least: int, where: str = "text IS NOT NULL") -> str:
    return rf"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE {where}), x AS (SELECT doc_id, l, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM d),
    m AS (SELECT doc_id, l, line, no, lead(no) OVER (PARTITION BY doc_id ORDER BY no) AS nx, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n
          FROM x WHERE regexp_matches(line, '{boundary}'))
    SELECT doc_id, k AS section_no, line AS title, no AS start_line, coalesce(nx - 1, len(l)) AS end_line FROM m WHERE n >= {least}"""


@query(sections_sql(r"^#{1,6}\s+\S", 1))
def section_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.sections(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(sections_sql(r"^\[", 2))
def toml_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.sections(table(spark, sf_dir, "documents"), "doc_id", "text", TG.TOML_BOUNDARY, 2)


@query(r"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM d),
    g AS (SELECT doc_id, no, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS g FROM x WHERE regexp_matches(line, '[^ \t\r]'))
    SELECT doc_id, min(no) AS start_line, max(no) AS end_line FROM g GROUP BY doc_id, g
""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.islands(TG.lines(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "line rlike '[^ \\\\t\\\\r]'")


@query(r"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN len(l) > 30 THEN array_to_string(list_slice(l, 1, 30), chr(10)) || chr(10) || '# ... [' || (len(l) - 30) || ' more lines]' ELSE text END AS content FROM d
""")
def truncate_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.truncated(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def dedup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.md5("text")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(f"""
    WITH {R.FRAGMENTS_SQL}
    SELECT id, file, row_number() OVER (PARTITION BY file ORDER BY end_line - start_line DESC, start_line, id) AS rank FROM f QUALIFY rank <= 30
""")
def per_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fragments(spark, sf_dir).select("id", "file", "start_line", "end_line")
    return TG.capped(f, "file", [F.desc(F.col("end_line") - F.col("start_line")), "start_line", "id"], 30).select("id", "file", "rank")


@query(f"""
    WITH {R.FRAGMENTS_SQL} SELECT file, 1 AS start_line, max(end_line) AS end_line, count(*) AS parts FROM f GROUP BY file
""")
def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fragments(spark, sf_dir).groupBy("file").agg(F.lit(1).alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("parts"))


@query(r"""
    SELECT doc_id, greatest(strlen(text) // 4, 1) + 40 AS cost FROM documents WHERE text IS NOT NULL
""")
def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", X.token_cost(F.col("text")).alias("cost"))


@query(r"""
    WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?m)^#{1,6}[ \t]+([^\n]+)', 1))) AS h FROM documents)
    SELECT doc_id, h AS heading, regexp_replace(regexp_replace(lower(trim(h)), '[^a-z0-9 _-]', '', 'g'), '[ _]+', '-', 'g') AS slug FROM d
""")
def heading_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}[ \t]+([^\n]+)"), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(heads).alias("heading")).withColumn("slug", X.slug(F.col("heading")))
