"""Queries of needs, match strength, gains and post-selection filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import filters as FL
from weftline.operators import needs as N
from weftline.operators import relations as R
from weftline.operators import selection as S
from weftline.plans.edge_queries import CANON, CONFIG, both_sql, key_match_edges, name_edges
from weftline.plans.registry import query
from weftline.plans.text_queries import DIRS_SQL, STEM_SQL, sql_list
from weftline.runtime import cut

BUDGET = 8000
KINDS = "('class', 'interface', 'struct')"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def names_sql(text: str, pattern: str, least: int = N.MIN_SYMBOL) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({text}, '{quoted(pattern)}', 1), lambda x: lower(x))), lambda x: length(x) >= {least} AND NOT list_contains({sql_list(N.BUILTINS)}, x))"


def imported_sql(pattern: str) -> str:
    lists = f"flatten(list_transform(regexp_extract_all(content, '{quoted(pattern)}', 1), lambda x: string_split(x, ',')))"
    return rf"list_filter(list_transform({lists}, lambda x: lower(trim(regexp_replace(x, '\s+as\s+[\s\S]*$', '')))), lambda x: regexp_full_match(x, '\w+'))"


def minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def producer(kind: str, symbols: str, scope: str, priority: float, rank: int) -> str:
    return f"SELECT query, '{kind}' AS need_type, unnest({symbols}) AS symbol, {scope} AS scope, {priority}::DOUBLE AS priority, {rank} AS rank FROM l"


EXT_SQL = r"lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))"
NEEDS_SQL = rf"""{R.FRAGMENTS_SQL}, ch AS (SELECT *, array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '{quoted(N.COMMENT)}')), chr(10)) AS code,
      list_distinct(list_concat({imported_sql(N.FOREIGN_JS)}, {imported_sql(N.FOREIGN_PY)})) AS outside FROM f WHERE kind IN {KINDS} AND repo IS NOT NULL AND content IS NOT NULL),
    l AS (SELECT id AS query, file, lower(coalesce(symbol, CASE WHEN {EXT_SQL} IN ('swift', 'java', 'kt') THEN {STEM_SQL} END)) AS own, {minus(names_sql("code", N.CALL), "outside")} AS calls,
      {minus(f"list_distinct(list_concat({names_sql('code', N.TYPE, 2)}, {names_sql('code', N.GENERIC, 1)}))", "outside")} AS types,
      list_filter(list_distinct(list_concat({imported_sql(N.LOCAL_JS)}, {imported_sql(N.LOCAL_PY)})), lambda x: length(x) >= 3 AND NOT list_contains({sql_list(N.BUILTINS)}, x)) AS local, {names_sql("content", N.CHECK)} AS checks,
      CASE WHEN {EXT_SQL} IN ('tf', 'tfvars', 'hcl') THEN {names_sql("content", N.TF_VAR)} ELSE [] END AS vars, {names_sql("content", f"({X.IDENTIFIER})")} AS words FROM ch),
    m AS ({producer("impact", "CASE WHEN length(own) > 0 THEN [own] ELSE [] END", "file", N.PRIORITY["impact"], 0)} UNION ALL {producer("definition", "calls", "NULL", N.PRIORITY["definition"], 1)}
      UNION ALL {producer("signature", "types", "NULL", N.PRIORITY["signature"], 2)} UNION ALL {producer("definition", "local", "NULL", N.PRIORITY["import"], 3)}
      UNION ALL {producer("invariant", "checks", "NULL", N.PRIORITY["invariant"], 4)} UNION ALL {producer("definition", "vars", "NULL", N.PRIORITY["terraform"], 5)}),
    w AS (SELECT query, unnest(words) AS symbol FROM l),
    al AS (SELECT * FROM m UNION ALL SELECT query, 'definition', symbol, NULL, {N.FALLBACK}::DOUBLE, 6 FROM w WHERE query NOT IN (SELECT query FROM m)
      UNION ALL SELECT query, 'background', symbol, NULL, {N.PRIORITY["background"]}::DOUBLE, 7 FROM w WHERE query IN (SELECT query FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE m.query = w.query AND m.symbol = w.symbol)),
    n0 AS (SELECT query, need_type, symbol, scope, priority FROM al QUALIFY row_number() OVER (PARTITION BY query, need_type, symbol ORDER BY rank) = 1),
    tf AS (SELECT *, {DIRS_SQL} AS dirs, {STEM_SQL} AS st FROM f),
    ts AS (SELECT *, coalesce(list_has_any(dirs, {sql_list(X.TEST_DIRS)}) OR regexp_matches(lower(st), '(^|[_.\-])(test|tests|spec|specs|selftest|selftests)([_.\-]|$)') OR regexp_matches(st, '(Test|Tests|Spec|Specs)$|^(Test|Tests|Spec|Specs)\p{{Lu}}'), false)
      OR coalesce(starts_with(lower(symbol), 'test_'), false) AS t FROM tf),
    tn AS (SELECT DISTINCT query, 'test' AS need_type, symbol, NULL AS scope, {N.PRIORITY["test"]}::DOUBLE AS priority FROM n0 WHERE need_type IN ('impact', 'definition') AND symbol IN (SELECT regexp_replace(lower(symbol), '^test_', '') FROM ts WHERE t AND symbol IS NOT NULL)),
    nd AS (SELECT * FROM n0 UNION ALL SELECT * FROM tn)"""
V = N.STRENGTH
MATCH_SQL = f"""{NEEDS_SQL}, q AS (SELECT nd.*, repo FROM nd JOIN f ON nd.query = f.id),
    h AS (SELECT id, repo, file, path, kind, symbol AS fs, t, list_transform(coalesce(identifiers, []), lambda x: lower(x)) AS ids FROM ts WHERE repo IS NOT NULL),
    hw AS (SELECT *, unnest(list_distinct(list_concat(ids, CASE WHEN fs IS NULL THEN [] ELSE [lower(fs)] END))) AS symbol FROM h),
    few AS (SELECT repo, symbol FROM hw GROUP BY 1, 2 HAVING count(*) <= 64),
    nm AS (SELECT query, need_type, q.symbol, priority, id, CASE WHEN need_type = 'impact' AND coalesce(scope = file, false) THEN {V["impact_scope"]} WHEN coalesce(lower(fs) = q.symbol, false) AND coalesce(kind NOT IN ('{"', '".join(N.SIGNATURE_KINDS)}'), true)
        THEN CASE WHEN coalesce(scope = file, false) THEN {V["defines_scope"]} WHEN scope IS NULL THEN {V["defines"]} ELSE {V["defines_other"]} END
      WHEN need_type = 'impact' AND list_contains(ids, q.symbol) THEN {V["impact_mentions"]} WHEN coalesce(lower(fs) = q.symbol, false) THEN {V["signature"]} WHEN need_type = 'test' AND list_contains(ids, q.symbol) AND t THEN {V["test"]}
      WHEN list_contains(ids, q.symbol) THEN {V["mentions"]} ELSE 0 END::DOUBLE AS strength FROM q JOIN few USING (repo, symbol) JOIN hw ON hw.repo = q.repo AND hw.symbol = q.symbol),
    sc AS (SELECT query, need_type, symbol, priority, h.id, {V["impact_scope"]}::DOUBLE AS strength FROM q JOIN h ON h.repo = q.repo AND h.file = q.scope WHERE need_type = 'impact'),
    ms AS (SELECT query, need_type, symbol, id, max(priority) AS priority, coalesce(min(strength) FILTER (need_type = 'impact' AND strength = {V["impact_scope"]}), max(strength)) AS strength
      FROM (SELECT * FROM nm UNION ALL SELECT query, need_type, symbol, priority, id, strength FROM sc) WHERE strength > 0 GROUP BY 1, 2, 3, 4)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(R.fragments(spark, sf_dir).select("id", "repo", "file", "path", "kind", "symbol", "content", "identifiers"))


def all_needs(f: DataFrame) -> DataFrame:
    """The needs of every class, interface and struct, its text taken as the change."""
    changed = f.filter(f"kind in {KINDS} and repo is not null").select(F.col("id").alias("query"), "file", "path", "symbol", F.col("content").alias("changed"))
    needs = cut(N.extract(changed))
    return needs.unionByName(N.test_needs(needs, f))


@query(f"WITH {NEEDS_SQL} SELECT query, need_type, symbol, scope, priority FROM nd")
def needs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact, definition, signature, import, invariant, test, terraform and background needs."""
    return all_needs(sources(spark, sf_dir))


def need_matches(f: DataFrame) -> DataFrame:
    held = f.filter("repo is not null")
    needs = all_needs(f).join(held.select(F.col("id").alias("query"), "repo"), "query")
    return N.matches(needs, held.drop("content"))


@query(f"WITH {MATCH_SQL} SELECT query, need_type, symbol, priority, id, strength FROM ms")
def needs_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All needs against all fragments of their repo, by the first of nine levels that holds."""
    return need_matches(sources(spark, sf_dir))


IMPORTANCE_SQL = f"CASE WHEN list_has_any({DIRS_SQL}, {sql_list(X.GENERATED_DIRS)}) THEN 0.1::DOUBLE WHEN list_has_any({DIRS_SQL}, {sql_list(X.PERIPHERAL_DIRS)}) OR regexp_matches(lower({STEM_SQL}), '{X.PERIPHERAL_STEM}') THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END"
GAINS_SQL = f"""{MATCH_SQL}, rl AS (SELECT query, id, max(strength) AS rel FROM ms GROUP BY 1, 2), im AS (SELECT id, coalesce({IMPORTANCE_SQL}, 1.0) AS importance, string_split(regexp_replace(file, '/?[^/]*$', ''), '/') AS dir, greatest(strlen(content) // 4, 1) + 40 AS tokens FROM f),
    g AS (SELECT query, id, max(rel) AS rel, sum(priority * sqrt(CASE WHEN need_type = 'impact' THEN strength * importance ELSE strength END + 0.2::DOUBLE * least(rel, 1))) AS g FROM ms JOIN rl USING (query, id) JOIN im USING (id) GROUP BY 1, 2),
    gg AS (SELECT query, id, round(g + CASE WHEN rel >= 0.03 THEN rel * 0.25::DOUBLE ELSE 0 END + 0.1::DOUBLE * least(rel, 1), 6) AS gain FROM g)"""


def gains(f: DataFrame) -> DataFrame:
    m = cut(need_matches(f))
    rel = m.groupBy("query", "id").agg(F.max("strength").alias("rel")).join(f.select("id", F.coalesce(X.importance(F.col("path")), F.lit(1.0)).alias("importance")), "id")
    return N.first_gain(m, rel)


@query(f"""WITH {GAINS_SQL} SELECT gg.query, gg.id, gain, round(gain / (1 + 0.30::DOUBLE * (len(a.dir) + len(b.dir) - 2 * len(list_filter(range(1, least(len(a.dir), len(b.dir)) + 1), lambda k: list_slice(a.dir, 1, k) = list_slice(b.dir, 1, k))))) / b.tokens, 8) AS density
    FROM gg JOIN im a ON gg.query = a.id JOIN im b ON gg.id = b.id WHERE b.tokens IS NOT NULL""")
def first_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal gain and density of every candidate before anything is picked; relevance is the best strength.

    The density is the gain times the nearness of the folders, for a token.
    """
    f = sources(spark, sf_dir)
    dirs = f.filter("content is not null").select("id", F.split(X.directory(F.col("file")), "/").alias("dir"), X.token_cost(F.col("content")).alias("tokens"))
    a = f.select(F.col("id").alias("query"), F.split(X.directory(F.col("file")), "/").alias("own"))
    pairs = gains(f).join(a, "query").join(dirs, "id")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size("own"), F.size("dir"))), lambda k: F.slice("own", F.lit(1), k) == F.slice("dir", F.lit(1), k)))
    apart = F.size("own") + F.size("dir") - 2 * shared
    return pairs.select("query", "id", "gain", F.round(F.col("gain") / (1 + N.NEAR_DECAY * apart) / F.col("tokens"), 8).alias("density"))


@query()
def submodular_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy cover of the needs of each class under the budget; compared with brute force in the tests."""
    src = sources(spark, sf_dir)
    m = cut(need_matches(src).select("query", "id", F.concat_ws(":", "need_type", "symbol").alias("need"), "priority", "strength"))
    f = src.filter("content is not null").select("id", "file", F.col("id").alias("start_line"), F.col("id").alias("end_line"), X.token_cost(F.col("content")).alias("tokens"))
    rel = m.groupBy("query", "id").agg(F.max("strength").alias("rel")).withColumn("core", F.col("query") == F.col("id"))
    return S.submodular_select(rel.join(f, "id"), m.select(*[F.col(c).alias(c) for c in m.columns]), BUDGET)


# Changed files of the filters: the least file of each repo and top folder.
CHANGED_SQL = "ck AS (SELECT min(file) AS file FROM f WHERE repo IS NOT NULL AND path IS NOT NULL GROUP BY repo, split_part(path, '/', 1))"
FILE_EDGES_SQL = f"""nd0 AS (SELECT DISTINCT repo || '|' || lower(symbol) AS name, id, file FROM f WHERE symbol IS NOT NULL AND repo IS NOT NULL), nu AS (SELECT DISTINCT repo || '|' || lower(unnest(identifiers)) AS name, id, file FROM f WHERE repo IS NOT NULL),
    nf AS (SELECT name FROM nd0 GROUP BY 1 HAVING count(DISTINCT file) <= 8),
    np AS (SELECT DISTINCT nu.id AS src, nd0.id AS dst FROM nu JOIN nf USING (name) JOIN nd0 USING (name) WHERE nu.id <> nd0.id AND NOT EXISTS (SELECT 1 FROM nd0 x WHERE x.name = nu.name AND x.id = nu.id)),
    ne AS ({both_sql("SELECT src, dst FROM np", "0.55", "0.40", "semantic")}),
    kw AS (SELECT id, file, language, unnest(identifiers) AS x FROM f WHERE language IS NOT NULL), kk AS (SELECT DISTINCT id, file, language IN {CONFIG} AS cfg, {CANON.format("x")} AS name FROM kw),
    kf AS (SELECT * FROM kk WHERE cfg AND length(name) >= 4), ko AS (SELECT * FROM kk WHERE NOT cfg AND length(name) >= 4),
    kh AS (SELECT name FROM kf GROUP BY 1 HAVING count(DISTINCT file) <= 8 INTERSECT SELECT name FROM ko GROUP BY 1 HAVING count(DISTINCT file) <= 8),
    kp AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM kf a JOIN kh USING (name) JOIN ko b USING (name)), ke AS ({both_sql("SELECT src, dst FROM kp", "0.35", "0.50", "key_match")}),
    fe AS (SELECT a.file AS src, b.file AS dst, category, max(weight) AS weight FROM (SELECT * FROM ne UNION ALL SELECT * FROM ke) e JOIN f a ON e.src = a.id JOIN f b ON e.dst = b.id WHERE a.file <> b.file GROUP BY 1, 2, 3)"""


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and key edges of fragments as edges of their files: the strongest of each pair and category."""
    e = name_edges(spark, sf_dir).unionByName(key_match_edges(spark, sf_dir))
    f = R.fragments(spark, sf_dir).select("id", "file")
    a, b = f.select(F.col("id").alias("src"), F.col("file").alias("sf")), f.select(F.col("id").alias("dst"), F.col("file").alias("df"))
    return cut(e.join(a, "src").join(b, "dst").filter("sf <> df").groupBy(F.col("sf").alias("src"), F.col("df").alias("dst"), "category").agg(F.max("weight").alias("weight")))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fragments(spark, sf_dir).filter("repo is not null and path is not null")
    return f.groupBy("repo", F.split("path", "/")[0].alias("top")).agg(F.min("file").alias("file")).select("file")


DIR = r"regexp_replace({0}, '/?[^/]*$', '')"


@query(f"""WITH {R.FRAGMENTS_SQL}, {CHANGED_SQL}, {FILE_EDGES_SQL}, rf AS (SELECT src, dst, max(weight) AS w FROM fe GROUP BY 1, 2),
    dp AS (SELECT a.src AS dependent, a.dst AS hub FROM rf a LEFT JOIN rf b ON a.src = b.dst AND a.dst = b.src WHERE a.w >= coalesce(b.w, 0) AND a.src <> a.dst AND a.src NOT IN (SELECT file FROM ck)),
    nr AS (SELECT DISTINCT CASE WHEN src IN (SELECT file FROM ck) THEN dst ELSE src END AS file FROM rf WHERE (src IN (SELECT file FROM ck)) <> (dst IN (SELECT file FROM ck))),
    hb AS (SELECT hub FROM dp WHERE hub IN (SELECT file FROM nr) GROUP BY 1 HAVING count(DISTINCT dependent) >= 2)
    SELECT DISTINCT dependent AS file FROM dp WHERE hub IN (SELECT hub FROM hb) AND dependent NOT IN (SELECT file FROM nr) AND {DIR.format("dependent")} NOT IN (SELECT {DIR.format("file")} FROM ck)""")
def hub_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.hub_noise(file_edges(spark, sf_dir), changed_files(spark, sf_dir))


BOUNDARY_SQL = "bd AS (SELECT CASE WHEN src IN (SELECT file FROM ck) THEN src ELSE dst END AS inside, CASE WHEN src IN (SELECT file FROM ck) THEN dst ELSE src END AS other, category, weight, src IN (SELECT file FROM ck) AS outward FROM fe WHERE (src IN (SELECT file FROM ck)) <> (dst IN (SELECT file FROM ck)))"
FILE_STEM = r"lower(regexp_replace(list_extract(string_split({0}, '/'), -1), '\.[^.]*$', ''))"


@query(f"WITH {R.FRAGMENTS_SQL}, {CHANGED_SQL}, {FILE_EDGES_SQL}, {BOUNDARY_SQL} SELECT inside, other, category, weight, outward FROM bd")
def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with exactly one end in a changed file."""
    return FL.boundary(file_edges(spark, sf_dir), changed_files(spark, sf_dir))


@query(rf"""WITH {R.FRAGMENTS_SQL}, {CHANGED_SQL}, {FILE_EDGES_SQL}, {BOUNDARY_SQL}, gk AS (SELECT other AS file FROM bd WHERE category = 'key_match' GROUP BY 1 HAVING count(*) <= 1)
    SELECT file FROM gk WHERE file NOT IN (SELECT other FROM bd WHERE category IN ('semantic', 'config')) AND lower(regexp_extract(file, '\.([A-Za-z0-9]+)$', 1)) IN ('{"', '".join(FL.CODE)}')
      AND {FILE_STEM.format("file")} NOT IN (SELECT {FILE_STEM.format("file")} FROM ck)""")
def generic_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.generic_only(file_edges(spark, sf_dir), changed_files(spark, sf_dir))


@query(f"""WITH {R.FRAGMENTS_SQL}, {FILE_EDGES_SQL}, se AS (SELECT id FROM f WHERE kind = 'class'), rf AS (SELECT src, dst FROM ne UNION ALL SELECT src, dst FROM ke),
    nb AS (SELECT DISTINCT dst AS id FROM rf WHERE src IN (SELECT id FROM se) AND dst NOT IN (SELECT id FROM se)), nt AS (SELECT id, lower(symbol) AS symbol, greatest(strlen(content) // 4, 1) + 40 AS tokens FROM f WHERE symbol IS NOT NULL),
    wt AS (SELECT DISTINCT symbol FROM nb JOIN nt USING (id) WHERE symbol NOT IN (SELECT symbol FROM nt WHERE id IN (SELECT id FROM se))), ind AS (SELECT dst AS id, count(*)::DOUBLE AS score FROM rf GROUP BY 1)
    SELECT symbol, arg_min(id, struct_pack(s := -coalesce(score, 0), t := coalesce(tokens, 0), i := id)) AS id FROM nt JOIN wt USING (symbol) LEFT JOIN ind USING (id) GROUP BY 1""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What completes the selection of all classes: the definitions they refer to, the most referred one of each name."""
    f = cut(R.fragments(spark, sf_dir).select("id", "kind", "symbol", F.coalesce(X.token_cost(F.col("content")), F.lit(0)).alias("tokens")))
    e = cut(name_edges(spark, sf_dir).unionByName(key_match_edges(spark, sf_dir)))
    score = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("score"))
    return FL.dangling(f.filter("kind = 'class'").select("id"), e, f, score)


@query(f"""WITH {R.FRAGMENTS_SQL}, {FILE_EDGES_SQL}, co AS (SELECT id FROM f WHERE kind = 'class'), rf AS (SELECT src, dst FROM ne UNION ALL SELECT src, dst FROM ke)
    SELECT DISTINCT file FROM f WHERE id IN (SELECT id FROM co UNION SELECT dst FROM rf WHERE src IN (SELECT id FROM co) UNION SELECT src FROM rf WHERE dst IN (SELECT id FROM co))""")
def admitted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files let through by the gate: those that hold a core (here: a class) or are linked with one."""
    f = cut(R.fragments(spark, sf_dir).select("id", "file", "kind"))
    return FL.admitted(name_edges(spark, sf_dir).unionByName(key_match_edges(spark, sf_dir)), f.filter("kind = 'class'"), f)
