"""Queries of the edge builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import edges as E
from weftline.operators import ranking
from weftline.operators import relations as R
from weftline.operators import rules
from weftline.plans.registry import query
from weftline.runtime import table
from weftline.sources import tokens


def both_sql(pairs: str, forward: str, reverse: str, category: str) -> str:
    return f"""SELECT src, dst, ({forward})::DOUBLE AS weight, '{category}' AS category FROM ({pairs}) WHERE src <> dst
        UNION ALL SELECT dst AS src, src AS dst, ({forward})::DOUBLE * {reverse}::DOUBLE AS weight, '{category}' AS category FROM ({pairs}) WHERE src <> dst"""


SPANS_SQL = "s AS (SELECT id, file, start_line, end_line FROM f UNION ALL SELECT -min(id) AS id, file, 1 AS start_line, max(end_line) AS end_line FROM f GROUP BY file)"


def spans(frags: DataFrame) -> DataFrame:
    """Fragments and the whole file around them, whose id is the negative of its least fragment's."""
    whole = frags.groupBy("file").agg((-F.min("id")).alias("id"), F.lit(1).alias("start_line"), F.max("end_line").alias("end_line"))
    return frags.select("id", "file", "start_line", "end_line").unionByName(whole)


CONTAIN_PAIRS = """SELECT i.id AS src, arg_min(o.id, struct_pack(l := o.end_line - o.start_line, i := o.id)) AS dst FROM s i JOIN s o ON i.file = o.file AND o.start_line <= i.start_line
    AND i.end_line <= o.end_line AND i.id <> o.id AND (o.end_line - o.start_line > i.end_line - i.start_line OR o.id < i.id) GROUP BY i.id"""


@query(f"WITH {R.FRAGMENTS_SQL}, {SPANS_SQL}, p AS ({CONTAIN_PAIRS}) " + both_sql("SELECT src, dst FROM p", "0.5", "0.7", "structural"))
def containment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.containment(spans(R.fragments(spark, sf_dir)))


FILE_DIRS_SQL = r"d AS (SELECT DISTINCT repo || ':' || regexp_replace(path, '/?[^/]*$', '') AS dir, repo || ':' || path AS node FROM fragments WHERE repo IS NOT NULL AND path IS NOT NULL)"


@query(
    f"WITH {FILE_DIRS_SQL}, k AS (SELECT dir, node FROM d QUALIFY row_number() OVER (PARTITION BY dir ORDER BY node) <= 20), p AS (SELECT a.node AS src, b.node AS dst FROM k a JOIN k b ON a.dir = b.dir AND a.node < b.node) "
    + both_sql("SELECT src, dst FROM p", "0.05", "1.0", "sibling")
)
def sibling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fragments").filter("repo is not null and path is not null")
    return E.siblings(f.select(F.concat_ws(":", "repo", X.directory(F.col("path"))).alias("dir"), F.concat_ws(":", "repo", "path").alias("node")))


COCHANGE_SQL = f"""{R.BASKETS_SQL}, sz AS (SELECT commit_id FROM b GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30), bb AS (SELECT * FROM b JOIN sz USING (commit_id)),
    p AS (SELECT x.node AS src, y.node AS dst, count(*) AS n FROM bb x JOIN bb y ON x.commit_id = y.commit_id AND x.node < y.node GROUP BY 1, 2 HAVING count(*) >= 2)"""
COCHANGE_EDGES = both_sql("SELECT src, dst, n FROM p", "least(0.40, 0.1 * ln(1 + n))", "1.0", "history")


@query(f"WITH {COCHANGE_SQL} {COCHANGE_EDGES}")
def cochange_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cochange(R.baskets(spark, sf_dir))


@query(r"""
    WITH t AS (SELECT doc_id AS doc, lower(unnest(regexp_extract_all(text, '[A-Za-z_][\p{L}\p{M}\p{Nd}\p{Pc}]*'))) AS term FROM documents),
    k AS (SELECT doc, term, count(*) AS tf FROM t WHERE strlen(term) >= 3 GROUP BY 1, 2), nn AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
    d AS (SELECT term, count(*) AS df, ln((any_value(n) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf, any_value(n) AS n FROM k, nn GROUP BY 1),
    g AS (SELECT * FROM d WHERE idf >= 2 AND df <= floor(greatest(0.15 * n, 1))),
    w AS (SELECT doc, term, df, tf * idf AS w FROM k JOIN g USING (term)), nm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
    u AS (SELECT doc, term, w / norm AS u FROM w JOIN nm USING (doc) WHERE df BETWEEN 2 AND 100),
    p AS (SELECT a.doc AS a, b.doc AS b, round(sum(a.u * b.u), 5) AS sim FROM u a JOIN u b ON a.term = b.term AND a.doc < b.doc GROUP BY 1, 2 HAVING round(sum(a.u * b.u), 5) >= 0.30),
    e AS (SELECT a AS src, b AS dst, sim FROM p UNION ALL SELECT b, a, sim FROM p)
    SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM e QUALIFY rank <= 5
""")
def lexical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    return E.lexical(tokens.token_table(docs, "doc_id", "text", ranking.MIN_TERM), docs.count())


@query(
    f"WITH {R.FRAGMENTS_SQL}, p AS (SELECT id AS src, lead(id) OVER (PARTITION BY file ORDER BY start_line, end_line, id) AS dst FROM f) "
    + both_sql("SELECT src, dst FROM p WHERE dst IS NOT NULL", "0.30", "0.83", "document")
)
def adjacency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.adjacency(R.fragments(spark, sf_dir))


@query(
    r"""WITH x AS (SELECT doc_id, lower(unnest(list_distinct(regexp_extract_all(text, '#(\d{3,6})\b', 1)))) AS key FROM documents),
    h AS (SELECT key, min(doc_id) AS hub, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT DISTINCT hub AS src, doc_id AS dst FROM x JOIN h USING (key) WHERE doc_id <> hub) """
    + both_sql("SELECT src, dst FROM p", "0.25", "1.0", "document")
)
def citation_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cite the same issue, each linked with the first."""
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"#(\d{3,6})\b"), F.lit(1)))).alias("key"))
    return E.star(keys)


@query(
    rf"""WITH {R.FRAGMENTS_SQL}, h AS (SELECT file, id, start_line, unnest(list_distinct(regexp_extract_all(content, '(?m)^#{{1,6}}[ \t]+([^\n]+)', 1))) AS t FROM f WHERE language = 'markdown'),
    s AS (SELECT regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9 _-]', '', 'g'), '[ _]+', '-', 'g') AS slug, arg_min(id, struct_pack(f := file, s := start_line, i := id)) AS dst FROM h GROUP BY 1),
    r AS (SELECT DISTINCT id AS src, regexp_replace(regexp_replace(lower(trim(unnest(regexp_extract_all(content, '`([a-z0-9 _-]+)`', 1)))), '[^a-z0-9 _-]', '', 'g'), '[ _]+', '-', 'g') AS slug FROM f WHERE language = 'markdown'),
    l AS (SELECT DISTINCT id AS src, unnest(regexp_extract_all(content, '\]\(#([^)]+)\)', 1)) AS slug FROM f),
    p AS (SELECT DISTINCT src, dst FROM (SELECT * FROM r UNION SELECT * FROM l) JOIN s USING (slug) WHERE src <> dst) """
    + both_sql("SELECT src, dst FROM p", "0.55", "0.64", "document")
)
def anchor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links ``](#slug)`` and quoted heading names to the first section of that slug."""
    f = R.fragments(spark, sf_dir)
    md = f.filter("language = 'markdown'")
    heads = md.select("file", "id", "start_line", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^#{1,6}[ \t]+([^\n]+)"), F.lit(1)))).alias("t"))
    first = heads.groupBy(X.slug(F.col("t")).alias("slug")).agg(F.min_by("id", F.struct("file", "start_line", "id")).alias("dst"))
    quoted = md.select(F.col("id").alias("src"), F.explode(F.regexp_extract_all("content", F.lit("`([a-z0-9 _-]+)`"), F.lit(1))).alias("q")).select("src", X.slug(F.col("q")).alias("slug"))
    linked = f.select(F.col("id").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(r"\]\(#([^)]+)\)"), F.lit(1))).alias("slug"))
    return E.both_ways(quoted.unionByName(linked).join(first, "slug").filter("src <> dst").select("src", "dst").distinct(), 0.55, 0.64, "document")


CANON = r"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
CONFIG = "('yaml', 'json', 'toml', 'env', 'properties', 'hcl')"


@query(
    rf"""WITH {R.FRAGMENTS_SQL}, w AS (SELECT id, file, language, unnest(identifiers) AS x FROM f WHERE language IS NOT NULL), k AS (SELECT DISTINCT id, file, language IN {CONFIG} AS cfg, {CANON.format("x")} AS name FROM w),
    cf AS (SELECT * FROM k WHERE cfg AND length(name) >= 4), co AS (SELECT * FROM k WHERE NOT cfg AND length(name) >= 4),
    few AS (SELECT name FROM cf GROUP BY 1 HAVING count(DISTINCT file) <= 8 INTERSECT SELECT name FROM co GROUP BY 1 HAVING count(DISTINCT file) <= 8),
    p AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM cf a JOIN few USING (name) JOIN co b USING (name)) """
    + both_sql("SELECT src, dst FROM p", "0.35", "0.50", "key_match")
)
def key_match_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration keys linked with the code that names them, in any spelling; bounded on both sides."""
    f = R.fragments(spark, sf_dir).filter("language is not null").select("id", "file", "language", F.explode("identifiers").alias("x"))
    k = f.select("id", "file", F.col("language").isin("yaml", "json", "toml", "env", "properties", "hcl").alias("cfg"), X.canonical_key(F.col("x")).alias("name")).filter("length(name) >= 4").distinct()
    few = lambda d: d.groupBy("name").agg(F.countDistinct("file").alias("n")).filter(F.col("n") <= E.AMBIGUOUS).select("name")
    cf, co = k.filter("cfg"), k.filter("not cfg")
    cf, co = cf.join(few(cf), "name"), co.join(few(co), "name")
    pairs = cf.select("name", F.col("id").alias("src")).join(co.select("name", F.col("id").alias("dst")), "name").select("src", "dst").distinct()
    return E.both_ways(pairs, 0.35, 0.50, "key_match")


@query(
    rf"""WITH {R.FRAGMENTS_SQL}, w AS (SELECT id, file, unnest(identifiers) AS x FROM f), k AS (SELECT DISTINCT id, file, {CANON.format("x")} AS key FROM w),
    g AS (SELECT key FROM k WHERE length(key) >= 3 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5), p AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM k a JOIN g USING (key) JOIN k b USING (key) WHERE a.id < b.id AND a.file <> b.file) """
    + both_sql("SELECT src, dst FROM p", "0.30", "0.70", "key_match")
)
def tags_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fragments(spark, sf_dir).select(F.col("id").alias("node"), "file", F.explode("identifiers").alias("x"))
    return E.shared_keys(f.select("node", "file", X.canonical_key(F.col("x")).alias("key")).filter("length(key) >= 3"))


@query(
    f"""WITH {R.FRAGMENTS_SQL}, d AS (SELECT DISTINCT repo || '|' || lower(symbol) AS name, id, file FROM f WHERE symbol IS NOT NULL AND repo IS NOT NULL),
    u AS (SELECT DISTINCT repo || '|' || lower(unnest(identifiers)) AS name, id, repo FROM f WHERE repo IS NOT NULL),
    few AS (SELECT name FROM d GROUP BY 1 HAVING count(DISTINCT file) <= 8),
    p AS (SELECT DISTINCT u.id AS src, d.id AS dst FROM u JOIN few USING (name) JOIN d USING (name) WHERE u.id <> d.id AND NOT EXISTS (SELECT 1 FROM d x WHERE x.name = u.name AND x.id = u.id)) """
    + both_sql("SELECT src, dst FROM p", "0.55", "0.40", "semantic")
)
def name_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments linked with the definers of the symbols they name, within a repo."""
    f = R.fragments(spark, sf_dir).filter("repo is not null")
    defs = f.filter("symbol is not null").select(F.concat_ws("|", "repo", F.lower("symbol")).alias("name"), F.col("id").alias("node"), "file")
    uses = f.select("repo", "id", "file", F.explode("identifiers").alias("x")).select(F.concat_ws("|", "repo", F.lower("x")).alias("name"), F.col("id").alias("node"), "file")
    return E.name_links(defs, uses, 0.55, 0.40)


@query(
    rf"""WITH x AS (SELECT DISTINCT repo, path, repo || ':' || path AS file FROM fragments WHERE repo IS NOT NULL AND path IS NOT NULL),
    y AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS ext, regexp_replace(list_extract(string_split(path, '/'), -1), '\.[^.]*$', '') AS stem FROM x),
    z AS (SELECT *, regexp_replace(regexp_replace(stem, '^(test|spec)[_.\-]', ''), '[_.\-](test|tests|spec|specs)$', '') AS target,
      list_has_any(list_transform(list_filter(string_split(dir, '/'), lambda q: q <> ''), lambda q: lower(q)), ['test', 'tests', '__tests__', 'spec', 'specs'])
      OR regexp_matches(lower(stem), '(^|[_.\-])(test|tests|spec|specs|selftest|selftests)([_.\-]|$)') OR regexp_matches(stem, '(Test|Tests|Spec|Specs)$|^(Test|Tests|Spec|Specs)\p{{Lu}}') AS t FROM y),
    n AS (SELECT a.file AS src, b.file AS dst, (a.dir = b.dir)::INT AS same FROM z a JOIN z b ON a.t AND a.target <> a.stem AND NOT b.t AND a.repo = b.repo AND a.target = b.stem AND a.ext = b.ext),
    p AS (SELECT src, dst FROM (SELECT *, max(same) OVER (PARTITION BY src) AS best, count(*) OVER (PARTITION BY src) AS c FROM n) WHERE (best = 1 AND same = 1) OR (best = 0 AND c <= 8)) """
    + both_sql("SELECT src, dst FROM p", "0.50", "0.50", "test_edge")
)
def test_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fragments").filter("repo is not null and path is not null").select("repo", "path", F.concat_ws(":", "repo", "path").alias("file")).distinct()
    return E.test_links(f)


@query(rules.oracle())
def language_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of the language table in one pass: imports, types, calls, each bounded to eight defining files."""
    return rules.language_edges(R.fragments(spark, sf_dir))


MERGED_SQL = f"""WITH {R.FRAGMENTS_SQL}, {SPANS_SQL}, c AS ({CONTAIN_PAIRS}), a AS (SELECT id AS src, lead(id) OVER (PARTITION BY file ORDER BY start_line, end_line, id) AS dst FROM f),
    al AS ({both_sql("SELECT src, dst FROM c", "0.5", "0.7", "structural")} UNION ALL {both_sql("SELECT src, dst FROM a WHERE dst IS NOT NULL", "0.30", "0.83", "document")}),
    m AS (SELECT src, dst, max(struct_pack(w := weight, c := category)) AS e FROM al GROUP BY 1, 2)"""


def fragment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fragments(spark, sf_dir)
    return E.merged(E.containment(spans(f)).unionByName(E.adjacency(f)))


@query(f"{MERGED_SQL} SELECT src, dst, e.w AS weight, e.c AS category FROM m")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_edges(spark, sf_dir)


@query(f"{MERGED_SQL}, x AS (SELECT src, dst, e.w AS weight, e.c AS category FROM m) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 3")
def edge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.out_capped(fragment_edges(spark, sf_dir), 3)


@query(f"""WITH {R.FRAGMENTS_SQL}, {SPANS_SQL}, {R.HUNKS_SQL}
    SELECT hunk, arg_min(id, struct_pack(l := end_line - start_line, i := id)) AS core FROM h JOIN s ON h.file = s.file AND start_line <= hs AND he <= end_line GROUP BY hunk""")
def core_for_hunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fragments(spark, sf_dir)
    return E.cores(spans(f), R.hunks(f))


@query(f"""WITH {R.FRAGMENTS_SQL}, {SPANS_SQL}, {R.HUNKS_SQL}
    SELECT id, sum(least(he, end_line) - greatest(hs, start_line) + 1)::BIGINT AS changed, sum(he - hs + 1)::BIGINT AS seed FROM h JOIN s ON h.file = s.file AND start_line <= he AND hs <= end_line GROUP BY id""")
def seed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fragments(spark, sf_dir)
    return E.changed_lines(spans(f), R.hunks(f))


@query(f"""WITH {R.FRAGMENTS_SQL}, {R.HUNKS_SQL}, x AS (SELECT id, kind, greatest(0, hs - end_line, start_line - he) AS gap FROM f JOIN h ON f.file = h.file WHERE hunk <> id)
    SELECT id, round(0.04 / (1 + min(gap)::DOUBLE / CASE WHEN any_value(kind) = 'definition' THEN 5 ELSE 50 END), 8) AS bonus FROM x GROUP BY id""")
def hunk_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity floor of each fragment from the nearest hunk of its file before and after it.

    Hunks of a file are sorted with the fragments once; the nearest on either side is a running
    maximum or minimum, so no pairs of fragments and hunks arise.
    """
    f = R.fragments(spark, sf_dir).select("id", "file", "kind", "start_line", "end_line")
    h = R.hunks(f)
    return E.nearest_gap(f, h).select("id", F.round(0.04 / (1 + F.col("gap") / F.when(F.col("kind") == "definition", 5).otherwise(50)), 8).alias("bonus"))
