"""Queries of typed keys, Kubernetes links, clamped lexical edges and the fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import keys as K
from weftline.operators import relations as R
from weftline.plans.edge_queries import CANON, CONFIG, both_sql, name_edges, tags_edges
from weftline.plans.registry import ORACLE, query
from weftline.runtime import cut, table


def q(s: str) -> str:
    return s.replace("'", "''")


def side_sql(side: str) -> str:
    rows = " UNION ALL ".join(f"SELECT id, file, repo, '{k}' AS kind, '{m}' AS mechanism, lower(unnest(list_filter(list_distinct(regexp_extract_all(content, '{q(p)}', 1)), lambda x: length(x) >= 3))) AS key FROM f WHERE content IS NOT NULL AND repo IS NOT NULL" for k, s, m, p in K.KEYS if s == side)
    stop = "('" + "', '".join(K.STOP) + "')"
    return f"""SELECT DISTINCT *, CASE WHEN kind IN ('image', 'proto') THEN regexp_replace(regexp_extract(key, '([^/]+)$', 1), '(request|response|service|client|stub|server)$', '') ELSE key END AS short FROM ({rows}) WHERE key NOT IN {stop}"""


TYPED_SQL = f"""{R.FRAGMENTS_SQL}, d AS (SELECT * FROM ({side_sql("declares")}) WHERE short <> ''), u AS (SELECT * FROM ({side_sql("refers")}) WHERE short <> ''), few AS (SELECT repo, kind, short FROM d GROUP BY 1, 2, 3 HAVING count(DISTINCT file) <= 8),
    tl AS (SELECT DISTINCT d.kind, CASE WHEN d.key = u.key THEN 'strong' ELSE 'weak' END AS strength, d.key, d.id AS a, u.id AS b, d.mechanism AS a_mechanism, u.mechanism AS b_mechanism
      FROM d JOIN few USING (repo, kind, short) JOIN u USING (repo, kind, short) WHERE d.file <> u.file)"""


@query(f"WITH {TYPED_SQL} SELECT * FROM tl")
def typed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment, image, route, table and message keys: who declares and who refers to them."""
    return K.typed_links(cut(R.fragments(spark, sf_dir).select("id", "file", "repo", "content")))


@query(rf"""WITH {R.FRAGMENTS_SQL}, w AS (SELECT id, file, language, unnest(identifiers) AS x FROM f WHERE language IS NOT NULL), k AS (SELECT DISTINCT id, file, language IN {CONFIG} AS cfg, {CANON.format("x")} AS name FROM w),
    g AS (SELECT * FROM k WHERE length(name) >= 4 AND name NOT IN ('{"', '".join(K.STOP)}')), cf AS (SELECT id, file, name FROM g WHERE cfg), co AS (SELECT * FROM g WHERE NOT cfg),
    pa AS (SELECT * FROM (SELECT id, file, name, unnest(string_split(name, '_')) AS part FROM cf) WHERE length(part) >= 4 AND part NOT IN ('{"', '".join(K.STOP)}') AND part <> name),
    cm AS (SELECT part FROM (SELECT DISTINCT name, part FROM pa) GROUP BY 1 HAVING count(*) <= 0.25::DOUBLE * (SELECT count(DISTINCT name) FROM cf)),
    ky AS (SELECT * FROM cf UNION SELECT id, file, part FROM pa WHERE part IN (SELECT part FROM cm)), fa AS (SELECT name FROM ky GROUP BY 1 HAVING count(DISTINCT file) <= 8), fb AS (SELECT name FROM co GROUP BY 1 HAVING count(DISTINCT file) <= 8),
    p AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM ky a JOIN fa USING (name) JOIN co b USING (name) JOIN fb USING (name)) """ + both_sql("SELECT src, dst FROM p", "0.35", "0.50", "key_match"))
def config_key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration keys and their telling parts linked with the code that names them."""
    from weftline.operators import edges as E

    f = R.fragments(spark, sf_dir).select("id", "file", "language", "identifiers")
    return E.both_ways(K.config_keys(f, F.col("language").isin("yaml", "json", "toml", "env", "properties", "hcl")), 0.35, 0.50, "key_match")


CLAMP = "CASE x " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in K.LEXICAL.items()) + f" ELSE {K.LEXICAL_DEFAULT[0]} END"
CLAMP_HIGH = "CASE x " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in K.LEXICAL.items()) + f" ELSE {K.LEXICAL_DEFAULT[1]} END"


def clamp_sql() -> str:
    base = ORACLE["lexical_edges"].strip()
    lang = "CASE " + " ".join(f"WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) = '{e}' THEN '{v}'" for e, v in X.LANGUAGES.items()) + " ELSE 'other' END"
    at = lambda c, x: c.replace("CASE x", f"CASE {x}")
    return f"""SELECT src, dst, round(greatest({at(CLAMP, "a.l")}, {at(CLAMP, "b.l")})::DOUBLE + (sim - 0.30::DOUBLE) / 0.70::DOUBLE * (greatest({at(CLAMP_HIGH, "a.l")}, {at(CLAMP_HIGH, "b.l")}) - greatest({at(CLAMP, "a.l")}, {at(CLAMP, "b.l")})), 5)
      * CASE WHEN src < dst THEN 1 ELSE 0.5::DOUBLE END AS weight FROM ({base}) JOIN (SELECT doc_id, {lang} AS l FROM documents) a ON src = a.doc_id JOIN (SELECT doc_id, {lang} AS l FROM documents) b ON dst = b.doc_id"""


def rounded_weight(weight: Column) -> Column:
    """Five digits.  Many weights end in half a unit: their double decides, as in the SQL, not its shortest decimal form."""
    return F.round(weight * 1e5) / 1e5


@query(clamp_sql())
def lexical_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similar documents with the weight their languages allow; half of it against the order of ids."""
    from weftline.plans.edge_queries import lexical_edges

    d = table(spark, sf_dir, "documents").select("doc_id", X.language(F.coalesce("path", F.lit(""))).alias("lang"))
    e = lexical_edges(spark, sf_dir).join(d.select(F.col("doc_id").alias("src"), F.col("lang").alias("a")), "src").join(d.select(F.col("doc_id").alias("dst"), F.col("lang").alias("b")), "dst")
    back = F.when(F.col("src") < F.col("dst"), F.lit(1.0)).otherwise(F.lit(K.LEXICAL_BACK))
    return e.select("src", "dst", (rounded_weight(K.lexical_weight(F.col("sim"), F.col("a"), F.col("b"))) * back).alias("weight"))


@query(f"WITH t AS ({ORACLE['tags_edges']}), o AS ({ORACLE['name_edges']}), n AS (SELECT src AS node FROM o UNION SELECT dst FROM o) SELECT * FROM t WHERE src NOT IN (SELECT node FROM n) AND dst NOT IN (SELECT node FROM n)")
def tag_fallback_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared words as edges only where names link nothing."""
    return K.fallback(tags_edges(spark, sf_dir), cut(name_edges(spark, sf_dir)))


@query(r"""WITH s AS (SELECT DISTINCT symbol AS name FROM fragments WHERE symbol IS NOT NULL), c AS (SELECT name, trim(regexp_replace(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS canon,
      trim(regexp_replace(replace(replace(lower(name), '.', '_'), '-', ''), '[^a-z0-9]+', '_', 'g'), '_') AS relaxed FROM s), k AS (SELECT name, unnest(list_distinct([canon, relaxed])) AS key FROM c)
    SELECT name, key, nullif(regexp_extract(key, '^kafka_(?:cfg_)?(.{3,})$', 1), '') AS property FROM k WHERE length(key) >= 2""")
def property_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spellings under which a name can be set by an environment variable."""
    s = table(spark, sf_dir, "fragments").filter("symbol is not null").select(F.col("symbol").alias("name")).distinct()
    return s.select("name", F.explode(X.property_keys(F.col("name"))).alias("key")).withColumn("property", X.kafka_property(F.col("key")))
