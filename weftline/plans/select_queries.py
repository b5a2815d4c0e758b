"""Queries of needs, utility and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import edges as E
from weftline.operators import fragmenting as TG
from weftline.operators import order, ranking
from weftline.operators import relations as R
from weftline.operators import selection as S
from weftline.plans.graph_queries import BM25_SQL, QUERY_SQL, corpus, source_terms
from weftline.plans.edge_queries import spans
from weftline.plans.registry import query
from weftline.runtime import cut, table

BUDGET = 8000


def costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 scores of the source queries with what each document costs."""
    cost = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), X.token_cost(F.col("text")).alias("cost"))
    return ranking.bm25(corpus(spark, sf_dir), source_terms(spark, sf_dir)).join(cost, "doc")


@query(f"""WITH RECURSIVE {QUERY_SQL}, {BM25_SQL}, c AS (SELECT doc_id AS doc, greatest(strlen(text) // 4, 1) + 40 AS cost FROM documents WHERE text IS NOT NULL),
    pl AS MATERIALIZED (SELECT query, doc, cost, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS k FROM bm JOIN c USING (doc) WHERE score > 0),
    w(query, k, doc, used, took) AS (SELECT query, 0::BIGINT, NULL::BIGINT, 0::BIGINT, false FROM (SELECT DISTINCT query FROM pl)
      UNION ALL SELECT w.query, pl.k, pl.doc, CASE WHEN w.used + pl.cost <= {BUDGET} THEN w.used + pl.cost ELSE w.used END, w.used + pl.cost <= {BUDGET} FROM w JOIN pl ON w.query = pl.query AND pl.k = w.k + 1)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY k) AS pick, doc, used AS used_tokens FROM w WHERE took""")
def bm25_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: rank all documents against each source's first one and pack the best under the budget."""
    return S.greedy_pack(costed(spark, sf_dir).select("query", "doc", "score", "cost"), BUDGET)


def overflow_sql() -> str:
    from weftline.plans.registry import ORACLE

    head, _, tail = ORACLE["bm25_pack"].rpartition("SELECT query, row_number()")
    return (
        f"{head.rstrip()}, took AS (SELECT query, row_number(){tail}) SELECT bm.query, bm.doc, score, row_number() OVER (PARTITION BY bm.query ORDER BY score DESC, bm.doc) AS rank, "
        "count(*) OVER (PARTITION BY bm.query) AS total FROM bm JOIN c USING (doc) LEFT JOIN took ON bm.query = took.query AND bm.doc = took.doc WHERE took.doc IS NULL QUALIFY rank <= 50"
    )


@query(overflow_sql())
def locate_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What did not fit: the 50 best of each query, with the true number."""
    all_docs = cut(costed(spark, sf_dir).select("query", "doc", "score", "cost"))
    left = all_docs.join(S.greedy_pack(all_docs, BUDGET).select("query", "doc"), ["query", "doc"], "left_anti")
    left = cut(left)
    total = left.groupBy("query").agg(F.count("*").alias("total"))
    return order.top_per_group(left, "query", [F.desc("score"), F.asc("doc")], 50).join(F.broadcast(total), "query").select("query", "doc", "score", "rank", "total")


@query("""WITH i AS (SELECT DISTINCT ON (instance_id) instance_id, gold_patch FROM instances WHERE gold_patch IS NOT NULL ORDER BY instance_id, ingested_at DESC NULLS LAST), t AS (SELECT instance_id, least(greatest(strlen(gold_patch) // 4, 1), 1500) AS core FROM i)
    SELECT instance_id, core, greatest(least(3 * core, 48000), 8000) AS budget FROM t""")
def auto_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = R.instances(spark, sf_dir).filter("gold_patch is not null")
    core = F.least(F.greatest(F.floor(F.octet_length("gold_patch") / 4), F.lit(1)), F.lit(S.CORE_CLAMP))
    return i.select("instance_id", core.alias("core")).withColumn("budget", S.auto_budget(F.col("core")))


@query()
def boltzmann_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.boltzmann_select(costed(spark, sf_dir).select("query", "doc", "score", "cost"), BUDGET)


@query(f"""WITH {QUERY_SQL}, {BM25_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r, count(*) OVER (PARTITION BY query) AS n FROM bm WHERE score > 0),
    tt AS (SELECT query, score AS floor_score FROM x WHERE r = floor(n * (1 - 0.80::DOUBLE)) + 1)
    SELECT x.query, source, arg_min(doc, struct_pack(s := -score, d := doc)) AS doc FROM x JOIN tt USING (query) JOIN documents ON doc = doc_id WHERE score >= floor_score AND source IS NOT NULL GROUP BY 1, 2""")
def rescue_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the best fifth of each query's documents, the best one of every source."""
    s = cut(costed(spark, sf_dir).filter("score > 0").select("query", "doc", "score"))
    n = s.groupBy("query").agg(F.count("*").alias("n"))
    ranks = ranking.ranked(s).join(F.broadcast(n), "query")
    floor = ranks.filter(F.col("rank") == F.floor(F.col("n") * (1 - F.lit(S.RESCUE_PERCENTILE))) + 1).select("query", F.col("score").alias("floor"))
    src = table(spark, sf_dir, "documents").filter("source is not null").select(F.col("doc_id").alias("doc"), "source")
    return s.join(F.broadcast(floor), "query").filter("score >= floor").join(src, "doc").groupBy("query", "source").agg(F.min_by("doc", F.struct(-F.col("score"), F.col("doc"))).alias("doc"))


@query(f"""WITH {R.FRAGMENTS_SQL}, o AS (SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS new FROM (SELECT * FROM f)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY start_line, end_line, id) AS g FROM o) SELECT file, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS parts FROM g GROUP BY file, g""")
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of a file joined where at most two lines lie between them."""
    f = R.fragments(spark, sf_dir).select("id", "file", "start_line", (F.col("end_line") + 2).alias("end_line"))
    return TG.merged_ranges(f, "file").withColumn("end_line", F.col("end_line") - 2)


@query(f"""WITH {R.FRAGMENTS_SQL}, {R.HUNKS_SQL}, c AS (SELECT id AS core, file, start_line AS s, end_line AS e FROM f WHERE id IN (SELECT hunk FROM h))
    SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file = f.file AND c.core <> f.id AND c.s <= f.start_line AND f.end_line <= c.e AND (c.s < f.start_line OR f.end_line < c.e))""")
def core_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that do not lie strictly inside another core."""
    f = R.fragments(spark, sf_dir).select("id", "file", "start_line", "end_line")
    c = E.binned(f.join(R.hunks(R.fragments(spark, sf_dir)).select(F.col("hunk").alias("id")), "id", "left_semi").select(F.col("id").alias("core"), "file", F.col("start_line").alias("s"), F.col("end_line").alias("e")), "s", "e")
    inner = f.withColumn("bin", F.floor(F.col("start_line") / E.BIN)).join(c, ["file", "bin"]).filter("core <> id and s <= start_line and end_line <= e and (s < start_line or end_line < e)")
    return f.join(inner.select("id").distinct(), "id", "left_anti").select("id")


@query(f"""WITH {R.FRAGMENTS_SQL}, {R.HUNKS_SQL}, hit AS (SELECT DISTINCT f.id, f.file, f.start_line, f.end_line FROM f JOIN h ON f.file = h.file AND f.start_line <= he AND hs <= f.end_line)
    SELECT file, arg_min(id, struct_pack(t := greatest(strlen(content) // 4, 1), i := id)) AS id FROM f JOIN hit USING (id, file) WHERE content IS NOT NULL GROUP BY file""")
def changed_file_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest fragment of each changed file that a hunk touches."""
    f = R.fragments(spark, sf_dir)
    hit = E.changed_lines(f.select("id", "file", "start_line", "end_line"), R.hunks(f)).select("id")
    return f.filter("content is not null").join(hit, "id").groupBy("file").agg(F.min_by("id", F.struct(F.greatest(F.floor(F.octet_length("content") / 4), F.lit(1)), F.col("id"))).alias("id"))


@query(f"""WITH {R.FRAGMENTS_SQL}, s AS (SELECT id, file, start_line, end_line FROM f UNION ALL SELECT -min(id), file, 1, max(end_line) FROM f GROUP BY file), d AS (SELECT id, file, start_line, end_line FROM f WHERE symbol IS NOT NULL)
    SELECT s.id, arg_min(d.id, struct_pack(l := d.end_line - d.start_line, i := d.id)) AS container FROM s JOIN d ON s.file = d.file AND d.start_line <= s.start_line AND s.end_line <= d.end_line GROUP BY s.id""")
def named_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest named fragment around each span, itself included."""
    f = R.fragments(spark, sf_dir)
    d = E.binned(f.filter("symbol is not null").select(F.col("id").alias("d"), "file", F.col("start_line").alias("ds"), F.col("end_line").alias("de")), "ds", "de")
    s = spans(f).withColumn("bin", F.floor(F.col("start_line") / E.BIN))
    return s.join(d, ["file", "bin"]).filter("ds <= start_line and end_line <= de").groupBy("id").agg(F.min_by("d", F.struct(F.col("de") - F.col("ds"), F.col("d"))).alias("container"))
