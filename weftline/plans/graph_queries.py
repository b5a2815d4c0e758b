"""Queries of graph analytics and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import edges as E
from weftline.operators import graph as G
from weftline.operators import ranking, search
from weftline.operators import relations as R
from weftline.plans.edge_queries import COCHANGE_EDGES, COCHANGE_SQL, MERGED_SQL, fragment_edges
from weftline.plans.registry import query
from weftline.runtime import cut, table
from weftline.sources import tokens

# Seeds of the co-change graph: parts of the largest order.
SEED_SQL = "sd AS (SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_orderkey = (SELECT l_orderkey FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, l_orderkey LIMIT 1))"
GRAPH_SQL = f"{COCHANGE_SQL}, ed AS ({COCHANGE_EDGES}), {SEED_SQL}"


def cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(E.cochange(R.baskets(spark, sf_dir)))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the order with the greatest quantity (ties: the least order)."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    top = l.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).agg(F.max_by("l_orderkey", F.struct("q", (-F.col("l_orderkey")).alias("k"))).alias("l_orderkey"))
    return l.join(F.broadcast(top), "l_orderkey").select(F.col("l_partkey").alias("node")).distinct()


@query(f"""WITH {GRAPH_SQL}, h1 AS (SELECT dst AS node, max(0.5 * weight) AS score FROM sd JOIN ed ON sd.node = ed.src GROUP BY 1),
    h2 AS (SELECT dst AS node, max(h1.score * 0.5 * weight) AS score FROM h1 JOIN ed ON h1.node = ed.src GROUP BY 1)
    SELECT node, round(max(score), 8) AS score FROM (SELECT node, 1.0::DOUBLE AS score FROM sd UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1""")
def ego_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ego(cochange(spark, sf_dir), seeds(spark, sf_dir)).withColumn("score", F.round("score", 8))


def pagerank_sql() -> str:
    out = f"WITH {GRAPH_SQL}, s0 AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS mass FROM sd)"
    for side, (a, b) in {"f": ("src", "dst"), "b": ("dst", "src")}.items():
        out += f", st{side} AS MATERIALIZED (SELECT {a} AS src, {b} AS dst, weight / sum(weight) OVER (PARTITION BY {a}) AS p FROM ed), {side}0 AS (SELECT node, mass AS score FROM s0)"
        for k in range(1, 11):
            out += f""", {side}{k} AS MATERIALIZED (SELECT node, sum(score) AS score FROM (SELECT st{side}.dst AS node, 0.60 * sum(score * p) AS score FROM {side}{k - 1} x JOIN st{side} ON x.node = st{side}.src GROUP BY 1
                UNION ALL SELECT node, 0.40 * mass FROM s0) GROUP BY 1)"""
    return out + " SELECT node, round(sum(score), 8) AS score FROM (SELECT node, 0.4 * score AS score FROM f10 UNION ALL SELECT node, 0.6 * score FROM b10) GROUP BY 1"


@query(pagerank_sql())
def ppr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seeds(spark, sf_dir)
    mass = s.join(F.broadcast(s.agg(F.count("*").alias("n")))).select("node", (F.lit(1.0) / F.col("n")).alias("mass"))
    return G.pagerank(cochange(spark, sf_dir), cut(mass)).withColumn("score", F.round("score", 8))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, ne AS (SELECT DISTINCT src, dst FROM ed), r(node, hops) AS (SELECT node, 0 FROM sd UNION SELECT ne.dst, r.hops + 1 FROM r JOIN ne ON r.node = ne.src WHERE r.hops < 12),
    nodes AS (SELECT src AS node FROM ne UNION SELECT node FROM sd), hb AS (SELECT node, min(hops) AS hops FROM r GROUP BY 1)
    SELECT node, coalesce(hops, -1) AS hops FROM nodes LEFT JOIN hb USING (node)""")
def seed_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hops(cochange(spark, sf_dir), seeds(spark, sf_dir))


@query(f"""{MERGED_SQL}, x AS (SELECT src, dst, e.w AS weight, e.c AS category FROM m), sc AS (SELECT src AS node, 1.0::DOUBLE / count(*) AS score FROM x GROUP BY 1)
    SELECT dst AS node, category, round(sum(weight * score), 6) AS mass, arg_max(src, struct_pack(m := round(weight * score, 9), s := src)) AS strongest FROM x JOIN sc ON x.src = sc.node GROUP BY 1, 2""")
def incoming_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(fragment_edges(spark, sf_dir))
    return G.incoming(e, e.groupBy(F.col("src").alias("node")).agg((F.lit(1.0) / F.count("*")).alias("score")))


TRADE_SQL = """o AS (SELECT c_nationkey AS src, s_nationkey AS dst, 'ship' || l_linestatus AS category, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to nation: one edge per line item."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("src", "dst", F.concat(F.lit("ship"), "l_linestatus").alias("category"), F.col("l_quantity").alias("weight"))


@query(f"""WITH {TRADE_SQL}, q AS (SELECT a.n_regionkey AS gs, b.n_regionkey AS gd, category, count(*) AS n, sum(weight) AS w FROM o JOIN nation a ON o.src = a.n_nationkey JOIN nation b ON o.dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2, 3)
    SELECT gs, gd, sum(n)::BIGINT AS n_edges, round(sum(w), 4) AS weight, arg_max(category, struct_pack(n := n, c := category)) AS category FROM q GROUP BY 1, 2""")
def quotient_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("grp"))
    return G.quotient(trade(spark, sf_dir), regions)


@query(f"""WITH {TRADE_SQL}, p AS (SELECT a.n_regionkey AS gs, b.n_regionkey AS gd, count(*) AS n FROM o JOIN nation a ON o.src = a.n_nationkey JOIN nation b ON o.dst = b.n_nationkey GROUP BY 1, 2),
    s AS (SELECT gs AS grp, gd AS other, 1 AS ou, n FROM p UNION ALL SELECT gd, gs, 0, n FROM p),
    g AS (SELECT grp, coalesce(sum(n) FILTER (grp = other AND ou = 1), 0)::BIGINT AS inner_edges, coalesce(sum(n) FILTER (grp <> other AND ou = 1), 0)::BIGINT AS out_edges, coalesce(sum(n) FILTER (grp <> other AND ou = 0), 0)::BIGINT AS in_edges,
      count(DISTINCT other) FILTER (grp <> other AND ou = 1) AS fan_out, count(DISTINCT other) FILTER (grp <> other AND ou = 0) AS fan_in FROM s GROUP BY 1)
    SELECT *, round(inner_edges::DOUBLE / (inner_edges + out_edges + in_edges), 6) AS cohesion, round(CASE WHEN out_edges + in_edges > 0 THEN out_edges::DOUBLE / (out_edges + in_edges) ELSE 0 END, 6) AS instability FROM g""")
def coupling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("grp"))
    return G.coupling(trade(spark, sf_dir), regions)


@query(f"WITH {COCHANGE_SQL}, ed AS ({COCHANGE_EDGES}), n AS (SELECT count(*) AS nodes FROM (SELECT src FROM ed UNION SELECT dst FROM ed)), e AS (SELECT count(*) AS edges FROM ed) SELECT nodes, edges, round(edges::DOUBLE / (nodes * (nodes - 1)), 8) AS density FROM n, e")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summary(cochange(spark, sf_dir))


@query(f"""WITH RECURSIVE {TRADE_SQL}, w AS (SELECT src, dst, sum(weight) AS weight FROM o WHERE src <> dst GROUP BY 1, 2),
    k AS MATERIALIZED (SELECT a.src, a.dst FROM w a LEFT JOIN w b ON a.src = b.dst AND a.dst = b.src WHERE a.weight >= 0.8 * coalesce(b.weight, 0)),
    r(a, b) AS (SELECT src, dst FROM k UNION SELECT r.a, k.dst FROM r JOIN k ON r.b = k.src)
    SELECT x.a AS node, least(x.a, min(x.b)) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""")
def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trade(spark, sf_dir).filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return G.cycles(G.dominant(w))


@query("""WITH d AS (SELECT user_id AS node, count(DISTINCT event_type) AS degree FROM events GROUP BY 1),
    c AS (SELECT user_id AS node, count(*) AS churn FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 12 MONTH FROM events) GROUP BY 1),
    b AS (SELECT coalesce(d.node, c.node) AS node, coalesce(degree, 0) AS degree, coalesce(churn, 0) AS churn FROM d FULL JOIN c ON d.node = c.node)
    SELECT *, round(0.5 * degree / max(degree) OVER () + 0.5 * churn / max(churn) OVER (), 4) AS score FROM b""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    last = ev.agg(F.max("ts").alias("last"))
    churn = ev.join(F.broadcast(last)).filter(F.col("ts") >= F.expr("last - interval 12 months")).groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("churn"))
    degree = ev.groupBy(F.col("user_id").alias("node")).agg(F.countDistinct("event_type").alias("degree"))
    return G.hotspots(degree, churn)


BM25_SQL = r"""t AS (SELECT doc_id AS doc, lower(unnest(regexp_extract_all(text, '[A-Za-z_][\p{L}\p{M}\p{Nd}\p{Pc}]*'))) AS term FROM documents),
    k AS MATERIALIZED (SELECT doc, term, count(*) AS tf FROM t WHERE strlen(term) >= 3 GROUP BY 1, 2), l AS (SELECT doc, sum(tf) AS dl FROM k GROUP BY 1), a AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), df AS (SELECT term, count(*) AS df FROM k GROUP BY 1),
    q AS (SELECT DISTINCT query, term FROM (SELECT query, lower(unnest(regexp_extract_all(x, '[A-Za-z_][\p{L}\p{M}\p{Nd}\p{Pc}]*'))) AS term FROM qq) WHERE strlen(term) >= 3),
    bm AS MATERIALIZED (SELECT query, k.doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 3.5 / (tf + 2.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN k USING (term) JOIN df USING (term) JOIN l ON k.doc = l.doc, a GROUP BY 1, 2)"""
QUERY_SQL = "qq AS (SELECT source AS query, arg_min(text, doc_id) AS x FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1)"


def source_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each source as a change."""
    d = table(spark, sf_dir, "documents").filter("source is not null and text is not null")
    return d.groupBy(F.col("source").alias("query")).agg(F.min_by("text", "doc_id").alias("x"))


def source_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.tokens(source_queries(spark, sf_dir), "query", "x").select(F.col("doc").alias("query"), "term")


# Every fiftieth document as a search; the queries of sources above keep their own SQL.
EVERY = 50
DOCUMENT_QUERY_SQL = f"qq AS (SELECT doc_id AS query, text AS x FROM documents WHERE doc_id % {EVERY} = 0 AND text IS NOT NULL)"


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of every document whose id is divisible by EVERY, with or without a source."""
    d = table(spark, sf_dir, "documents").filter((F.col("doc_id") % EVERY == 0) & F.col("text").isNotNull())
    return ranking.tokens(d, "doc_id", "text").select(F.col("doc").alias("query"), "term")


def searched(spark: SparkSession, sf_dir: str) -> search.Index:
    """All documents as an index for searches that grow with them."""
    return search.index(table(spark, sf_dir, "documents"), "doc_id", "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc, term, tf`` from the derived token table: the corpus is tokenised once, whatever asks for it."""
    return tokens.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", ranking.MIN_TERM)


@query(f"WITH {QUERY_SQL}, {BM25_SQL} SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(ranking.bm25(corpus(spark, sf_dir), source_terms(spark, sf_dir)))


@query(f"WITH {DOCUMENT_QUERY_SQL}, {BM25_SQL} SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(searched(spark, sf_dir), document_terms(spark, sf_dir))


# A second channel over the same documents: names shared with the query, by count.
OVERLAP_SQL = "ov AS (SELECT query, doc, count(*)::DOUBLE AS score FROM q JOIN k USING (term) GROUP BY 1, 2)"


def two_channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, q = corpus(spark, sf_dir), cut(source_terms(spark, sf_dir).distinct())
    return cut(ranking.bm25(k, q)), q.join(k, "term").groupBy("query", "doc").agg(F.count("*").cast("double").alias("score"))


RANKS_SQL = """ra AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r, percent_rank() OVER (PARTITION BY query ORDER BY score) AS p FROM bm),
    rb AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r, percent_rank() OVER (PARTITION BY query ORDER BY score) AS p FROM ov)"""


@query(f"WITH {QUERY_SQL}, {BM25_SQL}, {OVERLAP_SQL}, {RANKS_SQL} SELECT query, doc, round(coalesce(1.0::DOUBLE / (60 + ra.r), 0) + coalesce(1.0::DOUBLE / (60 + rb.r), 0), 8) AS score FROM ra FULL JOIN rb USING (query, doc)")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rrf(*two_channels(spark, sf_dir))


@query(f"WITH {DOCUMENT_QUERY_SQL}, {BM25_SQL}, {OVERLAP_SQL}, {RANKS_SQL} SELECT query, doc, round(coalesce(1.0::DOUBLE / (60 + ra.r), 0) + coalesce(1.0::DOUBLE / (60 + rb.r), 0), 8) AS score FROM ra FULL JOIN rb USING (query, doc)")
def rrf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rrf(searched(spark, sf_dir), document_terms(spark, sf_dir))


@query(f"""WITH {QUERY_SQL}, {BM25_SQL}, {OVERLAP_SQL}, {RANKS_SQL} SELECT query, doc, round(0.65::DOUBLE * coalesce(rb.p, 0) + 0.35::DOUBLE * coalesce(ra.p, 0) + CASE WHEN ra.r <= 20 AND rb.r <= 20 THEN 0.10::DOUBLE ELSE 0 END, 8) AS score
    FROM ra FULL JOIN rb USING (query, doc)""")
def pit_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_channels(spark, sf_dir)
    return ranking.pit(b, a)


@query(f"""WITH {DOCUMENT_QUERY_SQL}, {BM25_SQL}, {OVERLAP_SQL}, {RANKS_SQL} SELECT query, doc, round(0.65::DOUBLE * coalesce(rb.p, 0) + 0.35::DOUBLE * coalesce(ra.p, 0) + CASE WHEN ra.r <= 20 AND rb.r <= 20 THEN 0.10::DOUBLE ELSE 0 END, 8) AS score
    FROM ra FULL JOIN rb USING (query, doc)""")
def pit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pit(searched(spark, sf_dir), document_terms(spark, sf_dir))


@query(f"WITH {QUERY_SQL}, {BM25_SQL} SELECT query, arg_min(doc, struct_pack(s := -score, d := doc)) AS doc FROM bm JOIN (SELECT source, min(doc_id) AS own FROM documents WHERE text IS NOT NULL GROUP BY 1) o ON query = source WHERE doc <> own GROUP BY 1")
def bm25_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one best document beside the change itself."""
    own = table(spark, sf_dir, "documents").filter("source is not null and text is not null").groupBy(F.col("source").alias("query")).agg(F.min("doc_id").alias("own"))
    s = ranking.bm25(corpus(spark, sf_dir), source_terms(spark, sf_dir)).join(own, "query").filter("doc <> own")
    return s.groupBy("query").agg(F.min_by("doc", F.struct(-F.col("score"), F.col("doc"))).alias("doc"))


@query(f"""WITH {QUERY_SQL}, {BM25_SQL} SELECT DISTINCT query, doc FROM q JOIN df USING (term) JOIN k USING (term) WHERE df <= 3""")
def rare_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a name held by at most three of them."""
    k = corpus(spark, sf_dir)
    rare = k.groupBy("term").agg(F.count("*").alias("df")).filter("df <= 3").select("term")
    return source_terms(spark, sf_dir).join(rare, "term").join(k, "term").select("query", "doc").distinct()


@query(f"WITH {DOCUMENT_QUERY_SQL}, {BM25_SQL} SELECT query, arg_min(doc, struct_pack(s := -score, d := doc)) AS doc FROM bm WHERE doc <> query GROUP BY 1")
def discovery_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one best document beside each searching document."""
    return search.best(searched(spark, sf_dir), document_terms(spark, sf_dir))


@query(f"WITH {DOCUMENT_QUERY_SQL}, {BM25_SQL} SELECT DISTINCT query, doc FROM q JOIN df USING (term) JOIN k USING (term) WHERE df <= 3")
def rare_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``rare_discovery`` for each searching document."""
    k = corpus(spark, sf_dir)
    rare = k.groupBy("term").agg(F.count("*").alias("df")).filter("df <= 3").select("term")
    return document_terms(spark, sf_dir).join(rare, "term").join(k, "term").select("query", "doc").distinct()
