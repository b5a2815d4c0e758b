"""Queries of scores against gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import evaluation as EV
from weftline.operators import relations as R
from weftline.plans.registry import query

INSTANCES_SQL = "i AS (SELECT DISTINCT ON (instance_id) * FROM instances ORDER BY instance_id, ingested_at DESC NULLS LAST)"
HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
LENGTH = r"@@ -\d+(?:,\d+)? \+\d+(?:,(\d+))? @@"


@query(f"""WITH {INSTANCES_SQL}, h AS (SELECT instance_id, unnest(regexp_extract_all(gold_patch, '{HUNK}', 1)) AS a, unnest(regexp_extract_all(gold_patch, '{LENGTH}', 1)) AS l FROM i),
    s AS (SELECT DISTINCT instance_id, a::INT AS s, a::INT + greatest(CASE WHEN l = '' THEN 1 ELSE l::INT END, 1) - 1 AS e FROM h),
    g AS (SELECT DISTINCT instance_id, x.start_line AS s, x.end_line AS e FROM (SELECT instance_id, unnest(gold_fragments) AS x FROM i) WHERE x.start_line <= x.end_line),
    sl AS (SELECT DISTINCT instance_id, unnest(range(s, e + 1)) AS n FROM s), gl AS (SELECT DISTINCT instance_id, unnest(range(s, e + 1)) AS n FROM g),
    c AS (SELECT instance_id, count(*) AS common FROM sl JOIN gl USING (instance_id, n) GROUP BY 1), ns AS (SELECT instance_id, count(*) AS sel_lines FROM sl GROUP BY 1), ng AS (SELECT instance_id, count(*) AS gold_lines FROM gl GROUP BY 1),
    hit AS (SELECT g.instance_id, count(DISTINCT (g.s, g.e)) AS gh, count(DISTINCT (s.s, s.e)) AS sh FROM g JOIN s ON g.instance_id = s.instance_id AND s.s <= g.e AND g.s <= s.e GROUP BY 1),
    cn AS (SELECT instance_id, count(*) AS gn FROM g GROUP BY 1), cs AS (SELECT instance_id, count(*) AS sn FROM s GROUP BY 1),
    r AS (SELECT instance_id, coalesce(gh, 0)::DOUBLE / gn AS fr, coalesce(sh, 0)::DOUBLE / sn AS fp, coalesce(common, 0)::DOUBLE / sel_lines AS p, coalesce(common, 0)::DOUBLE / gold_lines AS r
      FROM cn LEFT JOIN cs USING (instance_id) LEFT JOIN hit USING (instance_id) JOIN ng USING (instance_id) LEFT JOIN ns USING (instance_id) LEFT JOIN c USING (instance_id))
    SELECT instance_id, round(fr, 6) AS fragment_recall, round(fp, 6) AS fragment_precision, round(p, 6) AS line_precision, round(r, 6) AS line_recall, round(CASE WHEN r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS line_f1 FROM r""")
def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges a patch touches against the gold ranges of its instance."""
    i = R.instances(spark, sf_dir)
    pairs = F.arrays_zip(F.regexp_extract_all("gold_patch", F.lit(HUNK), F.lit(1)).alias("a"), F.regexp_extract_all("gold_patch", F.lit(LENGTH), F.lit(1)).alias("l"))
    h = i.select("instance_id", F.explode(pairs).alias("x")).select("instance_id", F.col("x.a").cast("int").alias("s"), F.greatest(F.coalesce(F.nullif("x.l", F.lit("")).cast("int"), F.lit(1)), F.lit(1)).alias("n"))
    gold = i.select("instance_id", F.explode("gold_fragments").alias("x")).select("instance_id", F.col("x.start_line").alias("s"), F.col("x.end_line").alias("e")).filter("s <= e")
    return EV.line_scores(h.select("instance_id", "s", (F.col("s") + F.col("n") - 1).alias("e")), gold, "instance_id")


FILE_SETS_SQL = rf"""{INSTANCES_SQL}, fs AS (SELECT instance_id, source_benchmark, list_distinct(gold_files) AS gold, list_distinct(list_concat(regexp_extract_all(coalesce(gold_patch, ''), '(?m)^diff --git a/(\S+)', 1), regexp_extract_all(coalesce(problem_statement, ''), '[\w./-]+/[\w.-]+\.[a-z]+'))) AS sel
    FROM i WHERE gold_files IS NOT NULL), fb AS (SELECT *, list_filter(sel, lambda x: regexp_matches(x, '(^|/)(test|tests|docs)/') AND NOT list_contains(gold, x)) AS forbidden FROM fs)"""


def file_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected, gold and forbidden files: what patch and problem name; test and handbook files beside the gold are forbidden."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    sel = F.array_distinct(F.concat(F.regexp_extract_all(empty("gold_patch"), F.lit(r"(?m)^diff --git a/(\S+)"), F.lit(1)), F.regexp_extract_all(empty("problem_statement"), F.lit(r"[\w./-]+/[\w.-]+\.[a-z]+"), F.lit(0))))
    s = R.instances(spark, sf_dir).filter("gold_files is not null").select("instance_id", "source_benchmark", F.array_distinct("gold_files").alias("gold"), sel.alias("sel"))
    return s.withColumn("forbidden", F.filter("sel", lambda x: x.rlike("(^|/)(test|tests|docs)/") & ~F.array_contains("gold", x)))


RECALL = "CASE WHEN len(gold) > 0 THEN len(list_intersect(sel, gold))::DOUBLE / len(gold) ELSE 1 END"


@query(rf"""WITH {FILE_SETS_SQL} SELECT instance_id, round(100::DOUBLE * {RECALL} * (1 - CASE WHEN len(forbidden) > 0 THEN len(list_intersect(sel, forbidden))::DOUBLE / len(forbidden) ELSE 0 END), 6) AS oracle_score,
    round(coalesce(100::DOUBLE * {RECALL} * (1 - len(list_intersect(sel, forbidden))::DOUBLE / nullif(len(sel), 0)), 0), 6) AS real_world_score FROM fb""")
def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = (F.col("sel"), F.col("gold"), F.col("forbidden"))
    return file_sets(spark, sf_dir).select("instance_id", F.round(EV.oracle_score(*sets), 6).alias("oracle_score"), F.round(EV.real_world_score(*sets), 6).alias("real_world_score"))


@query(rf"""WITH {FILE_SETS_SQL}, e AS (SELECT source_benchmark, unnest(gold) AS hidden, gold, sel FROM fb WHERE len(gold) > 0)
    SELECT source_benchmark, count(*) AS n, round(avg(list_contains(sel, hidden)::INT), 6) AS found_rate, round(avg(len(list_filter(sel, lambda x: NOT list_contains(gold, x)))::DOUBLE / nullif(len(sel), 0)), 6) AS distractor_rate FROM e GROUP BY 1""")
def held_out_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gold file hidden once: whether it is found, and how much else is selected."""
    return EV.held_out(file_sets(spark, sf_dir).select("source_benchmark", "gold", F.col("sel").alias("selected")), "source_benchmark")


PAIRS_SQL = f"{R.RESULTS_SQL}, pr AS (SELECT instance_id, source_benchmark, max(file_recall) FILTER (scorer = 'bm25') AS a, max(file_recall) FILTER (scorer = 'ego') AS b FROM r WHERE source_benchmark IS NOT NULL GROUP BY 1, 2)"


def scorer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda s: F.max(F.when(F.col("scorer") == s, F.col("file_recall")))
    return R.results(spark, sf_dir).filter("source_benchmark is not null").groupBy("instance_id", "source_benchmark").agg(pick("bm25").alias("a"), pick("ego").alias("b"))


@query(f"""WITH {PAIRS_SQL}, d AS (SELECT source_benchmark AS grp, round(a - b, 6) AS d FROM pr WHERE a IS NOT NULL AND b IS NOT NULL AND round(a - b, 6) <> 0),
    c AS (SELECT grp, abs(d) AS m, count(*) AS t, count(*) FILTER (d > 0) AS up FROM d GROUP BY 1, 2),
    k AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY grp ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0::DOUBLE AS rank FROM c),
    s AS (SELECT grp, sum(t)::DOUBLE AS n, sum(up * rank) AS w, sum(t::DOUBLE * t * t - t) AS ties FROM k GROUP BY 1)
    SELECT grp, n::BIGINT AS n, round(w, 4) AS w_plus, round(CASE WHEN n * (n + 1) * (2 * n + 1) / 24 - ties / 48 > 0 THEN (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) ELSE 0 END, 6) AS z FROM s""")
def signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed-rank test of two scorers over the same instances, per benchmark."""
    return EV.signed_ranks(scorer_pairs(spark, sf_dir), "source_benchmark", "a", "b")


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.paired_bootstrap(scorer_pairs(spark, sf_dir), "source_benchmark", "a", "b")
