"""Queries of evaluation metrics and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import fragmenting as TG
from weftline.operators import metrics as M
from weftline.operators import order
from weftline.operators import relations as R
from weftline.plans.registry import query
from weftline.runtime import cut, table

QS = {25: 0.25, 50: 0.5, 75: 0.75, 95: 0.95, 99: 0.99}


@query("SELECT l_returnflag, count(l_extendedprice) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS p{k}" for k, q in QS.items()) + ", round(avg(l_extendedprice), 6) AS mean, max(l_extendedprice) AS max, round(stddev_pop(l_extendedprice), 6) AS std FROM lineitem GROUP BY 1")
def percentile_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.percentile_block(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@query(f"WITH {R.RESULTS_SQL} SELECT scorer, count(elapsed_seconds) AS n, quantile_disc(elapsed_seconds, 0.5) AS p50, quantile_disc(elapsed_seconds, 0.95) AS p95 FROM r WHERE elapsed_seconds IS NOT NULL GROUP BY 1")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles: a value of the data, found by counting ranges."""
    r = R.results(spark, sf_dir).select("scorer", "elapsed_seconds")
    got = order.percentiles(r, "scorer", "elapsed_seconds", (0.5, 0.95), interpolate=False)
    return got.select("scorer", "n", F.col("q0").alias("p50"), F.col("q1").alias("p95"))


BETAS = {"half": 0.5, "one": 1.0, "two": 2.0}
FB = "CASE WHEN {b} * file_precision + file_recall > 0 THEN (1 + {b}) * file_precision * file_recall / ({b} * file_precision + file_recall) WHEN {b} * file_precision + file_recall = 0 THEN 0 END"


@query(f"WITH {R.RESULTS_SQL} SELECT source_benchmark, " + ", ".join(f"round(avg({FB.format(b=b * b)}), 6) AS mean_{n}, round(quantile_cont({FB.format(b=b * b)}, 0.5), 6) AS median_{n}" for n, b in (("half", 0.5), ("one", 1.0), ("two", 2.0))) + " FROM r GROUP BY 1")
def f_beta_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(R.results(spark, sf_dir).select("source_benchmark", *[M.f_beta(F.col("file_precision"), F.col("file_recall"), b).alias(n) for n, b in BETAS.items()]))
    out = rows.groupBy("source_benchmark").agg(*[F.round(F.avg(n), 6).alias(f"mean_{n}") for n in BETAS])
    for n in BETAS:
        mid = order.percentiles(rows, "source_benchmark", n, (0.5,)).select(F.col("source_benchmark").alias("b"), F.round("q0", 6).alias(f"median_{n}"))
        out = out.join(mid, F.col("source_benchmark").eqNullSafe(F.col("b")), "left").drop("b")
    return out


@query(f"""WITH {R.RESULTS_SQL} SELECT scorer, count(file_recall) AS n, round(100.0::DOUBLE * count(*) FILTER (file_recall >= 1) / count(file_recall), 4) AS perfect, round(100.0::DOUBLE * count(*) FILTER (file_recall = 0) / count(file_recall), 4) AS zero,
    round(100.0::DOUBLE * count(*) FILTER (file_recall > 0 AND file_recall < 1) / count(file_recall), 4) AS partial FROM r GROUP BY 1""")
def recall_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, n = F.col("file_recall"), F.count("file_recall")
    share = lambda c, name: F.round(100.0 * F.count_if(c) / n, 4).alias(name)
    return R.results(spark, sf_dir).groupBy("scorer").agg(n.alias("n"), share(x >= 1, "perfect"), share(x == 0, "zero"), share((x > 0) & (x < 1), "partial"))


@query("SELECT CASE WHEN o_totalprice < 50000 THEN '0-50k' WHEN o_totalprice < 100000 THEN '50k-100k' WHEN o_totalprice < 200000 THEN '100k-200k' ELSE '200k+' END AS bucket, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2")
def strata_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    bucket = F.when(p < 50000, "0-50k").when(p < 100000, "50k-100k").when(p < 200000, "100k-200k").otherwise("200k+")
    return table(spark, sf_dir, "orders").groupBy(bucket.alias("bucket"), "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg(p), 4).alias("mean"))


@query(f"WITH {R.RESULTS_SQL} SELECT source_benchmark, round(avg(file_recall) FILTER (used_tokens <= budget), 6) AS within_budget, round(avg(file_recall) FILTER (used_tokens > budget), 6) AS beyond_budget FROM r GROUP BY 1")
def conditional_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("file_recall")
    inside = F.col("used_tokens") <= F.col("budget")
    return R.results(spark, sf_dir).groupBy("source_benchmark").agg(F.round(F.avg(F.when(inside, x)), 6).alias("within_budget"), F.round(F.avg(F.when(F.col("used_tokens") > F.col("budget"), x)), 6).alias("beyond_budget"))


@query(f"WITH {R.RESULTS_SQL}, g AS (SELECT config_hash, source_benchmark, avg(file_recall) AS m FROM r WHERE source_benchmark IS NOT NULL GROUP BY 1, 2) SELECT config_hash, round(min(m), 6) AS objective, arg_min(source_benchmark, struct_pack(m := round(m, 9), b := source_benchmark)) AS weakest FROM g GROUP BY 1")
def min_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least mean recall over benchmarks of each configuration."""
    g = R.results(spark, sf_dir).filter("source_benchmark is not null").groupBy("config_hash", "source_benchmark").agg(F.avg("file_recall").alias("m"))
    return g.groupBy("config_hash").agg(F.round(F.min("m"), 6).alias("objective"), F.min_by("source_benchmark", F.struct(F.round("m", 9), F.col("source_benchmark"))).alias("weakest"))


@query("""WITH i AS (SELECT DISTINCT ON (instance_id) instance_id, gold_files, gold_patch FROM instances ORDER BY instance_id, ingested_at DESC NULLS LAST), s AS (SELECT instance_id, list_distinct(regexp_extract_all(gold_patch, '(?m)^diff --git a/(\\S+)', 1)) AS sel, gold_files FROM i WHERE gold_files IS NOT NULL AND gold_patch IS NOT NULL)
    SELECT instance_id, round(len(list_intersect(sel, list_distinct(gold_files)))::DOUBLE / greatest(len(list_distinct(gold_files)), 1), 6) AS recall, CASE WHEN len(sel) > 0 THEN round(len(list_intersect(sel, list_distinct(gold_files)))::DOUBLE / len(sel), 6) END AS precision FROM s""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files a patch names against the gold files."""
    sel = F.array_distinct(F.regexp_extract_all("gold_patch", F.lit(r"(?m)^diff --git a/(\S+)"), F.lit(1)))
    s = R.instances(spark, sf_dir).filter("gold_files is not null and gold_patch is not null").select("instance_id", sel.alias("sel"), F.array_distinct("gold_files").alias("gold"))
    hit = F.size(F.array_intersect("sel", "gold"))
    return s.select("instance_id", F.round(hit / F.greatest(F.size("gold"), F.lit(1)), 6).alias("recall"), F.when(F.size("sel") > 0, F.round(hit / F.size("sel"), 6)).alias("precision"))


@query("""WITH i AS (SELECT DISTINCT ON (instance_id) instance_id, gold_fragments FROM instances ORDER BY instance_id, ingested_at DESC), g AS (SELECT DISTINCT instance_id, x.path AS path, unnest(range(x.start_line, x.end_line + 1)) AS line FROM (SELECT instance_id, unnest(gold_fragments) AS x FROM i))
    SELECT instance_id, count(*) AS gold_lines, count(DISTINCT path) AS gold_paths FROM g GROUP BY 1""")
def gold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct gold lines of an instance: ranges are merged per path and their lengths added, no line is written out."""
    g = R.instances(spark, sf_dir).select("instance_id", F.posexplode("gold_fragments").alias("id", "x")).filter("x.start_line <= x.end_line")
    key = F.struct("instance_id", F.col("x.path").alias("path"))
    merged = TG.merged_ranges(g.select(key.alias("key"), "id", F.col("x.start_line").alias("start_line"), F.col("x.end_line").alias("end_line")), "key")
    lines = F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long")
    return merged.groupBy("key.instance_id").agg(lines.alias("gold_lines"), F.countDistinct("key.path").alias("gold_paths"))


@query(r"""WITH i AS (SELECT DISTINCT ON (instance_id) instance_id, gold_files, gold_patch, problem_statement FROM instances ORDER BY instance_id, ingested_at DESC),
    s AS (SELECT instance_id, list_distinct(gold_files) AS gold, list_distinct(regexp_extract_all(gold_patch, '(?m)^diff --git a/(\S+)', 1)) AS a,
      list_distinct(regexp_extract_all(problem_statement, '[\w./-]+/[\w.-]+\.[a-z]+')) AS e FROM i WHERE len(gold_files) > 0 AND gold_patch IS NOT NULL AND problem_statement IS NOT NULL)
    SELECT count(*) AS n, round(avg(len(list_intersect(a, gold))::DOUBLE / len(gold)), 6) AS first, round(avg(len(list_intersect(e, gold))::DOUBLE / len(gold)), 6) AS second,
      round(avg(len(list_intersect(list_distinct(list_concat(a, e)), gold))::DOUBLE / len(gold)), 6) AS ceiling FROM s""")
def union_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of two selections, and of the union of their files: the files a patch names and those its problem names."""
    i = R.instances(spark, sf_dir).filter("size(gold_files) > 0 and gold_patch is not null and problem_statement is not null")
    sel = i.select(
        F.array_distinct("gold_files").alias("gold"),
        F.array_distinct(F.regexp_extract_all("gold_patch", F.lit(r"(?m)^diff --git a/(\S+)"), F.lit(1))).alias("a"),
        F.array_distinct(F.regexp_extract_all("problem_statement", F.lit(r"[\w./-]+/[\w.-]+\.[a-z]+"), F.lit(0))).alias("e"),
    )
    return sel.agg(F.count("*").alias("n"), *[F.round(F.avg(M.recall(x, F.col("gold"))), 6).alias(n) for n, x in (("first", F.col("a")), ("second", F.col("e")), ("ceiling", F.array_union("a", "e")))])


@query(f"""WITH {R.RESULTS_SQL}, x AS (SELECT instance_id, budget, max(used_tokens) AS u FROM r WHERE scorer = 'bm25' GROUP BY 1, 2), y AS (SELECT instance_id, budget, max(used_tokens) AS u FROM r WHERE scorer = 'ego' GROUP BY 1, 2)
    SELECT coalesce(x.budget, y.budget) AS budget, count(*) FILTER (x.u IS NOT DISTINCT FROM y.u) AS same, count(*) FILTER (x.u IS DISTINCT FROM y.u) AS different FROM x FULL JOIN y ON x.instance_id = y.instance_id AND x.budget = y.budget GROUP BY 1""")
def equivalence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side: how many cells agree."""
    r = R.results(spark, sf_dir)
    side = lambda s, n: r.filter(F.col("scorer") == s).groupBy("instance_id", "budget").agg(F.max("used_tokens").alias(n))
    both = side("bm25", "a").join(side("ego", "b"), ["instance_id", "budget"], "full")
    return both.groupBy("budget").agg(F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))


@query("""WITH d AS (SELECT doc_id, repo, path, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL),
    p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY repo, path ORDER BY doc_id) AS v FROM d)
    SELECT doc_id, round(len(list_intersect(w, v))::DOUBLE / greatest(len(list_distinct(list_concat(w, v))), 1), 6) AS jaccard FROM p WHERE v IS NOT NULL""")
def jaccard_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the words of each text of a file with the one before: how far a selection moves from run to run."""
    d = table(spark, sf_dir, "documents").filter("text is not null and repo is not null and path is not null")
    d = d.select("doc_id", "repo", "path", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    p = d.withColumn("v", F.lag("w").over(Window.partitionBy("repo", "path").orderBy("doc_id"))).filter("v is not null")
    return p.select("doc_id", F.round(F.size(F.array_intersect("w", "v")) / F.greatest(F.size(F.array_union("w", "v")), F.lit(1)), 6).alias("jaccard"))


# One p value per benchmark from its counts: the share of runs beyond their budget.
PV_SQL = f"{R.RESULTS_SQL}, pv AS (SELECT source_benchmark AS test, round(count(*) FILTER (used_tokens > budget)::DOUBLE / count(*), 8) AS p FROM r WHERE source_benchmark IS NOT NULL GROUP BY 1)"


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.results(spark, sf_dir).filter("source_benchmark is not null")
    return r.groupBy(F.col("source_benchmark").alias("test")).agg(F.round(F.count_if(F.col("used_tokens") > F.col("budget")) / F.count("*"), 8).alias("p"))


@query(f"WITH {PV_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS n FROM pv) SELECT test, p, round(max(least(1, (n - k + 1) * p)) OVER (ORDER BY k), 8) AS holm FROM k")
def holm_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.holm(p_values(spark, sf_dir))


@query(f"WITH {PV_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS n FROM pv) SELECT test, p, round(min(least(1, n * p / k)) OVER (ORDER BY k DESC), 8) AS bh FROM k")
def bh_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bh(p_values(spark, sf_dir))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bootstrap_ci(R.results(spark, sf_dir).filter("source_benchmark is not null"), "source_benchmark", "file_recall")


@query()
def wilcoxon_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.results(spark, sf_dir)
    pick = lambda s: F.max(F.when(F.col("scorer") == s, F.col("file_recall")))
    pairs = r.groupBy("instance_id", "source_benchmark").agg(pick("bm25").alias("a"), pick("ego").alias("b")).filter("source_benchmark is not null")
    return M.wilcoxon(pairs, "source_benchmark", "a", "b")


@query(f"WITH {R.RESULTS_SQL}, l AS (SELECT scorer, source_benchmark, avg(file_recall) AS x, sum(file_recall) AS s, count(file_recall) AS c FROM r WHERE source_benchmark IS NOT NULL GROUP BY 1, 2) SELECT scorer, source_benchmark, round((sum(s) OVER (PARTITION BY scorer) - s) / (sum(c) OVER (PARTITION BY scorer) - c), 6) AS left_out_mean FROM l")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall of a scorer over all benchmarks but one, from one pass of sums."""
    g = R.results(spark, sf_dir).filter("source_benchmark is not null").groupBy("scorer", "source_benchmark").agg(F.sum("file_recall").alias("s"), F.count("file_recall").alias("c"))
    w = Window.partitionBy("scorer")
    return g.select("scorer", "source_benchmark", F.round((F.sum("s").over(w) - F.col("s")) / (F.sum("c").over(w) - F.col("c")), 6).alias("left_out_mean"))


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user: a maximum with partial aggregation, not a sort."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", "event_type").alias("r"))
    return e.groupBy("user_id").agg(F.max("r").alias("r")).select("user_id", "r.event_id", "r.event_type", "r.ts")


@query("WITH s AS (SELECT DISTINCT instance_id, split FROM split_manifest), i AS (SELECT DISTINCT ON (instance_id) instance_id, repo, base_commit FROM instances ORDER BY instance_id, ingested_at DESC NULLS LAST) SELECT instance_id FROM i JOIN s USING (instance_id) WHERE split <> 'calibration' AND NOT EXISTS (SELECT 1 FROM i x JOIN s y ON x.instance_id = y.instance_id AND y.split = 'calibration' WHERE x.repo = i.repo AND x.base_commit = i.base_commit)")
def contamination_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation instances whose repo and commit, as written, are not in the training split."""
    s = table(spark, sf_dir, "split_manifest").select("instance_id", "split").distinct()
    i = R.instances(spark, sf_dir).select("instance_id", "repo", "base_commit").join(s, "instance_id")
    train = i.filter("split = 'calibration'").select("repo", "base_commit").distinct()
    return i.filter("split <> 'calibration'").join(train, ["repo", "base_commit"], "left_anti").select("instance_id")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def churn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly churn: the batch twin of the streaming operator."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
