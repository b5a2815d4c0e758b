"""Queries of core identification and of whole files cut into fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import cores as C
from weftline.operators import definitions as D
from weftline.operators import relations as R
from weftline.plans.registry import query
from weftline.runtime import cut, table

# Hunks that begin with a fragment's last line and reach two lines beyond: some are covered, some overlap two, some lie in a gap.
EDGE_HUNKS_SQL = "h AS (SELECT id AS hunk, file, end_line + CASE WHEN end_line - start_line > 9 THEN -4 ELSE 1 END AS hs, end_line + CASE WHEN end_line - start_line > 9 THEN -2 ELSE 2 END AS he FROM f)"
SP = "s AS (SELECT id, file, coalesce(kind, '') AS kind, start_line, end_line FROM f)"
SEM = "('" + "', '".join(C.SEMANTIC) + "')"
BOX = "('" + "', '".join(C.CONTAINERS) + "')"
CORES_SQL = f"""{R.FRAGMENTS_SQL}, {EDGE_HUNKS_SQL}, {SP}, mt AS (SELECT hunk, hs, he, s.* FROM h JOIN s USING (file) WHERE start_line <= he AND end_line >= hs),
    cv AS (SELECT hunk, arg_min(id, struct_pack(k := (kind NOT IN {SEM})::INT, l := end_line - start_line, s := start_line, i := id)) AS core FROM mt WHERE start_line <= hs AND he <= end_line GROUP BY 1),
    ov AS (SELECT hunk, id AS core FROM mt WHERE hunk NOT IN (SELECT hunk FROM cv)), al AS (SELECT * FROM h WHERE hunk NOT IN (SELECT hunk FROM mt)),
    bf AS (SELECT hunk, arg_max(id, struct_pack(e := end_line, s := -start_line, i := -id)) AS core FROM al JOIN s USING (file) WHERE end_line < hs GROUP BY 1),
    af AS (SELECT hunk, arg_min(id, struct_pack(s := start_line, e := end_line, i := id)) AS core FROM al JOIN s USING (file) WHERE start_line > he GROUP BY 1),
    fd AS (SELECT hunk, core, 'covering' AS tier, 1 AS r FROM cv UNION ALL SELECT hunk, core, 'overlapping', 2 FROM ov UNION ALL SELECT hunk, core, 'nearest', 3 FROM bf UNION ALL SELECT hunk, core, 'nearest', 3 FROM af),
    bx AS (SELECT hunk, b.id AS core, 'container' AS tier, 4 AS r FROM fd JOIN s c ON fd.core = c.id JOIN s b ON b.file = c.file AND b.kind IN {BOX} AND b.id <> c.id AND b.start_line <= c.start_line AND c.end_line <= b.end_line),
    cr AS (SELECT hunk, core, arg_min(tier, r) AS tier FROM (SELECT * FROM fd UNION ALL SELECT * FROM bx) GROUP BY 1, 2)"""


def edge_hunks(frags: DataFrame) -> DataFrame:
    long = F.col("end_line") - F.col("start_line") > 9
    return frags.select(F.col("id").alias("hunk"), "file", (F.col("end_line") + F.when(long, -4).otherwise(1)).alias("hs"), (F.col("end_line") + F.when(long, -2).otherwise(2)).alias("he"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(R.fragments(spark, sf_dir).select("id", "file", F.coalesce("kind", F.lit("")).alias("kind"), "start_line", "end_line"))


@query(f"WITH {CORES_SQL} SELECT hunk, core, tier FROM cr")
def core_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = parts(spark, sf_dir)
    return C.identify(f, edge_hunks(f))


@query(f"""WITH {CORES_SQL}, c AS (SELECT * FROM s WHERE id IN (SELECT core FROM cr)), ow AS (SELECT c.id, sum(he - hs + 1)::DOUBLE AS seed, sum(least(he, end_line) - greatest(hs, start_line) + 1)::DOUBLE AS changed FROM c JOIN h ON c.file = h.file AND start_line <= he AND hs <= end_line GROUP BY 1),
    mi AS (SELECT * FROM c WHERE id NOT IN (SELECT id FROM ow)), sm AS (SELECT m.id, sum(seed) AS seed, sum(changed) AS changed FROM mi m JOIN c ON m.kind IN {BOX} AND m.file = c.file AND m.start_line <= c.start_line AND c.end_line <= m.end_line JOIN ow ON c.id = ow.id GROUP BY 1),
    be AS (SELECT file, max(he - hs + 1)::DOUBLE AS best FROM h GROUP BY 1)
    SELECT id AS core, seed, changed FROM ow UNION ALL SELECT * FROM sm UNION ALL SELECT id, best, best FROM mi JOIN be USING (file) WHERE id NOT IN (SELECT id FROM sm)""")
def core_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = parts(spark, sf_dir)
    h = edge_hunks(f)
    return C.seed_weights(f, h, cut(C.identify(f, h)))


@query(rf"""WITH {R.FRAGMENTS_SQL}, {R.HUNKS_SQL}, t AS (SELECT DISTINCT f.id FROM f JOIN h ON f.file = h.file AND f.start_line <= he AND hs <= f.end_line),
    k AS (SELECT id, file, start_line, end_line, (id IN (SELECT id FROM t) OR coalesce(len(string_split(content, chr(10))) <= 2 AND regexp_matches(ltrim(content, ' '), '^(apiVersion|kind|metadata):'), false))::INT AS keep FROM f)
    SELECT id, file, keep, row_number() OVER (PARTITION BY file ORDER BY keep DESC, end_line - start_line DESC, start_line, id) AS rank FROM k QUALIFY rank <= 5""")
def changed_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fragments of each file: what a hunk touches first, then the longest."""
    f = R.fragments(spark, sf_dir).select("id", "file", "kind", "content", "start_line", "end_line")
    return D.per_file_cap(f.drop("kind"), R.hunks(f), 5)


@query()
def file_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut by the first strategy that finds anything; compared with fixtures in the tests."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("file"), F.coalesce("path", F.lit("")).alias("path"), F.col("text").alias("content"))
    return D.fragment_files(d)
