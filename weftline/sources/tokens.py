"""The derived token table: term counts of every distinct text, kept between queries.

Texts are known by the hash of their content, so a text that is unchanged, moved or copied is never
tokenised again.  New texts are appended; the table is cut into SHARDS by hash, and ``evict`` drops
the shards' texts that no corpus has named for longest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.runtime import checkpoint_dir, small

#: Number of shards, and the share of the allowed size that eviction leaves.
SHARDS, KEEP = 256, 0.80
SCHEMA = "oid string, term string, tf bigint, seen bigint, shard int"


def store(spark: SparkSession, least: int) -> str:
    """Where this session keeps the tokens of a least length."""
    return f"{checkpoint_dir(spark)}/tokens-{least}"


def held(spark: SparkSession, folder: str) -> DataFrame:
    """The table as it stands, empty if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(SCHEMA).parquet(folder) if known else spark.createDataFrame([], SCHEMA)


def token_table(docs: DataFrame, key: str, text: str, least: int, folder: str | None = None) -> DataFrame:
    """``doc, term, tf`` of a corpus, from the table; texts it does not hold are tokenised and appended first.

    Null texts have no terms.  Of one text under several ids the work is done once.
    """
    spark = docs.sparkSession
    folder = folder or store(spark, least)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("t"), F.sha2(text, 256).alias("oid"))
    have = held(spark, folder)
    missing = rows.join(have.select("oid").distinct(), "oid", "left_anti")
    if not missing.isEmpty():
        stamp = F.unix_micros(F.current_timestamp())
        terms = missing.groupBy("oid").agg(F.any_value("t").alias("t")).select("oid", F.explode(X.identifiers(F.col("t"), least)).alias("term"))
        counted = terms.groupBy("oid", "term").agg(F.count("*").alias("tf")).withColumn("seen", stamp).withColumn("shard", F.conv(F.substring("oid", 1, 2), 16, 10).cast("int"))
        counted.write.mode("append").parquet(folder)
        have = held(spark, folder)
    return rows.select("doc", "oid").join(have.select("oid", "term", "tf"), "oid").select("doc", "term", "tf")


def evict(spark: SparkSession, folder: str, most_rows: int) -> int:
    """Drops the texts seen longest ago until KEEP of ``most_rows`` are left; rows left.  A table within the limit stays.

    The kept rows are written beside the table and take its place, so a reader finds one or the other.
    """
    table = held(spark, folder)
    total = table.count()
    if total <= most_rows:
        return total
    sizes = table.groupBy("oid").agg(F.count("*").alias("n"), F.max("seen").alias("seen"))
    # Whole steps of age are dropped: the counts per stamp are few.
    ages = sizes.groupBy("seen").agg(F.sum("n").alias("n")).orderBy(F.desc("seen")).collect()
    kept, since = 0, None
    for r in ages:
        if kept + r["n"] > KEEP * most_rows:
            break
        kept, since = kept + r["n"], r["seen"]
    stay = sizes.filter(F.col("seen") >= since) if since is not None else sizes.limit(0)
    table.join(small(stay.select("oid")), "oid", "left_semi").select(*table.columns).write.mode("overwrite").parquet(f"{folder}.next")
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm(folder), True)
    fs.rename(jvm(f"{folder}.next"), jvm(folder))
    return kept
