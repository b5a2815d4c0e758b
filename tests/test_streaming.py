"""Sessions and co-change over streams."""

import pytest

from weftline.streaming import churn


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)


@pytest.fixture
def feed(spark, tmp_path):
    def make(rows, schema, names):
        # One file for each batch, so that the watermark moves between them.
        for part in rows:
            spark.createDataFrame(part, schema).selectExpr(*names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        typed = spark.read.parquet(str(tmp_path / "in")).schema
        return spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def test_sessions_end_after_a_pause(spark, tmp_path, feed):
    early = [("2024-01-01 10:00:00", 1), ("2024-01-01 10:20:00", 1), ("2024-01-01 12:00:00", 1), ("2024-01-01 10:05:00", 2)]
    stream = feed([early, [("2024-01-09 00:00:00", 9)]], "ts string, user_id long", ["cast(ts as timestamp) ts", "user_id"])
    run(churn.sessions(stream), tmp_path, "sessions_out")
    got = sorted((r["user_id"], r["n"]) for r in spark.table("sessions_out").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_cochange_pairs_of_final_commits(spark, tmp_path, feed):
    early = [("c1", p, "2024-01-01 10:00:00") for p in ("a", "b", "c")] + [("c2", "a", "2024-01-01 11:00:00")]
    late = [("c9", p, "2024-01-09 00:00:00") for p in ("x", "y")]
    stream = feed([early, late], "commit_id string, path string, ts string", ["commit_id", "path", "cast(ts as timestamp) ts"])
    run(churn.cochange(stream), tmp_path, "pairs_out")
    assert sorted((r["commit_id"], r["src"], r["dst"]) for r in spark.table("pairs_out").collect()) == [("c1", "a", "b"), ("c1", "a", "c"), ("c1", "b", "c")]
