"""Operators against brute force, and their edge cases."""

import itertools
import random

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import edges as E
from weftline.operators import fragmenting as TG
from weftline.operators import graph as G
from weftline.operators import metrics as M
from weftline.operators import ranking, selection
from weftline.sinks import documents, graphs
from weftline.sources import diffs, trees
from weftline.streaming import churn


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_containment_is_innermost(spark):
    spans = [(1, "a", 1, 100), (2, "a", 1, 50), (3, "a", 10, 20), (4, "b", 1, 3), (5, "a", 300, 700), (6, "a", 600, 650)]
    got = {(r["src"], r["dst"]) for r in E.containment(spark.createDataFrame(spans, "id long, file string, start_line int, end_line int")).filter("weight = 0.5").collect()}
    assert got == {(2, 1), (3, 2), (6, 5)}


def test_cochange_counts_small_commits_only(spark):
    baskets = [(c, n) for c in range(3) for n in (1, 2)] + [(9, n) for n in range(1, 40)]
    got = E.cochange(spark.createDataFrame(baskets, "commit_id int, node int")).collect()
    assert {(r["src"], r["dst"]) for r in got} == {(1, 2), (2, 1)}


def test_nearest_gap_matches_brute_force(spark):
    rng = random.Random(1)
    frags, hunks = [], []
    at = 1
    for i in range(40):
        end = at + rng.randint(3, 12)
        frags.append((i, "f", "function" if i % 3 else "chunk", at, end))
        if i % 3 and i % 2:
            hunks.append((i, "f", at + 1, min(at + 3, end)))
        at = end + rng.randint(1, 9)
    got = {r["id"]: r["gap"] for r in E.nearest_gap(spark.createDataFrame(frags, "id long, file string, kind string, start_line int, end_line int"), spark.createDataFrame(hunks, "hunk long, file string, hs int, he int")).collect()}
    for i, _, _, s, e in frags:
        assert got[i] == min(max(0, a - e, s - b) for k, _, a, b in hunks if k != i)


def test_cycles_and_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7)], "src int, dst int").withColumn("weight", F.lit(1.0))
    assert rows(G.cycles(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert dict(rows(G.hops(edges, spark.createDataFrame([(1,)], "node int")))) == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: -1, 7: -1}
    assert G.cycles(edges.limit(0)).count() == 0


def test_pagerank_keeps_mass_on_a_ring(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "src int, dst int, weight double")
    total = G.pagerank(edges, spark.createDataFrame([(0, 1.0)], "node int, mass double")).agg(F.sum("score")).first()[0]
    assert abs(total - 1.0) < 1e-9


def test_greedy_pack_skips_what_does_not_fit(spark):
    ranked = spark.createDataFrame([("q", 1, 3.0, 60), ("q", 2, 2.0, 50), ("q", 3, 1.0, 40), ("q", 4, 0.0, 1)], "query string, doc long, score double, cost int")
    assert rows(selection.greedy_pack(ranked, 100)) == [("q", 1, 1, 60), ("q", 2, 3, 100)]


def test_lazy_greedy_properties():
    rng = random.Random(2)
    for _ in range(30):
        items, strengths = [], {}
        for i in range(12):
            s = rng.randint(1, 40)
            items.append((i, f"f{rng.randint(0, 3)}", s, s + rng.randint(0, 9), rng.randint(5, 60), rng.random()))
            strengths[i] = {f"n{k}": rng.choice([0.3, 0.5, 1.0]) for k in rng.sample(range(5), 2)}
        picked, value = selection.lazy_greedy(items, strengths, {}, 120, core=[0])
        by = {i[0]: i for i in items}
        assert sum(by[p][4] for p in picked) <= 120 and len(set(picked)) == len(picked) and value >= 0
        for a, b in itertools.combinations(picked, 2):
            assert by[a][1] != by[b][1] or by[a][3] < by[b][2] or by[b][3] < by[a][2]


def test_boltzmann_fills_the_budget():
    items = [(i, 10 + i, 1.0 / (i + 1)) for i in range(50)]
    beta = selection.calibrate_beta(items, 300)
    assert sum(10 + i for i in selection.boltzmann(items, 300, beta)) >= 270


def test_diff_round_trip():
    rng = random.Random(3)
    for _ in range(60):
        old = [rng.choice("abcdef") for _ in range(rng.randint(0, 25))]
        new = [x for x in old if rng.random() > 0.2]
        for _ in range(rng.randint(0, 5)):
            new.insert(rng.randint(0, len(new)), rng.choice("xyz"))
        a, b = "\n".join(old), "\n".join(new)
        assert diffs.revert(b, diffs.line_diff(a, b)) == a
        patch = f"diff --git a/p b/p\n{diffs.unified(a, b, 'p')}"
        runs = [h[1:] for h in diffs.parse_patch(patch)]
        if a and b and a != b:
            assert diffs.revert(b, runs) == a


def test_ignore_rules(spark):
    df = spark.createDataFrame([("a/b.lock",), ("node_modules/x.js",), ("src/a.py",), ("keep.lock",), (None,)], "path string")
    got = [r["path"] for r in df.filter(trees.ignored(F.col("path"), ["*.lock", "!keep.lock", "node_modules/", "", "# c"])).collect()]
    assert got == ["a/b.lock", "node_modules/x.js"]


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes("﻿x = 1\r\ny\n".encode())
    (tmp_path / "b.py").write_bytes(b"\x00\x01")
    (tmp_path / "c.unknown").write_text("z")
    got = trees.read_tree(spark, str(tmp_path)).collect()
    assert [(r["path"], r["content"]) for r in got] == [("a/x.py", "x = 1\ny\n")]


def test_result_log_last_wins(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"instance_id":"a","seq":1,"v":1}\nbroken\n{"instance_id":"a","seq":2,"v":5}\n')
    assert rows(trees.result_log(spark, str(p), "instance_id string, seq long, v long")) == [("a", 2, 5)]


def test_fetch_refuses_escapes(spark):
    files = spark.createDataFrame([("a.py", "1\n2\n3")], "path string, content string")
    ids = spark.createDataFrame([("a.py:2-3",), ("../a.py:1-2",), ("a.py:0-1",)], "id string")
    assert dict(rows(trees.fetch(files, ids))) == {"a.py:2-3": "2\n3", "../a.py:1-2": None, "a.py:0-1": None}


def test_text_functions(spark):
    df = spark.createDataFrame([("DATABASE_URL",), ("databaseUrl",), ("database-url",), ("größe_x",), (None,), ("",)], "s string")
    got = [r[0] for r in df.select(X.canonical_key(F.col("s"))).collect()]
    assert got[:3] == ["database_url"] * 3 and got[4] is None and got[5] == ""
    assert df.select(X.identifiers(F.col("s"))).collect()[3][0] == ["größe_x"]
    d = spark.createDataFrame([("24h",), ("90min",), ("1h30m",), ("2w",)], "w string")
    assert [r[0] for r in d.select(X.duration_seconds(F.col("w"))).collect()] == [86400, 5400, 5400, 1209600]
    t = spark.createDataFrame([("src/latest.py",), ("src/FooTest.java",), ("tests/a.py",), ("a/widget.spec.ts",)], "p string")
    assert [r[0] for r in t.select(X.is_test(F.col("p"))).collect()] == [False, True, True, True]


def test_fragmenting_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x\n# a\nb\n## c"), (4, "\n".join(map(str, range(450))))], "id int, t string")
    assert rows(TG.sections(docs, "id", "t")) == [(3, 0, "# a", 2, 3), (3, 1, "## c", 4, 4)]
    assert [(r["id"], r["start_line"], r["end_line"]) for r in TG.line_blocks(docs, "id", "t").collect()][-3:] == [(4, 1, 200), (4, 201, 400), (4, 401, 450)]
    assert TG.sections(docs.limit(0), "id", "t").count() == 0


def test_fusion_and_bm25(spark):
    k = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "doc int, term string, tf int")
    q = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "zz")], "query string, term string")
    s = ranking.bm25(k, q)
    assert [r["doc"] for r in ranking.ranked(s).orderBy("rank").collect()] == [2, 1]
    assert ranking.rrf(s, s).count() == ranking.pit(s, s).count() == 2


def test_wilcoxon_and_bootstrap(spark):
    pairs = spark.createDataFrame([("g", float(i), float(i + 1)) for i in range(12)], "g string, a double, b double")
    r = M.wilcoxon(pairs, "g", "a", "b").first()
    assert r["n"] == 12 and r["w_plus"] == 0 and r["p"] < 0.01
    c = M.bootstrap_ci(pairs, "g", "a").first()
    assert c["low"] < c["mean"] < c["high"]


def test_documents(spark):
    f = spark.createDataFrame([("a.py", 1, 2, "x ``` y\n")], "path string, start_line int, end_line int, content string")
    assert documents.markdown(f).first()["block"] == "### a.py:1-2\n````\nx ``` y\n````"
    assert documents.yaml(f).first()["block"].startswith('- path: "a.py')
    e = spark.createDataFrame([("a", "b", 1.0, "x&y")], "src string, dst string, weight double, category string")
    assert any("x&amp;y" in r["line"] for r in graphs.graphml_rows(e).collect()) and "-->|100%|" in graphs.mermaid(e)


def test_streaming_churn(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame([(1, "2024-01-01 00:10:00", 1, "a", 1.0), (1, "2024-01-01 00:10:00", 1, "a", 1.0), (2, "2024-01-05 00:00:00", 1, "b", 1.0)], "event_id long, ts string, user_id long, event_type string, value double").selectExpr(
        "event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value"
    ).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = churn.churn(stream).writeStream.outputMode("update").format("memory").queryName("churn_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["event_type"], r["n"]) for r in spark.table("churn_out").collect()} == {("a", 1), ("b", 1)}


def test_lexical_weight_has_the_doubles_of_its_sql(spark):
    """Every similarity of five digits, for bounds whose doubles are no exact distance apart, bit by bit."""
    import duckdb

    from weftline.operators import keys
    from weftline.plans.key_queries import rounded_weight

    got = spark.range(30000, 100001).select((F.col("id") / 1e5).alias("sim")).select("sim", rounded_weight(keys.lexical_weight(F.col("sim"), F.lit("c"), F.lit("java"))).alias("w")).toPandas()
    assert len(got) == 70001
    want = duckdb.sql("SELECT sim, round(0.08::DOUBLE + (sim - 0.30::DOUBLE) / 0.70::DOUBLE * (0.15 - 0.08), 5) AS w FROM got").df()
    assert dict(zip(got["sim"], got["w"])) == dict(zip(want["sim"], want["w"]))


def test_searches_over_segments_equal_those_by_pairs(spark, monkeypatch):
    """Ties, a repeated document, one without an id, null and empty texts; several segments."""
    from weftline.operators import search

    monkeypatch.setattr(search, "SEGMENT_DOCS", 7)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps_1", "zeta"], k=rng.randint(0, 6)))) for i in range(60)]
    df = spark.createDataFrame([*docs, (8, "beta omega"), (None, "beta beta gamma"), (None, "zeta"), (99, None), (70, "omega")], "doc_id long, text string")
    k = ranking.tokens(df.filter("text is not null"), "doc_id", "text")
    q = k.filter("doc % 4 = 0").select(F.col("doc").alias("query"), "term")
    q = q.unionByName(spark.createDataFrame([(500, "nowhere")], "query long, term string"))
    ix, a = search.index(df, "doc_id", "text"), ranking.bm25(k, q).cache()
    b = q.join(k, "term").groupBy("query", "doc").agg(F.count("*").cast("double").alias("score")).filter("doc is not null")
    assert len(ix.files) > 3 and ix.void

    def near(x):
        return {(r[0], r[1]): tuple(round(v, 5) for v in r[2:]) for r in x.collect()}

    assert near(search.ranked(ix, q)) == near(ranking.ranked(a).select("query", "doc", "score", "rank"))
    assert rows(search.best(ix, q)) == rows(a.filter("doc <> query").groupBy("query").agg(F.min_by("doc", F.struct(-F.col("score"), F.col("doc"))).alias("doc")))
    ids = df.filter("doc_id is not null")
    only, k = search.index(ids, "doc_id", "text"), ranking.tokens(ids.filter("text is not null"), "doc_id", "text")
    a = ranking.bm25(k, q).cache()
    assert near(search.rrf(only, q)) == near(ranking.rrf(a, b)) and near(search.pit(only, q)) == near(ranking.pit(b, a))
    assert search.ranked(search.index(df.limit(0), "doc_id", "text"), q).count() == 0
