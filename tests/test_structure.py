"""Fragmenting, cores, needs, references, keys, impact, sources and sinks on small fixtures."""

import datetime as dt
import json
import random

import pytest

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import cores as C
from weftline.operators import definitions as D
from weftline.operators import evaluation as EV
from weftline.operators import filters as FL
from weftline.operators import impact, keys, needs, order, ranking, references, selection
from weftline.sinks import documents, files, graphs
from weftline.sources import adapters, diffs, tokens, trees

TS = dt.datetime(2025, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Sources and sinks ------------------------------------------------------------------------------


def test_read_tree_takes_broken_bytes_and_drops_binaries(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"\xef\xbb\xbfx = '\xff\xfe'\r\ny = 1\rz = 2\n")
    (tmp_path / "b.py").write_bytes(b"ab \n\x00tail")
    (tmp_path / "c.py").write_bytes(b"")
    (tmp_path / "d.unknown").write_bytes(b"x")
    got = {r["path"]: r["content"] for r in trees.read_tree(spark, str(tmp_path)).collect()}
    # A file without bytes has no row, as the reader gives none for it.
    assert set(got) == {"a.py"} and got["a.py"].startswith("x = '\ufffd") and got["a.py"].endswith("\ny = 1\nz = 2\n")


def test_candidates_snapshot_and_log(spark):
    fs = spark.createDataFrame([("a.py", 5, "x"), ("run", 9, "#!/usr/bin/env python3\n"), ("big.py", 10**6, "x"), ("notes", 3, "text"), ("c.go", 4, None)], "path string, size long, content string")
    changed = spark.createDataFrame([("c.go",)], "path string")
    assert {r[0] for r in trees.candidates(fs, changed).select("path").collect()} == {"a.py", "run"}
    assert {r[0] for r in trees.candidates(fs, changed, spark.createDataFrame([("run",)], "path string")).select("path").collect()} == {"run"}
    objects = spark.createDataFrame([("r1", "100644", "src/a", "o1", 3), ("r1", "120000", "src/link", "o2", 3), ("r1", "160000", "sub", "o3", 0), ("r2", "100644", "src/a", "o4", 3), ("r1", "100755", "srcx/b", "o5", 1)], "revision string, mode string, path string, oid string, size long")
    assert rows(trees.snapshot(objects, "r1")) == [("src/a", "o1", 3), ("srcx/b", "o5", 1)] and rows(trees.snapshot(objects, "r1", ["src/"])) == [("src/a", "o1", 3)]
    log = spark.createDataFrame([(f"c{i}", TS + dt.timedelta(hours=i), f"p{i}") for i in range(9)] + [("c8", TS + dt.timedelta(hours=8), "q")], "commit_id string, committed_at timestamp, path string")
    assert rows(trees.commit_log(log, 2)) == [("c7", "p7"), ("c8", "p8"), ("c8", "q")]


def test_ignore_rules_have_folders(spark):
    df = spark.createDataFrame([(p,) for p in ("a.log", "x/keep.log", "x/y/z.tmp", "y/z.tmp", "node_modules/q.js", ".env", "src/m.py", "x/y/keep.tmp")], "path string")
    got = {r[0] for r in trees.listed(df, [("", ["*.log", "!keep.log"]), ("x/y", ["*.tmp", "!keep.tmp"])]).collect()}
    assert got == {"x/keep.log", "y/z.tmp", "src/m.py", "x/y/keep.tmp"}
    assert {r[0] for r in trees.listed(df, allow=["*.py"]).collect()} == {"src/m.py"} and ".env" in {r[0] for r in trees.listed(df, secrets=True).collect()}


def test_placeholders(spark):
    df = spark.createDataFrame([("a/b.txt", 3, b"x\r\ny"), ("c", 200_000, b"x"), ("d", 2048, b"\x00\x01"), ("e", 0, None)], "path string, length long, content binary")
    got = {r["path"]: (r["depth"], r["content"]) for r in trees.placeholders(df).collect()}
    assert got == {"a/b.txt": (2, "x\ny"), "c": (1, "<too large: 195.3 KB>"), "d": (1, "<binary: 2.0 KB>"), "e": (1, "<unreadable>")}


def test_versions_diff_and_revert(spark):
    rng = random.Random(3)
    data = []
    for i in range(30):
        old = [f"l{rng.randrange(8)}" for _ in range(rng.randrange(12))]
        new = [x for x in old if rng.random() > 0.3] + [f"n{rng.randrange(4)}" for _ in range(rng.randrange(3))]
        data.append((f"p{i}", "\n".join(old), "\n".join(new)))
    v = spark.createDataFrame(data, "path string, old string, new string")
    back = {r["path"]: r["old"] for r in diffs.reverted(v.select("path", F.col("new").alias("content")), diffs.version_hunks(v)).collect()}
    assert back == {p: o for p, o, _ in data}
    text = {r["path"]: r["diff"] for r in diffs.unified_diffs(spark.createDataFrame([("a", "", "x"), ("b", "x", ""), ("c", "x", "x")], "path string, old string, new string")).collect()}
    assert text["a"].startswith("--- /dev/null\n+++ b/a") and "+++ /dev/null" in text["b"] and text["c"] == ""


def test_adapters(spark):
    a = adapters.adapt(spark.createDataFrame([("t1", "git@h.example:o/n.git", "diff --git a/x.py b/x.py\n", "PY")], "task_id string, repository string, patch string, lang string"), "bench")
    b = adapters.adapt(spark.createDataFrame([("bench::t1", "https://h.example/o/n", None), ("t2", None, None)], "id string, repo string, gold_patch string"), "bench")
    got = {r["instance_id"]: r for r in adapters.pooled([a, b]).collect()}
    assert set(got) == {"bench::t1", "bench::t2"} and got["bench::t1"]["repo"] == "o/n" and got["bench::t1"]["gold_files"] == ["x.py"] and got["bench::t1"]["language"] == "py" and got["bench::t2"]["gold_files"] == []


def test_token_table_is_kept_and_evicted(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alpha beta alpha"), (3, None), (4, "")], "id long, t string")
    want = [(1, "alpha", 2), (1, "beta", 1), (2, "alpha", 2), (2, "beta", 1)]
    assert rows(tokens.token_table(df, "id", "t", 3, folder)) == want and rows(tokens.token_table(df, "id", "t", 3, folder)) == want
    assert tokens.held(spark, folder).count() == 2
    more = df.unionByName(spark.createDataFrame([(5, "gamma delta epsilon")], "id long, t string"))
    assert tokens.token_table(more, "id", "t", 3, folder).count() == 7 and tokens.held(spark, folder).count() == 5
    assert tokens.evict(spark, folder, 4) == 3 and {r["term"] for r in tokens.held(spark, folder).collect()} == {"gamma", "delta", "epsilon"}


def test_documents_parse(spark, tmp_path):
    frags = spark.createDataFrame([('a "b"/c.py', 1, 2, "x: 1\n\ty\n"), ("z.py", 3, 3, "\u2028 odd"), ("e.py", 1, 1, "")], "path string, start_line int, end_line int, content string")
    yaml = "\n".join(r["block"] for r in documents.yaml(frags).orderBy("path").collect())
    paths = [line[len("- path: "):] for line in yaml.split("\n") if line.startswith("- path: ")]
    assert [json.loads(p) for p in paths] == ['a "b"/c.py', "e.py", "z.py"]
    assert {json.loads(r["block"])["content"] for r in documents.json_items(frags).collect()} == {"x: 1\n\ty\n", "\u2028 odd", ""}
    assert "a \"b\"/c.py:1-2\n  x: 1\n" in documents.text(frags).filter("end_line = 2" if "end_line" in documents.text(frags).columns else "start_line = 1").orderBy("path").first()["block"]
    edges = spark.createDataFrame([(1, 2, 0.5, "semantic"), (2, 1, 0.25, "x")], "src long, dst long, weight double, category string")
    nodes = spark.createDataFrame([(1, "f", "function"), (2, "g", None)], "id long, file string, kind string")
    path = str(tmp_path / "graph.json")
    files.write_document(graphs.json_document(nodes, edges), path, ("ord", "key"))
    doc = json.load(open(path))
    assert doc["summary"] == {"nodes": 2, "edges": 2} and len(doc["nodes"]) == 2 and doc["edges"][0]["source"] == "1"


def test_atomic_write_leaves_what_was_there(tmp_path):
    path = tmp_path / "x"
    files.write_atomically(str(path), ["a", "b"])

    def broken():
        yield "c"
        raise ValueError

    with pytest.raises(ValueError):
        files.write_atomically(str(path), broken())
    assert path.read_text() == "a\nb\n" and [p.name for p in tmp_path.iterdir()] == ["x"]
    p = files.Phases("r")
    with p.phase("scan"):
        pass
    assert set(json.loads(p.line())["phases_ms"]) == {"scan"}


# Ranks and percentiles ----------------------------------------------------------------------------


def test_percentiles_and_ranks_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    data = [("a", float(x)) for x in rng.lognormal(size=5000)] + [("b", float(x)) for x in rng.integers(0, 4, size=3000)] + [("c", 1.5), (None, 2.0), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double")
    qs = (0.0, 0.25, 0.5, 0.99, 1.0)
    for interpolate in (True, False):
        got = {r["g"]: r for r in order.percentiles(df, "g", "v", qs, interpolate).collect()}
        assert set(got) == {"a", "b", "c", None}
        for g in got:
            x = np.sort([v for k, v in data if k == g and v is not None])
            for i, q in enumerate(qs):
                want = np.quantile(x, q) if interpolate else x[max(int(np.ceil(q * len(x))) - 1, 0)]
                assert got[g][f"q{i}"] == pytest.approx(want), (g, q)
    scores = spark.createDataFrame([(q, d, float((d * 7) % 5)) for q in range(2) for d in range(400)], "query int, doc int, score double")
    ranks = ranking.ranked(scores).collect()
    for q in range(2):
        mine = sorted((r for r in ranks if r["query"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 401)) and mine == sorted(mine, key=lambda r: (-r["score"], r["doc"]))


def test_packing_equals_the_walk(spark, monkeypatch):
    monkeypatch.setattr(selection, "ROUND", 7)
    rng = random.Random(8)
    data = [(q, d, rng.choice([0.0, 1.0, 2.5, 3.0]), rng.choice([1, 5, 40, 90, 300])) for q in range(3) for d in range(200)]
    got = {}
    for r in sorted(selection.greedy_pack(spark.createDataFrame(data, "query int, doc long, score double, cost long"), 500).collect(), key=lambda r: (r["query"], r["pick"])):
        got.setdefault(r["query"], []).append((r["doc"], r["used_tokens"]))
    for q in range(3):
        used, want = 0, []
        for _, d, s, c in sorted((x for x in data if x[0] == q and x[2] > 0), key=lambda x: (-x[2], x[1])):
            if used + c <= 500:
                used += c
                want.append((d, used))
        assert got[q] == want


def test_boltzmann_of_contenders_equals_that_of_all(spark):
    rng = random.Random(9)
    data = [(1, d, rng.choice([0.5, 1.0, 2.0]) * rng.random(), rng.randrange(30, 200)) for d in range(600)]
    items = [(d, c, s) for _, d, s, c in data]
    beta = selection.calibrate_beta(items, 900)
    got = [r["doc"] for r in sorted(selection.boltzmann_select(spark.createDataFrame(data, "query int, doc long, score double, cost long"), 900).collect(), key=lambda r: r["pick"])]
    assert got == selection.boltzmann(items, 900, beta)
    assert selection.boltzmann([(1, 10, 1.0, "f", 1, 9), (2, 5, 5.0, "f", 5, 6), (3, 5, 0.5, "g", 5, 6)], 100, 0.0, core=[1]) == [1, 3]


# Fragments, cores, needs ----------------------------------------------------------------------------


def test_strategies_and_gaps():
    python = "import os\n\n@wrap\ndef f(a,\n      b={}):\n    return a\n\nclass K:\n    def m(self):\n        pass\n"
    strategy, spans = D.fragment(python, "a.py")
    assert strategy == "definitions" and ("function", "f", 3, 6) in spans and ("class", "K", 8, 10) in spans and ("function", "m", 9, 10) in spans and ("chunk", None, 1, 1) in spans
    go = "package x\n\nfunc (s *T) Run(a int) error {\n\tif a > 0 {\n\t\treturn nil // }\n\t}\n\treturn nil\n}\n\ntype T struct {\n\ta int\n}\n"
    strategy, spans = D.fragment(go, "a.go")
    assert strategy == "definitions" and ("function", "Run", 3, 8) in spans and ("type", "T", 10, 12) in spans
    assert D.fragment("intro\n# One\na\n\n## Two\nb\n", "a.md") == ("markdown", [("section", "One", 2, 3), ("section", "Two", 5, 6)])
    assert D.fragment("[a]\nx=1\n\n[b]\ny=2\n", "a.toml")[1] == [("section", "a", 1, 2), ("section", "b", 4, 5)] and D.fragment("x=1\n[b]\n", "a.toml")[1] == [("chunk", None, 1, 2)]
    assert D.fragment("\n".join(f"l{i}" for i in range(450)), "a.txt")[1] == [("chunk", None, 1, 200), ("chunk", None, 201, 400), ("chunk", None, 401, 450)]
    assert D.fragment("def broken(:\n  x\n", "a.py")[0] == "gaps" and D.fragment(" \n\n", "a.py") == ("none", []) and D.fragment("", "") == ("none", [])


def test_gap_split_covers_every_line_once():
    lines = ["" if i % 13 == 7 else f"l{i}" for i in range(300)]
    got = D.split_gap(lines, 1, 300)
    assert got[0][0] == 1 and got[-1][1] == 300 and all(b + 1 == c for (_, b), (c, _) in zip(got, got[1:])) and all(b - a + 1 <= 30 for a, b in got)
    assert D.split_gap(lines, 5, 34) == [(5, 34)]


def test_signatures_and_excerpts():
    assert D.signature_end(["@a(", "  1)", "def f(x={},", "      y=1):", "    pass"]) == 4
    assert D.signature_end(["class K {", "}"]) == 1 and D.signature_end(["x", "y", "z"]) == 2 and D.signature_end(["fn f(a: &str) {", "  x", "}"]) == 1
    assert D.excerpt(1, 100, [(50, 52)]) == [(47, 55)] and D.excerpt(1, 10, [(5, 5)]) == [] and D.excerpt(1, 20, [(2, 19)]) == []
    assert D.excerpt(1, 100, [(5, 5), (95, 95)]) == [(2, 8), (92, 98)]
    assert D.rendered([f"l{i}" for i in range(1, 101)], [(2, 3), (8, 9)], 1) == "l2\nl3\n… [4 unchanged lines]\nl8\nl9"


def test_fragment_files_gives_heads(spark):
    df = spark.createDataFrame([("r:a.py", "a.py", "def f(a,\n  b):\n    x = 1\n    y = 2\n    return x\n"), ("r:n", "n.py", None), ("r:e", "e.py", "")], "file string, path string, content string")
    assert rows(D.fragment_files(df)) == [("r:a.py", "definitions", "function", "f", 1, 5, 2)]


def test_cores_against_brute_force(spark):
    rng = random.Random(6)
    spans, hunks, at = [], [], 1
    for i in range(40):
        end = at + rng.randrange(0, 12)
        spans.append((i, "f", rng.choice(["function", "chunk", "class"]), at, end))
        if rng.random() < 0.4:
            spans.append((100 + i, "f", rng.choice(["function", "chunk"]), at, max(at, end - rng.randrange(0, 3))))
        at = end + rng.randrange(1, 9)
    for i in range(60):
        a = rng.randrange(1, at + 9)
        hunks.append((i, "f", a, a + rng.randrange(0, 6)))
    s = spark.createDataFrame(spans, "id long, file string, kind string, start_line int, end_line int")
    h = spark.createDataFrame(hunks, "hunk long, file string, hs int, he int")
    got = {}
    for r in C.identify(s, h).collect():
        got.setdefault(r["hunk"], {})[r["core"]] = r["tier"]
    for i, _, a, b in hunks:
        cover = [x for x in spans if x[3] <= a and b <= x[4]]
        over = [x for x in spans if x[3] <= b and x[4] >= a]
        if cover:
            want = {min(cover, key=lambda x: (x[2] not in C.SEMANTIC, x[4] - x[3], x[3], x[0]))[0]}
        elif over:
            want = {x[0] for x in over}
        else:
            before, after = [x for x in spans if x[4] < a], [x for x in spans if x[3] > b]
            want = ({max(before, key=lambda x: (x[4], -x[3], -x[0]))[0]} if before else set()) | ({min(after, key=lambda x: (x[3], x[4], x[0]))[0]} if after else set())
        by_id = {x[0]: x for x in spans}
        boxes = {x[0] for x in spans if x[2] in C.CONTAINERS and any(x[0] != c and x[3] <= by_id[c][3] and by_id[c][4] <= x[4] for c in want)}
        assert set(got[i]) == want | boxes, i


def test_needs_of_a_change(spark):
    text = "from .local import helper as h\nfrom typing import Optional\n# comment_call()\ndef run(x: Optional[int]) -> Thing:\n    assert(limit)\n    return compute(x)\n"
    df = spark.createDataFrame([(1, "r:a.py", "a.py", "Run", text), (2, "r:b.py", "b.py", None, ""), (3, "r:c.py", "c.py", None, "plain words only"), (4, "r:d.py", "d.py", None, None)], "query long, file string, path string, symbol string, changed string")
    got = {(r["query"], r["need_type"], r["symbol"]): (r["scope"], r["priority"]) for r in needs.extract(df).collect()}
    assert got[1, "impact", "run"] == ("r:a.py", 0.8) and got[1, "definition", "compute"] == (None, 1.0) and got[1, "definition", "helper"] == (None, 0.9) and got[1, "signature", "thing"] == (None, 0.7) and got[1, "invariant", "limit"] == (None, 0.85)
    assert (1, "signature", "optional") not in got and not any(k[2] == "comment_call" and k[1] == "definition" for k in got)
    assert {k[1:] + v for k, v in got.items() if k[0] == 3} == {("definition", w, None, 0.5) for w in ("plain", "words", "only")} and not any(k[0] in (2, 4) for k in got)


def test_match_levels(spark):
    cases = [("impact", "a", "s", "a", "x", "function", True, 0.15), ("definition", None, "s", "b", "s", "function", True, 0.5), ("definition", "b", "s", "b", "s", "function", True, 1.0), ("definition", "a", "s", "b", "s", "function", True, 0.3), ("impact", "a", "s", "b", "x", "function", True, 0.8),
             ("signature", None, "s", "b", "s", "function_signature", True, 0.7), ("test", None, "s", "tests/b.py", "x", "function", True, 0.6), ("definition", None, "s", "b", "x", "function", True, 0.3), ("definition", None, "s", "b", None, None, False, 0.0)]
    df = spark.createDataFrame([c[:7] for c in cases], "t string, scope string, s string, file string, fs string, kind string, m boolean")
    got = [r[0] for r in df.select(needs.strength(F.col("t"), F.col("scope"), F.col("s"), F.col("file"), F.col("file"), F.col("fs"), F.col("kind"), F.col("m"))).collect()]
    assert got == [c[7] for c in cases]


# Edges --------------------------------------------------------------------------------------------


def sources(spark, items):
    return spark.createDataFrame([(i, "r", p, f"r:{p}", X.LANGUAGES.get(p.rpartition(".")[2]), c) for i, (p, c) in enumerate(items)], "id long, repo string, path string, file string, language string, content string")


def test_references_by_language(spark):
    items = [
        ("pkg/a.py", "from .b import f\nimport pkg.c.d\n"), ("pkg/b.py", ""), ("pkg/c/d.py", "from ..b import g"), ("web/a.ts", "import { x } from './lib';\nconst y = require('../web/c')"), ("web/lib/index.ts", ""), ("web/c.tsx", ""),
        ("src/a.c", '#include "inc/b.h"\n#include <stdio.h>\n'), ("src/inc/b.h", ""), ("run.sh", ". lib/env.sh\nbash tools/go.sh\n"), ("lib/env.sh", ""), ("tools/go.sh", ""), ("x/main.scss", "@use 'theme/colors';"), ("x/theme/colors.scss", ""),
        ("Dockerfile", "FROM base\nCOPY --chown=1 pkg/b.py /x\n"), (".github/workflows/ci.yml", "run: ./tools/go.sh\n"), ("m.rs", "mod walker;\nuse crate::token::X;\n"), ("walker.rs", ""), ("token.rs", ""), ("q/models/o.sql", "select * from {{ ref('stage_orders') }}"), ("q/stage_orders.sql", ""),
        ("api.yaml", "x:\n  $ref: 'schemas/user.yaml'\n"), ("schemas/user.yaml", ""), ("up.py", "from ...... import z"),
    ]
    got = {(r["src"][2:], r["dst"][2:]) for r in references.file_imports(sources(spark, items)).collect()}
    want = {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/c/d.py"), ("pkg/c/d.py", "pkg/b.py"), ("web/a.ts", "web/lib/index.ts"), ("web/a.ts", "web/c.tsx"), ("src/a.c", "src/inc/b.h"), ("run.sh", "lib/env.sh"), ("run.sh", "tools/go.sh"), ("x/main.scss", "x/theme/colors.scss"),
            ("Dockerfile", "pkg/b.py"), (".github/workflows/ci.yml", "tools/go.sh"), ("m.rs", "walker.rs"), ("m.rs", "token.rs"), ("q/models/o.sql", "q/stage_orders.sql"), ("api.yaml", "schemas/user.yaml")}
    assert got == want
    edges = {(r["src"], r["dst"]): r["weight"] for r in references.import_edges(sources(spark, items)).collect()}
    assert edges["r:pkg/a.py", "r:pkg/b.py"] == 0.75 and edges["r:pkg/b.py", "r:pkg/a.py"] == pytest.approx(0.375)


def test_names_are_confirmed_by_imports(spark):
    defs = spark.createDataFrame([("f", 1, "b"), ("f", 2, "c")], "name string, node long, file string")
    uses = spark.createDataFrame([("f", 9, "a"), ("f", 8, "c"), ("f", 1, "b")], "name string, node long, file string")
    got = {(r["src"], r["dst"]): round(r["weight"], 4) for r in references.confirmed_links(defs, uses, spark.createDataFrame([("a", "b")], "src string, dst string"), 0.5, 0.4).collect()}
    assert got == {(9, 1): 0.75, (1, 9): 0.3, (9, 2): 0.1, (2, 9): 0.04, (8, 2): 0.5, (2, 8): 0.2, (8, 1): 0.1, (1, 8): 0.04}


def test_typed_keys_and_kubernetes(spark):
    items = [(".env", "DATABASE_URL=x\n"), ("a.py", "os.environ['DATABASE_URL']"), ("b.sql", "create table users (id int)"), ("c.py", 'q = "select 1 from users"'), ("k/deploy.yaml", "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: web\n  labels:\n    app: web\nspec:\n  envFrom:\n  - configMapRef:\n      name: settings\n"),
             ("k/cm.yaml", "apiVersion: v1\nkind: ConfigMap\nmetadata:\n  name: settings\n---\napiVersion: v1\nkind: Service\nmetadata:\n  name: front\nspec:\n  selector:\n    app: web\n")]
    f = sources(spark, items)
    got = {(r["kind"], r["key"], r["a"], r["b"]) for r in keys.typed_links(f).collect()}
    assert got == {("env", "database_url", 0, 1), ("table", "users", 2, 3)}
    assert keys.typed_links(f, spark.createDataFrame([(3,)], "id long")).count() == 1
    assert rows(keys.kubernetes_links(f)) == [(4, 5, "configmap"), (5, 4, "selector")]
    assert {(r["src"], r["dst"]): r["weight"] for r in keys.kubernetes_edges(f).collect()}[4, 5] == 0.7


def test_boundary_filters(spark):
    edges = spark.createDataFrame([("d/a", "e/hub", 0.5, "semantic"), ("x/p.py", "e/hub", 0.5, "semantic"), ("y/q.py", "e/hub", 0.5, "semantic"), ("d/near.py", "e/hub", 0.5, "semantic"), ("d/a", "z/key.py", 0.3, "key_match"), ("d/a", "z/two.py", 0.3, "key_match"), ("z/two.py", "d/a", 0.2, "semantic")], "src string, dst string, weight double, category string")
    changed = spark.createDataFrame([("d/a",)], "file string")
    assert rows(FL.hub_noise(edges, changed)) == [("x/p.py",), ("y/q.py",)] and rows(FL.generic_only(edges, changed)) == [("z/key.py",)]
    kept, cover = FL.capped_contributions(edges, 3)
    assert kept.count() == 3 and rows(cover) == [(7, 3, True)] and rows(FL.capped_contributions(edges, 99)[1]) == [(7, 7, False)]


# Impact and scores ----------------------------------------------------------------------------------


def test_facts_by_language():
    py = impact.python_facts("from a.b import c as d, e\nfrom z import *\nimport sys\nsys.path.insert(0, 'lib')\nclass K(Base):\n    def m(self): return d(e.x())\nf = K\n__all__ = ['K']\ngetattr(x, y)\n")
    assert {("import", "d", "a.b.c", 1), ("star", "z", "z", 2), ("def", "K", None, 5), ("base", "Base", "K", 5), ("use", "d", "d", 6), ("use", "x", "e.x", 6), ("alias", "f", "K", 7), ("export", "K", None, 8), ("root", "sys.path", "lib", 4), ("unresolved", "dynamic:getattr", None, 9)} <= set(py)
    assert impact.python_facts("def (") == [("unresolved", "syntax", None, 1)]
    sql = impact.sql_facts("-- create table no\ncreate or replace function s.run(a int) returns int as $$ select go(a) from s.items where n = 'from x' $$;\ncall s.run(1);\ncreate view v as select * from \"Items\" join t2 on true;")
    assert {("def", "run", "s", 2), ("use", "go", None, 2), ("use", "items", "s", 2), ("use", "run", "s", 3), ("def", "v", None, 4), ("use", "items", None, 4), ("use", "t2", None, 4)} <= set(sql) and not any(x[1] == "no" for x in sql) and not any(x[1] == "x" for x in sql)
    sh = impact.text_facts("build() {\n  make all\n}\nsource ./env.sh\nbuild && deploy x\n", "a.sh")
    assert {("def", "build", None, 1), ("import", "sh", "./env.sh", 4), ("use", "build", None, 5), ("use", "deploy", None, 5)} <= set(sh)
    ts = impact.text_facts("import { a } from './x';\nexport class K extends Base {\n}\nconst f = (q) => a(q)\n", "a.ts")
    assert {("def", "K", None, 2), ("base", "Base", "K", 2), ("def", "f", None, 4), ("use", "a", None, 4)} <= set(ts)
    assert impact.text_facts("x", "a.cob") == [("unresolved", "not modelled:cob", None, 1)]


def test_callers_tests_and_overlay(spark):
    items = [("src/core.py", "def compute(x):\n    return x\n"), ("src/use.py", "from src.core import compute as c\ndef outer():\n    return c(1)\n"), ("tests/test_use.py", "from src.use import outer\ndef test_outer():\n    outer()\n"), ("src/other.py", "def other(): pass\n"), ("bad.py", "def (")]
    f = sources(spark, items)
    fact = impact.facts(f)
    changed = spark.createDataFrame([("r:src/core.py",)], "file string")
    assert rows(impact.callers(fact, changed)) == [("compute", "r:src/use.py", 3, False)]
    assert rows(impact.reaching_tests(fact, changed)) == [("r:tests/test_use.py", 2)]
    after = impact.facts(sources(spark, [("src/core.py", "def renamed(x): pass\n")]))
    assert rows(impact.removals(fact, impact.overlay(fact, after))) == [("compute", "r:src/core.py")]
    assert rows(impact.coverage(fact, f)) == [("grammar", 5, 1)]
    doc = json.loads(documents.impact_document(impact.callers(fact, changed), impact.reaching_tests(fact, changed), impact.coverage(fact, f)).first()["document"])
    assert doc["schema"] == "impact.v1" and not doc["empty"] and doc["totals"] == {"n_callers": 1, "n_tests": 1} and doc["coverage"][0]["unresolved"] == 1


def test_scores(spark):
    rng = random.Random(2)
    sel, gold = [], []
    for k in range(12):
        for side in (sel, gold):
            for _ in range(rng.randrange(0 if side is sel else 1, 4)):
                a = rng.randrange(1, 40)
                side.append((k, a, a + rng.randrange(0, 9)))
    got = {r["k"]: r for r in EV.line_scores(spark.createDataFrame(sel, "k int, s int, e int"), spark.createDataFrame(gold, "k int, s int, e int"), "k").collect()}
    for k in range(12):
        S, G = {n for q, a, b in sel if q == k for n in range(a, b + 1)}, {n for q, a, b in gold if q == k for n in range(a, b + 1)}
        assert got[k]["line_recall"] == pytest.approx(len(S & G) / len(G), abs=1e-6) and (got[k]["line_precision"] is None if not S else got[k]["line_precision"] == pytest.approx(len(S & G) / len(S), abs=1e-6))
    df = spark.createDataFrame([(["a", "b", "x"], ["a", "b", "c", "d"], ["x", "y"])], "sel array<string>, req array<string>, forb array<string>")
    assert tuple(df.select(EV.oracle_score(F.col("sel"), F.col("req"), F.col("forb")), EV.real_world_score(F.col("sel"), F.col("req"), F.col("forb"))).first()) == pytest.approx((25.0, 100 * 0.5 * 2 / 3))
    pairs = spark.createDataFrame([("g", 1.0, 0.5)] * 30 + [("g", 0.5, 1.0)] * 5 + [("h", 1.0, 1.0), ("h", None, 1.0)], "grp string, a double, b double")
    boot = {r["grp"]: r for r in EV.paired_bootstrap(pairs, "grp", "a", "b").collect()}
    assert boot["g"]["low"] > 0 and boot["g"]["p"] < 0.01 and boot["h"]["n"] == 1 and boot["h"]["p"] == 1.0


def test_scalar_functions(spark):
    assert X.fnv1a64("") == 0xCBF29CE484222325 and X.fnv1a64("a") == 0xAF63DC4C8601EC8C
    df = spark.createDataFrame([(1234567, 999, 1536)], "a long, b long, c long")
    assert tuple(df.select(X.grouped_thousands(F.col("a")), X.grouped_thousands(F.col("b")), X.human_size(F.col("c"))).first()) == ("1,234,567", "999", "1.5 KB")
