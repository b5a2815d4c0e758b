"""The engine as functions over a corpus and a change: context, locate and impact documents, a project's graph, a tree.

A corpus is a DataFrame ``path, content`` of the files after the change, a change the text of a unified
diff.  The heavy part (fragments, edges, scores) makes a ``State`` that is kept in the shared folder;
selections with other budgets or thresholds are taken from it without doing that work again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import cores as C
from weftline.operators import definitions as D
from weftline.operators import edges as E
from weftline.operators import graph as G
from weftline.operators import impact, needs, ranking, references, selection
from weftline.runtime import cut
from weftline.sinks import documents
from weftline.sources import diffs, trees

SCORING = ("ego", "ppr", "bm25", "rrf", "pit")
#: Tokens of a document's envelope and of each entry, what an unlimited budget is, and above how many fragments costly edges are left out.
ENVELOPE, ENTRY, UNLIMITED, EXPENSIVE = 24, 4, 10_000_000, 2_000
CHANGE = "change"


@dataclass
class State:
    """What a change looks like: fragments, edges, cores, scores, needs and their matches."""

    fragments: DataFrame
    hunks: DataFrame
    edges: DataFrame
    cores: DataFrame
    scores: DataFrame
    matches: DataFrame
    files: DataFrame
    scoring: str


def fragments_of(files: DataFrame) -> DataFrame:
    """``id, repo, path, file, kind, symbol, start_line, end_line, content, identifiers, tokens, language``."""
    f = files.select(F.col("path").alias("file"), "path", "content")
    cut_up = D.fragment_files(f).join(files.select(F.col("path").alias("file"), "content"), "file")
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    rows = cut_up.withColumn("content", body).select(
        F.xxhash64("file", "start_line", "end_line", "kind", "symbol").alias("id"), F.lit("").alias("repo"), F.col("file").alias("path"), "file", "kind", "symbol", "start_line", "end_line", "content",
        F.array_distinct(X.identifiers(F.col("content"))).alias("identifiers"), X.token_cost(F.col("content")).alias("tokens"), X.language(F.col("file")).alias("language"),
    )
    return rows.dropDuplicates(["id"])


def project_edges(frags: DataFrame) -> DataFrame:
    """All edges of a project's fragments, the strongest of each pair; the costly ones only up to EXPENSIVE fragments.

    File-level edges are laid between the first fragments of the files.
    """
    spans = frags.select("id", "file", "start_line", "end_line")
    first = frags.groupBy("file").agg(F.min_by("id", F.struct("start_line", "id")).alias("id"))
    a, b = first.select(F.col("file").alias("src"), F.col("id").alias("s")), first.select(F.col("file").alias("dst"), F.col("id").alias("d"))
    lifted = lambda e: e.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight", "category")
    files = frags.select("repo", "path", "file").distinct()
    defs = frags.filter("symbol is not null").select(F.lower("symbol").alias("name"), F.col("id").alias("node"), "file")
    uses = frags.select("id", "file", F.explode("identifiers").alias("name")).select("name", F.col("id").alias("node"), "file")
    imports = references.file_imports(frags.select("repo", "path", "file", "language", "content"))
    edges = E.containment(spans).unionByName(E.adjacency(frags)).unionByName(references.confirmed_links(defs, uses, imports, 0.55, 0.40)).unionByName(lifted(references.import_edges(frags.select("repo", "path", "file", "language", "content"))))
    edges = edges.unionByName(lifted(E.siblings(files.select(X.directory(F.col("path")).alias("dir"), F.col("file").alias("node"))))).unionByName(lifted(E.test_links(files)))
    if frags.count() <= EXPENSIVE:
        words = ranking.tokens(frags, "id", "content")
        similar = E.lexical(words, frags.count()).select("src", "dst", F.round(F.col("sim") * 0.15, 5).alias("weight"), F.lit("similarity").alias("category"))
        edges = edges.unionByName(similar)
    return E.merged(edges)


def scored_state(files: DataFrame, diff: str, scoring: str = "ego", alpha: float = 0.60) -> State:
    """The heavy part: everything up to scores and matches, written to the shared folder."""
    if scoring not in SCORING:
        raise ValueError(f"scoring is one of {', '.join(SCORING)}")
    spark = files.sparkSession
    frags = cut(fragments_of(files))
    runs = [(i, path, max(s, 1), max(s, 1) + max(n, 1) - 1) for i, (path, _, _, s, n, *_) in enumerate(diffs.parse_patch(diff))]
    hunks = spark.createDataFrame(runs, "hunk long, file string, hs int, he int")
    cores = cut(C.identify(frags, hunks).select("core").distinct())
    edges = cut(project_edges(frags))
    seeds = cores.select(F.col("core").alias("node"))
    changed = "\n".join(x for *_, gone, came in diffs.parse_patch(diff) for x in (*gone, *came))
    text = spark.createDataFrame([(CHANGE, changed)], "query string, text string")

    def structural() -> DataFrame:
        if scoring == "ppr":
            mass = C.seed_weights(frags, hunks, cores)
            total = mass.agg(F.sum("seed").alias("t"))
            return G.pagerank(edges, cut(mass.join(F.broadcast(total)).select(F.col("core").alias("node"), (F.col("seed") / F.col("t")).alias("mass"))), alpha=alpha, tolerance=1e-4)
        return G.ego(edges, seeds)

    as_scores = lambda df: df.select(F.lit(CHANGE).alias("query"), F.col("node").alias("doc"), "score")
    if scoring in ("ego", "ppr"):
        scores = as_scores(structural())
    else:
        words = ranking.tokens(text, "query", "text").select(F.col("doc").alias("query"), "term")
        lexical = cut(ranking.bm25(ranking.tokens(frags, "id", "content"), words))
        scores = lexical if scoring == "bm25" else (ranking.rrf if scoring == "rrf" else ranking.pit)(cut(as_scores(structural())), lexical)
    first = frags.join(cores.withColumnRenamed("core", "id"), "id").groupBy("file", "path").agg(F.min("symbol").alias("symbol"))
    changes = first.select(F.lit(CHANGE).alias("query"), "file", "path", "symbol").withColumn("changed", F.lit(changed))
    wanted = cut(needs.extract(changes))
    wanted = wanted.unionByName(needs.test_needs(wanted, frags)).withColumn("repo", F.lit(""))
    matches = cut(needs.matches(wanted, frags.select("id", "repo", "file", "path", "kind", "symbol", "identifiers")))
    return State(frags, hunks, edges, cores, cut(scores), matches, files.select("path", "content"), scoring)


def budget_of(state: State, budget: int | None) -> int:
    """Tokens of a document: as given, unlimited below 0, else from the clamped size of the cores."""
    if budget is not None:
        return UNLIMITED if budget < 0 else budget
    core = state.fragments.join(state.cores.withColumnRenamed("core", "id"), "id").agg(F.sum(F.least("tokens", F.lit(selection.CORE_CLAMP)))).first()[0] or 0
    return min(max(selection.BUDGET_FACTOR * int(core), selection.BUDGET_LOW), selection.BUDGET_HIGH)


def select(state: State, budget: int | None = None, full: bool = False) -> DataFrame:
    """The light part: ``pick, id, used_tokens`` under a budget, the envelope charged first.

    ``full`` takes every fragment of the changed files and nothing else.
    """
    changed = state.hunks.select("file").distinct()
    if full:
        rows = state.fragments.join(changed, "file", "left_semi").orderBy("file", "start_line", "id")
        return rows.select((F.monotonically_increasing_id() + 1).cast("int").alias("pick"), "id", F.lit(0).cast("long").alias("used_tokens"))
    left = budget_of(state, budget) - ENVELOPE - ENTRY * changed.count()
    rel = state.scores.select(F.col("doc").alias("id"), F.col("score").alias("rel"))
    core = state.cores.select(F.col("core").alias("id"), F.lit(True).alias("core"))
    items = state.fragments.join(rel, "id", "left").join(core, "id", "left").select(
        F.lit(CHANGE).alias("query"), "id", "file", "start_line", "end_line", "tokens", F.coalesce("rel", F.lit(0.0)).alias("rel"), F.coalesce("core", F.lit(False)).alias("core")
    ).filter("core or rel > 0")
    served = state.matches.select("query", "id", F.concat_ws(":", "need_type", "symbol").alias("need"), "priority", "strength")
    return selection.submodular_select(items, served, max(left, 0)).select("pick", "id", "used_tokens")


def build_context(files: DataFrame, diff: str, name: str = "project", budget: int | None = None, scoring: str = "ego", full: bool = False, content: bool = True) -> str:
    """The context document of a change as JSON; a changed path is always named, whatever the budget."""
    state = scored_state(files, diff, scoring)
    return render_context(state, select(state, budget, full), name, content)


def render_context(state: State, picked: DataFrame, name: str, content: bool = True) -> str:
    rows = picked.join(state.fragments, "id").orderBy("pick").select("pick", "path", "start_line", "end_line", "kind", "symbol", "content", "used_tokens").collect()
    items = [{"path": r["path"], "lines": f"{r['start_line']}-{r['end_line']}", "kind": r["kind"], **({"symbol": r["symbol"]} if r["symbol"] else {}), **({"content": r["content"]} if content else {})} for r in rows]
    files = sorted(r[0] for r in state.hunks.select("file").distinct().collect())
    total = state.fragments.count()
    return json.dumps({"schema": "context.v1", "name": name, "type": "context", "changed_files": files, "fragment_count": len(items), "fragments": items, "provenance": {"scoring": state.scoring}, "coverage": {"fragments": total, "selected": len(items), "used_tokens": max((r["used_tokens"] for r in rows), default=0)}})


def build_locate(files: DataFrame, diff: str, name: str = "project", budget: int | None = None, scoring: str = "ego", most: int = 50) -> str:
    """The ranked list of what matters beside the selection, with its true number."""
    state = scored_state(files, diff, scoring)
    picked = select(state, budget)
    open_rows = state.scores.filter("score > 0").join(picked.select(F.col("id").alias("doc")), "doc", "left_anti")
    total = open_rows.count()
    where = state.fragments.select(F.col("id").alias("doc"), "path", "start_line", "end_line", "symbol")
    rows = open_rows.orderBy(F.desc("score"), "doc").limit(most).join(where, "doc").orderBy(F.desc("score"), "path", "start_line").collect()
    items = [{"rank": k, "path": r["path"], "lines": f"{r['start_line']}-{r['end_line']}", "symbol": r["symbol"], "score": round(r["score"], 6), "confidence": round(min(r["score"], 0.999), 3)} for k, r in enumerate(rows, 1)]
    return json.dumps({"schema": "locate.v1", "name": name, "budget_tokens": budget_of(state, budget), "summary": {"selected": picked.count()}, "item_count": len(items), "items": items, "overflow": {"total": total, "shown": len(items)}, "coverage": {"fragments": state.fragments.count()}})


def build_impact(files: DataFrame, diff: str = "", name: str = "project", symbol: str | None = None) -> str:
    """Callers outside the change and the tests that reach it; with ``symbol`` those of one definition, without a change."""
    rows = files.select(F.col("path").alias("file"), "path", "content")
    facts = cut(impact.facts(rows))
    if symbol:
        path, _, bare = symbol.rpartition(":")
        hits = impact.symbol(facts, rows, bare)
        changed = hits.filter("fact = 'def'" + (f" and file = '{path}'" if path else "")).select("file").distinct()
        callers = hits.filter("fact <> 'def'").select(F.lit(bare).alias("name"), "file", "line", X.is_test(F.col("file")).alias("is_test"))
    else:
        changed = files.sparkSession.createDataFrame([(p,) for p in sorted({r[0] for r in diffs.parse_patch(diff)})], "file string")
        callers = impact.callers(facts, changed)
    doc = json.loads(documents.impact_document(callers, impact.reaching_tests(facts, changed), impact.coverage(facts, rows)).first()["document"])
    names = sorted(r[0] for r in changed.collect())
    return json.dumps(doc | {"name": name, "changed_files": names, "changed": names})


def map_directory(spark: SparkSession, root: str) -> DataFrame:
    """Every folder and file under a root, with depth, files and bytes."""
    return trees.directory_tree(trees.read_tree(spark, root, known_only=False).select("path", "size"))
