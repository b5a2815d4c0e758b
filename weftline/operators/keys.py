"""Links over shared keys: typed keys of deployment and code, Kubernetes objects, configuration names, language clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.edges import AMBIGUOUS, both_ways

# Weight and reverse factor per kind and strength of a typed key.
TYPED = {
    ("env", "strong"): (0.35, 0.50), ("image", "strong"): (0.35, 0.50), ("image", "weak"): (0.25, 0.50), ("route", "strong"): (0.35, 0.50), ("route", "prefix"): (0.35, 0.50), ("table", "strong"): (0.35, 0.50), ("proto", "strong"): (0.35, 0.50), ("proto", "weak"): (0.25, 0.50),
}
#: Kind, mechanism and pattern with one group of both sides of a key: what declares it and what refers to it.
KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("env", "declares", "env_file", r"(?m)^\s*(?:export\s+)?([A-Z][A-Z0-9_]{3,})="),
    ("env", "declares", "manifest", r"(?m)^\s*-?\s*name:\s*[\"']?([A-Z][A-Z0-9_]{3,})[\"']?\s*$"),
    ("env", "declares", "compose", r"(?m)^\s*-?\s*[\"']?([A-Z][A-Z0-9_]{3,})[\"']?\s*[:=]\s*\S"),
    ("env", "refers", "call", r"(?:environ(?:\.get)?[\[(]|getenv\(|env\.get\(|process\.env[.\[]|env::var\(|System\.getenv\(|os\.Getenv\()\s*[\"']?([A-Z][A-Z0-9_]{3,})"),
    ("env", "refers", "expansion", r"\$\{?([A-Z][A-Z0-9_]{3,})\b"),
    ("image", "declares", "build", r"(?m)^\s*image:\s*[\"']?([\w./-]+?)(?::[\w.-]+)?[\"']?\s*$"),
    ("image", "refers", "from", r"(?m)^\s*FROM\s+([\w./-]+)"),
    ("route", "declares", "handler", r"(?:\.(?:get|post|put|delete|patch|route|HandleFunc)|@(?:Get|Post|Put|Delete|Request)Mapping)\(\s*[\"'](/[\w/{}:.-]{2,})[\"']"),
    ("route", "refers", "client", r"(?:fetch|axios\.\w+|requests\.\w+|http\.\w+)\(\s*[\"'`](?:https?://[^/\"'`]+)?(/[\w/{}:.-]{2,})"),
    ("table", "declares", "ddl", r"(?i)\bcreate\s+(?:table|view)\s+(?:if\s+not\s+exists\s+)?(?:\w+\.)?(\w{3,})"),
    ("table", "declares", "model", r"__tablename__\s*=\s*[\"'](\w{3,})[\"']|@Table\(\s*name\s*=\s*[\"']\w{3,}[\"']"),
    ("table", "refers", "query", r"(?i)\b(?:from|join|into|update)\s+(?:\w+\.)?(\w{3,})"),
    ("proto", "declares", "message", r"(?m)^\s*(?:message|service|rpc)\s+(\w{3,})"),
    ("proto", "refers", "type", r"\b([A-Z]\w{2,}(?:Request|Response|Service|Client|Stub|Server))\b"),
)
STOP = ("name", "type", "value", "data", "test", "true", "false", "null", "none", "version", "default", "config", "file", "path", "item", "list", "string", "number", "select", "from", "where", "this", "self")


def typed_keys(frags: DataFrame, side: str) -> DataFrame:
    """``id, file, repo, kind, key, mechanism`` of one side of the table of keys."""
    rows = [r for r in KEYS if r[1] == side]
    found = F.flatten(F.array(*[F.transform(F.filter(F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(1))), lambda x: F.length(x) >= 3), _named(kind, mechanism)) for kind, _, mechanism, p in rows]))
    return frags.filter("content is not null and repo is not null").select("id", "file", "repo", F.explode(found).alias("k")).select("id", "file", "repo", "k.*").filter(~F.lower("key").isin(*STOP)).distinct()


def _named(kind: str, mechanism: str):  # noqa: ANN202
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("key"), F.lit(mechanism).alias("mechanism"))


def typed_links(frags: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``kind, strength, key, a, b, a_mechanism, b_mechanism``: declarers and referrers of one key in a repo, in two files.

    Keys declared in more than AMBIGUOUS files link nothing.  An image or message met by its last part only
    is weak.  With ``touched(id)`` only keys one of these fragments holds are linked.
    """
    d, u = typed_keys(frags, "declares"), typed_keys(frags, "refers")
    short = lambda df: df.withColumn("short", F.when(F.col("kind").isin("image", "proto"), F.regexp_replace(F.regexp_extract("key", r"([^/]+)$", 1), r"(request|response|service|client|stub|server)$", "")).otherwise(F.col("key"))).filter("short <> ''")
    d, u = short(d), short(u)
    if touched is not None:
        keys = d.unionByName(u).join(touched.select("id"), "id", "left_semi").select("repo", "kind", "short").distinct()
        d, u = d.join(keys, ["repo", "kind", "short"], "left_semi"), u.join(keys, ["repo", "kind", "short"], "left_semi")
    few = d.groupBy("repo", "kind", "short").agg(F.countDistinct("file").alias("n")).filter(F.col("n") <= AMBIGUOUS).select("repo", "kind", "short")
    left = d.join(few, ["repo", "kind", "short"]).select("repo", "kind", "short", "key", F.col("id").alias("a"), F.col("file").alias("fa"), F.col("mechanism").alias("a_mechanism"))
    right = u.select("repo", "kind", "short", F.col("key").alias("key_b"), F.col("id").alias("b"), F.col("file").alias("fb"), F.col("mechanism").alias("b_mechanism"))
    hits = left.join(right, ["repo", "kind", "short"]).filter("fa <> fb")
    strength = F.when(F.col("key") == F.col("key_b"), F.lit("strong")).otherwise(F.lit("weak"))
    return hits.select("kind", strength.alias("strength"), "key", "a", "b", "a_mechanism", "b_mechanism").distinct()


def typed_edges(links: DataFrame) -> DataFrame:
    """Edges of typed links by kind and strength, both ways."""
    weights = F.create_map(*[x for (k, s), (w, _) in TYPED.items() for x in (F.lit(f"{k}|{s}"), F.lit(w))])
    best = links.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.max(F.coalesce(F.try_element_at(weights, F.concat_ws("|", "kind", "strength")), F.lit(0.25))).alias("w"))
    return strongest(both_ways(best, F.col("w"), 0.50, "config"))


def strongest(edges: DataFrame) -> DataFrame:
    """One edge for each pair, the strongest of both directions' links."""
    return edges.groupBy("src", "dst", "category").agg(F.max("weight").alias("weight"))


# Weight per relation of Kubernetes objects, and their reverse factor.
KUBERNETES = {"configmap": 0.70, "secret": 0.70, "service": 0.60, "selector": 0.55}
KUBERNETES_REVERSE = 0.45


def kubernetes_links(frags: DataFrame) -> DataFrame:
    """``src, dst, relation``: manifests that name another object of their repo, and services with what their selector picks.

    A manifest is a text with ``apiVersion`` and ``kind``; documents of one file between ``---`` lines are
    read one by one.
    """
    docs = frags.filter("repo is not null and content is not null").filter(F.col("content").rlike(r"(?m)^apiVersion:")).select("id", "repo", F.explode(F.split("content", r"(?m)^---\s*$")).alias("d"))
    one = lambda p, k=1: F.regexp_extract("d", p, k)
    objects = docs.withColumn("kind", F.lower(one(r"(?m)^kind:\s*[\"']?(\w+)"))).withColumn("name", one(r"(?s)\bmetadata:\s*\n(?:\s+[^\n]*\n)*?\s+name:\s*[\"']?([\w.-]+)")).filter("kind <> '' and name <> ''")
    refs = F.array(
        *[F.transform(F.regexp_extract_all("d", F.lit(p), F.lit(1)), _relation(r)) for r, p in (
            ("configmap", r"configMap(?:KeyRef|Ref)?:\s*\n\s+(?:key:\s*\S+\s*\n\s+)?name:\s*[\"']?([\w.-]+)"), ("secret", r"secret(?:KeyRef|Ref)?:\s*\n\s+(?:key:\s*\S+\s*\n\s+)?(?:secretName|name):\s*[\"']?([\w.-]+)"), ("service", r"serviceName:\s*[\"']?([\w.-]+)"), ("service", r"(?m)\bservice:\s*\n\s+name:\s*[\"']?([\w.-]+)"),
        )]
    )
    used = objects.select("id", "repo", F.explode(F.flatten(refs)).alias("x")).select("id", "repo", "x.*").distinct()
    named = objects.select(F.col("id").alias("dst"), "repo", "kind", "name").distinct()
    direct = used.join(named, ["repo", "name"]).filter(F.col("relation") == F.col("kind")).filter("id <> dst").select(F.col("id").alias("src"), "dst", "relation")
    selector = objects.filter("kind = 'service'").select("id", "repo", F.regexp_extract("d", r"selector:\s*\n\s+([\w./-]+:\s*[\w.-]+)", 1).alias("label")).filter("label <> ''")
    labels = objects.filter("kind <> 'service'").select(F.col("id").alias("dst"), "repo", F.explode(F.array_distinct(F.regexp_extract_all("d", F.lit(r"labels:\s*\n\s+([\w./-]+:\s*[\w.-]+)"), F.lit(1)))).alias("label"))
    picked = selector.join(labels, ["repo", "label"]).filter("id <> dst").select(F.col("id").alias("src"), "dst", F.lit("selector").alias("relation"))
    return direct.unionByName(picked).distinct()


def _relation(r: str):  # noqa: ANN202
    return lambda x: F.struct(F.lit(r).alias("relation"), x.alias("name"))


def kubernetes_edges(frags: DataFrame) -> DataFrame:
    """The links by the weight of their relation, both ways."""
    weights = F.create_map(*[x for k, w in KUBERNETES.items() for x in (F.lit(k), F.lit(w))])
    best = kubernetes_links(frags).groupBy("src", "dst").agg(F.max(F.element_at(weights, F.col("relation"))).alias("w"))
    return strongest(both_ways(best, F.col("w"), KUBERNETES_REVERSE, "config"))


# Least and greatest lexical weight per language.
LEXICAL = {
    "python": (0.10, 0.20), "javascript": (0.10, 0.20), "jsx": (0.10, 0.20), "typescript": (0.10, 0.18), "tsx": (0.10, 0.18), "rust": (0.05, 0.10), "java": (0.05, 0.10), "kotlin": (0.05, 0.12), "scala": (0.05, 0.12), "go": (0.05, 0.12), "c": (0.08, 0.15),
    "cpp": (0.08, 0.15), "csharp": (0.05, 0.12), "fsharp": (0.05, 0.12), "ruby": (0.08, 0.15), "php": (0.08, 0.15), "shell": (0.10, 0.18), "swift": (0.05, 0.12),
}
LEXICAL_DEFAULT, LEXICAL_FLOOR, LEXICAL_BACK = (0.08, 0.15), 0.30, 0.50


def lexical_weight(sim: Column, a: Column, b: Column) -> Column:
    """Weight of a similarity: 0 below the floor, else between the larger bounds of both languages."""

    def bound(lang: Column, which: int) -> Column:
        rows = F.create_map(*[x for k, v in LEXICAL.items() for x in (F.lit(k), F.lit(v[which]))])
        return F.coalesce(F.try_element_at(rows, F.coalesce(lang, F.lit(""))), F.lit(LEXICAL_DEFAULT[which]))

    low, high = F.greatest(bound(a, 0), bound(b, 0)), F.greatest(bound(a, 1), bound(b, 1))
    # The bounds are decimals of two digits, and so is their distance: 0.15 - 0.08 is 0.07 and no double beside it.
    return F.when(sim < LEXICAL_FLOOR, F.lit(0.0)).otherwise(low + (sim - LEXICAL_FLOOR) / (1 - LEXICAL_FLOOR) * F.round(high - low, 2))


def config_keys(frags: DataFrame, config: Column, share: float = 0.25, least: int = 4) -> DataFrame:
    """``src, dst``: configuration fragments and the code that names their keys, in any spelling.

    A key is a canonical name of ``least`` characters that is no stop word; of a name in parts the whole
    counts, and of its parts those that no more than ``share`` of the configuration's keys hold.  Keys of
    more than AMBIGUOUS configuration or code files are dead.
    """
    words = frags.filter("language is not null").select("id", "file", config.alias("cfg"), F.explode("identifiers").alias("x")).select("id", "file", "cfg", X.canonical_key(F.col("x")).alias("name")).distinct()
    good = lambda c: (F.length(c) >= least) & ~F.col(c).isin(*STOP)
    cf, co = words.filter("cfg").filter(good("name")), words.filter("not cfg").filter(good("name"))
    parts = cf.select("id", "file", "name", F.explode(F.split("name", "_")).alias("part")).filter(good("part")).filter("part <> name")
    total = cf.select("name").distinct().agg(F.count("*").alias("total"))
    common = parts.select("name", "part").distinct().groupBy("part").agg(F.count("*").alias("n")).join(F.broadcast(total)).filter(F.col("n") <= share * F.col("total")).select("part")
    keys = cf.select("id", "file", "name").unionByName(parts.join(common, "part").select("id", "file", F.col("part").alias("name"))).distinct()
    few = lambda d: d.groupBy("name").agg(F.countDistinct("file").alias("n")).filter(F.col("n") <= AMBIGUOUS).select("name")
    a = keys.join(few(keys), "name").select("name", F.col("id").alias("src"))
    b = co.join(few(co), "name").select("name", F.col("id").alias("dst"))
    return a.join(b, "name").select("src", "dst").distinct()


def fallback(edges: DataFrame, others: DataFrame) -> DataFrame:
    """Edges of a fallback builder: only those whose two ends no other builder has an edge for."""
    linked = others.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    left = edges.join(linked.withColumnRenamed("node", "src"), "src", "left_anti")
    return left.join(linked.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)
