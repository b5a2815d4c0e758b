"""References between files as data: imports, includes, sources, build and deployment files.

A row is (flavour, role, weight, reverse factor, kind, pattern with one group, the reference).  The
flavour of a file is its language, or what its place and name make it.  Kinds: ``path`` is resolved
from the declaring folder, then from the root, with the flavour's endings; ``module`` is the same for
dotted names; ``name`` matches a file's stem, ``folder`` the files of a folder of that name.  What no
path answers falls back on the stem.  Names and folders of more than AMBIGUOUS files answer nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.edges import AMBIGUOUS, both_ways, pairs_of
from weftline.operators.links import resolved

# What makes a file more than its language, by path, first match counts.
FLAVOURS: tuple[tuple[str, str], ...] = (
    ("docker", r"(^|/)([\w.-]+\.)?Dockerfile(\.[\w.-]+)?$"),
    ("compose", r"(^|/)(docker-)?compose[\w.-]*\.ya?ml$"),
    ("ci", r"(^|/)\.github/workflows/|(^|/)\.gitlab-ci\.yml$|(^|/)Jenkinsfile$|(^|/)\.circleci/|(^|/)azure-pipelines\.yml$|(^|/)\.travis\.yml$"),
    ("make", r"(^|/)(GNU)?[Mm]akefile$|\.mk$"),
    ("cmake", r"(^|/)CMakeLists\.txt$|\.cmake$"),
    ("bazel", r"(^|/)(BUILD|WORKSPACE)(\.bazel)?$|\.bzl$"),
    ("cargo", r"(^|/)Cargo\.toml$"),
    ("ansible", r"(^|/)(roles|playbooks)/.*\.ya?ml$"),
    ("helm", r"(^|/)templates/.*\.(ya?ml|tpl)$"),
)
# Weight and reverse factor per role.
REFERENCES: tuple[tuple[str, str, float, float, str, str], ...] = (
    ("python", "from", 0.75, 0.50, "module", r"(?m)^\s*from\s+(\.*[A-Za-z_][\w.]*)\s+import\b"),
    ("python", "import", 0.75, 0.50, "module", r"(?m)^\s*import\s+([A-Za-z_][\w.]*)"),
    ("javascript", "import", 0.55, 0.50, "path", r"(?:from\s+|require\(\s*|import\s*\(?\s*)[\"'](\.{1,2}/[^\"']+)[\"']"),
    ("typescript", "import", 0.55, 0.50, "path", r"(?:from\s+|require\(\s*|import\s*\(?\s*)[\"'](\.{1,2}/[^\"']+)[\"']"),
    ("go", "import", 0.70, 0.40, "folder", r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([\w.-]+(?:/[\w.-]+)+)\"\s*$"),
    ("rust", "use", 0.65, 0.40, "name", r"(?m)^\s*(?:pub )?use (?:crate|super|self)::(\w+)"),
    ("rust", "mod", 0.70, 0.40, "name", r"(?m)^\s*(?:pub )?mod (\w+);"),
    ("java", "import", 0.75, 0.40, "name", r"(?m)^import (?:static )?[\w.]*?(\w+);"),
    ("kotlin", "import", 0.75, 0.40, "name", r"(?m)^import [\w.]*?(\w+)\s*$"),
    ("scala", "import", 0.75, 0.40, "name", r"(?m)^import [\w.]*?(\w+)\s*$"),
    ("c", "include", 0.65, 0.40, "path", r"(?m)^\s*#\s*include\s+\"([^\"\n]+)\""),
    ("cpp", "include", 0.65, 0.40, "path", r"(?m)^\s*#\s*include\s+\"([^\"\n]+)\""),
    ("csharp", "using", 0.65, 0.40, "name", r"(?m)^using [\w.]*?(\w+);"),
    ("dart", "import", 0.65, 0.40, "path", r"(?m)^(?:import|export|part) '([^'\n]+)'"),
    ("haskell", "import", 0.70, 0.40, "module", r"(?m)^import (?:qualified )?([A-Z][\w.]*)"),
    ("shell", "source", 0.60, 0.35, "path", r"(?m)^\s*(?:source|\.)\s+[\"']?([\w./-]+)"),
    ("shell", "script", 0.50, 0.35, "path", r"(?m)^\s*(?:bash|sh|exec)\s+[\"']?([\w./-]+\.(?:sh|bash|py))"),
    ("ruby", "require", 0.65, 0.40, "path", r"(?m)^\s*require(?:_relative)?\s*\(?[\"']([\w./-]+)[\"']"),
    ("php", "require", 0.60, 0.40, "path", r"(?m)^\s*(?:require|include)(?:_once)?\s*\(?\s*[\"']([\w./-]+)[\"']"),
    ("php", "use", 0.65, 0.40, "name", r"(?m)^use (?:\w+\\)*(\w+)"),
    ("swift", "import", 0.65, 0.40, "name", r"(?m)^import (\w+)"),
    ("elixir", "use", 0.65, 0.40, "name", r"(?m)^\s*(?:use|alias|import) (?:\w+\.)*(\w+)"),
    ("lua", "require", 0.65, 0.40, "module", r"\b(?:require|dofile)\s*\(?\s*[\"']([\w.]+)[\"']"),
    ("css", "import", 0.55, 0.40, "path", r"@(?:import|use|forward)\s+(?:url\(\s*)?[\"']([\w./-]+)[\"']"),
    ("scss", "import", 0.55, 0.40, "path", r"@(?:import|use|forward)\s+(?:url\(\s*)?[\"']([\w./-]+)[\"']"),
    ("protobuf", "import", 0.65, 0.40, "path", r"(?m)^import (?:public )?\"([^\"\n]+)\""),
    ("latex", "input", 0.65, 0.40, "path", r"\\(?:input|include|subfile)\{([^}\n]+)\}"),
    ("latex", "package", 0.55, 0.40, "name", r"\\usepackage(?:\[[^\]\n]*\])?\{(\w+)"),
    ("latex", "bib", 0.55, 0.40, "name", r"\\(?:bibliography|addbibresource)\{(\w+)"),
    ("yaml", "ref", 0.60, 0.40, "path", r"\$ref[\"']?\s*:\s*[\"']([\w./-]+\.(?:yaml|yml|json))"),
    ("json", "ref", 0.60, 0.40, "path", r"\$ref[\"']?\s*:\s*[\"']([\w./-]+\.(?:yaml|yml|json))"),
    ("sql", "dbt_ref", 0.65, 0.40, "name", r"\{\{\s*ref\(\s*[\"'](\w+)[\"']"),
    ("sql", "dbt_source", 0.60, 0.40, "name", r"\{\{\s*source\(\s*[\"']\w+[\"']\s*,\s*[\"'](\w+)[\"']"),
    ("r", "source", 0.60, 0.40, "path", r"\bsource\([\"']([\w./-]+)[\"']"),
    ("perl", "use", 0.65, 0.40, "name", r"(?m)^\s*use (?:\w+::)*(\w+)"),
    ("julia", "include", 0.60, 0.40, "path", r"\binclude\(\"([\w./-]+)\"\)"),
    ("julia", "using", 0.65, 0.40, "name", r"(?m)^(?:using|import) (?:\w+\.)*(\w+)"),
    ("zig", "import", 0.65, 0.40, "path", r"@import\(\"([\w./-]+)\"\)"),
    ("nix", "import", 0.60, 0.40, "path", r"\b(?:import|callPackage)\s+(\.{1,2}/[\w./-]+)"),
    ("ocaml", "open", 0.65, 0.40, "name", r"(?m)^\s*open (\w+)"),
    ("nim", "import", 0.65, 0.40, "path", r"(?m)^(?:import|include|from) ([\w./]+)"),
    ("erlang", "include", 0.65, 0.40, "path", r"(?m)^-include(?:_lib)?\(\"([\w./-]+)\"\)"),
    ("clojure", "require", 0.65, 0.40, "module", r"\[([a-z][\w-]*(?:\.[\w-]+)+)(?:\s+:as|\s+:refer|\])"),
    ("hcl", "module_source", 0.48, 0.40, "folder", r"(?m)^\s*source\s*=\s*\"(\.{1,2}/[\w./-]+)\""),
    ("docker", "copy", 0.65, 0.40, "path", r"(?m)^\s*(?:COPY|ADD)\s+(?:--\S+\s+)*([\w./-]+)"),
    ("docker", "entry", 0.55, 0.40, "path", r"(?m)^\s*(?:CMD|ENTRYPOINT|RUN)\b[^\n]*?[\s\"']((?:\./)?[\w/-]+\.(?:sh|py|js))"),
    ("compose", "build", 0.50, 0.40, "folder", r"(?m)^\s*(?:build|context):\s*[\"']?(\.{1,2}(?:/[\w.-]+)+)"),
    ("compose", "volume", 0.33, 0.40, "path", r"(?m)^\s*-\s*[\"']?(\.{1,2}/[\w./-]+):"),
    ("compose", "env_file", 0.50, 0.40, "path", r"(?m)^\s*(?:env_file:|dockerfile:)\s*[\"']?([\w./-]+)"),
    ("ci", "script", 0.60, 0.35, "path", r"(?:^|[\s\"'=])((?:\./)?(?:[\w.-]+/)*[\w.-]+\.(?:sh|py|js|ts|rb))\b"),
    ("make", "include", 0.60, 0.35, "path", r"(?m)^-?include\s+([\w./-]+)"),
    ("make", "source", 0.60, 0.35, "path", r"\b((?:[\w.-]+/)+[\w.-]+\.(?:c|h|cpp|cc|py|go|rs|sh))\b"),
    ("cmake", "source", 0.60, 0.35, "path", r"\b((?:[\w.-]+/)*[\w.-]+\.(?:c|h|cpp|cc|hpp|cmake))\b"),
    ("cmake", "folder", 0.60, 0.35, "folder", r"add_subdirectory\(\s*([\w./-]+)"),
    ("bazel", "deps", 0.65, 0.40, "folder", r"\"//([\w./-]+)(?::[\w.-]+)?\""),
    ("bazel", "load", 0.60, 0.40, "path", r"load\(\s*\"(?://)?[\w./-]*?:?([\w.-]+\.bzl)\""),
    ("bazel", "srcs", 0.55, 0.40, "path", r"\"([\w./-]+\.(?:c|cc|cpp|h|py|go|rs|java|ts|js|sh))\""),
    ("cargo", "path_dep", 0.65, 0.40, "folder", r"\bpath\s*=\s*\"([\w./-]+)\""),
    ("cargo", "workspace", 0.60, 0.40, "folder", r"(?m)^\s*\"((?:[\w-]+/)*[\w-]+)\",?\s*$"),
    ("cargo", "entry", 0.55, 0.40, "path", r"\bpath\s*=\s*\"([\w./-]+\.rs)\""),
    ("ansible", "include", 0.60, 0.40, "path", r"(?:include|import)(?:_tasks|_playbook|_vars)?:\s*[\"']?([\w./-]+\.ya?ml)"),
    ("ansible", "role", 0.55, 0.40, "folder", r"(?m)^\s*-?\s*role:\s*[\"']?([\w./-]+)"),
    ("helm", "template", 0.63, 0.40, "name", r"\{\{-?\s*(?:include|template)\s+\"[\w-]*?\.?(\w+)\""),
)
# What a reference may leave out at its end.
ENDINGS = {
    "python": ("", ".py", "/__init__.py"), "javascript": ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts"), "typescript": ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"), "ruby": ("", ".rb"), "lua": ("", ".lua", "/init.lua"),
    "haskell": ("", ".hs"), "clojure": ("", ".clj", ".cljs"), "css": ("", ".css", ".scss"), "scss": ("", ".scss", ".css"), "latex": ("", ".tex"), "nix": ("", ".nix", "/default.nix"), "nim": ("", ".nim"), "zig": ("", ".zig"),
}


def flavour(path: Column, language: Column) -> Column:
    """What a file is for its references: by its place and name, else its language."""
    out = F.when(path.rlike(FLAVOURS[0][1]), FLAVOURS[0][0])
    for name, pattern in FLAVOURS[1:]:
        out = out.when(path.rlike(pattern), name)
    return out.otherwise(language)


def as_path(ref: Column, kind: Column) -> Column:
    """A dotted module as a path; leading dots climb from the declaring folder."""
    dots = F.regexp_extract(ref, r"^(\.*)", 1)
    rest = F.replace(F.substr(ref, F.length(dots) + 1), F.lit("."), F.lit("/"))
    climb = F.when(F.length(dots) > 0, F.concat(F.lit("./"), F.repeat(F.lit("../"), F.length(dots) - 1))).otherwise(F.lit(""))
    return F.when(kind == "module", F.concat(climb, rest)).otherwise(ref)


def as_row(role: str, weight: float, reverse: float, kind: str) -> Callable[[Column], Column]:
    """A reference found by a row of the table, with the row's facts."""
    return lambda x: F.struct(F.lit(role).alias("role"), F.lit(weight).alias("weight"), F.lit(reverse).alias("reverse"), F.lit(kind).alias("kind"), x.alias("ref"))


def references(frags: DataFrame, rows: tuple = REFERENCES) -> DataFrame:
    """``repo, file, dir, flavour, role, weight, reverse, kind, ref`` of ``repo, path, file, language, content``."""
    found = None
    for name in sorted({r[0] for r in rows}):
        parts = [
            F.transform(
                F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))),
                as_row(role, w, rv, kind),
            )
            for f, role, w, rv, kind, pattern in rows
            if f == name
        ]
        expr = F.concat(*parts) if len(parts) > 1 else parts[0]
        found = F.when(F.col("flavour") == name, expr) if found is None else found.when(F.col("flavour") == name, expr)
    f = frags.filter("repo is not null and path is not null and content is not null").withColumn("flavour", flavour(F.col("path"), F.col("language")))
    return f.select("repo", "file", X.directory(F.col("path")).alias("dir"), "flavour", F.explode(found).alias("x")).select("repo", "file", "dir", "flavour", "x.*").distinct()


def file_imports(frags: DataFrame, rows: tuple = REFERENCES) -> DataFrame:
    """``repo, src, dst, role, weight, reverse``: files and the files they refer to."""
    refs = references(frags, rows).withColumn("p", as_path(F.col("ref"), F.col("kind"))).withColumn("rid", F.xxhash64("repo", "file", "flavour", "role", "ref"))
    files = frags.filter("repo is not null and path is not null").select("repo", "path", F.col("file").alias("dst")).distinct()
    ends = F.create_map(*[x for k, v in ENDINGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    endings = F.coalesce(F.try_element_at(ends, F.col("flavour")), F.array(F.lit("")))
    bases = F.array_distinct(F.array_compact(F.array(resolved(F.lit(""), F.concat_ws("/", F.nullif("dir", F.lit("")), F.col("p"))), resolved(F.lit(""), F.col("p")))))
    tried = refs.filter("kind in ('path', 'module')").select("rid", "repo", F.posexplode(F.flatten(F.transform(bases, lambda b: F.transform(endings, lambda e: F.concat(b, e))))).alias("at", "path"))
    by_path = tried.join(files, ["repo", "path"]).groupBy("rid").agg(F.min_by("dst", F.struct("at", "dst")).alias("dst"))
    last = lambda c: F.lower(X.file_name(F.regexp_replace(c, "/+$", "")))
    # By name: the stem of a file, in the reference's own language or, for build files, in any.
    named = files.select("repo", F.lower(X.stem(F.col("path"))).alias("name"), "dst")
    held = named.groupBy("repo", "name").agg(F.count("*").alias("n")).filter(F.col("n") <= AMBIGUOUS).select("repo", "name")
    open_refs = refs.filter("kind <> 'folder'").join(by_path.select("rid"), "rid", "left_anti").select("rid", "repo", F.lower(X.stem(last(F.col("p")))).alias("name")).filter("name <> ''")
    by_name = open_refs.join(held, ["repo", "name"]).join(named, ["repo", "name"]).select("rid", "dst")
    folders = files.select("repo", last(X.directory(F.col("path"))).alias("name"), "dst").filter("name <> ''")
    small = folders.groupBy("repo", "name").agg(F.count("*").alias("n")).filter(F.col("n") <= AMBIGUOUS).select("repo", "name")
    by_folder = refs.filter("kind = 'folder'").select("rid", "repo", last(F.col("p")).alias("name")).join(small, ["repo", "name"]).join(folders, ["repo", "name"]).select("rid", "dst")
    hits = by_path.unionByName(by_name).unionByName(by_folder)
    return refs.join(hits, "rid").filter("file <> dst").select("repo", F.col("file").alias("src"), "dst", "role", "weight", "reverse").distinct()


def import_edges(frags: DataFrame, rows: tuple = REFERENCES, category: str = "semantic") -> DataFrame:
    """File-level edges of all references, both ways; of several roles the strongest counts."""
    e = file_imports(frags, rows).groupBy("src", "dst").agg(F.max_by(F.struct("weight", "reverse"), F.struct("weight", "reverse")).alias("w")).select("src", "dst", "w.*")
    pair = F.explode(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * F.col("reverse")).alias("weight"))))
    return e.select(pair.alias("e")).select("e.*").groupBy("src", "dst").agg(F.max("weight").alias("weight")).withColumn("category", F.lit(category))


#: Factors of a name link whose definer the user's file imports, and of one it does not.
CONFIRMED, UNCONFIRMED = 1.5, 0.2


def confirmed_links(defs: DataFrame, uses: DataFrame, imports: DataFrame, weight: float, reverse: float, category: str = "semantic") -> DataFrame:
    """Users linked with the definers of a name: ``name, node, file`` on both sides, ``src, dst`` files of ``imports``.

    A link within a file counts as it is; one into an imported file is confirmed and counts CONFIRMED
    times, any other UNCONFIRMED times.  Names of more than AMBIGUOUS files link nothing.
    """
    few = defs.groupBy("name").agg(F.countDistinct("file").alias("n")).filter(F.col("n") <= AMBIGUOUS).select("name")
    d = defs.join(few, "name").select("name", F.col("node").alias("dst"), F.col("file").alias("df")).distinct()
    u = uses.join(defs.select("name", "node"), ["name", "node"], "left_anti").select("name", F.col("node").alias("src"), F.col("file").alias("uf")).distinct()
    known = imports.select(F.col("src").alias("uf"), F.col("dst").alias("df"), F.lit(True).alias("sure")).distinct()
    hits = u.join(d, "name").filter("src <> dst").join(known, ["uf", "df"], "left")
    factor = F.when(F.col("sure"), F.lit(CONFIRMED)).when(F.col("uf") == F.col("df"), F.lit(1.0)).otherwise(F.lit(UNCONFIRMED))
    best = hits.groupBy("src", "dst").agg(F.max(F.least(factor * weight, F.lit(1.0))).alias("w"))
    return both_ways(best, F.col("w"), reverse, category).groupBy("src", "dst", "category").agg(F.max("weight").alias("weight"))


def package_edges(files: DataFrame, languages: dict[str, float], most: int = 20) -> DataFrame:
    """All pairs of the first ``most`` files of one language in a folder, at the language's weight: one package."""
    weights = F.create_map(*[x for k, v in languages.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy("repo", "dir", "language").orderBy("file")
    rows = files.filter(F.col("language").isin(*languages)).select("repo", X.directory(F.col("path")).alias("dir"), "language", "file").distinct()
    held = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).groupBy("repo", "dir", "language").agg(F.sort_array(F.collect_list("file")).alias("m"))
    return both_ways(pairs_of(held, "m", ("language",)), F.element_at(weights, F.col("language")), 0.40, "semantic")


def imports_sql(rows: tuple = REFERENCES) -> str:
    """``imp(repo, src, dst, role, weight, reverse)`` over ``f`` in DuckDB's dialect."""
    q = lambda s: s.replace("'", "''")
    flav = "CASE " + " ".join(f"WHEN regexp_matches(path, '{q(p)}') THEN '{n}'" for n, p in FLAVOURS) + " ELSE language END"
    parts = " UNION ALL ".join(
        f"SELECT repo, file, dir, flavour, '{role}' AS role, {w}::DOUBLE AS weight, {rv}::DOUBLE AS reverse, '{kind}' AS kind, unnest(list_distinct(regexp_extract_all(content, '{q(p)}', 1))) AS ref FROM g WHERE flavour = '{n}'"
        for n, role, w, rv, kind, p in rows
    )
    clean = "regexp_replace(regexp_replace(regexp_replace({0}, '/+', '/', 'g'), '(^|/)(?:\\./)+', '\\1', 'g'), '/$', '')"
    up = "{0}"
    for _ in range(6):
        up = f"regexp_replace({up}, '(^|/)[^/.][^/]*/\\.\\.(/|$)', '\\1')"
    norm = lambda x: up.format(clean.format(x))
    ends = "CASE flavour " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(e) for e in v)}]" for k, v in ENDINGS.items()) + " ELSE [''] END"
    stem = r"lower(regexp_replace(list_extract(string_split({0}, '/'), -1), '\.[^.]*$', ''))"
    return f"""g AS (SELECT repo, file, regexp_replace(path, '/?[^/]*$', '') AS dir, {flav} AS flavour, content FROM f WHERE repo IS NOT NULL AND path IS NOT NULL AND content IS NOT NULL),
    rr AS (SELECT DISTINCT *, CASE WHEN kind = 'module' THEN CASE WHEN ref LIKE '.%' THEN './' || repeat('../', length(regexp_extract(ref, '^(\\.*)', 1)) - 1) ELSE '' END || replace(regexp_replace(ref, '^\\.+', ''), '.', '/') ELSE ref END AS p FROM ({parts})),
    rn AS (SELECT *, row_number() OVER () AS rid FROM rr), fs AS (SELECT DISTINCT repo, path, file AS dst FROM f WHERE repo IS NOT NULL AND path IS NOT NULL),
    bs AS (SELECT rid, repo, {ends} AS ends, [{norm("CASE WHEN dir = '' THEN p ELSE dir || '/' || p END")}, {norm("p")}] AS b, [CASE WHEN dir = '' THEN p ELSE dir || '/' || p END, p] AS raw FROM rn WHERE kind IN ('path', 'module')),
    tb AS (SELECT rid, repo, ends, b[k] AS base, k FROM (SELECT *, unnest([1, 2]) AS k FROM bs) WHERE NOT regexp_matches(raw[k], '^/|://|[${{}}]') AND NOT regexp_matches(b[k], '(^|/)\\.\\.(/|$)')),
    te AS (SELECT rid, repo, base || ends[e] AS path, k * 100 + e AS place FROM (SELECT *, unnest(range(1, len(ends) + 1)) AS e FROM tb)),
    bp AS (SELECT rid, arg_min(dst, struct_pack(a := place, d := dst)) AS dst FROM te JOIN fs USING (repo, path) GROUP BY 1),
    nm AS (SELECT repo, {stem.format("path")} AS name, dst FROM fs), nh AS (SELECT repo, name FROM nm GROUP BY 1, 2 HAVING count(*) <= {AMBIGUOUS}),
    bn AS (SELECT rid, dst FROM (SELECT rid, repo, {stem.format("regexp_replace(p, '/+$', '')")} AS name FROM rn WHERE kind <> 'folder' AND rid NOT IN (SELECT rid FROM bp)) JOIN nh USING (repo, name) JOIN nm USING (repo, name) WHERE name <> ''),
    fo AS (SELECT repo, lower(list_extract(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), -1)) AS name, dst FROM fs), fh AS (SELECT repo, name FROM fo WHERE name <> '' GROUP BY 1, 2 HAVING count(*) <= {AMBIGUOUS}),
    bf AS (SELECT rid, dst FROM (SELECT rid, repo, lower(list_extract(string_split(regexp_replace(p, '/+$', ''), '/'), -1)) AS name FROM rn WHERE kind = 'folder') JOIN fh USING (repo, name) JOIN fo USING (repo, name)),
    imp AS (SELECT DISTINCT rn.repo, file AS src, dst, role, weight, reverse FROM rn JOIN (SELECT * FROM bp UNION ALL SELECT * FROM bn UNION ALL SELECT * FROM bf) USING (rid) WHERE file <> dst)"""
