"""What a change needs to be understood, and how well a fragment serves a need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X

# Priorities of the needs, in the order in which the first producer of a symbol's need counts.
PRIORITY = {"impact": 0.8, "definition": 1.0, "signature": 0.7, "import": 0.9, "invariant": 0.85, "test": 0.6, "terraform": 0.9, "background": 0.3}
FALLBACK = 0.5
# Strengths of the nine levels of a match.
STRENGTH = {"impact_scope": 0.15, "defines_scope": 1.0, "defines": 0.5, "defines_other": 0.3, "impact_mentions": 0.8, "signature": 0.7, "test": 0.6, "mentions": 0.3, "none": 0.0}
# Least relevance and weight of the diversity bonus, slope of the distance factor.
LEAST_RELEVANCE, RELATEDNESS, NEAR_DECAY = 0.03, 0.25, 0.30
MIN_SYMBOL = 3
#: Names of the language itself are no need.
BUILTINS = (
    "and", "for", "not", "with", "this", "that", "from", "self", "return", "import", "def", "class", "none", "true", "false", "null", "var", "let", "const", "function", "string", "int", "print", "len", "range", "list",
    "dict", "set", "str", "float", "bool", "super", "isinstance", "hasattr", "getattr", "setattr", "iter", "map", "filter", "sorted", "sum", "min", "max", "any", "all", "zip", "enumerate", "open", "type", "while", "switch",
    "catch", "new", "typeof", "require", "assert", "ensure", "precondition", "postcondition", "invariant", "println", "printf", "append", "make", "panic", "defer", "async", "await", "else", "elif", "try", "void",
)
CALL = r"([A-Za-z_]\w*)\s*\("
TYPE = r"(?::|->)\s*([A-Z]\w+)"
GENERIC = r"[\[<,]\s*([A-Z]\w*)"
CHECK = r"(?i)\b(?:assert|require|ensure|precondition|postcondition|invariant)\s*\(\s*(\w+)"
LOCAL_JS = r"import\s+\{([^}]+)\}\s+from\s+['\"][.@~]"
FOREIGN_JS = r"import\s+\{([^}]+)\}\s+from\s+['\"][^.@~'\"]"
LOCAL_PY = r"from\s+\.[\w.]*\s+import\s+([^\n]+)"
FOREIGN_PY = r"from\s+[A-Za-z_][\w.]*\s+import\s+([^\n]+)"
TF_VAR = r"\bvar\.(\w+)"
COMMENT = r"^\s*(#|//|\* |/\*|--|\"\"\"|'''|<!--)"
SIGNATURE_KINDS = ("signature", "function_signature", "class_signature")


def imported(text: Column, pattern: str) -> Column:
    """Lower-case names of all import lists a pattern finds; ``a as b`` gives a."""
    lists = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    names = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))
    return F.filter(F.transform(names, lambda x: F.lower(F.trim(F.split(x, r"\s+as\s+")[0]))), lambda x: x.rlike(r"^\w+$"))


def names_of(text: Column, pattern: str, least: int = MIN_SYMBOL) -> Column:
    """Lower-case names a pattern finds that are no builtin."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)
    return F.filter(F.array_distinct(found), lambda x: (F.length(x) >= least) & ~x.isin(*BUILTINS))


def plain_lines(text: Column) -> Column:
    """The text without its comment lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(COMMENT)), "\n")


def extract(changes: DataFrame) -> DataFrame:
    """``query, need_type, symbol, scope, priority`` of ``query, file, path, symbol, changed``.

    ``changed`` is the text of the changed lines, ``symbol`` the core's (null if it has none).  Of
    several needs of one symbol and type there is one; a change without any gets its names as
    definitions at the fallback priority.  Names imported from outside are no need.
    """
    ext = X.extension(F.col("path"))
    own = F.lower(F.coalesce(F.col("symbol"), F.when(ext.isin("swift", "java", "kt"), X.stem(F.col("path")))))
    code = plain_lines(F.col("changed"))
    outside = F.array_union(imported(F.col("changed"), FOREIGN_JS), imported(F.col("changed"), FOREIGN_PY))
    calls = F.array_except(names_of(code, CALL), outside)
    types = F.array_except(F.array_union(names_of(code, TYPE, 2), names_of(code, GENERIC, 1)), outside)
    local = F.filter(F.array_distinct(F.concat(imported(F.col("changed"), LOCAL_JS), imported(F.col("changed"), LOCAL_PY))), lambda x: (F.length(x) >= MIN_SYMBOL) & ~x.isin(*BUILTINS))
    rows = changes.filter("changed is not null").select(
        "query", "file", own.alias("own"), calls.alias("calls"), types.alias("types"), local.alias("local"), names_of(F.col("changed"), CHECK).alias("checks"),
        F.when(ext.isin("tf", "tfvars", "hcl"), names_of(F.col("changed"), TF_VAR)).otherwise(F.array().cast("array<string>")).alias("vars"), names_of(F.col("changed"), rf"({X.IDENTIFIER})").alias("words"),
    )
    # Producers in their order: of one (type, symbol) the first counts.
    of = lambda kind, symbols, scope, priority, rank: F.transform(symbols, lambda s: F.struct(F.lit(kind).alias("need_type"), s.alias("symbol"), scope.alias("scope"), F.lit(priority).alias("priority"), F.lit(rank).alias("rank")))
    free = F.lit(None).cast("string")
    own_list = F.when(F.length("own") > 0, F.array("own")).otherwise(F.array().cast("array<string>"))
    made = F.concat(
        of("impact", own_list, F.col("file"), PRIORITY["impact"], 0), of("definition", F.col("calls"), free, PRIORITY["definition"], 1), of("signature", F.col("types"), free, PRIORITY["signature"], 2),
        of("definition", F.col("local"), free, PRIORITY["import"], 3), of("invariant", F.col("checks"), free, PRIORITY["invariant"], 4), of("definition", F.col("vars"), free, PRIORITY["terraform"], 5),
    )
    held = rows.withColumn("made", made)
    covered = F.transform("made", lambda x: x["symbol"])
    rest = F.array_except("words", covered)
    late = F.when(F.size("made") == 0, of("definition", F.col("words"), free, FALLBACK, 6)).otherwise(of("background", rest, free, PRIORITY["background"], 7))
    listed = held.select("query", F.explode(F.concat("made", late)).alias("x")).select("query", "x.*")
    return listed.groupBy("query", "need_type", "symbol").agg(F.min_by(F.struct("scope", "priority"), "rank").alias("n")).select("query", "need_type", "symbol", "n.*")


def test_needs(needs: DataFrame, frags: DataFrame) -> DataFrame:
    """Further needs: the symbols of impact and definition needs that a test fragment's name names."""
    tested = frags.filter("symbol is not null").filter(is_test(F.col("path"), F.col("symbol"))).select(F.regexp_replace(F.lower("symbol"), "^test_", "").alias("symbol")).distinct()
    named = needs.filter("need_type in ('impact', 'definition')").select("query", "symbol").distinct().join(tested, "symbol")
    return named.select("query", F.lit("test").alias("need_type"), "symbol", F.lit(None).cast("string").alias("scope"), F.lit(PRIORITY["test"]).alias("priority"))


def is_test(path: Column, symbol: Column) -> Column:
    return F.coalesce(X.is_test(path), F.lit(False)) | F.coalesce(F.lower(symbol).startswith("test_"), F.lit(False))


def strength(need_type: Column, scope: Column, symbol: Column, file: Column, path: Column, frag_symbol: Column, kind: Column, mentions: Column) -> Column:
    """How well a fragment serves a need: the first level that holds."""
    scoped = F.coalesce(scope == file, F.lit(False))
    defines = F.coalesce(F.lower(frag_symbol) == symbol, F.lit(False))
    signature = F.coalesce(kind.isin(*SIGNATURE_KINDS), F.lit(False))
    impact = need_type == "impact"
    v = {k: F.lit(x) for k, x in STRENGTH.items()}
    return (
        F.when(impact & scoped, v["impact_scope"])
        .when(defines & ~signature & scoped, v["defines_scope"])
        .when(defines & ~signature & scope.isNull(), v["defines"])
        .when(defines & ~signature, v["defines_other"])
        .when(impact & mentions, v["impact_mentions"])
        .when(defines, v["signature"])
        .when((need_type == "test") & mentions & is_test(path, frag_symbol), v["test"])
        .when(mentions, v["mentions"])
        .otherwise(v["none"])
    )


def matches(needs: DataFrame, frags: DataFrame, most: int = 64) -> DataFrame:
    """``query, need_type, symbol, priority, id, strength`` above 0: needs against the fragments of their repo.

    ``needs`` carry ``repo``; fragments are ``id, repo, file, path, kind, symbol, identifiers``.  Symbols
    in more than ``most`` fragments of a repo say nothing.
    """
    words = F.array_distinct(F.concat(F.transform(F.coalesce("identifiers", F.array().cast("array<string>")), F.lower), F.array_compact(F.array(F.lower("symbol")))))
    held = frags.withColumn("ids", F.transform(F.coalesce("identifiers", F.array().cast("array<string>")), F.lower)).select("id", "repo", "file", "path", "kind", F.col("symbol").alias("fs"), "ids", F.explode(words).alias("symbol"))
    few = held.groupBy("repo", "symbol").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("repo", "symbol")
    hits = needs.join(held.join(few, ["repo", "symbol"]), ["repo", "symbol"])
    level = strength(F.col("need_type"), F.col("scope"), F.col("symbol"), F.col("file"), F.col("path"), F.col("fs"), F.col("kind"), F.array_contains("ids", F.col("symbol")))
    named = hits.select("query", "need_type", "symbol", "priority", "id", level.alias("strength"))
    # An impact need is served a little by every fragment of its own file.
    scoped = needs.filter("need_type = 'impact'").join(frags.select("id", "repo", F.col("file").alias("scope")), ["repo", "scope"]).select("query", "need_type", "symbol", "priority", "id", F.lit(STRENGTH["impact_scope"]).alias("strength"))
    return named.unionByName(scoped).filter("strength > 0").groupBy("query", "need_type", "symbol", "id").agg(F.max("priority").alias("priority"), F.min(F.when((F.col("need_type") == "impact") & (F.col("strength") == STRENGTH["impact_scope"]), F.col("strength"))).alias("own"), F.max("strength").alias("best")).select(
        "query", "need_type", "symbol", "priority", "id", F.coalesce("own", "best").alias("strength")
    )


def first_gain(matched: DataFrame, relevance: DataFrame, cap: float = 1.0, eta: float = 0.20, bonus: float = 0.10) -> DataFrame:
    """``query, id, gain`` of each fragment before anything is picked: needs, diversity and structure.

    ``relevance`` is ``query, id, rel, importance``: an impact need's strength is first multiplied by the
    file's importance.  Nothing is covered yet, so the diversity bonus is whole.
    """
    extra = eta * F.least(F.col("rel") / cap, F.lit(1.0))
    level = F.when(F.col("need_type") == "impact", F.col("strength") * F.col("importance")).otherwise(F.col("strength")) + extra
    sums = matched.join(relevance, ["query", "id"]).groupBy("query", "id").agg(F.sum(F.col("priority") * F.sqrt(level)).alias("g"), F.max("rel").alias("rel"))
    diversity = F.when(F.col("rel") >= LEAST_RELEVANCE, F.col("rel") * RELATEDNESS).otherwise(F.lit(0.0))
    return sums.select("query", "id", F.round(F.col("g") + diversity + bonus * F.least(F.col("rel") / cap, F.lit(1.0)), 6).alias("gain"))
