"""Static impact: definitions, uses and imports as tables, callers and reaching tests by joins.

MODELS says how a language is read: by its grammar, by a lexer or by patterns, and which relations
are modelled.  What is not is reported as ``unresolved`` with its reason, never as a clean zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X

FACTS = "file string, fact string, name string, target string, line int"
#: Name, qualified or bare, and the last part of it.
NAME = r"[A-Za-z_][\w$]*"
RELATIONS = ("callers", "uses", "imports", "implementations", "public_api", "removals")
#: How each language is read, and what of RELATIONS its facts answer.
MODELS: dict[str, tuple[str, tuple[str, ...]]] = {
    "py": ("grammar", RELATIONS), "js": ("patterns", ("callers", "uses", "imports", "implementations")), "ts": ("patterns", ("callers", "uses", "imports", "implementations")), "go": ("patterns", ("callers", "uses", "imports", "public_api")),
    "rs": ("patterns", ("callers", "uses", "imports", "implementations")), "java": ("patterns", ("callers", "uses", "imports", "implementations")), "kt": ("patterns", ("callers", "uses", "imports", "implementations")),
    "swift": ("patterns", ("callers", "uses", "implementations")), "sh": ("patterns", ("callers", "imports")), "sql": ("lexer", ("callers", "uses")),
}
ENDINGS = {"pyi": "py", "jsx": "js", "mjs": "js", "cjs": "js", "tsx": "ts", "bash": "sh", "kts": "kt"}
# Definition, import and inheritance per language; uses are calls of a name.
PATTERNS: dict[str, dict[str, str]] = {
    "js": {"def": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class)\s+(\w+)|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", "import": r"\bfrom\s+[\"']([^\"']+)[\"']|\brequire\(\s*[\"']([^\"']+)[\"']", "base": r"\bclass\s+\w+\s+extends\s+([\w.]+)"},
    "ts": {"def": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|enum|type)\s+(\w+)|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*\w+\s*)?=>", "import": r"\bfrom\s+[\"']([^\"']+)[\"']|\brequire\(\s*[\"']([^\"']+)[\"']", "base": r"\b(?:extends|implements)\s+([\w.]+)"},
    "go": {"def": r"^func\s+(?:\([^)]*\)\s*)?(\w+)|^type\s+(\w+)", "import": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", "base": r"(?!)"},
    "rs": {"def": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|type|mod)\s+(\w+)", "import": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "base": r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\b"},
    "java": {"def": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(\w+)|^\s+(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\(", "import": r"^import\s+(?:static\s+)?([\w.]+)", "base": r"\b(?:extends|implements)\s+(\w+)"},
    "kt": {"def": r"^\s*(?:(?:public|private|internal|open|data|sealed|override|suspend)\s+)*(?:class|interface|object|fun)\s+(?:\w+\.)?(\w+)", "import": r"^import\s+([\w.]+)", "base": r"\bclass\s+\w+[^:{]*:\s*(\w+)"},
    "swift": {"def": r"^\s*(?:(?:public|private|open|final|static)\s+)*(?:class|struct|protocol|enum|func)\s+(\w+)", "import": r"^import\s+(\w+)", "base": r"\b(?:class|struct|enum|extension)\s+\w+\s*:\s*(\w+)"},
    "sh": {"def": r"^\s*(?:function\s+)?(\w[\w-]*)\s*\(\)\s*\{?|^\s*function\s+(\w[\w-]*)\s*\{", "import": r"^\s*(?:source|\.)\s+[\"']?([\w./-]+)", "base": r"(?!)"},
}
CALL = re.compile(r"(?<![\w$])(" + NAME + r")\s*(?:::<[^>]*>)?\(")
WORD_COMMAND = re.compile(r"(?:^|[;&|]\s*|\$\(\s*|\b(?:then|do|else|if|while)\s+)(\w[\w-]*)")
SQL_TOKEN = re.compile(r"--[^\n]*|/\*[\s\S]*?\*/|'(?:[^']|'')*'|\$(\w*)\$[\s\S]*?\$\1\$|\"([^\"]+)\"|`([^`]+)`|\[([^\]]+)\]|([A-Za-z_][\w$]*)|([().;,])|\s+|.")
Fact = tuple[str, str, "str | None", int]


def python_facts(source: str) -> list[Fact]:
    """``(fact, name, target, line)``: def, use, import, alias, base, export; ``unresolved`` where it does not parse or names everything.

    An alias gives the imported name as its target; a name assigned from another one is an alias too.
    """
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [("unresolved", "syntax", None, 1)]
    out: list[Fact] = []

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Attribute):
            head = dotted(node.value)
            return f"{head}.{node.attr}" if head else node.attr
        return node.id if isinstance(node, ast.Name) else None

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(("def", node.name, None, node.lineno))
            out += [("base", b, node.name, node.lineno) for b in map(dotted, getattr(node, "bases", [])) if b]
        elif isinstance(node, ast.Call):
            name = dotted(node.func)
            if name:
                out.append(("use", name.rpartition(".")[2], name, node.lineno))
            if name and name.endswith("path.insert") or name == "sys.path.append":
                out.append(("root", "sys.path", next((a.value for a in reversed(node.args) if isinstance(a, ast.Constant) and isinstance(a.value, str)), None), node.lineno))
            if name in ("getattr", "__import__", "importlib.import_module", "eval", "exec"):
                out.append(("unresolved", f"dynamic:{name}", None, node.lineno))
        elif isinstance(node, ast.Import):
            out += [("import", a.asname or a.name, a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for a in node.names:
                if a.name == "*":
                    out.append(("star", module, module, node.lineno))
                else:
                    out.append(("import", a.asname or a.name, f"{module}.{a.name}" if not module.endswith(".") else module + a.name, node.lineno))
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            name = node.targets[0].id
            if name == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                out += [("export", e.value, None, node.lineno) for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
            elif (target := dotted(node.value)) is not None:
                out.append(("alias", name, target, node.lineno))
    return out


def sql_facts(source: str) -> list[Fact]:
    """Routines, tables and views a text creates, and what it calls and reads, with their schema as target.

    A lexer skips comments, strings and quoted bodies' delimiters, so that nothing inside a text is a name;
    the body of a routine between dollar signs is read as SQL again.
    """
    tokens: list[tuple[str, int]] = []

    def lex(text: str, line: int) -> None:
        for m in SQL_TOKEN.finditer(text):
            s = m.group()
            at = line + text.count("\n", 0, m.start())
            if s.startswith("$") and s.count("$") >= 4:
                mark = f"${m[1]}$"
                lex(s[len(mark) : -len(mark)], at)
            elif m[2] or m[3] or m[4]:
                tokens.append((m[2] or m[3] or m[4], at))
            elif m[5] or m[6]:
                tokens.append((s, at))

    lex(source, 1)
    words = [t.lower() for t, _ in tokens]
    out: list[Fact] = []

    def name_at(i: int) -> tuple[str | None, str, int]:
        """Schema, name and the place after a possibly qualified name."""
        if i + 2 < len(words) and words[i + 1] == ".":
            return words[i], words[i + 2], i + 3
        return None, words[i], i + 1

    i = 0
    while i < len(words):
        w = words[i]
        if w in ("create", "alter"):
            j = i + 1
            while j < len(words) and words[j] in ("or", "replace", "temp", "temporary", "materialized", "unique", "recursive"):
                j += 1
            if j < len(words) and words[j] in ("table", "view", "function", "procedure", "trigger", "index", "type"):
                j += 1
                while j < len(words) and words[j] in ("if", "not", "exists", "only"):
                    j += 1
                if j < len(words) and words[j] not in "().;,":
                    schema, name, after = name_at(j)
                    out.append(("def" if w == "create" else "use", name, schema, tokens[j][1]))
                    i = after
                    continue
        elif w in ("from", "join", "into", "update", "references", "call", "perform", "execute", "table") and i + 1 < len(words) and words[i + 1] not in "().;," and words[i + 1] not in ("select", "set", "only", "lateral", "if"):
            schema, name, after = name_at(i + 1)
            out.append(("use", name, schema, tokens[i + 1][1]))
            i = after
            continue
        elif i + 1 < len(words) and words[i + 1] == "(" and re.fullmatch(NAME, w) and w not in ("values", "in", "and", "or", "not", "on", "as", "key", "check", "exists", "over", "using", "when", "case", "by", "primary", "unique"):
            schema = words[i - 2] if i > 1 and words[i - 1] == "." else None
            out.append(("use", w, schema, tokens[i][1]))
        i += 1
    return out


def pattern_facts(source: str, ending: str) -> list[Fact]:
    """Definitions, imports, bases and calls of a text by the patterns of its language."""
    rows = {k: re.compile(p) for k, p in PATTERNS[ending].items()}
    out: list[Fact] = []
    for n, line in enumerate(source.split("\n"), 1):
        if re.match(r"\s*(?://|#(?!\[)|\*|/\*)", line):
            continue
        m = rows["def"].match(line)
        own = next((g for g in m.groups() if g), None) if m else None
        if own:
            out.append(("def", own, None, n))
        for m in rows["import"].finditer(line):
            target = next(g for g in m.groups() if g)
            out.append(("import", re.split(r"[./:]+", target.rstrip("/"))[-1], target, n))
        out += [("base", m[1].rpartition(".")[2].rpartition("::")[2], own, n) for m in rows["base"].finditer(line)]
        found = WORD_COMMAND.finditer(line) if ending == "sh" else CALL.finditer(line)
        out += [("use", m[1], None, n) for m in found if m[1] != own and m[1] not in ("if", "for", "while", "switch", "return", "function", "func", "fn", "catch", "then", "do", "done", "fi", "else", "elif", "case", "esac", "in", "local", "export")]
    return out


def text_facts(source: str, path: str) -> list[Fact]:
    """The facts of a text by the model of its language; a language without one is unresolved."""
    ending = path.rpartition(".")[2].lower() if "." in path else ""
    ending = ENDINGS.get(ending, ending)
    if ending not in MODELS:
        return [("unresolved", f"not modelled:{ending or 'none'}", None, 1)]
    return python_facts(source) if ending == "py" else sql_facts(source) if ending == "sql" else pattern_facts(source, ending)


def facts(files: DataFrame) -> DataFrame:
    """Facts of ``file, path, content``; null contents have none."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(f, *x) for f, p, c in zip(batch["file"], batch["path"], batch["content"]) if c for x in text_facts(c, p or "")]
            yield pd.DataFrame(rows, columns=["file", "fact", "name", "target", "line"])

    return files.select("file", "path", "content").mapInPandas(run, FACTS)


def overlay(base: DataFrame, changed: DataFrame) -> DataFrame:
    """The facts of ``base`` with those of every file in ``changed`` in place of its own."""
    return base.join(changed.select("file").distinct(), "file", "left_anti").unionByName(changed)


def resolved_uses(fact: DataFrame) -> DataFrame:
    """``name, file, line``: uses, those through an alias or a renamed import under the name they stand for."""
    last = F.regexp_extract("target", r"([A-Za-z_]\w*)$", 1)
    renamed = fact.filter("fact in ('import', 'alias') and target is not null").select("file", F.col("name").alias("alias"), last.alias("real")).filter("real <> '' and real <> alias").distinct()
    uses = fact.filter("fact = 'use'").select("name", "file", "line").distinct()
    through = uses.join(renamed, (uses["file"] == renamed["file"]) & (uses["name"] == renamed["alias"])).select(F.col("real").alias("name"), uses["file"], "line")
    return uses.unionByName(through).distinct()


def callers(fact: DataFrame, changed: DataFrame, most_files: int = 8) -> DataFrame:
    """``name, file, line, is_test`` of uses outside the changed files of names they define.

    Names defined in more than ``most_files`` files are reported once as ambiguous, with a null file.
    """
    defs = fact.filter("fact = 'def'").select("name", "file").distinct()
    wanted = defs.join(changed.select("file").distinct(), "file", "left_semi").select("name").distinct()
    count = defs.join(wanted, "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))
    clear = count.filter(F.col("n") <= most_files).select("name")
    uses = resolved_uses(fact).join(clear, "name").join(changed.select("file").distinct(), "file", "left_anti").select("name", "file", "line").distinct()
    found = uses.withColumn("is_test", X.is_test(F.regexp_replace("file", "^[^:]*:", "")))
    vague = count.filter(F.col("n") > most_files).select("name", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(False).alias("is_test"))
    return found.unionByName(vague)


def reaching_tests(fact: DataFrame, changed: DataFrame, depth: int = 2, most_files: int = 8) -> DataFrame:
    """``file, hops``: test files that use a changed definition, or one of up to ``depth`` files between.

    From the changed files the use of names leads to their users, and from these on; a name defined in
    more than ``most_files`` files leads nowhere.
    """
    defs = fact.filter("fact = 'def'").select("name", F.col("file").alias("to")).distinct()
    few = defs.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") <= most_files).select("name")
    links = resolved_uses(fact).select("name", "file").distinct().join(defs.join(few, "name"), "name").filter("file <> to").select("file", "to").distinct()
    seen = changed.select("file").distinct().withColumn("hops", F.lit(0))
    front = seen
    for k in range(1, depth + 1):
        front = links.join(front.select(F.col("file").alias("to")), "to").select("file").distinct().join(seen.select("file"), "file", "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen.filter((F.col("hops") > 0) & X.is_test(F.regexp_replace("file", "^[^:]*:", "")))


def implementations(fact: DataFrame, changed: DataFrame) -> DataFrame:
    """``name, file, line``: types elsewhere that derive from one the changed files define."""
    own = fact.filter("fact = 'def'").join(changed.select("file").distinct(), "file", "left_semi").select("name").distinct()
    bases = fact.filter("fact = 'base'").select(F.regexp_extract("name", r"(\w+)$", 1).alias("name"), "file", "line")
    return bases.join(own, "name").join(changed.select("file").distinct(), "file", "left_anti").distinct()


def removals(before: DataFrame, after: DataFrame) -> DataFrame:
    """``name, file`` of definitions a change takes away from a file and leaves nowhere in it."""
    defs = lambda df: df.filter("fact = 'def'").select("name", "file").distinct()
    return defs(before).join(defs(after), ["name", "file"], "left_anti")


def symbol(fact: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Where a symbol is defined and used; a plain search of the lines only if nothing defines it."""
    hits = fact.filter((F.col("name") == name) & F.col("fact").isin("def", "use")).select("fact", "file", "line")
    if hits.filter("fact = 'def'").isEmpty():
        lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("k", "l")).filter(F.col("l").contains(name))
        return hits.unionByName(lines.select(F.lit("text").alias("fact"), "file", (F.col("k") + 1).alias("line")))
    return hits


def coverage(fact: DataFrame, files: DataFrame) -> DataFrame:
    """``model, files, unresolved``: how the files were read, and in how many something was not resolved."""
    ending = F.regexp_replace(X.extension(F.col("path")), "^$", "none")
    model = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in MODELS.items() for x in (F.lit(k), F.lit(v[0]))]), ending), F.lit("none"))
    bad = fact.filter("fact = 'unresolved'").select("file").distinct().withColumn("bad", F.lit(1))
    return files.select("file", model.alias("model")).distinct().join(bad, "file", "left").groupBy("model").agg(F.count("*").alias("files"), F.count("bad").alias("unresolved"))
