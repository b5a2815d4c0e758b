"""Corpora of files as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as X

#: Size caps and the window of the binary test.
CONTEXT_BYTES, CHANGED_BYTES, BINARY_WINDOW = 100_000, 5_000_000, 8192


def decoded(content: Column) -> Column:
    """Bytes as text; every invalid UTF-8 sequence becomes U+FFFD, in the JVM."""
    return F.make_valid_utf8(content.cast("string"))


def read_tree(spark: SparkSession, root: str, most_bytes: int = CONTEXT_BYTES, known_only: bool = True) -> DataFrame:
    """``path, size, content`` of the text files under a folder.

    Size and extension are tested on the listing, before any content is read.  Binary files (a NUL
    in the first 8 kB) are dropped; byte-order mark and carriage returns go; invalid UTF-8 becomes
    U+FFFD; empty files have no row.  Paths are relative to the root.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).filter(F.col("length") <= most_bytes)
    if known_only:
        files = files.filter(X.language(F.col("path")) != "other")
    text = files.filter(~F.coalesce(F.contains(F.substring("content", 1, BINARY_WINDOW), F.lit(b"\x00")), F.lit(False)))
    plain = F.regexp_replace(F.regexp_replace(decoded(F.col("content")), "^﻿", ""), "\r\n?", "\n")
    return text.select(F.regexp_replace("path", f"^(?:file:)?/*{re.escape(base.lstrip('/'))}/", "").alias("path"), F.col("length").alias("size"), plain.alias("content"))


def candidates(files: DataFrame, changed: DataFrame | None = None, tracked: DataFrame | None = None, most_bytes: int = CONTEXT_BYTES) -> DataFrame:
    """The corpus beside a change: ``path, size, content`` of known languages, by ending or by the first line.

    Changed files leave, files above ``most_bytes`` leave, and where a list of tracked paths is given
    only these stay.
    """
    kept = files.filter((F.col("size") <= most_bytes) & (X.sniffed_language(F.col("path"), F.col("content")) != "other"))
    if tracked is not None:
        kept = kept.join(tracked.select("path").distinct(), "path", "left_semi")
    return kept if changed is None else kept.join(changed.select("path").distinct(), "path", "left_anti")


def snapshot(objects: DataFrame, revision: str, scope: Sequence[str] = ()) -> DataFrame:
    """``path, oid, size`` of one revision of ``revision, mode, path, oid, size``.

    Only regular files: links and submodules are dropped.  A scope is a list of folders or files; the
    revision is a filter on the table's partition.
    """
    kept = objects.filter((F.col("revision") == revision) & F.col("mode").isin("100644", "100755"))
    if scope:
        inside = F.lit(False)
        for s in (x.strip("/") for x in scope):
            inside = inside | (F.col("path") == s) | F.col("path").startswith(f"{s}/")
        kept = kept.filter(inside)
    return kept.select("path", "oid", "size")


def commit_log(commits: DataFrame, most: int = 500) -> DataFrame:
    """``commit_id, path`` of the last ``most`` commits of ``commit_id, committed_at, path``; ties by id."""
    last = commits.groupBy("commit_id").agg(F.max("committed_at").alias("at")).orderBy(F.desc("at"), F.desc("commit_id")).limit(most)
    return commits.join(F.broadcast(last.select("commit_id")), "commit_id", "left_semi").select("commit_id", "path").distinct()


#: What every listing leaves out.
DEFAULT_IGNORED = (
    ".git/", ".hg/", ".svn/", "node_modules/", "__pycache__/", "*.pyc", "*.pyo", ".venv/", "venv/", ".tox/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/", "dist/", "build/", "target/", "*.egg-info/", ".idea/", ".vscode/", ".DS_Store", "*.class", "*.o",
    "*.so", "*.dll", "*.exe", "*.log", "*.swp", "coverage/", ".next/", ".cache/",
)
SECRET_FILES = (".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_ed25519", ".netrc", ".npmrc", ".pypirc", "credentials.json")


def listed(files: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = (), allow: Sequence[str] = (), secrets: bool = False) -> DataFrame:
    """``path`` and the other columns of the files no rule ignores.

    ``rules`` are the patterns of ignore files with their folder ("" for the root), outer ones first: a
    pattern holds below its folder, and the last that matches decides.  The default patterns come
    before all; a list of allowed patterns keeps nothing else; files that hold secrets always leave.
    """
    path = F.col("path")
    verdict = ignored(path, DEFAULT_IGNORED)
    for folder, patterns in rules:
        base = f"{folder.strip('/')}/" if folder.strip("/") else ""
        inner = F.substr(path, F.lit(len(base) + 1)) if base else path
        for p in patterns:
            rule = ignore_regex(p)
            if rule:
                verdict = F.when((path.startswith(base) if base else F.lit(True)) & inner.rlike(rule[0]), F.lit(not rule[1])).otherwise(verdict)
    kept = files.filter(~verdict)
    if allow:
        kept = kept.filter(ignored(path, allow))
    return kept if secrets else kept.filter(~ignored(path, SECRET_FILES))


def placeholders(files: DataFrame, most_bytes: int = CONTEXT_BYTES) -> DataFrame:
    """``path, size, depth, content`` of ``path, length, content`` (bytes): what is no text or too large has a note in its place."""
    binary = F.contains(F.substring("content", 1, BINARY_WINDOW), F.lit(b"\x00"))
    text = (
        F.when(F.col("content").isNull(), F.lit("<unreadable>"))
        .when(F.col("length") > most_bytes, F.concat(F.lit("<too large: "), X.human_size(F.col("length")), F.lit(">")))
        .when(binary, F.concat(F.lit("<binary: "), X.human_size(F.col("length")), F.lit(">")))
        .otherwise(F.regexp_replace(F.regexp_replace(decoded(F.col("content")), "^\ufeff", ""), "\r\n?", "\n"))
    )
    return files.select("path", F.col("length").alias("size"), F.size(F.split("path", "/")).alias("depth"), text.alias("content"))


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """A gitignore line as ``(regular expression, whether it brings back)``; null for comments and blanks."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:]
    folder = line.endswith("/")
    line = line.rstrip("/")
    rooted = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i:]:
            end = line.index("]", i)
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if rooted else "(?:^|/)") + out + ("/.*$" if folder else "(?:/.*)?$"), back


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path is ignored: the last pattern that matches decides."""
    verdict = F.lit(False)
    for p in patterns:
        rule = ignore_regex(p)
        if rule:
            verdict = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(verdict)
    return verdict


def fetch(files: DataFrame, wanted: DataFrame, most: int = 40) -> DataFrame:
    """``id, content`` for ids ``path:start-end``: lines cut out of ``files(path, content)``.

    Ids that leave the root or ask for no lines give null; more than ``most`` ids are refused.
    """
    if wanted.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ids")
    part = lambda k: F.regexp_extract("id", r"^(.*):(\d+)-(\d+)$", k)
    ids = wanted.select("id", part(1).alias("path"), part(2).cast("int").alias("s"), part(3).cast("int").alias("e"))
    safe = (F.col("path") != "") & ~F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))") & (F.col("s") >= 1) & (F.col("e") >= F.col("s"))
    hit = ids.join(files.select("path", "content"), "path", "left")
    return hit.select("id", F.when(safe, F.array_join(F.slice(F.split("content", "\n"), F.greatest("s", F.lit(1)), F.greatest(F.col("e") - F.col("s") + 1, F.lit(0))), "\n")).alias("content"))


def result_log(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "instance_id") -> DataFrame:
    """A checkpoint log of JSON lines: malformed lines skipped, the last row of an id wins by ``seq``."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "seq").alias("r")).select(key, "r.*")


def directory_tree(files: DataFrame) -> DataFrame:
    """Every folder and file with its depth and, for folders, the files and bytes beneath."""
    parts = F.split("path", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("node"), k.alias("depth"), (k == F.size(parts)).alias("is_file"))))
    return files.select("size", up.alias("u")).groupBy("u.node", "u.depth", "u.is_file").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
