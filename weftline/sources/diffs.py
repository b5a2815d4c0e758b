"""Unified diffs and pairs of versions as hunk tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

HUNKS = "path string, old_start int, old_len int, new_start int, new_len int, removed array<string>, added array<string>"
_HEAD = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_patch(patch: str) -> list[tuple]:
    """Runs of changed lines of a unified diff, with the ranges a diff without context would print.

    Context splits a hunk into runs; the new path names a run, the old one where the file is deleted.
    """
    out: list[tuple] = []
    old = new = ""
    a = b = 0
    gone: list[str] = []
    came: list[str] = []
    inside = False

    def close() -> None:
        nonlocal gone, came
        if gone or came:
            s, t = a - len(gone), b - len(came)
            out.append((new if new and new != "/dev/null" else old, s if gone else s - 1, len(gone), t if came else t - 1, len(came), gone, came))
            gone, came = [], []

    for line in patch.split("\n"):
        if m := _HEAD.match(line):
            close()
            a, b, inside = int(m[1]), int(m[3]), True
            a += m[2] == "0"
            b += m[4] == "0"
        elif line.startswith("diff --git "):
            close()
            inside, old, new = False, "", ""
        elif not inside and line.startswith("--- "):
            old = re.sub(r"^a/", "", line[4:].split("\t")[0])
        elif not inside and line.startswith("+++ "):
            new = re.sub(r"^b/", "", line[4:].split("\t")[0])
        elif inside and line.startswith("-"):
            if came:
                close()
            gone.append(line[1:])
            a += 1
        elif inside and line.startswith("+"):
            came.append(line[1:])
            b += 1
        elif inside and not line.startswith("\\"):
            close()
            a, b = a + 1, b + 1
    close()
    return out


def patch_hunks(df: DataFrame, key: str, patch: str) -> DataFrame:
    """``key`` and the runs of each row's patch; null and empty patches have none."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(k, *h) for k, p in zip(batch[key], batch["__p"]) if p for h in parse_patch(p)]
            yield pd.DataFrame(rows, columns=[key, "path", "old_start", "old_len", "new_start", "new_len", "removed", "added"])

    return df.select(key, df[patch].alias("__p")).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {HUNKS}")


def line_diff(old: str, new: str) -> list[tuple]:
    """The runs between two versions; an empty new side is one deletion."""
    from difflib import SequenceMatcher

    x, y = (t.split("\n") if t else [] for t in (old, new))
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag != "equal":
            out.append((a + 1 if b > a else a, b - a, c + 1 if d > c else c, d - c, x[a:b], y[c:d]))
    return out


def version_hunks(versions: DataFrame) -> DataFrame:
    """Hunks of ``path, old, new``; a file on one side only is one run.  Paths run in parallel, without a shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(p, *h) for p, o, n in zip(batch["path"], batch["old"], batch["new"]) for h in line_diff(o or "", n or "")]
            yield pd.DataFrame(rows, columns=["path", "old_start", "old_len", "new_start", "new_len", "removed", "added"])

    return versions.select("path", "old", "new").mapInPandas(run, HUNKS)


def unified(old: str, new: str, path: str, radius: int = 3) -> str:
    """A unified diff; a missing side is ``/dev/null``."""
    from difflib import unified_diff

    a, b = f"a/{path}" if old else "/dev/null", f"b/{path}" if new else "/dev/null"
    return "\n".join(unified_diff(old.split("\n") if old else [], new.split("\n") if new else [], a, b, lineterm="", n=radius))


def revert(new: str, runs: list[tuple]) -> str | None:
    """The old text from the new one and its runs ``(old_start, old_len, new_start, new_len, removed, added)``.

    Null where the added lines are not where the runs say.
    """
    lines = new.split("\n") if new else []
    for _, _, start, length, removed, added in sorted(runs, key=lambda r: -r[2]):
        at = start - 1 if length else start
        if lines[at : at + length] != list(added):
            return None
        lines[at : at + length] = list(removed)
    return "\n".join(lines)


def unified_diffs(versions: DataFrame, radius: int = 3) -> DataFrame:
    """``path, diff`` of ``path, old, new``; equal versions have an empty diff."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            batch["diff"] = [unified(o or "", n or "", p, radius) if (o or "") != (n or "") else "" for p, o, n in zip(batch["path"], batch["old"], batch["new"])]
            yield batch[["path", "diff"]]

    return versions.select("path", "old", "new").mapInPandas(run, "path string, diff string")


def reverted(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """``path, old`` of ``path, content`` and the hunks of ``version_hunks``; null where the hunks do not fit, the text itself without hunks."""
    from pyspark.sql import functions as F

    runs = hunks.groupBy("path").agg(F.collect_list(F.struct("old_start", "old_len", "new_start", "new_len", "removed", "added")).alias("runs"))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            batch["old"] = [
                c if r is None else revert(c or "", [(x["old_start"], x["old_len"], x["new_start"], x["new_len"], list(x["removed"]), list(x["added"])) for x in r]) for c, r in zip(batch["content"], batch["runs"])
            ]
            yield batch[["path", "old"]]

    return files.select("path", "content").join(runs, "path", "left").mapInPandas(run, "path string, old string")
