"""Whole files to fragments: definitions by grammar or by shape, sections, blocks, and what lies between.

The strategies are tried in order, and the first that finds anything cuts the file: definitions,
Markdown sections, TOML sections, blocks of lines.  Lines no fragment covers become chunks.  A file
is cut inside one row of a task; files run in parallel and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

# Block size, gap above which chunks are cut, their size, and most fragments of a file.
BLOCK, GAP, CHUNK, MOST = 200, 30, 20, 200
# Least lines of a signature's definition, context, least parent and greatest share of an excerpt, least lines left out.
SIGNATURE_LEAST, CONTEXT, PARENT, SHARE, ELIDED = 5, 3, 12, 0.70, 2
#: What begins a definition, per language of an ending: kind by keyword, name in the last group.
WORDS = {"class": "class", "struct": "struct", "interface": "interface", "trait": "interface", "protocol": "interface", "enum": "enum", "impl": "impl", "type": "type", "module": "module", "mod": "module", "object": "class", "record": "record"}
BRACES = {
    "js": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s*\*?\s*(\w+)", "ts": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|enum)\s*\*?\s*(\w+)",
    "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?(\w+)", "rs": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(fn|struct|enum|trait|impl|mod)\s+(?:<[^>]*>\s*)?(\w+)",
    "java": r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(class|interface|enum|record)\s+(\w+)|^\s+(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ?]+\s+()(\w+)\s*\([^;]*$",
    "kt": r"^\s*(?:(?:public|private|internal|open|data|sealed|abstract|override|suspend)\s+)*(class|interface|object|fun)\s+(\w+)", "swift": r"^\s*(?:(?:public|private|open|final|static)\s+)*(class|struct|protocol|enum|func)\s+(\w+)",
    "c": r"^(?:typedef\s+)?(struct|enum)\s+(\w+)\s*\{?\s*$|^(?:static\s+|inline\s+|extern\s+)*[A-Za-z_][\w\s*]*?()\b(\w+)\s*\([^;]*$", "php": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(function|class|interface|trait)\s+(\w+)",
    "cs": r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(class|struct|interface|enum|record)\s+(\w+)", "scala": r"^\s*(?:(?:final|sealed|case|abstract|override)\s+)*(class|object|trait|def)\s+(\w+)",
    "dart": r"^\s*(?:abstract\s+)?(class|enum)\s+(\w+)", "sh": r"^\s*(?:function\s+)?()(\w+)\s*\(\)\s*\{", "tf": r"^(resource|data|module|variable|output|locals)\b\s*((?:\"[\w.-]+\"\s*)*)\{", "proto": r"^\s*(message|service|enum)\s+(\w+)", "css": r"^()([.#]?[\w-]+[^{};]*)\{\s*$",
}
SAME = {"jsx": "js", "mjs": "js", "cjs": "js", "tsx": "ts", "kts": "kt", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "bash": "sh", "scss": "css", "hcl": "tf"}
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|//.*$|#(?!\[).*$")
HEADING = re.compile(r"^#{1,6}\s+\S")
Span = tuple[str, "str | None", int, int]


def python_definitions(text: str) -> list[Span]:
    """Functions and classes of a Python text at any depth, decorators included; none where it does not parse."""
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, first, node.end_lineno))
    return sorted(out, key=lambda s: (s[2], -s[3]))


def brace_definitions(lines: Sequence[str], ending: str) -> list[Span]:
    """Definitions of a language with braces: from the line that names one to the brace that closes it."""
    pattern = re.compile(BRACES[ending])
    bare = [STRING.sub("", x) for x in lines]
    out: list[Span] = []
    for i, line in enumerate(lines):
        m = pattern.match(line)
        if not m or re.match(r"\s*(?:return|else|if|for|while|switch|new|throw)\b", line):
            continue
        groups = [g for g in m.groups() if g is not None]
        word, name = groups[0], groups[-1].replace('"', " ").split()
        depth, opened, end = 0, False, i
        for j in range(i, len(lines)):
            depth += bare[j].count("{") - bare[j].count("}")
            opened = opened or "{" in bare[j]
            end = j
            if opened and depth <= 0 or not opened and (j - i > 8 or bare[j].rstrip().endswith(";")):
                break
        if opened:
            out.append((WORDS.get(word, "definition" if ending == "tf" else "function"), ".".join(name) or None, i + 1, end + 1))
    return out


def sections(lines: Sequence[str], starts: list[int], kind: str) -> list[Span]:
    """From each starting line (from 0) to the one before the next; blank lines at the end go."""
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        while b > a + 1 and not lines[b - 1].strip():
            b -= 1
        out.append((kind, lines[a].strip("#[] \r") or None, a + 1, b))
    return out


def split_gap(lines: Sequence[str], start: int, end: int) -> list[tuple[int, int]]:
    """A run of lines as chunks near CHUNK lines that end at the last blank line within half of that around it."""
    if end - start + 1 <= GAP:
        return [(start, end)]
    out = []
    while start <= end:
        ideal = min(start + CHUNK - 1, end)
        stop = ideal
        if ideal < end:
            stop = next((n for n in range(min(ideal + CHUNK // 2, end), max(ideal - CHUNK // 2, start) - 1, -1) if not lines[n - 1].strip()), ideal)
        out.append((start, stop))
        start = stop + 1
    return out


def gaps(lines: Sequence[str], spans: Sequence[Span]) -> list[Span]:
    """Chunks of the lines no span covers, without blank lines at their ends."""
    covered = bytearray(len(lines) + 2)
    for _, _, a, b in spans:
        covered[a : b + 1] = b"\x01" * (b + 1 - a)
    out, n = [], 1
    while n <= len(lines):
        if covered[n]:
            n += 1
            continue
        end = n
        while end < len(lines) and not covered[end + 1]:
            end += 1
        for a, b in split_gap(lines, n, end):
            while a <= b and not lines[a - 1].strip():
                a += 1
            while b >= a and not lines[b - 1].strip():
                b -= 1
            if a <= b:
                out.append(("chunk", None, a, b))
        n = end + 1
    return out


def fragment(text: str, path: str) -> tuple[str, list[Span]]:
    """The strategy that cut a file, and its fragments ``(kind, symbol, first line, last line)`` in order."""
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    if not any(x.strip() for x in lines):
        return "none", []
    ending = path.rpartition(".")[2].lower() if "." in path else ""
    ending = SAME.get(ending, ending)
    if ending in ("py", "pyi"):
        found = python_definitions(text)
    else:
        found = brace_definitions(lines, ending) if ending in BRACES else []
    if found:
        return "definitions", sorted({*found, *gaps(lines, found)}, key=lambda s: (s[2], -s[3], s[0]))
    if ending in ("md", "markdown", "mdx"):
        found = sections(lines, [i for i, x in enumerate(lines) if HEADING.match(x)], "section")
        if found:
            return "markdown", found
    if ending == "toml":
        starts = [i for i, x in enumerate(lines) if x.startswith("[")]
        return "toml", sections(lines, starts, "section") if len(starts) >= 2 else [("chunk", None, 1, len(lines))]
    if ending in BRACES or ending in ("py", "pyi"):
        return "gaps", gaps(lines, [])
    return "blocks", [("chunk", None, a + 1, min(a + BLOCK, len(lines))) for a in range(0, len(lines), BLOCK)]


def signature_end(lines: Sequence[str]) -> int:
    """Lines of a definition's head: decorators, then up to where its parameters are closed or its body opens."""
    bare = [STRING.sub("", x) for x in lines]
    i, depth = 0, 0
    while i < len(lines) and (depth > 0 or lines[i].lstrip().startswith(("@", "#["))):
        depth += bare[i].count("(") - bare[i].count(")")
        i += 1
    if i == len(lines):
        i = 0
    depth, seen = 0, False
    for k in range(i, len(lines)):
        depth += bare[k].count("(") - bare[k].count(")")
        seen = seen or "(" in bare[k]
        if depth <= 0 and (seen or bare[k].count("{") > bare[k].count("}")):
            return k + 1
    return min(i + 2, len(lines))


def excerpt(first: int, last: int, hunks: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows of a fragment around its hunks; one window where it saves enough, else several; none where nothing is saved."""
    inside = sorted((max(a, first), min(b, last)) for a, b in hunks if a <= last and b >= first)
    n = last - first + 1
    if not inside or n < PARENT:
        return []
    whole = (max(first, inside[0][0] - CONTEXT), min(last, max(b for _, b in inside) + CONTEXT))
    if whole[1] - whole[0] + 1 <= SHARE * n:
        return [whole]
    out: list[tuple[int, int]] = []
    for a, b in inside:
        a, b = max(first, a - CONTEXT), min(last, b + CONTEXT)
        if out and a - out[-1][1] - 1 < ELIDED:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out if sum(b - a + 1 for a, b in out) <= SHARE * n else []


def rendered(lines: Sequence[str], windows: Sequence[tuple[int, int]], first: int) -> str:
    """The lines of the windows, with a note for what lies between; ``first`` is the number of the first line."""
    out, at = [], None
    for a, b in windows:
        if at is not None:
            out.append(f"… [{a - at - 1} unchanged lines]")
        out += lines[a - first : b - first + 1]
        at = b
    return "\n".join(out)


def fragment_files(files: DataFrame) -> DataFrame:
    """``file, strategy, kind, symbol, start_line, end_line, signature_end`` of ``file, path, content``.

    ``signature_end`` is the last line of a definition's head (null below SIGNATURE_LEAST lines).  Null
    and blank contents have no fragments.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for file, path, text in zip(batch["file"], batch["path"], batch["content"]):
                if not text:
                    continue
                strategy, spans = fragment(text, path or "")
                lines = text.split("\n")
                for kind, symbol, a, b in spans:
                    head = a + signature_end(lines[a - 1 : b]) - 1 if b - a + 1 >= SIGNATURE_LEAST and kind in ("function", "class", "struct", "interface", "enum", "variable") else None
                    out.append((file, strategy, kind, symbol, a, b, head))
            frame = pd.DataFrame(out, columns=["file", "strategy", "kind", "symbol", "start_line", "end_line", "signature_end"])
            yield frame.astype({"signature_end": "Int64"})

    return files.select("file", "path", "content").mapInPandas(run, "file string, strategy string, kind string, symbol string, start_line int, end_line int, signature_end int")


def per_file_cap(frags: DataFrame, hunks: DataFrame, most: int = MOST) -> DataFrame:
    """At most ``most`` fragments of a file: those a hunk touches and resource headers stay, then the longest.

    ``frags`` are ``id, file, content, start_line, end_line``, ``hunks`` ``file, hs, he``.
    """
    from pyspark.sql import functions as F

    from weftline.operators.edges import binned
    from weftline.operators.order import top_per_group

    touched = binned(hunks.select("file", "hs", "he"), "hs", "he").join(binned(frags.select("id", "file", "start_line", "end_line"), "start_line", "end_line"), ["file", "bin"]).filter("start_line <= he and hs <= end_line").select("id").distinct()
    header = (F.size(F.split("content", "\n")) <= 2) & F.ltrim("content").rlike("^(apiVersion|kind|metadata):")
    kept = frags.join(touched.withColumn("touched", F.lit(True)), "id", "left").withColumn("keep", (F.coalesce("touched", F.lit(False)) | F.coalesce(header, F.lit(False))).cast("int"))
    return top_per_group(kept, "file", [F.desc("keep"), F.desc(F.col("end_line") - F.col("start_line")), F.asc("start_line"), F.asc("id")], most).select("id", "file", "keep", "rank")
