"""Column functions over paths, names and source text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A name: letter or underscore, then letters, marks, digits and connectors of any script.
IDENTIFIER = r"[A-Za-z_][\p{L}\p{M}\p{Nd}\p{Pc}]*"
# Path and name lists of the prior and predicates.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs")
PERIPHERAL_DIRS = (
    "examples", "example", "demo", "demos", "samples", "sample", "showcase", "docs", "doc", "documentation", "tutorials", "tutorial", "guides", "benchmarks", "benchmark", "perf", "bench",
    "playground", "sandbox", "scratch", "vendor", "third_party", "third-party", "node_modules", "external", "fixtures", "testdata", "test_data", "test-data", "__fixtures__", "__mocks__", "stories", "__stories__",
)
GENERATED_DIRS = ("generated", "__generated__", "auto_generated", "auto-generated", "autogen", "autogenerated", "_generated", ".generated", "gen")
PERIPHERAL_STEM = r"^(example_|demo_|sample_)|(_example|_demo|_sample)$"
# Importance caps.
GENERATED_CAP, PERIPHERAL_CAP, FULL = 0.10, 0.15, 1.0
# File extension to language.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "scala": "scala", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp",
    "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "sh": "shell", "bash": "shell", "sql": "sql", "lua": "lua", "pl": "perl", "r": "r", "jl": "julia", "hs": "haskell", "ex": "elixir",
    "erl": "erlang", "clj": "clojure", "dart": "dart", "zig": "zig", "nim": "nim", "ml": "ocaml", "nix": "nix", "md": "markdown", "rst": "rst", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json",
    "tf": "hcl", "css": "css", "scss": "scss", "html": "html", "proto": "protobuf", "graphql": "graphql", "env": "env", "properties": "properties",
}
# The eight credential shapes, in order.
SHAPES = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "github_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})\b",
    "slack_token": r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "openai_key": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{32,}\b",
}
# What a one-line version, tag or digest edit looks like.
MECHANICAL_LINE = (
    r"(?i)(^\s*(tag|version|rev|ref|sha|digest|image|newTag|newName|commit|checksum|integrity)\s*[:=])|(sha256:[0-9a-f]{12,})|(\bv?\d+\.\d+\.\d+([-+.][0-9A-Za-z.]+)?\b)|(\b[0-9a-f]{7,64}\b)"
)
COMMENT_LINE = r"^\s*(#|//|--|/\*|\*|<!--|;|%|\"\"\"|''')"


def identifiers(text: Column, least: int = 2) -> Column:
    """All names of a text in lower case, at least ``least`` characters, in order, with repeats."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda x: F.octet_length(x) >= least)


def canonical_key(name: Column) -> Column:
    """One spelling of a key: words split at case changes and other characters, lower case, joined by ``_``."""
    x = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    x = F.regexp_replace(x, r"([A-Z])([A-Z][a-z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def dotted_runs(key: Column, most: int = 6) -> Column:
    """All contiguous runs of up to ``most`` segments of a dotted key."""
    parts = F.split(key, r"\.")
    starts = F.sequence(F.lit(0), F.size(parts) - 1)
    return F.flatten(
        F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(parts) - i)), lambda n: F.array_join(F.slice(parts, i + 1, n), ".")))
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    """The path without its last segment; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def directories(path: Column) -> Column:
    return F.transform(F.filter(F.split(directory(path), "/"), lambda x: x != ""), F.lower)


def language(path: Column) -> Column:
    """Language of a path by its extension, ``other`` if unknown."""
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, extension(path)), F.lit("other"))


def is_test(path: Column) -> Column:
    """Test material: a test directory, or a marker that is a whole segment or a capitalised word of the stem."""
    name = stem(path)
    return (
        F.arrays_overlap(directories(path), F.array(*map(F.lit, TEST_DIRS)))
        | F.lower(name).rlike(r"(^|[_.\-])(test|tests|spec|specs|selftest|selftests)([_.\-]|$)")
        | name.rlike(r"(Test|Tests|Spec|Specs)$|^(Test|Tests|Spec|Specs)\p{Lu}")
    )


def is_generated_dir(path: Column) -> Column:
    return F.arrays_overlap(directories(path), F.array(*map(F.lit, GENERATED_DIRS)))


#: Ends of names that generators give.
GENERATED_NAMES = r"(?i)(\.pb\.go|_pb2\.py|_pb2_grpc\.py|\.pb\.h|\.pb\.cc|\.g\.dart|\.freezed\.dart|\.generated\.\w+|_generated\.\w+|\.gen\.\w+|\.designer\.cs|\.min\.js|\.min\.css|-lock\.json|\.lock)$"
#: Interpreters of a first line, to language.
INTERPRETERS = {"python": "python", "node": "javascript", "bash": "shell", "sh": "shell", "zsh": "shell", "ruby": "ruby", "perl": "perl", "php": "php", "lua": "lua", "rscript": "r", "julia": "julia", "elixir": "elixir"}
#: Categories of languages.
CATEGORIES = {
    "code": ("python", "javascript", "jsx", "typescript", "tsx", "rust", "go", "java", "kotlin", "scala", "c", "cpp", "csharp", "ruby", "php", "swift", "shell", "sql", "lua", "perl", "r", "julia", "haskell", "elixir", "erlang", "clojure", "dart", "zig", "nim", "ocaml", "nix"),
    "docs": ("markdown", "rst"), "config": ("yaml", "toml", "json", "hcl", "env", "properties"), "data": ("html", "css", "scss", "protobuf", "graphql"),
}


def sniffed_language(path: Column, text: Column) -> Column:
    """Language by extension, else by the interpreter of the first line, else ``other``."""
    word = F.regexp_extract(text, r"^#!\s*(?:\S*/)?(?:env\s+(?:-S\s+)?)?([A-Za-z]+)", 1)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in INTERPRETERS.items() for x in kv]), F.lower(word))
    named = language(path)
    return F.when(named != "other", named).otherwise(F.coalesce(known, F.lit("other")))


def category(lang: Column) -> Column:
    """Category of a language: code, docs, config, data or generic."""
    pairs = F.create_map(*[F.lit(x) for k, v in CATEGORIES.items() for name in v for x in (name, k)])
    return F.coalesce(F.try_element_at(pairs, lang), F.lit("generic"))


def is_generated(path: Column, text: Column) -> Column:
    """By the end of the name, a directory of the path, or the header."""
    return F.coalesce(file_name(path).rlike(GENERATED_NAMES), F.lit(False)) | F.coalesce(is_generated_dir(path), F.lit(False)) | F.coalesce(generated_header(text), F.lit(False))


def property_keys(name: Column) -> Column:
    """The keys a property answers to: its canonical form, and the one relaxed binding gives a variable (dots as underscores, no dashes)."""
    relaxed = canonical_key(F.replace(F.replace(F.lower(name), F.lit("."), F.lit("_")), F.lit("-"), F.lit("")))
    return F.filter(F.array_distinct(F.array(canonical_key(name), relaxed)), lambda k: F.length(k) >= 2)


def kafka_property(name: Column) -> Column:
    """The property an image's variable sets: the key without ``kafka_cfg_`` or ``kafka_``; null for other variables."""
    rest = F.regexp_extract(canonical_key(name), r"^kafka_(?:cfg_)?(.{3,})$", 1)
    return F.when(rest != "", rest)


def grouped_thousands(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.regexp_replace(n.cast("long").cast("string"), r"(\d)(?=(\d{3})+$)", "$1,")


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for unit, size in (("KB", 1024), ("MB", 1024**2), ("GB", 1024**3)):
        out = F.when(n >= size, F.concat(F.format_number(n / size, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def fnv1a64(text: str) -> int:
    """The 64-bit FNV-1a hash of a text, for values that have to be equal elsewhere."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def generated_header(text: Column, lines: int = 10) -> Column:
    """A generator's signature in the first lines; ``@generated`` not followed by a small letter."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    low = F.lower(head)
    return (
        (low.contains("do not edit") & low.contains("generat"))
        | low.rlike(r"@generated([^a-z]|$)")
        | low.rlike("code generated by|auto-generated|autogenerated|this file is generated|automatically generated|auto generated")
    )


def change_class(lines: Column, paths: Column) -> Column:
    """Class of a patch from its lines and its files: the first that holds.

    Generated if all its files are by name or directory; unknown without changed lines; layout if both
    sides are equal up to blank lines and white space at line ends; content if a run has more than one
    line of a side; mechanical if every line names a version, tag or digest; else unknown.
    """
    mark = lambda x: F.when(x.startswith("+") & ~x.startswith("+++"), "+").when(x.startswith("-") & ~x.startswith("---"), "-").otherwise(" ")
    marks = F.array_join(F.transform(lines, mark), "")
    side = lambda m: F.filter(F.transform(F.filter(lines, lambda x: mark(x) == m), lambda x: F.regexp_replace(F.substr(x, F.lit(2)), r"\s+$", "")), lambda x: x != "")
    changed = F.transform(F.filter(lines, lambda x: mark(x) != " "), lambda x: F.substr(x, F.lit(2)))
    written = F.forall(paths, lambda x: file_name(x).rlike(GENERATED_NAMES) | is_generated_dir(x))
    return (
        F.when((F.size(paths) > 0) & written, "generated")
        .when(~marks.rlike("[+-]"), "unknown")
        .when(side("-") == side("+"), "layout")
        .when(marks.rlike(r"\+\+|--"), "content")
        .when(F.forall(changed, lambda x: x.rlike(MECHANICAL_LINE)), "mechanical")
        .otherwise("unknown")
    )


def evidence_priority(change: Column) -> Column:
    """Content and unknown changes first, mechanical and layout ones next, generated ones last."""
    return F.when(change == "generated", 2).when(change.isin("mechanical", "layout"), 1).otherwise(0)


def importance(path: Column) -> Column:
    """Prior of a file: generated, then peripheral, else full."""
    peripheral = F.arrays_overlap(directories(path), F.array(*map(F.lit, PERIPHERAL_DIRS))) | F.lower(stem(path)).rlike(PERIPHERAL_STEM)
    return F.when(is_generated_dir(path), F.lit(GENERATED_CAP)).when(peripheral, F.lit(PERIPHERAL_CAP)).otherwise(F.lit(FULL))


def slug(heading: Column) -> Column:
    """Anchor of a heading."""
    x = F.regexp_replace(F.lower(F.trim(heading)), r"[^a-z0-9 _-]", "")
    return F.regexp_replace(x, r"[ _]+", "-")


def token_cost(text: Column, overhead: int = 40) -> Column:
    """Tokens a fragment costs without a tokenizer: a quarter of its bytes, at least 1, and the overhead."""
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(1)) + overhead


def redacted(text: Column) -> Column:
    """The text with each credential shape replaced by ``[REDACTED:<category>]``."""
    for category, pattern in SHAPES.items():
        text = F.regexp_replace(text, pattern, f"[REDACTED:{category}]")
    return text


def duration_seconds(window: Column) -> Column:
    """Seconds of a window such as ``24h``, ``90min``, ``1h30m``, ``2w``."""
    units = {"w": 604800, "d": 86400, "h": 3600, "m(?:in)?": 60, "s": 1}
    total = F.lit(0)
    for unit, seconds in units.items():
        found = F.regexp_extract(window, rf"(\d+){unit}(?![a-z])", 1)
        total = total + F.when(found != "", found.cast("long") * seconds).otherwise(0)
    return total
