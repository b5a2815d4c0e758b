"""Files that are not hand-written source of their repository (problem 1).

Layout statistics of a file - mean and longest line, white space, alphanumeric share, digit share,
numeric literals per line, long encoded runs - are summed over its fragments and set against the
thresholds of its language.  What layout cannot show is decided after it: places and names by path,
the banner in the leading comment, lines in a generator's idiom.  Only numbers are shuffled, and the
sums are partly made before the shuffle, so a file of any number of fragments is one small row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.runtime import cut, small, spread

#: A banner counts in the leading comment of a file, however long, and in its first lines.
BANNER_LINES = 12
LEADING = re.compile(r"\s*(?:$|//|#|/\*|\*|--|<!--|;|%|\"\"\"|''')")
MARK = r"^\s*(?://+|#+|/\*+!?|--+|\*+|<!--|;+|%+|\"\"\"|''')\s*!?\s*"
# How generators sign their output.
BANNER = re.compile(
    MARK
    + r"(?:@generated\b(?! by hand)|<auto-?generated|(?:code|file|source) (?:was )?(?:automatically |auto-?)?generated (?:by|from)|auto-?generated\b|automatically generated\b|"
    r"this (?:file|code|source) (?:was|is|has been) (?:an? )?(?:automatically |auto-?|machine )generated|this is an? (?:auto-?|automatically |machine )generated|"
    r"machine[ -]generated|generated (?:by|from) \S+|do not edit\b(?! by hand only)|output of \S+ v?[\d.]+, checked in|"
    r"(?:diese datei wurde )?automatisch (?:erzeugt|generiert)|(?:ce fichier .{0,30})?(?:généré automatiquement|automatiquement généré)|"
    r"(?:este archivo .{0,30})?generado automáticamente|(?:este (?:arquivo|ficheiro) .{0,30})?gerado automaticamente|(?:plik .{0,30})?(?:wygenerowany automatycznie|automatycznie wygenerowany)|"
    r"(?:этот )?файл (?:создан|сгенерирован) автоматически|автоматически сгенерирован|[^。]{0,60}(?:自动生成|自動生成))",
    re.I,
)
# How copies of other projects are announced.
COPIED = re.compile(
    MARK
    + r"(?:(?:vendored|imported verbatim|copied verbatim|copied unchanged|taken verbatim) from\b|\S+ v?\d[\w.]*,? (?:- )?(?:copied from upstream|bundled copy)|"
    r"license:.{0,40}\(c\) .{0,40}contributors)",
    re.I,
)
HOLDER = re.compile(MARK + r"copyright \(c\) [\d, -]+ the (\S+) authors", re.I)
# Lines that only generators write.
IDIOM = re.compile(
    r"_descriptor\.\w*Descriptor\(|\bproto\.(?:get|set)Field\(|\.prototype\.(?:get|set)\w+ = function|bitField\d+_ (?:\|=|&=)|^\s*onChanged\(\);|^\s*if m != nil \{|"
    r"^\s*type=\d+, (?:label|cpp_type)|^\s*return m\.\w+$|^func \(\w+ \*\w+\) Get\w+\(\)|has_default(?:_value)?=(?:False|True)|^\s*(?:public )?Builder set\w+\(",
    re.M,
)
LOCK = re.compile(r"\"lockfileVersion\"|^\[\[package\]\]$|^# yarn lockfile", re.M)
SNAPSHOT = re.compile(r"^exports\[`.*`\] = `", re.M)
LITERAL = re.compile(r"(?<![\w.])[0-9][\w.]*")
ENCODED = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
PEM = re.compile(r"-----BEGIN |ssh-(?:rsa|ed25519) ")

# Places of generated files, copies and bundles, by path.
GENERATED_PATH = (
    r"(^|/)(autogen|generated-sources|generated-test-sources|__generated__|generated|codegen/out|gen|__snapshots__)/|"
    r"(_pb2|_pb2_grpc)\.pyi?$|[._]pb\.(go|js|cc|h|ts)$|\.pb\.gw\.go$|[._]generated\.\w+$|[._]gen\.(go|js|ts|rs|py|c|java)$|Grpc\.java$|\.tab\.[ch]$|_string\.go$|\.g\.(dart|cs)$|\.designer\.cs$|\.snap$|"
    r"(^|/)(package-lock|npm-shrinkwrap)\.json$|(^|/)(yarn|poetry|Cargo|uv|Pipfile|composer|Gemfile|pdm|flake|mix)\.lock$|(^|/)pnpm-lock\.yaml$|(^|/)go\.sum$"
)
COPIED_PATH = (
    r"(^|/)(vendor|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|jspm_packages|site-packages|dist-packages|Godeps/_workspace|"
    r"_vendor|_vendored|vendored|extern|externals?|contrib/bundled|deps|Pods|Carthage)/"
)
MINIFIED_PATH = r"(\.|-|_)min\.(js|mjs|cjs|css)$|(\.|-)bundle\.(js|mjs|cjs|css)$"

#: Thresholds per extension: greatest mean line, least white space, greatest alphanumeric and digit share, numeric
#: literals per line, share of encoded runs.  They lie above what hand-written files of the language reach and were
#: read from the statistics of a labelled sample of 8,614 files (the smallest margin is a fifth).
LIMITS: dict[str, tuple[float, float, float, float, float, float]] = {
    "py": (160, 0.06, 0.86, 0.20, 1.0, 0.70), "pyi": (160, 0.06, 0.86, 0.20, 1.0, 0.70), "js": (140, 0.09, 0.86, 0.20, 1.0, 0.60), "mjs": (140, 0.09, 0.86, 0.20, 1.0, 0.60), "cjs": (140, 0.09, 0.86, 0.20, 1.0, 0.60),
    "jsx": (140, 0.09, 0.86, 0.20, 1.0, 0.60), "ts": (140, 0.09, 0.86, 0.20, 0.9, 0.60), "tsx": (140, 0.09, 0.86, 0.20, 0.9, 0.60), "css": (140, 0.09, 0.90, 0.30, 9.0, 0.60), "go": (140, 0.08, 0.85, 0.20, 0.8, 0.50),
    "rs": (140, 0.06, 0.87, 0.20, 1.2, 0.70), "java": (140, 0.05, 0.82, 0.20, 0.8, 0.60), "c": (100, 0.08, 0.80, 0.20, 1.0, 0.45), "h": (100, 0.08, 0.80, 0.20, 1.0, 0.45), "cc": (100, 0.08, 0.80, 0.20, 1.0, 0.45),
    "cpp": (100, 0.08, 0.80, 0.20, 1.0, 0.45), "hpp": (100, 0.08, 0.80, 0.20, 1.0, 0.45), "sql": (160, 0.08, 0.86, 0.20, 1.6, 0.45), "json": (90, 0.07, 0.86, 0.30, 2.0, 0.70), "lock": (400, 0.0, 1.0, 0.30, 9.0, 0.40),
}
#: Of a language without a row: other code, and everything that is no code, where no layout says anything.
OTHER = (140, 0.08, 0.88, 0.22, 1.5, 0.60)
OTHER_CODE = ("cs", "rb", "php", "swift", "kt", "scala", "lua", "pl", "r", "sh")
#: A longest line that stands for the mean one where the mean is half as high, and the least size of a file whose shares count.
LONGEST, LEAST_CHARS, LEAST_LINES = 500, 400, 20
#: Least share and number of lines in a generator's idiom.
IDIOM_SHARE, IDIOM_LINES = 0.2, 6

SUMS = ("chars", "feeds", "lines", "spaces", "alnum", "digits", "literals", "encoded", "idiom")
MOSTS = ("longest", "banner", "copied", "lock", "snapshot", "pem")


def measure(text: str, first: int, repo: str) -> tuple:
    """The statistics of one fragment, in the order of SUMS and MOSTS."""
    import numpy as np

    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    digits = int(count[48:58].sum())
    alnum = digits + int(count[65:91].sum() + count[97:123].sum() + count[0xC3:0xF5].sum())
    spaces = int(count[9:14].sum() + count[32])
    lines = text.split("\n")
    longest = max(map(len, lines))
    encoded = sum(len(x) for x in ENCODED.findall(text)) if longest >= 40 else 0
    idiom = len(IDIOM.findall(text))
    banner = copied = 0
    if first <= BANNER_LINES:
        name = repo.rpartition("/")[2].lower()
        for k, line in enumerate(lines, max(first, 1)):
            if k > BANNER_LINES and not LEADING.match(line):
                break
            if BANNER.match(line):
                banner = 1
            elif COPIED.match(line):
                copied = 1
            elif (m := HOLDER.match(line)) and f"license-{m.group(1).lower()}" in line.lower() and m.group(1).lower() != name:
                copied = 1
    return (
        len(raw), len(lines) - 1, sum(1 for x in lines if x and not x.isspace()), spaces, alnum, digits, len(LITERAL.findall(text)) if digits else 0, encoded, idiom,
        longest, banner, copied, int(bool(LOCK.search(text))), int(bool(SNAPSHOT.search(text))), int("-----BEGIN " in text or "ssh-" in text and bool(PEM.search(text))),
    )


def file_statistics(fragments: DataFrame) -> DataFrame:
    """One row of statistics per ``(repo, path)``.

    A fragment delivered twice weighs twice, which leaves shares and maxima as they are.  Null and
    empty contents have no part; a file with nothing else has no row.  A null repo or path is a
    value like any other.
    """
    fields = [*SUMS, *MOSTS]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for repo, path, first, text in zip(batch["repo"], batch["path"], batch["start_line"], batch["content"]):
                if text:
                    out.append((repo, path, *measure(text, 1 if first is None or first != first else int(first), repo or "")))
            yield pd.DataFrame(out, columns=["repo", "path", *fields])

    rows = spread(fragments.select("repo", "path", "start_line", "content"))
    measured = rows.mapInPandas(run, "repo string, path string, " + ", ".join(f"{f} bigint" for f in fields))
    return measured.groupBy("repo", "path").agg(*[F.sum(f).alias(f) for f in SUMS], *[F.max(f).alias(f) for f in MOSTS])


def layout(extension: Column) -> Column:
    """What the layout of a file says by the thresholds of its language: minified, data, generated or null."""
    rows = F.create_map(*[x for e, limits in LIMITS.items() for x in (F.lit(e), F.array(*[F.lit(float(v)) for v in limits]))])
    limits = F.coalesce(F.try_element_at(rows, extension), F.when(extension.isin(*OTHER_CODE), F.array(*[F.lit(float(v)) for v in OTHER])))
    limit = lambda k: F.element_at(limits, k)
    solid = F.greatest(F.col("chars") - F.col("spaces"), F.lit(1))
    mean, space, alnum = F.col("chars") / (F.col("feeds") + 1), F.col("spaces") / F.col("chars"), F.col("alnum") / F.col("chars")
    sized, digits, encoded = F.col("chars") >= LEAST_CHARS, F.col("digits") / solid, F.col("encoded") / solid
    minified = (space < limit(2)) & ((mean > limit(1)) | ((F.col("longest") > LONGEST) & (mean > limit(1) / 2)))
    data = sized & ((digits >= limit(4)) | (F.col("pem") == 0) & ((encoded >= limit(6)) | (alnum >= limit(3)) & (encoded >= limit(6) / 2)))
    many = (F.col("lines") >= LEAST_LINES) & (F.col("literals") >= limit(5) * F.col("lines"))
    locked = extension.isin("json", "lock")
    return F.when(minified & locked, "generated").when(minified, "minified").when(data & ~locked, "data").when(data | many, "generated")


def reason() -> Column:
    """Why a file is not hand-written source, as ``kind`` and ``shown_by`` (layout, path, banner, idiom); null if it is.

    Layout comes first; path, banner and idiom decide where it says nothing.
    """
    extension = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    code = extension.isin(*OTHER_CODE, *(e for e in LIMITS if e not in ("json", "lock")))
    path = F.coalesce(F.col("path"), F.lit(""))
    idiom = (code & (F.col("idiom") >= IDIOM_LINES) & (F.col("idiom") >= IDIOM_SHARE * F.col("lines"))) | (extension.isin("json", "lock", "yaml") & (F.col("lock") > 0)) | ((F.col("snapshot") > 0) & ~code)
    said = lambda kind, by: F.struct(F.lit(kind).alias("kind"), F.lit(by).alias("shown_by"))
    shape = layout(extension)
    return (
        F.when(shape.isNotNull(), F.struct(shape.alias("kind"), F.lit("layout").alias("shown_by")))
        .when(F.col("copied") > 0, said("copied", "banner"))
        .when(F.col("banner") > 0, said("generated", "banner"))
        .when(idiom, said("generated", "idiom"))
        .when(path.rlike(COPIED_PATH), said("copied", "path"))
        .when(path.rlike(GENERATED_PATH), said("generated", "path"))
        .when(path.rlike(MINIFIED_PATH), said("minified", "path"))
    )


def not_hand_written(fragments: DataFrame) -> DataFrame:
    """``repo, path, kind, shown_by`` of every file that is not hand-written source of its repo."""
    return file_statistics(fragments).select("repo", "path", reason().alias("r")).filter("r is not null").select("repo", "path", "r.*")


def hand_written(fragments: DataFrame) -> DataFrame:
    """The fragments, all columns, of the files that are hand-written.

    The names of the files to drop are written once, and broadcast if they are few; else both sides are shuffled.
    """
    out = small(cut(not_hand_written(fragments).select(F.col("repo").alias("__repo"), F.col("path").alias("__path"))))
    return fragments.join(out, F.col("repo").eqNullSafe(F.col("__repo")) & F.col("path").eqNullSafe(F.col("__path")), "left_anti")
