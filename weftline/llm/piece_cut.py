"""Cutting oversized items at natural boundaries (problem 6).

Dynamic programming over boundary positions: a cut costs a penalty that is small at a paragraph or
an unindented line and large inside a word, a piece costs the square of its deviation from the even
size, no piece exceeds the limit, and each piece begins exactly the specified overlap before the
cut at which the previous one ends.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import small

#: Cut penalties: blank line before, line at column 0, per indent step, sentence end, space, anywhere else.
PARAGRAPH, LINE, INDENT, SENTENCE, SPACE, ANYWHERE = 0.0, 0.15, 0.05, 1.0, 2.0, 6.0
#: Weight of the size imbalance against the penalties.
BALANCE = 1.0
SCHEMA_TAIL = "piece_no int, start_line bigint, end_line bigint, n_tokens bigint, overlap_bytes bigint, content string"


def tokens_of_bytes(n: int) -> int:
    """Size in tokens of n bytes: a quarter, rounded down, at least 1."""
    return max(n // 4, 1)


def boundaries(raw: bytes, reach: int) -> tuple[list[int], list[float]]:
    """Byte positions where a cut may lie, with penalties, ascending; the gaps stay below ``reach``.

    Lines come first; a gap between lines of ``reach`` bytes or more is filled with sentence ends
    and spaces, and what is still too wide with an even grid of code-point starts.
    """
    import re

    found: dict[int, float] = {}
    blank = True
    start = 0
    for line in raw.split(b"\n"):
        body = line.strip()
        if start and body:
            indent = len(line) - len(line.lstrip(b" \t"))
            found[start] = PARAGRAPH if blank and not indent else LINE + INDENT * min(indent, 16) - (0.1 if blank else 0.0)
        blank = not body
        start += len(line) + 1
    marks = sorted(found)
    for pattern, cost in ((rb"[.!?;:,]\s+|\xe3\x80\x82|\xef\xbc\x8c", SENTENCE), (rb"\s+", SPACE), (None, ANYWHERE)):
        edges, more = [0, *marks, len(raw)], []
        for a, b in zip(edges, edges[1:]):
            if b - a < reach:
                continue
            # Without any natural boundary all positions cost the same, and an even grid is enough.
            inside = range(a + reach // 4, b, reach // 4) if pattern is None else (a + m.end() for m in re.finditer(pattern, raw[a:b]))
            for p in inside:
                p = floor_char(raw, p)
                if a < p < b and p not in found:
                    found[p] = cost
                    more.append(p)
        marks = sorted([*marks, *more])
    return marks, [found[p] for p in marks]


def floor_char(raw: bytes, at: int) -> int:
    """The start of the code point that holds byte ``at``."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def overlap_bytes(max_tokens: int, overlap_tokens: int) -> int:
    """Bytes two pieces share: as specified, but never above half of the limit, so that pieces advance."""
    return min(4 * max(0, overlap_tokens), max((4 * max_tokens + 3) // 2 - 3, 0))


def cut_points(raw: bytes, max_tokens: int, overlap_tokens: int) -> list[int]:
    """The chosen cuts of a text whose size is above ``max_tokens``."""
    import numpy as np

    cap = 4 * max_tokens + 3
    overlap = overlap_bytes(max_tokens, overlap_tokens)
    # 3 more bytes may be needed so that the overlap begins at a code point.
    step = cap - overlap - 3 if overlap else cap
    # Positions closer than a code point's bytes to each other, where there is room for no more.
    marks, costs = boundaries(raw, max(4, step // 8))
    at = np.array([0, *marks, len(raw)], dtype=np.int64)
    price = np.array([0.0, *costs, 0.0])
    least = max(1, -(-(len(raw) - overlap) // step))
    even = len(raw) / least
    n = len(at)
    best = np.full(n, np.inf)
    best[0] = 0.0
    back = np.zeros(n, dtype=np.int64)
    # The first piece has no overlap in front of it and may use the whole cap.
    lo = 0
    for j in range(1, n):
        while at[j] - at[lo] > (cap if lo == 0 else step):
            lo += 1
        if at[j] < overlap and j < n - 1:
            # The next piece would begin before the text.
            continue
        size = at[j] - at[lo:j]
        total = best[lo:j] + BALANCE * ((size - even) / even) ** 2
        k = int(total.argmin())
        best[j], back[j] = total[k] + price[j] + 0.001, lo + k
    cuts = []
    j = int(back[n - 1])
    while j > 0:
        cuts.append(int(at[j]))
        j = int(back[j])
    return cuts[::-1]


def pieces(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, str]]:
    """``(start byte, overlap bytes, piece)`` of a text; one piece if it is within the limit."""
    raw = text.encode("utf-8", "replace")
    if tokens_of_bytes(len(raw)) <= max_tokens:
        return [(0, 0, text)]
    overlap = overlap_bytes(max_tokens, overlap_tokens)
    cuts = cut_points(raw, max_tokens, overlap_tokens)
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(raw)]):
        begin = floor_char(raw, max(0, a - overlap)) if a else 0
        out.append((begin, a - begin, raw[begin:b].decode("utf-8")))
    return out


def oversized(fragments: DataFrame, limits: DataFrame, profile: str | None = None) -> DataFrame:
    """Fragments above a profile's limit, once per id and profile; of several deliveries the latest text counts.

    Deliveries without a text are none; of two with one time the larger text counts.  A profile named
    twice counts with its larger limit, one without a limit above 0 is none, a null overlap is 0.
    Texts that no profile can find too large are not shuffled, only their sizes.
    """
    wanted = limits if profile is None else limits.filter(F.col("profile") == profile)
    wanted = wanted.filter("max_tokens > 0").groupBy("profile").agg(F.max(F.struct("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens"))).alias("l")).select("profile", "l.*")
    # One row of the least limit.
    least = wanted.agg(F.min("max_tokens").alias("least"))
    size = F.greatest(F.floor(F.octet_length("content") / 4), F.lit(1))
    rows = fragments.select("fragment_id", "start_line", "content", "ingested_at").filter(F.col("content").isNotNull()).withColumn("size", size)
    rows = rows.join(F.broadcast(least)).withColumn("content", F.when(F.col("size") > F.col("least"), F.col("content")))
    last = rows.groupBy("fragment_id").agg(F.max_by(F.struct("start_line", "content", "size"), F.struct("ingested_at", "size", "content", "start_line")).alias("row")).select("fragment_id", "row.*")
    # The table of limits is a handful of rows: a broadcast nested loop over one pass, behind the size check.
    return last.join(small(wanted), F.col("size") > F.col("max_tokens")).select("fragment_id", "profile", "start_line", "content", "max_tokens", "overlap_tokens")


def cut_pieces(over: DataFrame) -> DataFrame:
    """Pieces of every row of ``oversized``: number, lines, size, bytes shared with the piece before, text.

    ``start_line`` is the line on which the piece begins, ``end_line`` the one of its last
    character; a null start line counts as 1.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for fid, profile, first, text, limit, overlap in zip(batch.fragment_id, batch.profile, batch.start_line, batch.content, batch.max_tokens, batch.overlap_tokens):
                raw = text.encode("utf-8", "replace")
                line = 1 if first is None or first != first else int(first)
                seen, counted = 0, line
                for number, (begin, shared, piece) in enumerate(pieces(text, int(limit), max(0, int(overlap) if overlap == overlap else 0)), 1):
                    counted += raw.count(b"\n", seen, begin)
                    seen = begin
                    size = len(piece.encode())
                    last = counted + piece.count("\n", 0, len(piece) - 1)
                    out.append((fid, profile, number, counted, last, tokens_of_bytes(size), shared, piece))
            yield pd.DataFrame(out, columns=["fragment_id", "profile", "piece_no", "start_line", "end_line", "n_tokens", "overlap_bytes", "content"])

    return over.mapInPandas(run, "fragment_id bigint, profile string, " + SCHEMA_TAIL)
