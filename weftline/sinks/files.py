"""Writing results: one file put in place at once, line files by partitions, phases of a run."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame


def write_atomically(path: str, lines: Iterator[str] | list[str]) -> int:
    """Writes lines to a file that appears whole or not at all; bytes written.

    The text goes to a file beside it, is forced to the disk and takes the name in one step; a failure
    leaves what was there.
    """
    folder = os.path.dirname(os.path.abspath(path))
    handle, beside = tempfile.mkstemp(dir=folder, prefix=f".{os.path.basename(path)}.")
    size = 0
    try:
        with os.fdopen(handle, "wb") as f:
            for line in lines:
                size += f.write((line + "\n").encode())
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise
    return size


def write_document(rows: DataFrame, path: str, order: tuple[str, ...] = ("ord", "line"), column: str = "line") -> int:
    """The lines of a document in order as one file; rows come one partition at a time."""
    return write_atomically(path, (r[0] for r in rows.orderBy(*order).select(column).toLocalIterator()))


def write_lines(rows: DataFrame, folder: str, column: str = "line") -> None:
    """A text file per partition, put in place by Spark's committer."""
    rows.select(column).write.mode("overwrite").text(folder)


class Phases:
    """Times of the phases of a run, as one JSON line."""

    def __init__(self, run: str) -> None:
        self.run, self.spent = run, {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Adds the time inside the block to a phase."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.spent[name] = self.spent.get(name, 0.0) + (time.perf_counter() - began) * 1000

    def line(self) -> str:
        return json.dumps({"run": self.run, "phases_ms": {k: round(v, 1) for k, v in self.spent.items()}, "total_ms": round(sum(self.spent.values()), 1)})
