"""Mergeable percentiles with a deterministic rank error (problem 2).

A sketch is a set of sorted buffers of ``k`` values with a power-of-two weight, at most one of each
weight, and fewer than ``k`` raw values.  Two buffers of one weight collapse into one of twice the
weight by keeping every second value of their merged order (even and odd positions by turns).  A
collapse into weight W moves any rank by at most W / 2; the sketch adds these up, so its ``err`` is
a proven bound on the rank error of every answer, whatever the order of the merges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.runtime import parallelism

#: Values of a buffer.  The rank error is about log2(n / K) / (2 K) of n: below 0.5 % up to n = 10**9.
K = 2048
#: Sketches that one task of a merge round combines.
FAN_IN = 64
#: Rows a task gathers before it adds them to its sketches.
FLUSH_ROWS = 250_000
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


class Sketch:
    """State: count, error bound, minimum, maximum, raw tail, one optional buffer per level."""

    def __init__(self, k: int = K) -> None:
        import numpy as np

        self.k, self.n, self.err = k, 0, 0.0
        self.low, self.high = np.inf, -np.inf
        self.tail = np.empty(0)
        self.levels: dict[int, object] = {}

    def _carry(self, level: int, buffers: object) -> None:
        """Adds sorted buffers (rows) of a level and collapses pairs upward, a tree of equal weights."""
        import numpy as np

        while len(buffers):
            held = self.levels.pop(level, None)
            if held is not None:
                buffers = np.vstack([held[None, :], buffers])
            pairs = len(buffers) // 2
            if len(buffers) % 2:
                self.levels[level] = buffers[-1]
            if not pairs:
                return
            both = np.sort(buffers[: 2 * pairs].reshape(pairs, 2 * self.k), axis=1)
            # Positions 1, 3, ... and 2, 4, ... of the merged order by turns, so that shifts balance.
            odd = (np.arange(pairs) + level) % 2 == 1
            buffers = np.where(odd[:, None], both[:, 1::2], both[:, 0::2])
            level += 1
            self.err += pairs * 2.0 ** (level - 1)

    def add(self, values: object) -> Sketch:
        import numpy as np

        values = np.asarray(values, dtype=float)
        if not len(values):
            return self
        self.n += len(values)
        self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
        self._raw(values)
        return self

    def _raw(self, values: object) -> None:
        import numpy as np

        held = np.concatenate([self.tail, values])
        full = len(held) // self.k
        self.tail = held[full * self.k :]
        if full:
            self._carry(0, np.sort(held[: full * self.k].reshape(full, self.k), axis=1))

    def merge(self, other: Sketch) -> Sketch:
        if self.k != other.k:
            raise ValueError("sketches of different buffer sizes do not combine")
        self.n += other.n
        self.err += other.err
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for level in sorted(other.levels):
            self._carry(level, other.levels[level][None, :])
        self._raw(other.tail)
        return self

    def quantiles(self, qs: Sequence[float]) -> list[float]:
        """Values of rank ceil(q n), within ``err`` ranks; the extremes are exact."""
        import numpy as np

        if not self.n:
            return [None] * len(qs)
        values = np.concatenate([self.tail, *(self.levels[l] for l in sorted(self.levels))])
        weights = np.concatenate([np.ones(len(self.tail)), *(np.full(self.k, 2.0**l) for l in sorted(self.levels))])
        order = np.argsort(values, kind="stable")
        rank = np.cumsum(weights[order])
        out = []
        for q in qs:
            at = int(np.searchsorted(rank, np.ceil(q * self.n), side="left"))
            out.append(self.low if q <= 0 else self.high if q >= 1 else float(values[order][min(at, len(values) - 1)]))
        return out

    def row(self) -> tuple:
        import numpy as np

        levels = sorted(self.levels)
        flat = np.concatenate([self.tail, *(self.levels[l] for l in levels)])
        return self.n, self.err, float(self.low), float(self.high), len(self.tail), levels, flat

    @classmethod
    def of(cls, n: int, err: float, low: float, high: float, tail: int, levels: Sequence[int], flat: Sequence[float], k: int = K) -> Sketch:
        import numpy as np

        s = cls(k)
        s.n, s.err, s.low, s.high = int(n), float(err), float(low), float(high)
        flat = np.asarray(flat, dtype=float)
        s.tail = flat[: int(tail)]
        for i, level in enumerate(levels):
            s.levels[int(level)] = flat[int(tail) + i * k : int(tail) + (i + 1) * k]
        return s


STATE = "n bigint, err double, low double, high double, tail int, levels array<int>, flat array<double>"
FIELDS = ["n", "err", "low", "high", "tail", "levels", "flat"]


def sketch_partitions(long: DataFrame, keys: Sequence[str], value: str, k: int = K, salts: int = FAN_IN) -> DataFrame:
    """One sketch per partition and key of a long table; adds ``salt``, the partition's number modulo ``salts``.

    Nulls and NaN do not count.  Nothing is shuffled: this is the map side of the aggregation.
    """
    rows = long.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("__v"), F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int").alias("salt")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", salt int, " + STATE

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held: dict[tuple, Sketch] = {}
        waiting: dict[tuple, list] = {}
        salt, size = 0, 0

        def flush() -> None:
            import numpy as np

            for key, parts in waiting.items():
                held.setdefault(key, Sketch(k)).add(np.concatenate(parts))
            waiting.clear()

        for batch in batches:
            if not len(batch):
                continue
            salt = int(batch["salt"].iloc[0])
            for key, part in batch.groupby(list(keys), dropna=False, sort=False)["__v"]:
                waiting.setdefault(tuple(None if x is None or x != x else x for x in (key if isinstance(key, tuple) else (key,))), []).append(part.to_numpy())
            size += len(batch)
            if size >= FLUSH_ROWS:
                flush()
                size = 0
        flush()
        if held:
            yield pd.DataFrame([(*key, salt, *s.row()) for key, s in held.items()], columns=[*keys, "salt", *FIELDS])

    return rows.mapInPandas(run, schema)


def merge_sketches(parts: DataFrame, keys: Sequence[str], rounds: int = 1, k: int = K) -> DataFrame:
    """One sketch per key from sketches with a ``salt``; ``rounds`` of at most FAN_IN each.

    A key held by every partition is combined as a tree over its salts.  Salts are below
    FAN_IN**rounds, so that one sketch of a key is left whatever the number of partitions; sketches
    of one salt are read one after another and need no memory of their own.
    """
    names = list(keys)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        # Rows of a key lie together and in a fixed order, so one sketch at a time is held.
        at, total, out = None, None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                key = (*(None if x is None or x != x else x for x in r[: len(names)]), int(r.salt) // FAN_IN)
                if key != at:
                    if at is not None:
                        out.append((*at, *total.row()))
                    at, total = key, Sketch(k)
                total.merge(Sketch.of(r.n, r.err, r.low, r.high, r.tail, r.levels, r.flat, k))
                if len(out) >= 256:
                    yield pd.DataFrame(out, columns=[*names, "salt", *FIELDS])
                    out = []
        if at is not None:
            out.append((*at, *total.row()))
        if out:
            yield pd.DataFrame(out, columns=[*names, "salt", *FIELDS])

    parts = parts.select(*names, "salt", *FIELDS)
    schema = parts.schema
    for left in range(rounds - 1, -1, -1):
        group = F.floor(F.col("salt") / FAN_IN)
        parts = parts.repartition(*names, group) if left else parts.repartition(*names)
        parts = parts.sortWithinPartitions(*names, "salt", "n", "low", "high").mapInPandas(run, schema)
    return parts.drop("salt")


def merge_rounds(spark: SparkSession) -> int:
    """Rounds after which FAN_IN**rounds salts, as many as a shuffle has partitions, are one."""
    salts, rounds = parallelism(spark), 1
    while salts > FAN_IN:
        salts, rounds = -(-salts // FAN_IN), rounds + 1
    return rounds


def percentiles_of(sketches: DataFrame, keys: Sequence[str], qs: Sequence[float] = PERCENTILES, k: int = K) -> DataFrame:
    """The percentiles of sketches, with the proven rank error in rows and as a share of n."""
    names = [f"p{round(q * 100):02d}" for q in qs]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.select(*keys).schema)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                s = Sketch.of(r.n, r.err, r.low, r.high, r.tail, r.levels, r.flat, k)
                rows.append((*(getattr(r, c) for c in keys), s.n, s.low, *s.quantiles(qs), s.high, s.err, s.err / s.n if s.n else 0.0))
            yield pd.DataFrame(rows, columns=[*keys, "n", "low", *names, "high", "rank_error", "rank_error_share"])

    return sketches.mapInPandas(run, f"{schema}, n bigint, low double, {', '.join(x + ' double' for x in names)}, high double, rank_error double, rank_error_share double")


def latest(results: DataFrame, by: str = "result_id", columns: Sequence[str] = ("source_benchmark", "run_day", "used_tokens", "elapsed_seconds")) -> DataFrame:
    """One row per id, the one ingested last (ties: the greatest values); rows without an id all count."""
    picked = results.filter(F.col(by).isNotNull()).groupBy(by).agg(F.max_by(F.struct(*columns), F.struct("ingested_at", *columns)).alias("r")).select("r.*")
    return picked.unionByName(results.filter(F.col(by).isNull()).select(*columns))


def measures(rows: DataFrame) -> DataFrame:
    """Long form: benchmark, day, measure, value."""
    pair: Column = F.explode(
        F.array(
            F.struct(F.lit("used_tokens").alias("measure"), F.col("used_tokens").cast("double").alias("value")),
            F.struct(F.lit("elapsed_seconds").alias("measure"), F.col("elapsed_seconds").alias("value")),
        )
    )
    return rows.select("source_benchmark", "run_day", pair.alias("m")).select("source_benchmark", F.col("run_day").cast("string").alias("run_day"), "m.measure", "m.value")


def day_sketches(results: DataFrame, k: int = K) -> DataFrame:
    """One sketch per benchmark, day and measure, to be kept and combined later."""
    keys = ["source_benchmark", "run_day", "measure"]
    rounds = merge_rounds(results.sparkSession)
    parts = sketch_partitions(measures(latest(results)), keys, "value", k, FAN_IN**rounds)
    return merge_sketches(parts, keys, rounds, k)


def over_days(days: DataFrame, k: int = K) -> DataFrame:
    """The sketches of all days of a benchmark combined, as a tree over salts drawn from the day."""
    keys = ["source_benchmark", "measure"]
    salted = days.select(*keys, F.pmod(F.xxhash64("run_day"), F.lit(FAN_IN * FAN_IN)).cast("int").alias("salt"), *FIELDS)
    return merge_sketches(salted, keys, 2, k)
