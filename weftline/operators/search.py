"""Searches of many queries over a corpus: every score of a query is made in one task, and no pair is shuffled.

The corpus is cut by document into segments, each an inverted index (terms, their documents, their
counts) written once to the shared folder.  A task takes a block of queries and reads segment after
segment: what it holds is one segment and one number per document and query of the block, so neither
grows with the number of pairs.  Only results leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.ranking import AGREE_TOP, AGREEMENT, BLEND, K1, MIN_TERM, RRF_K, SMOOTH, B
from weftline.runtime import cut, written

# Documents of a segment, bytes of a block's scores, rows of a batch of results.
SEGMENT_DOCS, BLOCK_BYTES, BATCH = 25_000, 96_000_000, 1 << 17
SEGMENT = "first long, n long, tokens long, void boolean, docs binary, lengths binary, terms array<string>, dfs array<int>, at binary, tf binary"


@dataclass(frozen=True)
class Index:
    """Segments in the order of documents, each with its file and length, and the facts of the whole corpus."""

    segments: DataFrame
    files: tuple[tuple[str, int], ...]
    n: int
    mean: float
    void: bool  # the last document is the one without an id


def index(docs: DataFrame, key: str, text: str, least: int = MIN_TERM) -> Index:
    """The index of ``docs``; texts of one document count together, null texts not at all."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t"))
    count = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SEGMENT_DOCS))
    ranged = rows.repartitionByRange(count, F.col("doc").asc_nulls_last())
    segments = written(ranged.select("doc", X.identifiers(F.col("t"), least).alias("w")).mapInArrow(_segment, SEGMENT))
    # One row per segment.
    facts = sorted((r["void"], r["first"], r["n"], r["tokens"], r["file"]) for r in segments.select("first", "n", "tokens", "void", F.input_file_name().alias("file")).collect())
    n = sum(f[2] for f in facts)
    return Index(segments, tuple((f[4], f[2]) for f in facts), n, sum(f[3] for f in facts) / max(n, 1), any(f[0] for f in facts))


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a partition's documents: its terms in order, and for each the documents that hold it, in order."""
    codes: dict[str, int] = {}
    ids, held, words = [], [], []
    for b in batches:
        lists = b.column(1)
        coded = lists.flatten().dictionary_encode()
        into = np.array([codes.setdefault(w, len(codes)) for w in coded.dictionary.to_pylist()], np.int64)
        words.append(into[coded.indices.to_numpy(zero_copy_only=False)] if len(into) else np.zeros(0, np.int64))
        each = lists.value_lengths().to_numpy(zero_copy_only=False)
        doc = b.column(0)
        ids.append(np.repeat(doc.fill_null(0).to_numpy(zero_copy_only=False), each))
        held.append(np.repeat(doc.is_null().to_numpy(zero_copy_only=False), each))
    if not codes:
        return
    word, doc, null = np.concatenate(words), np.concatenate(ids), np.concatenate(held)
    docs, void = np.unique(doc[~null]), bool(null.any())
    at = np.searchsorted(docs, doc)
    if void:
        at[null], docs = len(docs), np.append(docs, 0)
    terms = sorted(codes)
    place = np.empty(len(terms), np.int64)
    place[[codes[t] for t in terms]] = np.arange(len(terms))
    pair, tf = np.unique(place[word] * len(docs) + at, return_counts=True)
    term = pair // len(docs)
    row = {
        "first": [int(docs[0])], "n": [len(docs)], "tokens": [len(word)], "void": [void], "docs": [docs.tobytes()], "lengths": [np.bincount(at, minlength=len(docs)).tobytes()], "terms": [terms],
        "dfs": [np.bincount(term, minlength=len(terms)).astype(np.int32)], "at": [(pair % len(docs)).astype(np.int32).tobytes()], "tf": [tf.astype(np.int32).tobytes()],
    }
    yield pa.RecordBatch.from_pydict(row)


def _read(uri: str, columns: list[str]) -> dict:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return {k: c.chunk(0)[0] for k, c in zip(columns, pyarrow.parquet.ParquetFile(fs.open_input_file(path)).read(columns).columns)}


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


class _Reader:
    """The vocabulary of the searches, and segments as a task reads them."""

    def __init__(self, files: tuple[tuple[str, int], ...], vocabulary: str, n: int, mean: float) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(vocabulary)
        table = pyarrow.dataset.dataset(path, filesystem=fs, format="parquet").to_table()
        self.files, self.mean, self.terms = files, mean, table["term"].combine_chunks()
        df = table["df"].to_numpy()
        self.idf = np.log(1 + (n - df + SMOOTH) / (df + SMOOTH))

    def codes(self, terms: pa.Array) -> np.ndarray:
        """Places of terms in the vocabulary; -1 of others."""
        return pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)

    def docs(self) -> np.ndarray:
        return np.concatenate([_array(_read(f, ["docs"])["docs"], np.int64) for f, _ in self.files])

    def segment(self, file: str) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of a query's terms, the places and weights of all their documents in this segment."""
        x = _read(file, ["lengths", "terms", "dfs", "at", "tf"])
        at, tf, dfs = _array(x["at"], np.int32).astype(np.intp), _array(x["tf"], np.int32), x["dfs"].values.to_numpy()
        code = self.codes(x["terms"].values)
        norm = K1 * (1 - B + B * _array(x["lengths"], np.int64) / self.mean)
        weight = np.repeat(np.where(code >= 0, self.idf[code], 0.0), dfs) * tf * (K1 + 1) / (tf + norm[at])
        ends = np.append(0, np.cumsum(dfs, dtype=np.int64))
        slot = np.full(len(self.idf), -1)
        slot[code[code >= 0]] = np.flatnonzero(code >= 0)

        def postings(query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = slot[query]
            cuts = [slice(a, b) for a, b in zip(ends[own[own >= 0]].tolist(), ends[own[own >= 0] + 1].tolist())]
            return (np.concatenate([at[c] for c in cuts]), np.concatenate([weight[c] for c in cuts])) if cuts else (at[:0], weight[:0])

        return postings


def _half_up(x: np.ndarray) -> np.ndarray:
    """Whole numbers; halves go up, as in the SQL (no value is negative)."""
    low = np.floor(x)
    return low + (x - low >= 0.5)


def _run(ix: Index, queries: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(reader, ids, codes)`` over shares of the queries ``query, term``; yields batches of ``schema``."""
    packed = cut(queries.groupBy("query").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    spark = packed.sparkSession
    wanted = packed.select(F.explode("terms").alias("term")).distinct()
    counts = ix.segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    vocabulary = written(counts.join(wanted, "term", "left_semi").select("term", "df"))
    folder = vocabulary.inputFiles()
    if not ix.files or not folder or not vocabulary.head(1):
        return spark.createDataFrame([], schema)
    files, where, n, mean = ix.files, folder[0].rpartition("/")[0], ix.n, ix.mean

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, reader = [], [], None
        for b in batches:
            reader = reader or _Reader(files, where, n, mean)
            ids += b.column(0).to_pylist()
            flat, ends = reader.codes(b.column(1).flatten()), np.append(0, np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False)))
            codes += [c[c >= 0] for c in (flat[a:z] for a, z in zip(ends[:-1], ends[1:]))]
        if reader:
            yield from work(reader, ids, codes)

    return packed.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(task, schema)


def best(ix: Index, queries: DataFrame) -> DataFrame:
    """``query, doc``: the document of the best score beside the query itself; of equal ones the least."""
    void = ix.void

    def work(reader: _Reader, ids: list[int], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        score, found = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)
        for k, (file, n) in enumerate(reader.files):
            docs, postings = _array(_read(file, ["docs"])["docs"], np.int64), reader.segment(file)
            real = n - (void and k == len(reader.files) - 1)
            for i, (q, c) in enumerate(zip(ids, codes)):
                sums = np.bincount(*postings(c), minlength=n)[:real]
                own = np.searchsorted(docs[:real], q)
                if own < real and docs[own] == q:
                    sums[own] = 0
                # Only sums within a rounding of the greatest can share its score.
                near = np.flatnonzero((sums > 0) & (sums >= sums.max(initial=0) - 2e-6))
                if len(near):
                    rounded = _half_up(sums[near] * 1e6)
                    top = rounded.argmax()
                    if rounded[top] > score[i]:
                        score[i], found[i] = rounded[top], docs[near[top]]
        has = score >= 0
        yield pa.RecordBatch.from_pydict({"query": np.array(ids, np.int64)[has], "doc": found[has]})

    return _run(ix, queries, work, "query long, doc long")


def _order(score: np.ndarray) -> np.ndarray:
    """Places by descending whole score, equal ones by place: one sort of numbers that hold both."""
    top, bits = int(score.max(initial=0)), len(score).bit_length()
    if top.bit_length() + bits < 63:
        return np.sort(((top - score.astype(np.int64)) << bits) + np.arange(len(score))) & ((1 << bits) - 1)
    return np.argsort(-score, kind="stable")


def _each(reader: _Reader, ids: list[int], codes: list[np.ndarray], counted: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Of each query its sums over all documents, and with ``counted`` the number of shared terms."""
    total = sum(n for _, n in reader.files)
    block = max(1, BLOCK_BYTES // (total * (12 if counted else 8)))
    for first in range(0, len(ids), block):
        own = codes[first : first + block]
        sums, shared, start = np.zeros((len(own), total)), np.zeros((len(own), total), np.int32) if counted else None, 0
        for file, n in reader.files:
            postings = reader.segment(file)
            for i, c in enumerate(own):
                at, weight = postings(c)
                sums[i, start : start + n] = np.bincount(at, weight, minlength=n)
                if counted:
                    shared[i, start : start + n] = np.bincount(at, minlength=n)
            start += n
        for i, q in enumerate(ids[first : first + block]):
            yield q, sums[i], shared[i] if counted else None


def _batches(query: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    count = len(columns["doc"])
    for a in range(0, count, BATCH):
        part = {k: c[a : a + BATCH] for k, c in columns.items()}
        yield pa.RecordBatch.from_pydict({"query": np.full(len(part["doc"]), query, np.int64)} | part)


def ranked(ix: Index, queries: DataFrame) -> DataFrame:
    """``query, doc, score, rank`` of every document that shares a term with a query."""
    void = ix.void

    def work(reader: _Reader, ids: list[int], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        docs = reader.docs()
        for q, sums, _ in _each(reader, ids, codes, False):
            at = np.flatnonzero(sums[: len(sums) - void])
            score = _half_up(sums[at] * 1e6)
            order = _order(score)
            yield from _batches(q, doc=docs[at[order]], score=score[order] / 1e6, rank=np.arange(1, len(at) + 1, dtype=np.int32))

    return _run(ix, queries, work, "query long, doc long, score double, rank int")


def _fused(ix: Index, queries: DataFrame, fuse: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Both channels of a query, scores and shared terms, through ``fuse``.

    A document without an id takes part in the second channel only, behind its equals, as the SQL joins no null.
    """
    void = ix.void

    def work(reader: _Reader, ids: list[int], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        docs = reader.docs()
        for q, sums, shared in _each(reader, ids, codes, True):
            at = np.flatnonzero(shared)
            score, count = _half_up(sums[at] * 1e6), shared[at]
            last = bool(void and len(at) and at[-1] == len(sums) - 1)
            out = fuse(score[: len(score) - last], count)
            yield from _batches(q, doc=pa.array(docs[at], mask=(at == len(sums) - 1) if last else None), score=_half_up(out * 1e8) / 1e8)

    return _run(ix, queries, work, "query long, doc long, score double")


def _reciprocal(score: np.ndarray) -> np.ndarray:
    """Reciprocal rank of each place."""
    out = np.empty(len(score))
    out[_order(score)] = 1.0 / (RRF_K + np.arange(1, len(score) + 1))
    return out


def _percentile(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of the other places with a lower score, and whether a place is near the top."""
    order, count = _order(score), len(score)
    part, near = np.zeros(count), np.zeros(count, bool)
    near[order[:AGREE_TOP]] = True
    if count > 1:
        held = score[order]
        # A run of equal scores has below it what follows its end.
        ends = np.append(np.flatnonzero(held[1:] != held[:-1]) + 1, count)
        part[order] = np.repeat((count - ends) / (count - 1), np.diff(ends, prepend=0))
    return part, near


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a`` filled up with zeros, plus ``b``."""
    return np.append(a, np.zeros(len(b) - len(a))) + b


def rrf(ix: Index, queries: DataFrame) -> DataFrame:
    """Reciprocal ranks of both channels added."""
    return _fused(ix, queries, lambda score, count: _plus(_reciprocal(score), _reciprocal(count)))


def pit(ix: Index, queries: DataFrame) -> DataFrame:
    """Percentiles of both channels blended, with a bonus where both have the document near their top."""

    def fuse(score: np.ndarray, count: np.ndarray) -> np.ndarray:
        (a, top), (b, most) = _percentile(score), _percentile(count)
        return _plus((1 - BLEND) * a, BLEND * b) + np.where(np.append(top, np.zeros(len(b) - len(a), bool)) & most, AGREEMENT, 0.0)

    return _fused(ix, queries, fuse)
