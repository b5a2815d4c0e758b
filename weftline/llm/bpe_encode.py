"""Corpus encoding with a public byte-level BPE vocabulary (problem 7).

Every pre-token is merged through a *hierarchical-bitmap rank queue*: one bucket of linked-list
positions per merge rank, three levels of 64-bit words above the buckets, find-first-set to pick
the lowest occupied rank, and stale entries skipped when popped.  A pre-token of n bytes costs
O(n log n) at worst, so a megabyte without white space is no special case.

Pre-tokens repeat, so each worker keeps a bounded table of finished ones.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabulary files, the same on every executor.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split over ASCII alone, where the classes can be written out for a faster matcher.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""
#: Finished pre-tokens a worker remembers, and the longest one worth remembering (characters).
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48


class RankQueue:
    """Merges by lowest rank, then leftmost position, for ranks below 64**3.

    ``buckets[rank]`` is one position, or a heap of several.  A bit of ``leaf`` says that a bucket
    is occupied, a bit of ``mid`` that a word of ``leaf`` is not zero, a bit of ``top`` the same of
    ``mid``.  All are empty again when a merge has ended, so one queue serves all pre-tokens.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.text = {r: t for t, r in ranks.items()}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}
        self.buckets: dict[int, int | list[int]] = {}
        self.leaf, self.mid = [0] * 4096, [0] * 64

    def learn(self, key: int) -> int:
        """The rank of a pair of ids seen for the first time, or -1."""
        if len(self.pairs) >= 4 * CACHE_ENTRIES:
            self.pairs.clear()
        found = self.pairs[key] = self.ranks.get(self.text[key >> 18] + self.text[key & 0x3FFFF], -1)
        return found

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        pairs, learn, buckets, leaf, mid, top = self.pairs.get, self.learn, self.buckets, self.leaf, self.mid, 0
        byte = self.byte
        parts = [byte[x] for x in piece]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n
        new = [(i, parts[i] << 18 | parts[i + 1]) for i in range(n - 1)]
        while True:
            for i, key in new:
                rank = pairs(key)
                if rank is None:
                    rank = learn(key)
                pair[i] = rank
                if rank < 0:
                    continue
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = i
                    a = rank >> 6
                    b = rank >> 12
                    leaf[a] |= 1 << (rank & 63)
                    mid[b] |= 1 << (a & 63)
                    top |= 1 << b
                elif type(held) is int:
                    buckets[rank] = [held, i] if held < i else [i, held]
                else:
                    heappush(held, i)
            if not top:
                break
            b = (top & -top).bit_length() - 1
            word = mid[b]
            a = b << 6 | (word & -word).bit_length() - 1
            word = leaf[a]
            rank = a << 6 | (word & -word).bit_length() - 1
            held = buckets[rank]
            if type(held) is int:
                i = held
            else:
                i = heappop(held)
            if type(held) is int or not held:
                del buckets[rank]
                leaf[a] = word = word & word - 1
                if not word:
                    mid[b] = word = mid[b] & mid[b] - 1
                    if not word:
                        top &= top - 1
            new = []
            if pair[i] != rank:  # stale
                continue
            j = after[i]
            k = after[i] = after[j]
            parts[i] = rank
            parts[j] = pair[j] = pair[i] = -1
            if k < n:
                before[k] = i
                new.append((i, rank << 18 | parts[k]))
            h = before[i]
            if h >= 0:
                new.append((h, parts[h] << 18 | rank))
        return tuple(p for p in parts if p >= 0)


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file as bytes -> rank; the rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes texts as a public tokenizer does, without special tokens."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import re

        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.lines = re.compile(r"(?<=\S)(?=\n)").split
        self.split_ascii = re.compile(ASCII_PATTERN).findall if pattern == PATTERN else self.split
        self.queue = RankQueue(self.ranks)
        self.known: dict[str, tuple[int, ...]] = {}

    def split_mixed(self, text: str) -> list[str]:
        """No pre-token holds a line feed after anything but white space, so lines can be split alone."""
        out: list[str] = []
        for line in self.lines(text):
            out += self.split_ascii(line) if line.isascii() else self.split(line)
        return out

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        get, add = self.known.get, ids.extend
        for piece in self.split_ascii(text) if text.isascii() else self.split_mixed(text):
            found = get(piece)
            if found is None:
                found = self.queue.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= CACHE_CHARS:
                    if len(self.known) >= CACHE_ENTRIES:
                        self.known.clear()
                    self.known[piece] = found
            add(found)
        return ids


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    kept = sys.__dict__.setdefault("_weftline_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode_column(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), counts_only: bool = False, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}"
) -> DataFrame:
    """``keep`` columns plus ``ids`` (array<int>), or ``n_tokens`` if ``counts_only``.

    A null or empty text gives an empty list (0).  A text is always encoded whole.  Rows map one to
    one, in the partitions they came in: there is no shuffle.
    """
    source = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    out_field = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    schema = T.StructType([*(source.schema[c] for c in keep), out_field])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            if counts_only:
                done = pa.array([len(enc.encode(t)) for t in texts], pa.int64())
            else:
                lists = [np.asarray(enc.encode(t), dtype=np.int32) for t in texts]
                ends = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
                done = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], done], names=[*keep, out_field.name])

    return source.mapInArrow(run, schema)
