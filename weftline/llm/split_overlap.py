"""Same and near-same records across splits (problem 3).

Texts are normalised to words and each word to three characters of a small alphabet, so that an
automaton's nodes have few branches and a match is a run of whole words.
Exact copies are one class.  A word and its number among the same words of its text make an element,
so that the elements two texts share bound their common word sequence from above.  Of each text
the part PREFIX with the rarest elements is held: two texts that agree by NEAR share a number of
those which their lengths give, so counting shared elements loses no pair.  Texts meet in blocks of
one field and range of lengths, and every candidate is confirmed by the length of its longest
common word sequence.

Of confirmed pairs an Aho-Corasick automaton over all passages of the evaluation text scans the
training text, and the matched runs are merged into the coverage of each evaluation record.

Words have one of 729,000 codes: two words of one code count as one.  A pair of unequal words agrees
by chance with 1.4e-6, whatever the size of the corpus, far below what moves an agreement of 3/4.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.runtime import cut, small, written

FIELDS = ("problem_statement", "gold_patch")
TRAIN, EVAL = "calibration", ("validation", "test")
#: Least agreement: twice the common sequence over the words of both texts.
NEAR = 0.75
#: Share of a text's elements that is held; any share above 0.4 (1 - NEAR / (2 - NEAR)) is exact, a larger
#: one leaves fewer candidates.
PREFIX = 0.6
#: Words of a passage whose matches make the coverage of an evaluation text.
PASSAGE = 5
#: Same words of a text are numbered apart up to NUMBERED, and counted apart over the corpus up to COUNTED.
NUMBERED, COUNTED = 4096, 8
#: Texts of a block of the training and the evaluation side.
TRAIN_BLOCK, EVAL_BLOCK = 10_000, 100_000
#: Elements a worker holds while it counts.
COUNT_ROWS = 4_000_000
#: A word is three of BASE characters from FIRST on; words of one code count as one word.
FIRST, BASE, WIDTH = 33, 90, 3
CODES = BASE**WIDTH
#: Normalisation: letters, digits and underscores make words; scripts without spaces go by character.
WORDS = r"[぀-ヿ㐀-鿿豈-﫿]|[^\W぀-ヿ㐀-鿿豈-﫿]+"


def prefix_words(n: int) -> int:
    """Elements held of a text of n words."""
    return math.ceil(PREFIX * n - 1e-9)


def length_class(n: Column) -> Column:
    """Texts that agree by NEAR are in the same or neighbouring classes."""
    return F.floor(F.log((2 - NEAR) / NEAR, n) + 1e-9).cast("int")


def common_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over the first text."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def agreement(a: str, b: str) -> float:
    """Share of the words of two coded texts that agree in order."""
    x, y = ([t[i : i + WIDTH] for i in range(0, len(t), WIDTH)] for t in (a, b))
    return 2 * common_length(x, y) / (len(x) + len(y)) if x or y else 0.0


def word_code(word: str) -> str:
    """Three characters for a word."""
    from zlib import crc32

    h = crc32(word.encode("utf-8", "replace")) % CODES
    return chr(FIRST + h // (BASE * BASE)) + chr(FIRST + h // BASE % BASE) + chr(FIRST + h % BASE)


def numbers(codes: str) -> object:
    """The codes of a text as integers."""
    import numpy as np

    c = np.frombuffer(codes.encode("ascii"), dtype=np.uint8).astype(np.int64).reshape(-1, WIDTH) - FIRST
    return (c[:, 0] * BASE + c[:, 1]) * BASE + c[:, 2]


def coded(records: DataFrame, fields: tuple[str, ...] = FIELDS, keep: tuple[str, ...] = ("instance_id",)) -> DataFrame:
    """``keep, field, key, n, codes`` for each non-empty text; ``key`` identifies the field and all its words."""
    source = records.select(*keep, *[F.col(f).cast("string") for f in fields])
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("field", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("codes", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import re
        import pyarrow as pa

        split, known = re.compile(WORDS).findall, {}

        def code(text: str) -> str:
            out = []
            for w in split(text.lower()):
                c = known.get(w)
                if c is None:
                    if len(known) >= 150_000:
                        known.clear()
                    c = known[w] = word_code(w)
                out.append(c)
            return "".join(out)

        for batch in batches:
            # Slices keep only a few texts at a time as Python strings.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for k, field in enumerate(fields, len(keep)):
                    coded_texts = [code(t) if t else "" for t in part.column(k).to_pylist()]
                    rows = pa.array([i for i, c in enumerate(coded_texts) if c], pa.int64())
                    held = [c for c in coded_texts if c]
                    sizes = [len(c) // WIDTH for c in held]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i).take(rows) for i in range(len(keep))), pa.array([field] * len(held), pa.string()), pa.array(sizes, pa.int32()), pa.array(held, pa.string())],
                        names=[*keep, "field", "n", "codes"],
                    )

    rows = source.mapInArrow(run, schema)
    return rows.withColumn("key", F.xxhash64("field", "codes"))


def elements(code: object) -> tuple:
    """The words of a text in order of code, and the number of each among its like."""
    import numpy as np

    held = np.sort(code)
    starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
    return held, np.arange(len(held)) - np.repeat(starts, np.diff(np.r_[starts, len(held)]))


def element_counts(classes: DataFrame) -> bytes:
    """How often each code and number (from COUNTED on as one) occurs, as 32-bit integers.

    The table is as long as there are codes, whatever the size of the corpus.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        held = np.zeros(CODES * COUNTED, dtype=np.int64)
        for batch in batches:
            for text in batch["codes"]:
                word, number = elements(numbers(text))
                # Places below the last number occur once in a text.
                first = number < COUNTED - 1
                held[word[first] * COUNTED + number[first]] += 1
                np.add.at(held, word[~first] * COUNTED + COUNTED - 1, 1)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"at": at, "n": held[at]})

    import numpy as np

    counts = classes.select("codes").mapInPandas(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(CODES * COUNTED, dtype=np.int32)
    table[counts["at"].to_numpy()] = np.minimum(counts["n"].to_numpy(), 2**20)
    return table.tobytes()


def prefixes(classes: DataFrame, counts: object) -> DataFrame:
    """``key, field, n, is_train, is_eval, ids``: the rarest elements of each class as 32-bit integers."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        often = np.frombuffer(counts.value, dtype=np.int32)
        for batch in batches:
            ids = []
            for text in batch["codes"]:
                word, number = elements(numbers(text))
                # Any total order would do; the rarest first leave the fewest candidates.
                order = often[word * COUNTED + np.minimum(number, COUNTED - 1)].astype(np.int64) << 42 | word << 22 | number
                size = prefix_words(len(word))
                first = np.argpartition(order, size - 1)[:size] if size < len(word) else np.arange(len(word))
                # Numbers beyond NUMBERED share an id, which can only add to what is counted.
                ids.append((word[first] * NUMBERED + np.minimum(number[first], NUMBERED - 1)).astype(np.uint32).tobytes())
            batch["ids"] = ids
            yield batch[["key", "field", "n", "is_train", "is_eval", "ids"]]

    return classes.select("key", "field", "n", "is_train", "is_eval", "codes").mapInPandas(run, "key bigint, field string, n int, is_train boolean, is_eval boolean, ids binary")


def candidates(evals: object, trains: object) -> object:
    """Pairs of one block that share as many held elements as texts which agree by NEAR must.

    Of the elements of texts of n and m words at least need = NEAR / 2 * (n + m) are shared, so at most n - need
    and m - need are not.  The side whose held part ends first in the common order has all the shared ones of
    that part within the other's part.
    """
    import numpy as np
    import pandas as pd

    names = ["eval_key", "train_key"]
    if not len(evals) or not len(trains):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
    trains = trains.sort_values("n")
    ids = [np.frombuffer(x, dtype=np.uint32) for x in trains["ids"]]
    flat = np.concatenate(ids)
    by_id = np.argsort(flat, kind="stable")
    holders = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])[by_id]
    known, starts = np.unique(flat[by_id], return_index=True)
    ends = np.r_[starts[1:], len(flat)]
    del flat, by_id, ids
    keys, m = trains["key"].to_numpy(), trains["n"].to_numpy().astype(np.int64)
    held_m = np.ceil(PREFIX * m - 1e-9)
    out, last = [], None
    evals = evals.sort_values("n")
    for key, n, raw in zip(evals["key"], evals["n"], evals["ids"]):
        if n != last:
            # What depends on the lengths alone is worked out once for each; the fitting lengths lie together.
            need = np.ceil(NEAR / 2 * (n + m) - 1e-9)
            fit = np.flatnonzero(need <= np.minimum(n, m))
            low, high = (int(fit[0]), int(fit[-1]) + 1) if len(fit) else (0, 0)
            need = need[low:high]
            least = np.maximum(1, np.minimum(prefix_words(n) - (n - need), held_m[low:high] - (m[low:high] - need))).astype(np.int64)
            last = n
        if low == high:
            continue
        mine = np.frombuffer(raw, dtype=np.uint32)
        at = np.searchsorted(known, mine)
        at = at[known[np.minimum(at, len(known) - 1)] == mine]
        shared, parts, size = None, [], 0
        for a, b in zip(starts[at].tolist(), ends[at].tolist()):
            parts.append(holders[a:b])
            size += b - a
            if size >= COUNT_ROWS:
                counted = np.bincount(np.concatenate(parts), minlength=len(m))
                shared, parts, size = counted if shared is None else shared + counted, [], 0
        if parts:
            counted = np.bincount(np.concatenate(parts), minlength=len(m))
            shared = counted if shared is None else shared + counted
        if shared is None:
            continue
        found = keys[low:high][shared[low:high] >= least]
        out += [(key, k) for k in found.tolist() if k != key]
    return pd.DataFrame(out, columns=names).astype("int64")


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """``eval_key, train_key`` of classes (``key, field, n, codes, is_train, is_eval``) that may agree by NEAR; none that does is left out."""
    spark = classes.sparkSession
    counts = spark.sparkContext.broadcast(element_counts(classes))
    texts = written(prefixes(classes, counts).withColumn("range", length_class(F.col("n"))))
    # As many rows as there are fields and ranges of lengths.
    sizes = texts.filter("is_train").groupBy("field", "range").agg(F.ceil(F.count("*") / TRAIN_BLOCK).cast("int").alias("parts"))
    evals = max(1, -(-texts.filter("is_eval").count() // EVAL_BLOCK))
    part = F.pmod(F.col("key"), F.lit(evals)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    train = texts.filter("is_train").join(F.broadcast(sizes), ["field", "range"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("eval_part", each(F.lit(evals)))
    near = texts.filter("is_eval").withColumn("eval_part", part).withColumn("range", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)))
    near = near.join(F.broadcast(sizes), ["field", "range"]).withColumn("part", each(F.col("parts")))
    block = ["field", "range", "part", "eval_part"]
    # Both sides come from one table; new columns keep them apart.
    sides = [x.select(*[F.col(c).alias(c) for c in (*block, "key", "n", "ids")]) for x in (near, train)]
    return sides[0].groupBy(*block).cogroup(sides[1].groupBy(*block)).applyInPandas(candidates, "eval_key bigint, train_key bigint")


def near_pairs(classes: DataFrame) -> DataFrame:
    """``eval_key, train_key, agree``: pairs of different classes whose words agree by NEAR or more."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            batch["agree"] = [agreement(a, b) for a, b in zip(batch["a"], batch["b"])]
            yield batch[batch["agree"] >= NEAR][["eval_key", "train_key", "agree"]]

    pairs = cut(candidate_pairs(classes))
    a = classes.filter("is_eval").select(F.col("key").alias("eval_key"), F.col("codes").alias("a"))
    b = classes.filter("is_train").select(F.col("key").alias("train_key"), F.col("codes").alias("b"))
    return pairs.join(a, "eval_key").join(b, "train_key").select("eval_key", "train_key", "a", "b").mapInPandas(run, "eval_key bigint, train_key bigint, agree double")


def commit_name(raw: Column) -> Column:
    """A commit in lower case, or null for what names none: no hex digits, fewer than 7, or all zero."""
    c = F.regexp_extract(F.lower(F.trim(raw)), r"^(?:commit\s*[:=]?\s*|sha1?\s*[:=-]\s*|.*/commit/)?([0-9a-f]{7,64})$", 1)
    return F.when((c != "") & ~c.rlike("^0+$"), c)


def same_commits(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a commit, and ``tc, ec`` of training and evaluation commits that are the same; an abbreviation names what it begins."""
    named = records.select("instance_id", "is_train", commit_name(F.col("base_commit")).alias("c")).filter("c is not null").distinct()
    t = named.filter("is_train").select(F.col("c").alias("tc")).distinct().withColumn("p", F.substring("tc", 1, 7))
    e = named.filter("not is_train").select(F.col("c").alias("ec")).distinct().withColumn("p", F.substring("ec", 1, 7))
    return named, t.join(e, "p").filter(F.col("tc").startswith(F.col("ec")) | F.col("ec").startswith(F.col("tc"))).select("tc", "ec")


def commit_pairs(records: DataFrame) -> DataFrame:
    """``eval_id, train_id`` of records whose commits are the same."""
    named, same = same_commits(records)
    return (
        same.join(named.filter("is_train").select(F.col("c").alias("tc"), F.col("instance_id").alias("train_id")), "tc")
        .join(named.filter("not is_train").select(F.col("c").alias("ec"), F.col("instance_id").alias("eval_id")), "ec")
        .select("eval_id", "train_id")
    )


def commit_hits(records: DataFrame) -> DataFrame:
    """``instance_id`` of the evaluation records whose commit is also a training record's."""
    named, same = same_commits(records)
    return named.filter("not is_train").join(same.select(F.col("ec").alias("c")).distinct(), "c").select("instance_id").distinct()


def text_classes(instances: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``instance_id, is_train, key`` and classes of equal texts ``key, field, n, codes, is_train, is_eval``."""
    texts = coded(instances.select("instance_id", *FIELDS)).join(small(splits), "instance_id")
    texts = written(texts.select("instance_id", "is_train", "field", "key", "n", "codes"))
    classes = written(
        texts.groupBy("key").agg(F.first("field").alias("field"), F.first("n").alias("n"), F.first("codes").alias("codes"), F.max("is_train").alias("is_train"), F.max(~F.col("is_train")).alias("is_eval"))
    )
    return texts.select("instance_id", "is_train", "key").distinct(), classes


def sides(manifest: DataFrame) -> DataFrame:
    """``instance_id, is_train`` of the records in a split."""
    return manifest.filter(F.col("split").isin(TRAIN, *EVAL) & F.col("instance_id").isNotNull()).select("instance_id", (F.col("split") == TRAIN).alias("is_train")).distinct()


def class_pairs(classes: DataFrame) -> DataFrame:
    """``eval_key, train_key`` of classes that agree; a class with members on both sides agrees with itself."""
    same = classes.filter("is_train and is_eval").select(F.col("key").alias("eval_key"), F.col("key").alias("train_key"))
    return near_pairs(classes).select("eval_key", "train_key").unionByName(same)


def overlaps(instances: DataFrame, manifest: DataFrame) -> DataFrame:
    """``eval_id, train_id`` of all records of an evaluation split that are also in the training split.

    Records in no split take no part; null and empty texts agree with nothing; repeated deliveries
    count once.  Copies are compared as one class and only written out as pairs at the end.
    """
    splits = sides(manifest)
    members, classes = text_classes(instances, splits)
    by_text = (
        class_pairs(classes)
        .join(members.filter("not is_train").select(F.col("key").alias("eval_key"), F.col("instance_id").alias("eval_id")), "eval_key")
        .join(members.filter("is_train").select(F.col("key").alias("train_key"), F.col("instance_id").alias("train_id")), "train_key")
        .select("eval_id", "train_id")
    )
    return by_text.unionByName(commit_pairs(instances.select("instance_id", "base_commit").join(small(splits), "instance_id"))).distinct()


def matched_runs(a: str, b: str, words: int = PASSAGE) -> list[tuple[int, int]]:
    """Runs of words ``[start, end)`` of coded text ``a`` whose passages an automaton over all of them finds in ``b``, merged."""
    import ahocorasick

    n = len(a) // WIDTH
    k = min(words, n)
    places: dict[str, list[int]] = {}
    for i in range(n - k + 1):
        places.setdefault(a[i * WIDTH : (i + k) * WIDTH], []).append(i)
    automaton = ahocorasick.Automaton()
    for passage in places:
        automaton.add_word(passage, passage)
    automaton.make_automaton()
    # A match counts where a word begins.
    hits = {p for end, p in automaton.iter(b) if (end + 1) % WIDTH == 0}
    out: list[tuple[int, int]] = []
    for i in sorted(i for p in hits for i in places[p]):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], i + k)
        else:
            out.append((i, i + k))
    return out


def class_coverage(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``eval_key, field, n, covered, partners``: words of an evaluation class that lie in passages of the training classes it agrees with.

    Pairs are scanned one by one and their runs joined by counting distinct words, so an evaluation
    text with any number of partners is in no one task.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(k, t, s, e) for k, t, a, b in zip(batch["eval_key"], batch["train_key"], batch["a"], batch["b"]) for s, e in ([(0, len(a) // WIDTH)] if a == b else matched_runs(a, b))]
            yield pd.DataFrame(rows, columns=["eval_key", "train_key", "s", "e"])

    a = classes.filter("is_eval").select(F.col("key").alias("eval_key"), F.col("codes").alias("a"))
    b = classes.filter("is_train").select(F.col("key").alias("train_key"), F.col("codes").alias("b"))
    runs = pairs.join(a, "eval_key").join(b, "train_key").select("eval_key", "train_key", "a", "b").mapInPandas(run, "eval_key bigint, train_key bigint, s int, e int")
    words = runs.select("eval_key", F.explode(F.sequence("s", F.col("e") - 1)).alias("at")).distinct().groupBy("eval_key").agg(F.count("*").alias("covered"))
    partners = pairs.groupBy("eval_key").agg(F.count("*").alias("partners"))
    return classes.filter("is_eval").select(F.col("key").alias("eval_key"), "field", "n").join(partners, "eval_key").join(words, "eval_key", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def record_overlap(instances: DataFrame, manifest: DataFrame) -> DataFrame:
    """``instance_id, split, source_benchmark, by_commit, coverage, partners`` of each evaluation record that is also in training.

    ``coverage`` is the greatest share of one of its texts that lies in passages of the training texts
    it agrees with (null if only the commit is the same), ``partners`` the number of such texts.
    Nothing is written out in pairs of records: a record overlaps if its class does.
    """
    splits = sides(manifest)
    members, classes = text_classes(instances, splits)
    held = class_coverage(classes, cut(class_pairs(classes))).select(F.col("eval_key").alias("key"), (F.col("covered") / F.col("n")).alias("coverage"), "partners")
    by_text = members.filter("not is_train").join(held, "key").groupBy("instance_id").agg(F.max("coverage").alias("coverage"), F.sum("partners").alias("partners"))
    by_commit = commit_hits(instances.select("instance_id", "base_commit").join(small(splits), "instance_id")).withColumn("by_commit", F.lit(True))
    once = instances.groupBy("instance_id").agg(F.max_by("source_benchmark", F.struct("ingested_at", "source_benchmark")).alias("source_benchmark"))
    rows = manifest.filter(F.col("split").isin(*EVAL)).select("instance_id", "split").distinct().join(once, "instance_id")
    hit = by_text.join(by_commit, "instance_id", "full")
    return rows.join(hit, "instance_id").select("instance_id", "split", "source_benchmark", F.coalesce("by_commit", F.lit(False)).alias("by_commit"), F.round("coverage", 6).alias("coverage"), F.coalesce("partners", F.lit(0)).alias("partners"))


def found_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs as ``instance_a < instance_b``."""
    return pairs.filter("eval_id <> train_id").select(F.least("eval_id", "train_id").alias("instance_a"), F.greatest("eval_id", "train_id").alias("instance_b")).distinct()


def overlap_report(instances: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per evaluation split and benchmark: records, records that are also in training, and how much of their texts on average."""
    once = instances.groupBy("instance_id").agg(F.max_by("source_benchmark", F.struct("ingested_at", "source_benchmark")).alias("source_benchmark"))
    rows = manifest.filter(F.col("split").isin(*EVAL)).select("instance_id", "split").distinct().join(once, "instance_id")
    hit = record_overlap(instances, manifest).select("instance_id", F.lit(1).alias("hit"), "coverage")
    return rows.join(hit, "instance_id", "left").groupBy("split", "source_benchmark").agg(
        F.count("*").alias("pool_before_dedup"), F.count("hit").alias("pool_dropped_by_contamination"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )
