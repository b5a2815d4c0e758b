"""Text decoded with the wrong character encoding (problem 9).

A garbled passage was written in one encoding and read in another: a chain.  Every record gets the
log-likelihood ratio of each chain against sound text, from the validity of its UTF-8 sequences and
from a character model counted over the whole corpus.  Expectation-maximization estimates how often
each chain occurs in each source, so that weak evidence counts more where a chain is common, and a
record is called and restored by its posterior.

The E-step needs only how many records of a source have which rounded ratios of their chains; this
histogram is all that is gathered, so the size of an EM task does not grow with the corpus.
"""

from __future__ import annotations

import html
import math
import re
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import cut, small, spread

#: Least posterior of a garbled record, rounds of EM, and the prior count of a chain in a source.
POSTERIOR, ROUNDS, PRIOR = 0.5, 25, 0.01
#: Ratios are rounded to 1 / STEP and clipped to +-LIMIT nats.
STEP, LIMIT = 2, 400.0
#: The EM sees a record's greatest ratio as at most this many nats: such a record is certain anyway.
PATTERN = 30.0

# Chains of a UTF-8 text read as something else, and of one legacy encoding read as another.
UTF8_READ_AS = ("latin", "cp1251", "cp1250", "koi8_r", "cp437", "cp850", "mac_roman", "cp866")
UTF8_READ_AS_WIDE = ("gbk", "cp932", "euc_kr", "big5")
SINGLE = (
    ("cp1251", "latin"), ("koi8_r", "latin"), ("cp1250", "latin"), ("iso8859_2", "latin"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"),
    ("latin", "cp1251"), ("latin", "cp1250"), ("mac_roman", "latin"), ("latin", "mac_roman"), ("cp437", "latin"), ("latin", "cp437"), ("cp1251", "cp866"), ("cp866", "latin"), ("cp850", "latin"),
)
WIDE = ("euc_jp", "cp932", "gbk", "euc_kr", "big5")
LOSSY = "lossy"
#: Mean log probability of a character below which the legacy chains are tried on a line.
POOR = -2.9
#: Least gain per character of a legacy chain, and the weight of single characters in the model.
GAIN, BACKOFF = 0.35, 5.0
#: What the evidence of a run of neighbouring words must exceed, and the words kept by a worker.
RUN_LEAST, KNOWN_WORDS = 5.0, 100_000
#: Evidence of one valid multi-byte sequence: how much rarer it is in sound text.
SEQUENCE = 4.0

UTF8_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
PLAUSIBLE = re.compile(r"[ -ſƒˆ˜Ș-țЀ-џҐґ‐-›€№™←-⇿∀-⋿⌀-⏿─-➿　-ヿ一-鿿가-힣＀-￯\U0001f300-\U0001faff]")
QUOTED = re.compile(r"`([^`\n]{1,40})`|\"([^\"\n]{1,40})\"|'([^'\n]{1,40})'|“([^”\n]{1,40})”|«([^»\n]{1,40})»")
ESCAPE = re.compile(r"&#(?:\d{2,6}|x[0-9a-fA-F]{2,5});|&[A-Za-z]{2,8}\d{0,2};|\\u00[0-9a-fA-F]{2}|\\x[89a-fA-F][0-9a-fA-F]")
CJK = re.compile(r"[　-ヿ一-鿿가-힣！-～]")
WORD = re.compile(r"[A-Za-z\x80-џҐґ–-⁄€№™ˆ˜ƒ]*[\x80-џҐґƒˆ˜€™‚„†‡‰][A-Za-z\x80-џҐґ–-⁄€№™ˆ˜ƒ]*")
WIDE_RUN = re.compile(r"[⺀-鿿가-힣豈-﫿＀-￯-　-ヿ€�]{2,}")
#: One wide character in a Latin word: an accented letter read as half of something else.
INSIDE_WORD = re.compile(r"(?<=[A-Za-z])[一-鿿가-힣](?![⺀-鿿가-힣豈-﫿])")
INSIDE = 5.0
LOST = re.compile(r"(?<=[^\W\d_])�|�(?=[^\W\d_])|�{2,}")


def bytes_of(codec: str) -> dict[int, int]:
    """Code point -> byte of a single-byte encoding above ASCII; undefined bytes stand for themselves.

    ``latin`` takes the characters of both usual Western encodings.
    """
    table: dict[int, int] = {}
    for b in range(128, 256):
        if codec == "latin":
            table[b] = b
        try:
            table[ord(bytes([b]).decode("cp1252" if codec == "latin" else codec))] = b
        except UnicodeDecodeError:
            table[b] = b
    return table


def chars_of(codec: str) -> list[str]:
    """Byte -> character; the inverse of ``bytes_of``."""
    out = [chr(b) for b in range(256)]
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode("cp1252" if codec == "latin" else codec)
        except UnicodeDecodeError:
            pass
    return out


def unescape(text: str) -> str:
    """Entities and backslash escapes of characters beyond ASCII as these characters."""
    if "&" not in text and "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        s = m.group()
        plain = html.unescape(s) if s[0] == "&" else chr(int(s[-2:], 16))
        return plain if ord(plain[0]) > 127 and len(plain) == 1 else s

    return ESCAPE.sub(one, text)


class Detector:
    """Evidence and repair under a character model; one per worker process."""

    def __init__(self, model: dict[str, int]) -> None:
        self.model = model
        self.first: dict[str, int] = {}
        self.second: dict[str, int] = {}
        for pair, n in model.items():
            if len(pair) == 2:
                self.first[pair[0]] = self.first.get(pair[0], 0) + n
                self.second[pair[1]] = self.second.get(pair[1], 0) + n
        self.pairs = sum(self.first.values()) + 1
        self.total = sum(n for x, n in model.items() if len(x) == 1) or 1
        self.bytes = {c: bytes_of(c) for c in {"latin", *UTF8_READ_AS, *(w for _, w in SINGLE)}}
        self.runs = {c: re.compile("[" + "".join(re.escape(chr(x)) for x in sorted(self.bytes[c])) + "]{2,}") for c in UTF8_READ_AS}
        self.single = {(t, w): {c: chars_of(t)[b] for c, b in self.bytes[w].items()} for t, w in SINGLE}
        self.memo: dict[str, float] = {}
        self.known: dict[str, tuple[float, dict]] = {}
        self.not_latin = re.compile("[^\\x00-\\x7f" + "".join(re.escape(chr(x)) for x in sorted(self.bytes["latin"])) + "]+")

    def score(self, word: str) -> float:
        """Log probability of a word's characters under the model of pairs."""
        total = 0.0
        for a, b in zip(" " + word, word + " "):
            pair = a + b
            p = self.memo.get(pair)
            if p is None:
                # Pairs never seen fall back on how often the second character occurs at all.
                alone = (self.second.get(b, 0) + 0.01) / self.pairs
                p = self.memo[pair] = math.log((self.model.get(pair, 0) + BACKOFF * alone) / (self.first.get(a, 0) + BACKOFF))
            total += p
        return total

    def wide_score(self, text: str) -> float:
        return sum(math.log((self.model.get(c, 0) + 0.05) / self.total) + 10.5 for c in CJK.findall(text))

    def utf8_runs(self, text: str, codec: str) -> list[tuple[int, int, str, float]]:
        """``start, end, restored, evidence`` of runs that are UTF-8 read in a single-byte encoding."""
        out = []
        table = self.bytes[codec]
        for m in self.runs[codec].finditer(text):
            run = m.group()
            raw = bytes(table[ord(c)] for c in run)
            hits = [(x.start(), x.end(), x.group().decode("utf-8", "replace")) for x in UTF8_SEQUENCE.finditer(raw)]
            hits = [h for h in hits if PLAUSIBLE.match(h[2]) or 0x80 <= ord(h[2][0]) < 0xA0]
            if not hits or sum(b - a for a, b, _ in hits) < 0.6 * len(raw):
                continue
            evidence = sum(SEQUENCE + 2.0 * (b - a - 2) for a, b, _ in hits)
            if codec != "latin":
                # In these readings some sequences are also usual neighbours in sound text.
                evidence += min(0.0, 0.8 * (self.score(raw.decode("utf-8", "replace")) - self.score(run)))
            restored, at = "", 0
            for a, b, s in hits:
                restored += run[at:a] + s
                at = b
            out.append((m.start(), m.end(), restored + run[at:], evidence))
        return out

    def utf8_wide(self, text: str, codec: str) -> list[tuple[int, int, str, float]]:
        """The same for UTF-8 read in a multi-byte encoding of East Asia."""
        out = []
        for m in WIDE_RUN.finditer(text):
            raw = b"".join(b"\xff" if c == "�" else c.encode(codec, "ignore") or b"\xff" for c in m.group())
            hits = [x.group().decode("utf-8", "replace") for x in UTF8_SEQUENCE.finditer(raw)]
            good = "".join(h for h in hits if PLAUSIBLE.match(h))
            size = len(good.encode())
            if size < 3 or size < 0.55 * len(raw.replace(b"\xff", b"")):
                continue
            gain = self.wide_score(good) / max(1, len(good)) - self.wide_score(m.group()) / len(m.group())
            evidence = (1.5 * len(good) if size > 4 else 1.0) + min(6.0, max(-6.0, gain)) * min(len(good), 6) / 2
            out.append((m.start(), m.end(), raw.replace(b"\xff", b"").decode("utf-8", "replace"), evidence))
        for m in INSIDE_WORD.finditer(text):
            letter = m.group().encode(codec, "ignore").decode("utf-8", "ignore")
            if len(letter) == 1 and "À" <= letter <= "ſ":
                out.append((m.start(), m.end(), letter, INSIDE if text[m.end() : m.end() + 1].isalpha() else INSIDE / 2))
        return sorted(out)

    def examples(self, text: str) -> str:
        """The text without quoted strings whose restored form is quoted as well: those are examples."""
        spans = [(m.start(), m.end(), next(g for g in m.groups() if g is not None)) for m in QUOTED.finditer(text)]
        if len(spans) < 2:
            return text
        have = {s for _, _, s in spans}
        for a, b, s in reversed(spans):
            if s.isascii():
                continue
            for codec in UTF8_READ_AS:
                runs = self.utf8_runs(s, codec)
                if runs:
                    fixed = s
                    for x, y, r, _ in reversed(runs):
                        fixed = fixed[:x] + r + fixed[y:]
                    if fixed in have or fixed in text.replace(s, ""):
                        text = text[:a] + " " * (b - a) + text[b:]
                        break
        return text

    def gains(self, word: str) -> tuple[float, dict[tuple[str, str], float]]:
        """Score of a word, and what each legacy chain that changes it would gain."""
        held = self.known.get(word)
        if held is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            before = self.score(word)
            changed = ((pair, word.translate(table)) for pair, table in self.single.items())
            held = self.known[word] = before, {pair: self.score(x) - before for pair, x in changed if x != word}
        return held

    def lines(self, text: str) -> list[tuple[int, str, list[str], float, bool]]:
        """``start, line, words, score, poor`` of lines beyond ASCII; poor ones the model finds improbable as a whole."""
        out, at = [], 0
        for line in text.split("\n"):
            if not line.isascii():
                words = WORD.findall(line)
                n = sum(map(len, words)) + len(words)
                total = sum(self.gains(w)[0] for w in words)
                if n:
                    out.append((at, line, words, total, total / n < POOR))
            at += len(line) + 1
        return out

    def passages(self, words: list[str], pair: tuple[str, str]) -> list[tuple[int, int, float]]:
        """``first, last, gain`` of the runs of neighbouring words that gain most under a chain and enough for their size."""
        out, total, best, first, last = [], 0.0, 0.0, 0, -1
        for i, w in enumerate([*words, None]):
            if w is not None:
                g = self.gains(w)[1].get(pair, 0.0)
                if total <= 0:
                    if g <= 0:
                        continue
                    total, best, first, last = 0.0, 0.0, i, i - 1
                total += g
                if total > best:
                    best, last = total, i
            if best > 0 and (w is None or total <= 0 or total < best - RUN_LEAST):
                # A run ends where sound words take back more than chance would.
                if best > GAIN * sum(len(x) + 1 for x in words[first : last + 1]) and 0.7 * best > RUN_LEAST:
                    out.append((first, last, best))
                total, best = 0.0, 0.0
        return out

    def stretches(self, line: str) -> list[tuple[int, int]]:
        """Parts of a line between letters that are not of the latin encodings."""
        out, at = [], 0
        for m in [*self.not_latin.finditer(line), None]:
            end = m.start() if m else len(line)
            if end > at and not line[at:end].isascii():
                out.append((at, end))
            at = m.end() if m else end
        return out

    def evidence(self, text: str) -> dict[str, float]:
        """``chain -> log-likelihood ratio`` against sound text; chains without any are left out."""
        text = unescape(text)
        if text.isascii():
            return {}
        plain = self.examples(text)
        out: dict[str, float] = {}

        def add(chain: str, x: float) -> None:
            out[chain] = out.get(chain, 0.0) + x

        for codec in UTF8_READ_AS:
            for *_, e in self.utf8_runs(plain, codec):
                add(f"utf_8>{codec}", e)
        if WIDE_RUN.search(plain) or INSIDE_WORD.search(plain):
            for codec in UTF8_READ_AS_WIDE:
                for *_, e in self.utf8_wide(plain, codec):
                    add(f"utf_8>{codec}", e)
        lost = len(LOST.findall(plain))
        if lost:
            add(LOSSY, 4.0 * lost)
        for _, line, words, before, poor in self.lines(plain):
            size = sum(map(len, words)) + len(words)
            for pair in SINGLE if any(g > 0 for w in words for g in self.gains(w)[1].values()) else ():
                gain = sum(self.gains(w)[1].get(pair, 0.0) for w in words)
                whole = 0.7 * gain - 3.0 if poor and gain > GAIN * size else 0.0
                runs = sum(0.7 * g - RUN_LEAST for *_, g in self.passages(words, pair))
                if whole or runs:
                    add(f"{pair[0]}>{pair[1]}", max(whole, runs) if runs else whole)
            if poor or any(self.gains(w)[0] < POOR * (len(w) + 1) for w in words):
                for a, b in self.stretches(line):
                    held = WORD.findall(line[a:b])
                    least = 3.0 if poor else RUN_LEAST
                    for codec, fixed in self.wide_fixes(line[a:b]):
                        gain = self.wide_score(fixed)
                        if gain > 0:
                            add(f"{codec}>latin", 0.5 * gain - 0.3 * sum(self.gains(w)[0] for w in held) - least)
        if max((e for c, e in out.items() if c.startswith("utf_8")), default=0) >= 2 * SEQUENCE:
            # Valid sequences explain a text better than a legacy chain that makes other letters of them.
            out = {c: e for c, e in out.items() if tuple(c.split(">")) not in self.single and c.split(">")[0] not in WIDE}
        return {c: e for c, e in out.items() if e > 0}

    def wide_fixes(self, line: str) -> list[tuple[str, str]]:
        """Readings of a line's latin characters as bytes of an East Asian encoding."""
        table, found = self.bytes["latin"], []
        if sum(ord(c) in table for c in line) < 4:
            return found
        raw = b"".join(bytes([table[ord(c)]]) if ord(c) in table else c.encode("ascii", "ignore") for c in line)
        for codec in WIDE:
            fixed = raw.decode(codec, "replace")
            wide = CJK.findall(fixed)
            if len(wide) >= 3 and fixed.count("�") * 8 <= len(wide) and sum(ord(c) > 127 for c in fixed) <= 1.3 * len(wide):
                found.append((codec, fixed))
        return found

    def restore(self, text: str, chain: str, depth: int = 3) -> str | None:
        """The text with the passages of a chain put right; null where it cannot be."""
        if chain == LOSSY:
            return None
        true, _, read = chain.partition(">")
        text = unescape(text)
        if true == "utf_8":
            runs = self.utf8_wide(text, read) if read in UTF8_READ_AS_WIDE else self.utf8_runs(text, read)
            for a, b, s, e in reversed(runs):
                if e > 0:
                    text = text[:a] + s + text[b:]
            return self.restore(text, chain, depth - 1) if depth > 1 and read in self.runs and any(e > 0 for *_, e in self.utf8_runs(text, read)) else text
        for at, line, words, _, poor in reversed(self.lines(text)):
            if read == "latin" and true in WIDE:
                fixed = line
                for a, b in reversed(self.stretches(line)):
                    fixed = fixed[:a] + next((f for c, f in self.wide_fixes(line[a:b]) if c == true), line[a:b]) + fixed[b:]
            else:
                pair = true, read
                runs = self.passages(words, pair)
                inside = {i for a, b, _ in runs for i in range(a, b + 1)} if runs or not poor else set(range(len(words)))
                order = iter(range(len(words)))
                fixed = WORD.sub(lambda m: m.group().translate(self.single[pair]) if next(order) in inside and self.gains(m.group())[1].get(pair, 0.0) > 0 else m.group(), line)
            text = text[:at] + fixed + text[at + len(line) :]
        return text


def character_model(docs: DataFrame, text: str = "text") -> DataFrame:
    """``x, n``: counts of single wide characters and of pairs of letters around those beyond ASCII, over all texts."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pandas as pd

        held: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                held.update(c for c in CJK.findall(t))
                for w in WORD.findall(t):
                    held.update(map("".join, zip(" " + w, w + " ")))
        yield pd.DataFrame(list(held.items()), columns=["x", "n"])

    rows = docs.select(F.col(text).alias("t")).filter(F.col("t").rlike("[^\\x00-\\x7F]"))
    return rows.mapInPandas(run, "x string, n bigint").groupBy("x").agg(F.sum("n").alias("n"))


def shared_model(docs: DataFrame, text: str = "text") -> object:
    """The model as a broadcast; an alphabet bounds it (pairs of some 1,300 letters, wide characters singly)."""
    rows = character_model(docs, text).filter("n > 1").collect()
    return docs.sparkSession.sparkContext.broadcast({r["x"]: r["n"] for r in rows})


def detector(model: object) -> Detector:
    """One detector per worker process and model."""
    kept = sys.__dict__.setdefault("_weftline_detectors", {})
    key = len(model.value), sum(model.value.values())
    if key not in kept:
        kept.clear()
        kept[key] = Detector(model.value)
    return kept[key]


def chain_evidence(docs: DataFrame, model: object) -> DataFrame:
    """``doc_id, source, chain, ratio``: the rows of records with any evidence; the text is not carried on."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        d = detector(model)
        for batch in batches:
            out = []
            for doc, source, text in zip(batch["doc_id"], batch["source"], batch["text"]):
                out += [(doc, source, c, round(min(LIMIT, e) * STEP) / STEP) for c, e in d.evidence(text).items()]
            yield pd.DataFrame(out, columns=["doc_id", "source", "chain", "ratio"])

    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").filter(F.col("text").rlike(r"[^\x00-\x7F]|&#|&[A-Za-z]{2,8};|\\u00|\\x[89a-fA-F]"))
    return spread(rows).mapInPandas(run, "doc_id bigint, source string, chain string, ratio double")


def chain_priors(evidence: DataFrame, sizes: DataFrame) -> DataFrame:
    """``source, chain, weight``: log odds of each chain against sound text in a source, by EM.

    The chain of a record is latent: the E-step spreads a record over all chains it has evidence for,
    and over being sound, by their shares in its source and its ratios; the M-step sums these parts.
    Records of one source with the same ratios are one row with a count; a record's ratios are
    shifted so that the greatest is at most PATTERN nats, and rounded, so the size of an EM task does
    not grow with the corpus.
    """
    above = F.greatest(F.lit(0.0), F.array_max(F.transform("p", lambda x: x["ratio"])) - PATTERN)
    shifted = F.transform("p", lambda x: F.struct(x["chain"].alias("chain"), F.greatest(F.round(x["ratio"] - F.col("above")), F.lit(-PATTERN)).cast("int").alias("r")))
    listed = evidence.groupBy("doc_id", "source").agg(F.sort_array(F.collect_list(F.struct("chain", "ratio"))).alias("p")).withColumn("above", above)
    patterns = listed.select("source", shifted.alias("p")).groupBy("source", "p").agg(F.count("*").alias("n"))

    def em(pdf: object) -> object:
        import numpy as np
        import pandas as pd

        total = float(pdf["total"].iloc[0])
        chains = sorted({x["chain"] for p in pdf["p"] for x in p})
        number = {c: i for i, c in enumerate(chains)}
        gain = np.zeros((len(pdf), len(chains)))
        for i, p in enumerate(pdf["p"]):
            for x in p:
                gain[i, number[x["chain"]]] = np.exp(x["r"])
        n = pdf["n"].to_numpy(dtype=float)
        share = np.full(len(chains), PRIOR / len(chains))
        for _ in range(ROUNDS):
            odds = gain * (share / max(1e-9, 1 - share.sum()))
            post = odds / (1 + odds.sum(axis=1, keepdims=True))
            share = (n @ post + PRIOR) / (total + 1)
            share *= min(1.0, 0.9 / share.sum())
        return pd.DataFrame({"source": pdf["source"].iloc[0], "chain": chains, "weight": np.log(share / (1 - share.sum()))})

    return patterns.join(sizes, "source").groupBy("source").applyInPandas(em, "source string, chain string, weight double")


def garbled(docs: DataFrame, model: object) -> DataFrame:
    """``doc_id, chain, posterior`` of the records at POSTERIOR or above.

    The posterior is that of any chain, the chain the likeliest one (ties: the greater name).
    """
    evidence = cut(chain_evidence(docs, model))
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("total"))
    odds = F.coalesce("weight", F.lit(math.log(PRIOR))) + F.col("ratio")
    called = evidence.join(small(chain_priors(evidence, sizes)), ["source", "chain"], "left").withColumn("odds", odds)
    best = called.groupBy("doc_id").agg(F.max_by("chain", F.struct("odds", "chain")).alias("chain"), F.sum(F.exp(F.least("odds", F.lit(50.0)))).alias("all"))
    return best.select("doc_id", "chain", (F.col("all") / (1 + F.col("all"))).alias("posterior")).filter(F.col("posterior") >= POSTERIOR)


def repaired(docs: DataFrame, model: object) -> DataFrame:
    """``doc_id, chain, posterior, restored``: garbled records with the original text, null where it is lost."""

    def run(batches: Iterator) -> Iterator:
        d = detector(model)
        for batch in batches:
            batch["restored"] = [d.restore(t, c) for t, c in zip(batch["text"], batch["chain"])]
            yield batch[["doc_id", "chain", "posterior", "restored"]]

    return garbled(docs, model).join(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id bigint, chain string, posterior double, restored string")
