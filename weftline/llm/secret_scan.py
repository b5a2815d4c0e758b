"""Credentials embedded in source and configuration text (problem 4).

Every quoted string without white space, every joined literal and every bare token of a text is a
candidate.  Its Shannon entropy over its own alphabet is set against a threshold for that alphabet
and its length; hashes, identifiers, references, templates, placeholders, public keys and blobs of
data are excluded.  What stands before a candidate moves the threshold: a credential's name, an
option or a login lowers it to BOUND of it, so that human passwords are found where they are
assigned, and a published token format to SHAPED; a candidate without any of these has to be as
random as a generated key is.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import spread

REDACTED = "[REDACTED]"

# The published shapes of tokens.
KNOWN_SHAPES = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[abeoprs]-[0-9A-Za-z-]{10,}",
    r"[srp]k_(?:live|test|prod)_[0-9A-Za-z]{16,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"AIza[0-9A-Za-z_-]{30,}",
    r"npm_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_-]{20,}",
    r"dop_v1_[0-9a-f]{40,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
)
# Words of a name that holds a credential, as the last word or words of the name.
SECRET_NAME = (
    r"(?:passw(?:or)?d|passwd|passphrase|passcode|pwd|pw|pass|secret|token|api_?key|apikey|auth|credentials?|"
    r"(?:private|access|secret|signing|encryption|master|account|storage|service|client|shared|license|auth|deploy|session)_?key|"
    r"bearer|authorization|webhook_secret|dsn|smtp_auth|basic_auth)"
)
# The word after a credential's word that makes the name speak about one.
ABOUT_NAME = (
    r"(?:label|policy|file|path|url|uri|name|type|size|mode|level|timeout|ttl|id|count|limit|length|len|etag|hash|sha\d*|md5|digest|checksum|"
    r"pattern|regex|format|prefix|suffix|field|header|hint|placeholder|prompt|message|error|env|var|ref|arn|provider|store|manager|endpoint|"
    r"expiry|expires|version|fingerprint|pub|public|kind|scope|index|key_id|rotation|required|enabled|test|example|sample|template)"
)
PUBLIC_KEY = r"ssh-(?:rsa|ed25519|dss)|ecdsa-sha2|sk-ssh|BEGIN (?:[A-Z ]*)?PUBLIC KEY|BEGIN CERTIFICATE"
PLACEHOLDER_WORDS = (
    r"example|changeme|change[_-]me|replace|your[_-]|placeholder|dummy|sample|redacted|masked|removed|hidden|todo|fixme|insert|"
    r"not[_-]?set|undefined|xxxx|\.\.\.|foobar|lorem|test[_-]?only|fake|secret[_-]?here|<[^>]*>|_here$"
)
# How files of a known format, certificates and hashes with their name begin in base64.
FILE_BEGINS = r"^(?:iVBORw0KGgo|R0lGOD|/9j/|UklGR|UEsDB|JVBERi0|H4sI|AAABAA|MII[A-F]|d0[9o]G|T2dnU|sha\d+[-:]|md5[-:])"
PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"


#: Shares of the threshold for a value bound to a credential's name and for a published format.
BOUND, SHAPED = 0.75, 0.6
#: Least length of a candidate, and of one that nothing announces.
LEAST, FREE_LEAST = 6, 20
#: A candidate that nothing announces and is longer than this is a blob of data, no key.
BLOB = 160
#: A value longer than this is data whatever its name; keys in armour and published formats are found as such.
DATA = 1024
#: Literal beginnings of the published formats.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "k_prod_", "SG.", "AIza", "npm_", "pypi-", "dop_v1_", "hf_", "sk-", "eyJ")
#: Languages that join literals which only stand beside each other.
BESIDE = re.compile(r"\.(?:py|pyi|c|h|cc|cpp|hpp|rb|m|d)$", re.I)
#: Characters before a candidate in which its name is looked for.
REACH = 200
#: Verdicts kept by a worker.
KNOWN_VALUES = 200_000
#: Files in which an unquoted word is a value; elsewhere it is code, except in a comment.
CONFIG_PATH = re.compile(r"(?:^|/)\.?[^/]*\.(?:env|ya?ml|properties|toml|ini|cfg|conf|md|rst|txt|sh|bash|tf|tfvars)(?:\.\w+)?$|(?:^|/)\.(?:env|netrc|pgpass|npmrc|pypirc)|Dockerfile", re.I)
COMMENT = re.compile(r"\s*(?:#|//|--|\*|/\*|;)")


def entropy(s: str) -> float:
    """Shannon entropy of a string in bits per character."""
    n = len(s)
    return -sum(c / n * log2(c / n) for c in map(s.count, set(s))) if n else 0.0


def threshold(n: int, alphabet: int) -> float:
    """What a random string of n characters over so many letters falls below only rarely.

    log2 of what can occur, less an allowance that shrinks with the length.
    """
    return log2(min(n, alphabet)) * (0.8 if n < 16 else 0.82 if n < 24 else 0.84)


def alphabet_of(s: str) -> int:
    """Letters of the smallest usual alphabet that holds a string."""
    for pattern, letters in ((r"[0-9]+", 10), (r"[0-9a-f-]+|[0-9A-F-]+", 16), (r"[0-9a-z_-]+|[0-9A-Z_-]+", 36), (r"[0-9A-Za-z+/=_-]+", 64)):
        if re.fullmatch(pattern, s):
            return letters
    return 80


def randomness(s: str, alphabet: int | None = None) -> float:
    """Entropy as a share of the threshold; 1 or more is what a generated key has."""
    return entropy(s) / max(threshold(len(s), alphabet or alphabet_of(s)), 1e-9) if len(s) > 1 else 0.0


class Scanner:
    """Compiled once per task."""

    def __init__(self) -> None:
        self.known_at = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{x})" for x in KNOWN_SHAPES) + ")")
        self.private = re.compile(PRIVATE_KEY)
        self.private_end = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
        self.armour = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----[\s\S]*?-----END \1-----")
        # Candidates: quoted strings without white space, literals joined to one another, bare tokens.
        self.quoted = re.compile(r"\"((?:[^\"\\\s]|\\.){6,})\"|'((?:[^'\\\s]|\\.){6,})'|`([^`\s]{6,})`")
        self.token = re.compile(r"[^\s\"'`,;:=(){}\[\]<>|\\]{6,}(?:={1,2}(?![^\s\"'`,;)}\]<&\\]))?")
        literal = r"(?:\"[^\"\\\n]*\"|'[^'\\\n]*')"
        self.joined = re.compile(rf"{literal}(?:\s*\+\s*{literal})+")
        self.beside = re.compile(rf"{literal}(?:\s*\+\s*{literal}|[ \t]*\\?\n?[ \t]*(?<![\"']){literal})+")
        self.literal = re.compile(literal)
        # What may stand before a value, up to its opening quote.
        name = r"(?<![\w.\-])[.\-]?(?P<name>[A-Za-z_][\w.\-]*)[\"'`\])]*"
        kind = r"(?:[ \t]*:[ \t]*(?!//)[&A-Za-z_][\w<>&' ]*?(?=[ \t]*=))?"
        other = r"(?:[A-Za-z_][\w.]*\s*(?:\|\||\?\?|\bor\b|:-)\s*)?"
        self.assign = re.compile(name + kind + r"\s*(?P<bind>:=|=>|=(?!=)|(?<!:):(?![:/])|,|\|\||\?\?|\bor\b)\s*" + other + r"(?:[rbfu](?=[\"'`]))?(?P<quote>[\"'`]*)$")
        self.flag = re.compile(r"(?<!\S)-{1,2}(?P<name>[A-Za-z][\w-]*)(?:=|\s+)[\"']?$")
        self.scheme = re.compile(r"\b(?:bearer|basic|token)\s+$", re.I)
        self.spoken = re.compile(r"\b(?:pw|pwd|pass|password|passwd|passphrase|secret|token|api key|apikey|credentials?)\b(?:\s+(?:for|of|to|on)\s+(?:the\s+)?[\w.@/-]+)?\s*(?:\bis\b|\bwas\b|->|=>|=|:)\s+[\"'`]?$", re.I)
        self.netrc = re.compile(r"\b(?:login|user)\s+\S+\s+password\s+$")
        self.user_option = re.compile(r"(?<!\S)(?:-u|--user)[\s=]+[\"']?[\w.-]+:[\"']?$")
        self.sql = re.compile(r"\b(?:password|identified\s+by)\s+(?:=\s*)?'$", re.I)
        self.named_value = re.compile(r"\bname[\"']?\s*[:=]\s*[\"']?(?P<name>[\w.-]+)[\"']?\s*,\s*[\"']?value[\"']?\s*[:=]\s*[\"']?$")
        self.element = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*)>$")
        self.pgpass = re.compile(r"(?<![\w/.-])[\w.*-]+:(?:\d{2,5}|\*):[\w.*-]+:[\w.*-]+:$")
        self.hashed = re.compile(r"(?:sha\d*|md5|integrity|checksum|digest|hash|etag|fingerprint|revision|commit|uuid|guid|nonce|base64,)[\"'`\])]*\s*[:=,-]?\s*[\"'`]?$", re.I)
        self.url = re.compile(r"(?<=[a-zA-Z0-9])://([^\s/:@\"'`<>{}$]*):([^\s/@\"'`]+)@[\w.\[\]{}$-]+")
        # Words of which what announces a credential has at least one.
        self.stem = re.compile(r"pass|pwd|pw\b|pw_|secret|token|key|auth|cred|bearer|basic|dsn|identified|login|user|-u\b|webhook|:(?:\d{2,5}|\*):")
        self.holds = re.compile(r"(?:^|[_.])" + SECRET_NAME + "$", re.I)
        self.about = re.compile(SECRET_NAME + r"s?[_.]*(?:" + ABOUT_NAME + r")$", re.I)
        self.words = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
        self.bad = re.compile(PLACEHOLDER_WORDS, re.I)
        self.reference = re.compile(
            r"^\$|\$\{|\$\(|\{\{|\}\}|%\(|%[A-Z_]+%|<%|^@|^&|^(?:vault|env|ref|secret|ssm|arn|kms|op|file|azurekeyvault|gcpsm|sops|aws|keychain|secretsmanager)[:/]|^/|^\./|^~/|"
            r"process\.env|os\.environ|getenv|std::env|ENV\[|secrets\.|^(?:null|none|nil|true|false|undefined)$",
            re.I,
        )
        self.uuid = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
        self.public = re.compile(PUBLIC_KEY + r"|^AAAA[BCE]3Nza")
        self.identifier = re.compile(r"^[A-Za-z_][A-Za-z]*(?:[_.\-/:][A-Za-z]+)*\d{0,2}$")
        self.hexes = re.compile(r"^(?:sha\d+[-:])?[0-9a-fA-F]+$")
        self.parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
        self.begins = re.compile(FILE_BEGINS)
        self.digit = re.compile(r"[0-9]")
        self.known: dict[str, tuple[bool, bool]] = {}

    def secret_name(self, name: str) -> bool:
        """Whether a name in any case style ends in a word for a credential."""
        flat = self.words.sub("_", name).lower().replace("-", "_").strip("_.")
        if self.about.search(flat):
            return False
        return bool(self.holds.search(flat))

    def placeholder(self, v: str) -> bool:
        """Templates, references, masks, sample words, and strings of few letters."""
        bare = v.strip("\"'`")
        if self.reference.search(bare) or self.bad.search(bare):
            return True
        core = bare.replace("-", "").replace("_", "")
        return len(set(core)) <= 3 or bare.count("*") > len(bare) // 2 or any(c in bare for c in "<>{}") and not any(c.isdigit() for c in bare)

    def excluded(self, v: str) -> bool:
        """What is no credential whatever its entropy and its name."""
        return len(v) < LEAST or v.isdigit() or "://" in v or "(" in v or bool(self.uuid.match(v) or self.public.search(v)) or self.placeholder(v)

    def bound(self, v: str) -> bool:
        """Whether a value bound to a credential's name is one."""
        if self.hexes.match(v):
            return len(v) >= 16 and randomness(v, 16) >= BOUND and not self.excluded(v)
        if self.identifier.match(v):
            # Words joined by usual signs; a run of letters in mixed case may still be random.
            return v.isalpha() and len(v) >= 12 and v[1:] != v[1:].lower() and v[1:] != v[1:].upper() and self.mixed(v) and randomness(v, 52) >= 1 and not self.excluded(v)
        # A password put together by hand has little entropy, but letters and something else in it.
        return len(v) >= LEAST and self.classes(v) >= 2 and randomness(v) >= BOUND and not self.excluded(v)

    def classes(self, v: str) -> int:
        """Kinds of characters of a value that has letters: small, large, digits, others; 0 without letters."""
        small, large = v != v.upper(), v != v.lower()
        return small + large + bool(self.digit.search(v)) + (not v.isalnum()) if small or large else 0

    def free(self, v: str) -> bool:
        """Whether a value that nothing announces is as random as a generated key, and no hash, identifier or blob."""
        if not FREE_LEAST <= len(v) <= BLOB or not self.digit.search(v) or not v.isascii():
            return False
        # Words and numbers, however joined, make few parts of one or two characters.
        if sum(len(x) for x in self.parts.findall(v) if len(x) <= 2) < 0.4 * len(v) or sum(not c.isalnum() for c in v) > len(v) // 5:
            return False
        return randomness(v) >= 1 and v.lower() != v.upper() and not (self.hexes.match(v) or self.identifier.match(v) or self.begins.match(v) or self.excluded(v))

    def mixed(self, v: str) -> bool:
        """Letters that change case as no camel-case name does."""
        parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", v)
        return sum(len(p) <= 2 for p in parts) * 3 >= len(parts)

    def verdict(self, v: str) -> tuple[bool, bool]:
        """Whether a value is a credential where something announces it, and where nothing does."""
        held = self.known.get(v)
        if held is None:
            if len(self.known) >= KNOWN_VALUES:
                self.known.clear()
            plain = self.identifier.match(v) and not (v.isalpha() and len(v) >= 12)
            held = self.known[v] = (False, False) if plain else (self.bound(v.rstrip(".")) or self.basic(v), self.free(v))
        return held

    def basic(self, v: str) -> bool:
        """Base64 of ``user:password``."""
        if len(v) < 12 or len(v) % 4:
            return False
        try:
            plain = base64.b64decode(v, validate=True)
        except (binascii.Error, ValueError):
            return False
        user, colon, password = plain.partition(b":")
        return bool(colon) and len(user) > 1 and len(password) >= 6 and all(32 < c < 127 for c in plain) and not self.placeholder(password.decode())

    def url_password(self, v: str) -> bool:
        return len(v) >= 4 and not self.placeholder(v) and v.lower() not in ("password", "pass", "secret", "pwd", "passwd", "user") and randomness(v) >= BOUND

    def announced(self, text: str, start: int, end: int, words: bool, stemmed: bool = True) -> bool | None:
        """Whether a credential's name, an option or a login stands before a value; not so if no such word is ``stemmed``.

        Null if what stands there says that it is something else: a hash's name, or code and not a value.
        """
        left = text[max(0, start - REACH) : start]
        line = left[left.rfind("\n") + 1 :]
        if not stemmed:
            return None if self.hashed.search(line[-40:]) else False
        if self.element.search(line):
            return self.secret_name(self.element.search(line)["name"]) and text.startswith("</", end)
        if self.scheme.search(line):
            return any(c.isdigit() for c in text[start:end])
        if any(x.search(line) for x in (self.spoken, self.netrc, self.sql, self.pgpass, self.user_option)):
            return True
        for pattern in (self.flag, self.named_value):
            if (m := pattern.search(line)) and self.secret_name(m["name"]):
                return True
        m = self.assign.search(left)
        if m and self.secret_name(m["name"]) and not text[start:end].lower().startswith(("bearer ", "basic ", "token ")):
            inside = m["quote"] or any(line.count(q) % 2 for q in "\"'`")
            if m["bind"] == "," and not m["quote"]:
                return False
            if not inside and (not (words or COMMENT.match(line)) or not self.bare(text, start, end)):
                return None
            return True
        return None if self.hashed.search(line[-40:]) else False

    def bare(self, text: str, start: int, end: int) -> bool:
        """An unquoted value is code in a programming language unless it cannot be a name or a call."""
        v, after = text[start:end], text[end : end + 1]
        if after in ("(", "[", "{", "<") or text.startswith("::", end) or v.endswith((".", "?")) or "->" in v:
            return False
        if self.identifier.match(v) or v.replace(".", "").replace("_", "").isalpha():
            return v.isalpha() and len(v) >= 12 and self.mixed(v)
        return not (v[0].isdigit() and v.replace(".", "").replace("_", "").isdigit())

    def blob(self, text: str, start: int, end: int) -> bool:
        """Whether the line before or after holds as long a run of the same kind: data written over several lines."""
        first, last = text.rfind("\n", 0, start), text.find("\n", end)
        before = text[text.rfind("\n", 0, max(first, 0)) + 1 : first] if first > 0 else ""
        after = text[last + 1 : (text.find("\n", last + 1) + 1 or len(text) + 1) - 1] if last >= 0 else ""
        least = 0.7 * (end - start)
        return any(len(x) >= least and not self.identifier.match(x) and randomness(x) >= 1 for line in (before, after) for x in self.token.findall(line))

    def credentials(self, text: str, path: str | None = None) -> list[list[tuple[int, int]]]:
        """The spans of each credential, ascending, without overlaps; a joined literal has a span for each part."""
        found: list[list[tuple[int, int]]] = []
        for m in self.private.finditer(text):
            end = self.private_end.search(text, m.end())
            # Without an end line, or with another key before it, the key runs to the end of its block of base64.
            again = self.private.search(text, m.end())
            found.append([(m.start(), end.end() if end and not (again and again.start() < end.start()) else min(len(text), self.key_end(text, m.end())))])
        other = [m.span() for m in self.armour.finditer(text) if not self.private.match(text, m.start())] if "-----BEGIN" in text else []
        words = not path or bool(CONFIG_PATH.search(path))
        for m in self.known_at.finditer(text) if any(x in text for x in PREFIXES) else ():
            v = m.group()
            if not self.bad.search(v) and len(set(v[8:])) > 5 and randomness(v) >= SHAPED:
                found.append([m.span()])
        if "://" in text:
            found += [[m.span(2)] for m in self.url.finditer(text) if self.url_password(m.group(2))]

        parts: set[int] = set()
        stems: list[int] = []

        def judge(v: str, start: int, end: int) -> bool:
            told, untold = self.verdict(v)
            # A part of a joined literal is judged with the whole.
            if start in parts or not told and not untold:
                return False
            if not stems:
                stems.extend([-1, *(m.start() for m in self.stem.finditer(text.lower()))])
            near = stems[bisect_left(stems, start) - 1] >= max(0, start - REACH)
            say = self.announced(text, start, end, words, near)
            return bool(say and told and len(v) <= DATA) or (say is False and untold and not self.blob(text, start, end))

        if "' " in text or '" ' in text or '"\n' in text or "'\n" in text or '"+' in text or "'+" in text:
            for m in (self.beside if path and BESIDE.search(path) else self.joined).finditer(text):
                spans = [(x.start() + 1, x.end() - 1) for x in self.literal.finditer(text, *m.span())]
                whole = "".join(text[a:b] for a, b in spans)
                if " " not in whole:
                    if len(whole) <= DATA and judge(whole, *spans[0]):
                        found.append([x for x in spans if x[1] > x[0]])
                    parts.update(a for a, _ in spans)
        for pattern in (self.quoted, self.token):
            groups = pattern.groups
            # Each distinct value is judged once; only where one may be a credential are its places looked up.
            values = set(pattern.findall(text)) if not groups else {x for m in set(pattern.findall(text)) for x in m if x}
            likely = {v for v in values if any(self.verdict(v))}
            if likely:
                for m in pattern.finditer(text):
                    v = m.group(m.lastindex) if groups else m.group()
                    if v in likely and judge(v, *m.span(m.lastindex if groups else 0)):
                        found.append([m.span(m.lastindex if groups else 0)])
        out: list[list[tuple[int, int]]] = []
        taken = 0
        for spans in sorted(found, key=lambda x: (x[0][0], -x[-1][1])):
            a, b = spans[0][0], spans[-1][1]
            if any(x <= a and b <= y for x, y in other):
                continue
            if a >= taken:
                out.append(spans)
                taken = b
            elif b > taken:
                # One that begins inside another carries it on.
                out[-1] = [*out[-1][:-1], (out[-1][-1][0], b)] if len(spans) == 1 and len(out[-1]) == 1 else [*out[-1], *[(max(x, taken), y) for x, y in spans if y > taken]]
                taken = b
        return out

    def spans(self, text: str, path: str | None = None) -> list[tuple[int, int]]:
        """All spans to mask, ascending."""
        return [x for spans in self.credentials(text, path) for x in spans]

    @staticmethod
    def key_end(text: str, at: int) -> int:
        while at < len(text) and (text[at].isalnum() or text[at] in "+/=\\\n\r \t\"',:-"):
            at += 1
        return at


def scan_secrets(fragments: DataFrame) -> DataFrame:
    """``fragment_id, line_no`` of every line on which a credential begins.

    ``line_no`` is ``start_line`` (1 if null) plus the line feeds before the line.  Null and empty
    contents have none.  Rows of several deliveries give the same lines and count once.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        scanner = Scanner()
        for batch in batches:
            out = []
            for fid, first, path, text in zip(batch["fragment_id"], batch["start_line"], batch["path"], batch["content"]):
                if text:
                    base = 1 if first is None or first != first else int(first)
                    out += [(fid, base + text.count("\n", 0, spans[0][0])) for spans in scanner.credentials(text, path)]
            yield pd.DataFrame(out, columns=["fragment_id", "line_no"])

    rows = spread(fragments.select("fragment_id", "start_line", "path", "content"))
    return rows.mapInPandas(run, "fragment_id bigint, line_no bigint").distinct()


def redact(fragments: DataFrame) -> DataFrame:
    """``fragment_id, content, n_redacted``: credentials replaced, all else unchanged.

    Quotes and what is outside the credential stay, and so do the line feeds inside a key block, so
    the code still parses and every line keeps its number.  A null content stays null.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        scanner = Scanner()
        for batch in batches:
            out = []
            for fid, path, text in zip(batch["fragment_id"], batch["path"], batch["content"]):
                found = scanner.credentials(text, path) if text else []
                for a, b in reversed([x for spans in found for x in spans]):
                    text = text[:a] + masked(text[a:b]) + text[b:]
                out.append((fid, text, len(found)))
            yield pd.DataFrame(out, columns=["fragment_id", "content", "n_redacted"])

    return spread(fragments.select("fragment_id", "path", "content")).mapInPandas(run, "fragment_id bigint, content string, n_redacted int")


def masked(secret: str) -> str:
    """What stands for a credential; of a key block, each line keeps what quotes, comments or joins it."""
    if "\n" not in secret:
        return REDACTED
    kept = []
    for line in secret.split("\n"):
        head = re.match(r"\s*(?://|#|\*|--(?!-))?\s*[\"'`]?", line).end()
        tail = re.search(r"(?:\\n)?[\"'`]?\s*[+;,.)\\]*\s*$", line).start()
        kept.append(line[:head] + (REDACTED if head < tail else "") + line[max(head, tail) :])
    return "\n".join(kept)
