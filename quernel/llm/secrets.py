"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions only at hits, embedded checksums.

A text is scanned as bytes, so that one automaton pass over lower-cased bytes finds every keyword whatever the script; a pattern is only
tried where its keyword begins. Bare hexadecimal runs have no keyword: the text is mapped to character classes, and a run of 24 class
members is searched as one keyword. Positions are then turned into code points.

Defined cases: null text is empty; an empty text has no spans; texts of any length are scanned whole; each row is scanned for itself,
so repeated rows repeat their result; other columns play no part. Time grows with a text's length, whatever it repeats.

A private key reaches from its header to its footer, which must follow within KEY_BYTES and before another header; where there is none, over the encapsulated headers and
the lines of base 64 that follow; where there are none either, the header line alone is the span. Line ends may be written as \\n.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed

#: Kinds in the order in which spans at one start are listed. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "slack", "stripe", "jwt", "pem")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = 24


def crc_valid(match: re.Match) -> bool:
    """Tokens of this form end with six base-62 digits of the CRC-32 of the 30 characters before."""
    body, check = match[1][:-6], match[1][-6:].decode()
    n = 0
    for c in check:
        n = n * 62 + BASE62.index(c)
    return n == zlib.crc32(body)


def jwt_valid(match: re.Match) -> bool:
    """The first part must decode to a JSON object that names its algorithm; one nested too deeply to be read doesn't."""
    part = match[1]
    try:
        head = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


#: kind: (lower-case keywords, pattern that begins with one of them, test of a match). A match that fails its test is dropped, yet covers its place.
RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    "access": (("akia",), rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])", crc_valid),
    "npm": (("npm_",), rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])", crc_valid),
    "slack": (("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), rb"xox[baprs]-[0-9]{8,}-[0-9A-Za-z-]{8,}", lambda m: True),
    "stripe": (("sk_live_", "rk_live_"), rb"[sr]k_live_[0-9A-Za-z]{24,}", lambda m: True),
    "jwt": (("eyj",), rb"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", jwt_valid),
    "pem": (("-----begin",), rb"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----", lambda m: True),
}
#: Bytes from a private key's header in which its footer must stand; the next encapsulation line; encapsulated headers with lines of base 64, the last of which may be short.
KEY_BYTES = 1 << 16
BOUNDARY = re.compile(rb"-----(?:BEGIN|(END) [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)")
_GAP = rb"(?:[\x20\t\r\n]|\\[rnt])"
BASE64_LINES = re.compile(
    rb"(?:" + _GAP + rb"{1,200}+[A-Za-z][A-Za-z0-9-]{0,40}:\x20?[^\x00-\x20\\]{0,200}+){0,20}+" + _GAP + rb"{1,200}+[A-Za-z0-9+/]{40,}+={0,2}+"
    rb"(?:" + _GAP + rb"{1,8}+[A-Za-z0-9+/]{40,}+={0,2}+)*+(?:" + _GAP + rb"{1,8}+(?=[A-Za-z0-9+/]{2,})(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?+(?=[\x20\t]{0,200}(?:[\r\n\"'`<,}\])]|\\[rn]|\Z)))?+"
)


def key_end(raw: bytes, at: int) -> int:
    """End of a private key, of which the header ends at `at`. What is read lies before the next header, or is part of the key, or is short."""
    if (found := BOUNDARY.search(raw, at, at + KEY_BYTES)) and found[1]:
        return found.end()
    lines = BASE64_LINES.match(raw, at)
    return lines.end() if lines else at


#: Kinds whose pattern begins with a run of these bytes: if it fails at one keyword of a run, it fails at all of that run, which is then passed over.
#: So a run is read once, however many keywords it holds.
RUNS = {"jwt": re.compile(rb"[A-Za-z0-9_-]+")}


class Scanner:
    """Holds the automaton and the compiled patterns of one Python worker."""

    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for kind, (keys, _, _) in RULES.items():
            for key in keys:
                self.words.add_word(key, (kind, len(key)))
        self.words.make_automaton()
        self.patterns = {kind: re.compile(pattern) for kind, (_, pattern, _) in RULES.items()}
        self.hex_class = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then kind as listed."""
        if not text:
            return []
        raw = text.encode("utf-8", "surrogatepass")
        found, covered = [], dict.fromkeys(RULES, 0)
        for last, (kind, length) in self.words.iter(raw.lower().decode("latin-1")):
            start = last + 1 - length
            if start < covered[kind]:
                continue
            if m := self.patterns[kind].match(raw, start):
                end = covered[kind] = key_end(raw, m.end()) if kind == "pem" else m.end()
                if RULES[kind][2](m):
                    found.append((kind, start, end))
            elif kind in RUNS and raw.startswith(b"eyJ", start):
                covered[kind] = RUNS[kind].match(raw, start).end()
        classes = raw.translate(self.hex_class)
        start = classes.find(b"h" * HEX_RUN)
        while start >= 0:
            end = start + HEX_RUN
            while end < len(classes) and classes[end] == 104:
                end += 1
            found.append(("hex", start, end))
            start = classes.find(b"h" * HEX_RUN, end)
        if len(raw) != len(text):
            at, chars, point = 0, 0, {}
            for byte in sorted({x for _, s, e in found for x in (s, e)}):
                chars += len(raw[at:byte].decode("utf-8", "surrogatepass"))
                at, point[byte] = byte, chars
            found = [(kind, point[s], point[e]) for kind, s, e in found]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> for each base kind, base_sha256, spans: one row for each row of docs (doc_id, text)."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for texts in trimmed(batches):
            rows = []
            for text in texts:
                spans = scanner.spans(text)
                base = [x for x in spans if x[0] in KINDS[:3]]
                counts = [sum(x[0] == kind for x in base) for kind in KINDS[:3]]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return bounded_batches(docs).select("doc_id", scan("text").alias("found")).select("doc_id", "found.*")


def redact_secrets(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with every span of a secret in text replaced by the mark; overlapping spans by one mark. All columns stay as they are otherwise."""

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner()
        for texts in trimmed(batches):
            out = []
            for text in texts:
                parts, at = [], 0
                for _, start, end in scanner.spans(text):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if parts else text)
            yield pd.Series(out, dtype=object)

    return bounded_batches(docs).withColumn("text", redact("text"))
