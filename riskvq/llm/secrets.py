"""Operator 1: secret scan.

An Aho-Corasick automaton finds keywords in a folded copy of the text (and runs
of hex digits in a copy folded to character classes); regular expressions are
tried only at those hits, anchored; tokens that embed a checksum are reported
only when it holds.

Cases: NULL and empty texts have no spans; repeated rows are scanned alike;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import annotated, map_texts, sha_hex

# Keywords and patterns of the base kinds, in the order of their kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
BASE = ("assign", "access", "hex")
# Prefixes of access tokens whose last six characters are a base-62 CRC-32 of the thirty before.
CHECKED = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
KINDS = (*BASE, *CHECKED)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

FIELDS = [("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"),
          ("base_sha256", "string"), ("spans", "string")]


def checksum62(body: str) -> str:
    """CRC-32 of the body in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


class SecretScanner:
    """Finds spans (start, kind index, end) in code points of one text."""

    def __init__(self):
        import ahocorasick

        self.assign, self.access, self.hex = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
        self.checked = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9_])")
        self.words = ahocorasick.Automaton()
        for w in ASSIGN_WORDS:
            self.words.add_word(w, (0, len(w)))
        self.words.add_word("akia", (1, 4))
        for kind, prefixes in CHECKED.items():
            for p in prefixes:
                self.words.add_word(p, (KINDS.index(kind), len(p)))
        self.words.make_automaton()
        self.runs = ahocorasick.Automaton()
        self.runs.add_word("x" * MIN_HEX, MIN_HEX)
        self.runs.make_automaton()
        # hex digits to x, other ASCII to a blank; bytes of longer characters stay
        self.classes = bytes(120 if chr(c) in "0123456789abcdef" else 32 if c < 128 else c for c in range(256))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        raw = text.encode("utf-8", "surrogatepass")
        found = []
        hits = sorted((end - n + 1, kind) for end, (kind, n) in
                      self.words.iter(raw.lower().decode("utf-8", "surrogatepass")))
        last = [0] * len(KINDS)
        for start, kind in hits:
            if start < last[kind]:
                continue
            if kind == 0:
                if m := self.assign.match(text, start):
                    last[0] = m.end()
                    if m.end(1) - m.start(1) >= MIN_ASSIGN:
                        found.append((start, 0, m.end()))
            elif kind == 1:
                if m := self.access.match(text, start):
                    last[1] = m.end()
                    if m.end() - start >= MIN_ACCESS:
                        found.append((start, 1, m.end()))
            elif text[start:start + 4] in CHECKED[KINDS[kind]] and (m := self.checked.match(text, start + 4)):
                body = m.group()
                if checksum62(body[:30]) == body[30:]:
                    last[kind] = m.end()
                    found.append((start, kind, m.end()))
        done = 0
        for end, n in self.runs.iter(raw.translate(self.classes).decode("utf-8", "surrogatepass")):
            if end - n + 1 >= done:
                done = self.hex.match(text, end - n + 1).end()
                found.append((end - n + 1, 2, done))
        return sorted(found)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _make_scan():
    scanner = SecretScanner()

    def of_text(text):
        spans = scanner.spans(text)
        base = [x for x in spans if x[1] < len(BASE)]
        return (*(sum(k == i for _, k, _ in base) for i in range(len(BASE))), sha_hex(_joined(base).encode()),
                _joined(spans))

    return of_text


def _make_redact():
    scanner = SecretScanner()

    def of_text(text):
        out, at = [], 0
        for s, k, e in scanner.spans(text):
            if s >= at:
                out += [text[at:s], f"[{KINDS[k]}]"]
            at = max(at, e)
        return ("".join([*out, text[at:]]),)

    return of_text


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): counts of base spans, their digest, and all spans as kind:start:end."""
    return map_texts(docs, _make_scan, FIELDS)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; NULL texts stay NULL, n_chars follows."""
    out, columns = annotated(docs, lambda d, carry: map_texts(d, _make_redact, [("_redacted", "string")], carry=carry))
    text = F.when(F.col("text").isNotNull(), F.col("_redacted"))
    changed = {"text": text, "n_chars": F.coalesce(F.length(text).cast(dict(docs.dtypes).get("n_chars", "bigint")),
                                                   columns[docs.columns.index("n_chars")] if "n_chars" in docs.columns
                                                   else F.lit(0))}
    return out.select(*(changed[n].alias(n) if n in changed else c for n, c in zip(docs.columns, columns, strict=True)))
