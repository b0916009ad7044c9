"""Secret scans with multipart credential linking: weak parts count only where complementary parts stand near."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import either, read, tune

#: The base patterns. Group 2 of assign must have 6 characters, access 20 in all, hex 24.
ASSIGN = r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Order in which kinds that start together are listed.
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
#: Parts within so many code points of each other lie in one scope; a line break run (blank line) ends a scope.
SCOPE = 200
#: Least bits a character of a weak secret without a name, and its least length; named ones have NAMED characters.
ENTROPY, WEAK_LENGTH, NAMED = 3.2, 16, 6
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"

_assign, _access, _hex = re.compile(ASSIGN), re.compile(ACCESS), re.compile(r"[0-9a-f]{24,}")
_words = ("password", "passwd", "secret", "token", "api")
_ident = re.compile(r"""(?a:\b(?i:user(?:_?name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,}))""")
_endpoint = re.compile(r"""(?a:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>|]{4,}|(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d{1,5})?(?![\d.]))""")
# "=" is padding behind a token only: before it, it parts a name from an unquoted value.
_weak = re.compile(rf"(?a:(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{WEAK_LENGTH},}}={{0,2}}(?![A-Za-z0-9+/_=-]))")
_named = re.compile(rf"""(?a:(?<![A-Za-z0-9])(?i:pwd|pw|pass|passphrase|credentials?|key|auth)["']?\x20*[:=]\x20*["']?([^\s"'<>,;&]{{{NAMED},}}))""")
_break = re.compile(r"\n[ \t]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost matches of each kind that do not overlap, without those that are too short."""
    found = []
    low = text.lower()
    if any(w in low for w in _words):
        found += [(m.start(), m.end(), "assign") for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in _hex.finditer(text)]  # runs are maximal, so the least length may stand in the pattern
    return found


def _bits(token: str) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values())


class _Covered:
    """What spans cover together: spans of different kinds may overlap, so they are kept as runs that do not."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [], []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifiers, secret-like tokens and endpoints that mean nothing alone and do not overlap a base span.

    A secret is a value with a weak name (pwd, pass, key and the like), however plain, or a long token without a name
    that looks drawn at random. One that begins inside an identifier or endpoint is part of that and none of its own.
    """
    parts = []
    if "://" in text or "." in text:
        parts += [(m.start(), m.end(), "endpoint") for m in _endpoint.finditer(text)]
    if "=" in text or ":" in text:
        parts += [(m.start(), m.end(), "ident") for m in _ident.finditer(text)]
    inside = _Covered(parts)
    values = []
    if "=" in text or ":" in text:
        values = [(m.start(1), m.end(1), "weak") for m in _named.finditer(text) if not inside.meets(m.start(1), m.start(1) + 1)]
    named = _Covered(values)
    parts += values
    for m in _weak.finditer(text):
        t = m[0]
        if any(c.isdigit() for c in t) and any(c.isalpha() for c in t) and _bits(t) >= ENTROPY and not inside.meets(m.start(), m.start() + 1) and not named.meets(m.start(), m.end()):
            parts.append((m.start(), m.end(), "weak"))
    taken = _Covered(base)
    return [p for p in parts if not taken.meets(p[0], p[1])]


#: What completes a part: a secret needs whom it is for or where it goes, an identifier or endpoint needs a secret.
SIDE = {"assign": "secret", "hex": "secret", "weak": "secret", "access": "identity", "ident": "identity", "endpoint": "identity"}


def link(text: str, base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The weak parts with a complementary part in their scope.

    An interval join of the two sides: each part, widened by SCOPE and cut at blank lines, is met with the sorted parts
    of the other side by binary search. The longest part of a side bounds how far back a search has to look, so the
    work grows with the parts and not with their pairs.
    """
    if not weak:
        return []
    walls = [m.start() for m in _break.finditer(text)]
    sides: dict[str, list[tuple[int, int]]] = {"secret": [], "identity": []}
    for a, b, kind in [*base, *weak]:
        sides[SIDE[kind]].append((a, b))
    for v in sides.values():
        v.sort()
    starts = {k: [a for a, _ in v] for k, v in sides.items()}
    reach: dict[str, list[int]] = {}
    for k, v in sides.items():
        far, reach[k] = 0, []
        for _, b in v:
            far = max(far, b)
            reach[k].append(far)
    kept = []
    for a, b, kind in weak:
        other = "identity" if SIDE[kind] == "secret" else "secret"
        i = bisect_left(walls, a)
        low = max(a - SCOPE, walls[i - 1] if i else 0)
        j = bisect_left(walls, b)
        high = min(b + SCOPE, walls[j] if j < len(walls) else len(text))
        # Parts that start before high; the furthest end among them tells whether any reaches into the scope.
        n = bisect_left(starts[other], high)
        if n and reach[other][n - 1] > low:
            kept.append((a, b, kind))
    return kept


def listed(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: numbers of base spans, a digest of their list, all spans, and how many were added by linking.

    A null text counts as empty and has no spans; rows keep their multiplicity; other columns are not read. A document
    is scanned as one text, whatever its length, so no scope ever spans two tasks and nothing is shuffled. An empty
    table gives an empty result.
    """
    tune(docs.sparkSession)
    rows = docs.select(either(docs, "doc_id", "long").alias("doc_id"), F.coalesce(either(docs, "text", "string"), F.lit("")).alias("text"))

    def work(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                base = base_spans(text)
                more = link(text, base, weak_parts(text, base))
                n = Counter(k for _, _, k in base)
                out.append((doc, n["assign"], n["access"], n["hex"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])
            frame["doc_id"] = batch["doc_id"].array
            yield frame

    return rows.mapInPandas(work, SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document; n_linked is added."""
    return scan(read(spark, sf_dir, "documents"))
