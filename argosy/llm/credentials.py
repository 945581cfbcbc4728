"""Secret scans with multipart credential linking.

Strong patterns are always reported. Beside them, parts of credentials are collected: access identifiers, secrets and
endpoints, each strong or weak. A weak part alone is no finding: an interval join links it to complementary parts (another
role) whose intervals, widened by `reach` code points, overlap its own within the same scope (a block of text between blank
lines), and it is reported only if a secret and an identifier or endpoint meet. Parts of a document lie in one row, so the
join is a merge over sorted starts within the document, in n log n and without a shuffle.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive; repeated rows are scanned each;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import each_text

# The strong patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

# Patterns of weak parts.
WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account_?id|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"\b(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._-]+(?::[0-9]{1,5})?|\bhost[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+\.[A-Za-z0-9.-]+", re.ASCII)
HINT = re.compile(r"(?i)user|login|client|account|access|://|host", re.ASCII)
GAP = re.compile(r"\n[\x20\t]*\n")

BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE, "weak_id", "weak_secret", "endpoint"))}
ROLE = {"assign": "secret", "hex": "secret", "access": "id", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}


class Found(NamedTuple):
    base: list[tuple[str, int, int]]
    weak: list[tuple[str, int, int]]
    links: list[tuple[tuple[str, int, int], tuple[str, int, int]]]


def strong(text: str) -> list[tuple[str, int, int]]:
    """The base spans."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN] if ":" in text or "=" in text else []
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def entropy(token: str) -> float:
    """Bits a character."""
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def _dense(token: str) -> bool:
    return bool(re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token)) and entropy(token) >= 3.5


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak candidates that overlap no base span."""
    found = [("weak_secret", *m.span()) for m in WEAK_SECRET.finditer(text) if _dense(m[0])]
    if HINT.search(text):
        found += [("weak_id", *m.span()) for m in WEAK_ID.finditer(text)] + [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if not found:
        return found
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], []
    for _, b in taken:  # the furthest end so far
        ends.append(max(b, ends[-1]) if ends else b)
    return [s for s in found if not (i := bisect_left(starts, s[2])) or ends[i - 1] <= s[1]]


def pairs(text: str, parts: list[tuple[str, int, int]], reach: int) -> list:
    """Every pair (identifier or endpoint, secret) of parts within reach and scope, by the interval join."""
    gaps = [m.start() for m in GAP.finditer(text)]
    scope = lambda at: bisect_right(gaps, at)
    secrets = sorted((s for s in parts if ROLE[s[0]] == "secret"), key=lambda s: s[1])
    starts = [s[1] for s in secrets]
    stops = list(accumulate((s[2] for s in secrets), max))  # the furthest end so far
    out = []
    for part in sorted((s for s in parts if ROLE[s[0]] != "secret"), key=lambda s: s[1]):
        near = secrets[bisect_left(stops, part[1] - reach) : bisect_right(starts, part[2] + reach)]
        out += [(part, s) for s in near if part[1] - s[2] <= reach and scope(s[1]) == scope(part[1])]
    return out


def link(text: str, base: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], reach: int) -> list:
    """Pairs (weak part, complementary part): each weak part with all parts of other roles within reach and scope."""
    own, found = set(weak), pairs(text, [*base, *weak], reach)
    return [(a, b) for a, b in found if a in own] + [(b, a) for a, b in found if b in own]


def scan(text: str, reach: int = 200) -> Found:
    base = strong(text)
    weak = weak_parts(text, base)
    links = pairs(text, [*base, *weak], reach) if weak or len(base) > 1 else []
    met = {s for pair in links for s in pair}
    return Found(base, sorted(set(weak) & met, key=lambda s: (s[1], ORDER[s[0]])), links)


def scan_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, base, added and links: arrays of spans, and all pairs of an identifier or endpoint (part) with a secret (other), strong parts too."""
    span = "struct<kind: string, start: int, stop: int>"

    def rows(texts):
        as_span = lambda s: dict(zip(("kind", "start", "stop"), s, strict=True))
        for f in (scan(t, reach) for t in texts):
            yield [as_span(s) for s in f.base], [as_span(s) for s in f.weak], [{"part": as_span(a), "other": as_span(b)} for a, b in f.links]

    return each_text(docs, lambda texts: list(rows(texts)), f"base array<{span}>, added array<{span}>, links array<struct<part: {span}, other: {span}>>")

