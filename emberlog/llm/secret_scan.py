"""Secrets by fixed patterns, and multipart credentials by an interval join of their parts.

Three base patterns always count. Besides, a text may hold a credential in parts: an access identifier, a secret and
an endpoint, each harmless or doubtful alone. Parts are spans; the scope of a part is its span widened by a fixed
number of code points. An interval join of the parts decides: a weak secret (a long mixed token without any keyword) is
reported only if its scope meets an access identifier or an endpoint, and an endpoint only if its scope meets a
secret. A token may be the value of an assignment, but not its name; inside an endpoint it is a part of that. Each part needs one partner within its scope, found by two probes of sorted spans; pairs are not listed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import arrow_map, keyed_text, rows_of

#: The base kinds in their order, with what a match must have.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Parts of multipart credentials.
WEAK = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|wss?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20\"'<>]+"
KINDS = ("assign", "access", "hex", "weak", "endpoint")

#: Code points within which complementary parts belong together.
SCOPE = 200

SPANS = """doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string,
           found array<struct<kind: string, start: int, end: int>>"""


class Scanner:
    """Spans of one text at a time; no state between texts."""

    def __init__(self, scope: int):
        self.scope = scope
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(f"{ACCESS[:-1]}{{{ACCESS_LEAST - 4},}}")
        self.hex = re.compile(f"{HEX[:-1]}{{{HEX_LEAST},}}")
        self.weak = re.compile(WEAK)
        self.endpoint = re.compile(ENDPOINT)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's place, end) of all base spans, in order.

        Identifiers and hexadecimal runs are maximal, so asking for their least length at once finds the same spans
        as dropping short matches. An assignment with a short value is a match that counts for the search and is
        dropped only then.
        """
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def linked(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Weak secrets whose scope meets an identifier or endpoint, and the endpoints whose scope meets a secret."""
        weak = [(m.start(), m.end()) for m in self.weak.finditer(text) if _mixed(m.group())]
        endpoints = [(m.start(), m.end()) for m in self.endpoint.finditer(text)]
        identifiers = [(s, e) for s, kind, e in base if kind == 1]
        secrets = [(s, e) for s, kind, e in base if kind != 1]
        if not (identifiers or endpoints) or not (weak or secrets):
            return []
        taken = Intervals((s, e) for s, _, e in base)
        inside = Intervals(endpoints)
        loose = [x for x in weak if not taken.near(x, 0) and not inside.near(x, 0)]
        near_id, near_end = Intervals(identifiers), Intervals(endpoints)
        kept = [x for x in loose if near_id.near(x, self.scope) or near_end.near(x, self.scope)]
        partners = Intervals(sorted(kept + secrets))
        return [(s, 3, e) for s, e in kept] + [(s, 4, e) for s, e in endpoints if partners.near((s, e), self.scope)]


class Intervals:
    """Disjoint or nested spans, asked for one that lies within a distance: a sorted interval join by two probes."""

    def __init__(self, spans):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.furthest, far = [], -1
        for _, end in self.spans:
            far = max(far, end)
            self.furthest.append(far)

    def near(self, span: tuple[int, int], distance: int) -> bool:
        start, end = span
        before = (bisect_left if not distance else bisect_right)(self.starts, end + distance)
        return before > 0 and self.furthest[before - 1] > start - distance - bool(distance)


def _mixed(token: str) -> bool:
    """Looks random: letters of both cases and digits."""
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, a digest of the base spans, and all spans.

    Offsets count code points, ends are exclusive; spans are ordered by start and then by kind as in ``KINDS``.
    Null and empty texts have no spans and the digest of the empty string. Rows with equal ids stay apart. Scopes lie
    inside a text, so parts are joined where the text is: no shuffle, and a long text costs n log n.
    """

    def make():
        scanner = Scanner(scope)

        def run(batches) -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, 64):
                text = text or ""
                base = scanner.base(text)
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                spans = sorted(base + scanner.linked(text, base))
                yield (doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans),
                       [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])

        return run

    return arrow_map(keyed_text(docs, id_col, text_col), make, SPANS)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
