"""Semantic versions: order, ranges, and affectedness by advisories (public semver.org rules and npm range syntax)."""

from __future__ import annotations

import re
from functools import total_ordering

_version = re.compile(r"^[v=\s]*(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$")
_partial = re.compile(r"^[v=\s]*(\d+|[xX*])?(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")


@total_ordering
class Version:
    def __init__(self, major: int, minor: int, patch: int, pre: tuple = ()):
        self.core, self.pre = (major, minor, patch), pre

    def _key(self):
        # A version without pre-release comes after those with one; numbers come before words.
        return self.core, not self.pre, tuple((isinstance(p, str), p) for p in self.pre)

    def __eq__(self, other):
        return self._key() == other._key()

    def __lt__(self, other):
        return self._key() < other._key()

    def __hash__(self):
        return hash(self._key())


def _pre(text: str | None) -> tuple:
    return tuple(int(p) if p.isdigit() else p for p in text.split(".")) if text else ()


def parse(text: str | None) -> Version | None:
    m = _version.match(text or "")
    return Version(int(m[1]), int(m[2]), int(m[3]), _pre(m[4])) if m else None


def compare(a: str, b: str) -> int | None:
    x, y = parse(a), parse(b)
    return None if x is None or y is None else (x > y) - (x < y)


def _bounds(op: str, text: str) -> list[tuple[str, Version]] | None:
    """One comparator → simple ones; None if it can't be read."""
    m = _partial.match(text)
    if not m:
        return None
    parts = [None if p is None or p in "xX*" else int(p) for p in m.group(1, 2, 3)]
    major, minor, patch = parts
    pre = _pre(m[4])
    low = Version(major or 0, (minor or 0) if major is not None else 0, (patch or 0) if minor is not None and major is not None else 0, pre if patch is not None else ())
    if major is None:
        return [("<", Version(0, 0, 0, (0,)))] if op in ("<", ">") else []
    edge = Version(major + 1, 0, 0, (0,)) if minor is None else Version(major, minor + 1, 0, (0,))
    full = minor is not None and patch is not None
    if op in ("", "="):
        return [("=", low)] if full else [(">=", low), ("<", edge)]
    if op == "^":
        top = Version(major + 1, 0, 0, (0,)) if major or minor is None else Version(0, minor + 1, 0, (0,)) if minor or patch is None else Version(0, 0, patch + 1, (0,))
        return [(">=", low), ("<", top)]
    if op in ("~", "~>"):
        return [(">=", low), ("<", edge)]
    if op == ">":
        return [(">", low)] if full else [(">=", Version(*edge.core))]
    if op == "<=":
        return [("<=", low)] if full else [("<", edge)]
    return [(op, low if full or op != "<" else Version(*low.core, (0,)))]


def _holds(v: Version, op: str, w: Version) -> bool:
    return {"=": v == w, ">": v > w, ">=": v >= w, "<": v < w, "<=": v <= w}[op]


def satisfies(version: str | None, wanted: str | None) -> bool:
    """npm range matching; a pre-release only satisfies comparators that name a pre-release of the same triple."""
    v = parse(version)
    if v is None or wanted is None:
        return False
    for alternative in wanted.split("||"):
        text = re.sub(r"\s*(?<!\S)(\S+)\s+-\s+(\S+)\s*", lambda m: f" >={m[1]} <={m[2]} ", alternative.strip())
        text = re.sub(r"(>=|<=|~>|>|<|=|\^|~)\s+", r"\1", text)
        simple, ok = [], True
        for part in text.split():
            m = re.match(r"^(>=|<=|~>|>|<|=|\^|~)?(.*)$", part)
            got = _bounds(m[1] or "", m[2])
            if got is None:
                ok = False
                break
            simple += got
        if not ok or not all(_holds(v, op, w) for op, w in simple):
            continue
        if v.pre and not any(w.pre and w.pre != (0,) and w.core == v.core for _, w in simple):
            continue
        return True
    return False


def osv_affected(version: str | None, versions: list[str] | None, ranges: list[list[dict]] | None) -> bool:
    """Listed, or inside a range: its events, in order, switch affectedness on and off, unless a limit excludes it.
    Without a version everything is affected. A range is a list of events with one of introduced, fixed, last_affected, limit."""
    if not version:
        return True
    if version in (versions or []):
        return True
    cmp = lambda x: -1 if (c := compare(version, x)) is None else c
    for events in ranges or []:
        limits = [e["limit"] for e in events if e.get("limit")]
        if limits and not any(x == "*" or cmp(x) < 0 for x in limits):
            continue
        on = False
        for e in events:
            if (x := e.get("introduced")) and (x == "0" or cmp(x) >= 0):
                on = True
            elif (x := e.get("fixed")) and cmp(x) >= 0:
                on = False
            elif (x := e.get("last_affected")) and cmp(x) > 0:
                on = False
        if on:
            return True
    return False
