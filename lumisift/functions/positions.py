"""Highlight ranges of matches, for the few rows that win: an Arrow UDF around a small traceback."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import matching as M
from . import paths as P
from .matching import BEST_UNITS, BOUNDARY, CAMEL, CONSECUTIVE, GAP_CAP, GAP_EXTEND, GAP_OPEN, MATCH, START, TRANSITION, Term


def _fold(text: str, t: Term) -> str:
    if t.ascii:
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join("i" if c == "İ" else c.lower() if len(c.lower()) == 1 else c for c in text)


def _bonus(before: str | None, c: str) -> int:
    if before is None:
        return START
    if before in "-_. ":
        return BOUNDARY
    if before.islower() and c.isupper():
        return CAMEL
    return TRANSITION if (before.isalpha() and c.isdigit()) or (before.isdigit() and c.isalpha()) else 0


def _gap(distance: int) -> int:
    return min(GAP_OPEN + (distance - 2) * GAP_EXTEND, GAP_CAP)


def _aligned(text: str, folded: str, pattern: str) -> list[int]:
    """Character indices of the best alignment, leftmost beyond the bound. Equal scores: the first end, and no gap."""
    if len(folded) > BEST_UNITS:
        out, at = [], -1
        for c in pattern:
            at = folded.index(c, at + 1)
            out.append(at)
        return out
    bonus = [_bonus(text[i - 1] if i else None, c) for i, c in enumerate(text)]
    rows: list[dict[int, tuple[int, int]]] = []  # for each pattern unit: place -> (score, the place before)
    for q, c in enumerate(pattern):
        row = {}
        for p, x in enumerate(folded):
            if x != c:
                continue
            if not q:
                row[p] = (MATCH + bonus[p], -1)
                continue
            best = None
            if p - 1 in rows[-1]:
                best = (rows[-1][p - 1][0] + MATCH + max(bonus[p], CONSECUTIVE), p - 1)
            for k in range(p - 2, -1, -1):
                if k in rows[-1]:
                    score = rows[-1][k][0] - _gap(p - k) + MATCH + bonus[p]
                    if best is None or score > best[0]:
                        best = (score, k)
            if best:
                row[p] = best
        rows.append(row)
    if not rows[-1]:
        return []
    at = max(rows[-1], key=lambda p: (rows[-1][p][0], -p))
    out = []
    for row in reversed(rows):
        out.append(at)
        at = row[at][1]
    return out[::-1]


def term_positions(text: str, t: Term, fuzzy: bool = True) -> list[int]:
    """Indices of the characters that the term's best occurrence covers."""
    folded, pattern = _fold(text, t), t.text
    if not pattern or not text:
        return []
    if folded.startswith(pattern):
        return list(range(len(pattern)))
    at = next((m.start() for m in re.finditer(f"(?={re.escape(pattern)})", folded) if not folded[m.start() - 1].isalnum()), folded.find(pattern))
    if at >= 0:
        return list(range(at, at + len(pattern)))
    return _aligned(text, folded, pattern) if fuzzy else []


def ranges(indices: set[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for i in sorted(indices):
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return out


def highlight(display: Column, wanted: list[Term], fuzzy: bool = True) -> Column:
    """Half-open character ranges of all terms in the display text, merged."""

    @F.pandas_udf("array<array<int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: ranges({i for t in wanted for i in term_positions(x or "", t, fuzzy)}))

    return run(display)


def substring_ranges(display: Column, wanted: list[Term]) -> Column:
    """The same where terms count as substrings only, as a Column that stays in the JVM."""

    def range_(t: Term) -> Column:
        folded = t.fold(display)
        inner = F.regexp_instr(folded, F.lit(r"[^\p{L}\p{Nd}]" + M._literal(t.text)))
        at = F.when(folded.startswith(t.text), 0).when(inner > 0, inner).otherwise(F.instr(folded, F.lit(t.text)) - 1)
        return F.when(at >= 0, F.array(at, at + t.units))

    return P.merge_ranges(F.filter(F.array(*(range_(t) for t in wanted)), lambda r: r.isNotNull()), F.length(display), 1 << 20)
