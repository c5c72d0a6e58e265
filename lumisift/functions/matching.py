"""Column builders of the match semantics: folding, terms, tiers, alignment scores.

A query's pattern chooses the folding when the plan is built: an ASCII pattern folds A-Z only, any
other folds each character by itself. All builders return Columns, so a query is one plan for Catalyst.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tiers of a match, the best first (fixed values).
EXACT, PREFIX, WORD_START, SUBSTRING, FUZZY, NONE = 1, 2, 3, 4, 5, 6
#: Alignment scores (fixed values): a match, its bonuses, and the cost of a gap.
MATCH, START, BOUNDARY, CONSECUTIVE, CAMEL, TRANSITION = 16, 12, 10, 8, 7, 6
GAP_OPEN, GAP_EXTEND, GAP_CAP = 3, 1, 9
#: Targets of more units are aligned leftmost rather than best.
BEST_UNITS = 512
_NEVER = -(1 << 28)


def ascii_fold(c: Column) -> Column:
    """A-Z as a-z, all else as it stands."""
    return F.translate(c, _UPPER, _LOWER)


def rune_fold(c: Column) -> Column:
    """Each character's own lower case; unlike lower(), no character depends on another or becomes two."""
    return F.array_join(F.transform(F.split(F.translate(c, "İ", "i"), ""), lambda x: F.lower(x)), "")


@dataclass(frozen=True)
class Term:
    """A folded pattern; ``ascii`` tells how haystacks fold."""

    text: str
    ascii: bool

    @property
    def units(self) -> int:
        return len(self.text)

    def fold(self, c: Column) -> Column:
        return ascii_fold(c) if self.ascii else rune_fold(c)


def term(pattern: str) -> Term:
    """One pattern, not split."""
    if pattern.isascii():
        return Term(pattern.translate(str.maketrans(_UPPER, _LOWER)), True)
    return Term("".join("i" if x == "İ" else x.lower() for x in pattern), False)


def terms(query: str) -> list[Term]:
    """The query's words, by Unicode white space (the information separators aren't)."""
    return [term(w) for w in re.split(r"[^\S\x1c-\x1f]+", query) if w]


def is_prefix(c: Column, t: Term) -> Column:
    return t.fold(c).startswith(t.text)


def is_suffix(c: Column, t: Term) -> Column:
    return t.fold(c).endswith(t.text)


def equals(c: Column, t: Term) -> Column:
    return t.fold(c) == t.text


def contains(c: Column, t: Term) -> Column:
    return t.fold(c).contains(t.text)


def index_of(c: Column, t: Term) -> Column:
    """Characters before the first occurrence, -1 if there is none."""
    return F.instr(t.fold(c), F.lit(t.text)) - 1


def prefix_bytes(c: Column, t: Term) -> Column:
    """Bytes of the haystack that the pattern covers at its beginning, -1 if it doesn't begin so."""
    return F.when(is_prefix(c, t), F.octet_length(F.left(c, F.lit(t.units)))).otherwise(-1)


def _literal(text: str) -> str:
    return "".join(f"\\x{{{ord(x):x}}}" for x in text)


def is_subsequence(c: Column, t: Term) -> Column:
    """The pattern's units stand in order. Possessive steps, so it is linear in the haystack."""
    return t.fold(c).rlike("(?s)^" + "".join(f"[^{_literal(x)}]*+{_literal(x)}" for x in t.text))


def is_word_start(c: Column, t: Term) -> Column:
    """An occurrence at the beginning or after what is neither a letter nor a digit."""
    return t.fold(c).rlike(rf"(?s)(^|[^\p{{L}}\p{{Nd}}]){_literal(t.text)}")


def tier(c: Column, t: Term, fuzzy: bool = True) -> Column:
    """The tier of one target; an empty target or pattern matches nothing."""
    if not t.text:
        return F.lit(NONE)
    out = F.when(c == "", NONE).when(equals(c, t), EXACT).when(is_prefix(c, t), PREFIX).when(is_word_start(c, t), WORD_START).when(contains(c, t), SUBSTRING)
    return F.coalesce((out.when(is_subsequence(c, t), FUZZY) if fuzzy else out).otherwise(NONE), F.lit(NONE))


def _units(c: Column, t: Term) -> tuple[Column, Column]:
    """Arrays of folded units and of the characters they come from. For an ASCII pattern a unit is a byte."""
    if t.ascii:
        for least, most, n in (("80", "7FF", 2), ("800", "FFFF", 3), ("10000", "10FFFF", 4)):
            c = F.regexp_replace(c, rf"[\x{{{least}}}-\x{{{most}}}]", "\x01" * n)
    return F.split(t.fold(c), ""), F.split(c, "")


def bonuses(chars: Column, unicode: bool) -> Column:
    """The positional bonus at each character."""
    small, capital, letter, digit = (r"\p{Ll}", r"\p{Lu}", r"\p{L}", r"\p{Nd}") if unicode else ("[a-z]", "[A-Z]", "[A-Za-z]", "[0-9]")

    def at(x: Column, i: Column) -> Column:
        before = F.get(chars, i - 1)
        return (
            F.when(i == 0, START).when(before.isin("-", "_", ".", " "), BOUNDARY).when(before.rlike(small) & x.rlike(capital), CAMEL)
            .when((before.rlike(letter) & x.rlike(digit)) | (before.rlike(digit) & x.rlike(letter)), TRANSITION).otherwise(0)
        )

    return F.transform(chars, at)


def _best(units: Column, bonus: Column, pattern: str) -> Column:
    """The best alignment, left to right in one pass: for each pattern unit the score of a match here, in a gap, and the best so far."""
    m = len(pattern)
    start = F.struct(*(F.lit(_NEVER).alias(f"{k}{q}") for q in range(m) for k in "hgr"), F.lit(_NEVER).alias("best"))

    def step(s: Column, x: Column) -> Column:
        fields = []
        for q, char in enumerate(pattern):
            b = x["bonus"]
            score = b + MATCH if q == 0 else F.greatest(s[f"h{q - 1}"] + MATCH + F.greatest(b, F.lit(CONSECUTIVE)), s[f"g{q - 1}"] + MATCH + b)
            h = F.when(x["unit"] == char, score).otherwise(_NEVER)
            g = F.greatest(s[f"h{q}"] - GAP_OPEN, s[f"g{q}"] - GAP_EXTEND, s[f"r{q}"] - GAP_CAP)
            fields += [h.alias(f"h{q}"), g.alias(f"g{q}"), F.greatest(s[f"r{q}"], h).alias(f"r{q}")]
            if q == m - 1:
                fields.append(F.greatest(s["best"], h).alias("best"))
        return F.struct(*fields)

    cells = F.zip_with(units, bonus, lambda u, b: F.struct(u.alias("unit"), b.alias("bonus")))
    return F.aggregate(cells, start, step, lambda s: s["best"])


def _leftmost(units: Column, bonus: Column, pattern: str) -> Column:
    """The alignment of first occurrences."""
    wanted = F.array(*(F.lit(x) for x in pattern))
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("score"), F.lit(-1).alias("last"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = s["at"] - s["last"] - 2
        next_to = s["last"] == s["at"] - 1
        b = F.when((s["q"] > 0) & next_to, F.greatest(x["bonus"], F.lit(CONSECUTIVE))).otherwise(x["bonus"])
        cost = F.when((s["q"] > 0) & ~next_to, F.least(GAP_OPEN + gap * GAP_EXTEND, F.lit(GAP_CAP))).otherwise(0)
        hit = (s["q"] < len(pattern)) & (x["unit"] == F.get(wanted, s["q"]))
        return F.struct(F.when(hit, s["q"] + 1).otherwise(s["q"]).alias("q"), F.when(hit, s["score"] + MATCH + b - cost).otherwise(s["score"]).alias("score"), F.when(hit, s["at"]).otherwise(s["last"]).alias("last"), (s["at"] + 1).alias("at"))

    cells = F.zip_with(units, bonus, lambda u, b: F.struct(u.alias("unit"), b.alias("bonus")))
    return F.aggregate(cells, start, step, lambda s: s["score"])


def term_score(c: Column, t: Term) -> Column:
    """The alignment score of a target that holds the term as a subsequence. Filter first: it is the expensive part."""
    units, chars = _units(c, t)
    bonus = bonuses(chars, not t.ascii)
    return F.when(F.size(units) > BEST_UNITS, _leftmost(units, bonus, t.text)).otherwise(_best(units, bonus, t.text))


def normalize_score(score: Column, units: Column | int) -> Column:
    """The score as a share of the best possible one, 0 to 1."""
    units = F.lit(units) if isinstance(units, int) else units
    return F.when((units <= 0) | (score <= 0), 0.0).otherwise(F.least(F.lit(1.0), score / (units * (MATCH + START))))


def match_fields(fields: list[Column], wanted: list[Term], fuzzy: bool = True) -> Column:
    """Struct (tier, field, score, units) of all terms over ordered fields, null where a term matches none.

    Each term takes its best tier, of the earliest field; the row has the worst tier and the latest field among the terms.
    """
    if not fields or not wanted:
        return F.lit(None).cast("struct<tier:int,field:int,score:int,units:int>")
    best = [F.array_min(F.array(*(F.struct(tier(F.coalesce(f, F.lit("")), t, fuzzy).alias("t"), F.lit(i).alias("f")) for i, f in enumerate(fields)))) for t in wanted]
    worst = F.array_max(F.array(*(b["t"] for b in best)))
    place = F.array_max(F.array(*(b["f"] for b in best)))
    score = reduce(lambda a, b: a + b, (reduce(lambda w, i: w.when(b["f"] == i, term_score(fields[i], t)), range(1, len(fields)), F.when(b["f"] == 0, term_score(fields[0], t))) for t, b in zip(wanted, best)))
    return F.when(worst < NONE, F.struct(worst.cast("int").alias("tier"), place.cast("int").alias("field"), score.cast("int").alias("score"), F.lit(sum(t.units for t in wanted)).alias("units")))


def glob_pattern(glob: str) -> str:
    """An anchored regular expression of a path glob: ``*`` and ``?`` stop at ``/``. Raises ValueError if malformed."""
    out, i = "^", 0
    while i < len(glob):
        x = glob[i]
        if x == "*":
            out += "[^/]*"
        elif x == "?":
            out += "[^/]"
        elif x == "\\":
            i += 1
            if i == len(glob):
                raise ValueError(f"malformed pattern {glob!r}")
            out += _literal(glob[i])
        elif x == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"malformed pattern {glob!r}")
            body = glob[i + 1 : end]
            deny = body.startswith("^")
            out += "[" + "^/" * deny + "".join(y if y == "-" else _literal(y) for y in body[deny:]) + "]"
            i = end
        else:
            out += _literal(x)
        i += 1
    return out + "$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Globs with a separator are held against the whole path, others against its last part."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    tests = [(path if "/" in g else name).rlike(glob_pattern(g)) for g in globs]
    return reduce(lambda a, b: a | b, tests, F.lit(False))
