"""Golden rows of the match semantics, and the alignment against a plain dynamic program."""

import random

import pytest
from pyspark.sql import functions as F

from lumisift.functions import matching as M
from lumisift.functions.positions import _aligned, _fold, highlight, ranges


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("r")).head()[0]


@pytest.mark.parametrize(
    "target,pattern,tier",
    [
        ("Fire", "fire", 1), ("Firefox", "fire", 2), ("Amazon Fire TV", "fire", 3), ("gnome-fire-manager", "fire", 3), ("org.fire.Tool", "fire", 3), ("Campfire", "fire", 4),
        ("Firefox", "fox", 4), ("x1able", "able", 4), ("Firefox", "firefx", 5), ("GIMP", "fire", 6), ("", "fire", 6), ("İstanbul", "istanbul", 6), ("İstanbul", "İSTANBUL", 1), ("kelvin.txt", "\u212ael", 2), ("Müsic", "MÜSIC", 1),
    ],
)
def test_tiers(spark, target, pattern, tier):
    assert one(spark, target, lambda c: M.tier(c, M.term(pattern))) == tier


def test_no_fuzzy_tier(spark):
    assert one(spark, "Firefox", lambda c: M.tier(c, M.term("firefx"), fuzzy=False)) == M.NONE
    assert one(spark, None, lambda c: M.tier(c, M.term("x"))) == M.NONE


@pytest.mark.parametrize(
    "text,query,expected",
    [
        ("Campfired Fireplace", "fire", [[10, 14]]), ("Firefox", "fire fox", [[0, 7]]), ("My Documents Backup", "my backup", [[0, 2], [13, 19]]), ("Firefox", "firefx", [[0, 5], [6, 7]]),
        ("foo_bar", "fb", [[0, 1], [4, 5]]), ("Ähnlich", "hnli", [[1, 5]]), (None, "a", []), ("", "a", []),
    ],
)
def test_highlight(spark, text, query, expected):
    assert one(spark, text, lambda c: highlight(c, M.terms(query))) == expected


def test_ranges_merge():
    assert ranges({4, 0, 1}) == [[0, 2], [4, 5]]


def best(text, t):
    """Every alignment, by definition."""
    folded, chars = _fold(text, t), text
    if t.ascii:
        units = [b for c in folded for b in ([c] if ord(c) < 128 else ["\x01"] * len(c.encode()))]
        raw = [b for c in chars for b in ([c] if ord(c) < 128 else ["\x01"] * len(c.encode()))]
    else:
        units, raw = list(folded), list(chars)

    def bonus(i):
        if not i:
            return 12
        p, c = raw[i - 1], raw[i]
        if p in "-_. ":
            return 10
        if p.islower() and c.isupper():
            return 7
        return 6 if (p.isalpha() and c.isdigit()) or (p.isdigit() and c.isalpha()) else 0

    scores = {i: 16 + bonus(i) for i, u in enumerate(units) if u == t.text[0]}
    for x in t.text[1:]:
        scores = {i: max([s - (0 if k == i - 1 else min(3 + (i - k - 2), 9)) + 16 + (max(bonus(i), 8) if k == i - 1 else bonus(i)) for k, s in scores.items() if k < i]) for i, u in enumerate(units) if u == x and any(k < i for k in scores)}
    return max(scores.values(), default=None)


def test_alignment_is_the_best(spark):
    rng = random.Random(4)
    for pattern in ("ab", "abc", "a1", "éb"):
        t = M.term(pattern)
        rows = [("".join(rng.choice("aAbBcC1_-. é") for _ in range(rng.randrange(2, 30))),) for _ in range(120)]
        found = spark.createDataFrame(rows, "s string").where(M.is_subsequence(F.col("s"), t)).select("s", M.term_score(F.col("s"), t).alias("r")).collect()
        assert found
        for s, r in found:
            assert r == best(s, t), (s, pattern)


def test_alignment_order(spark):
    t = M.term("fb")
    scores = [one(spark, s, lambda c: M.term_score(c, t)) for s in ("foo_bar", "FooBar", "fxxbyyy")]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 3
    capped = [one(spark, "f" + "x" * n + "b", lambda c: M.term_score(c, t)) for n in (40, 200)]
    assert capped[0] == capped[1]
    assert one(spark, "f" + "x" * 600 + "b", lambda c: M.term_score(c, t)) == 16 + 12 + 16 - 9


def test_traceback_scores_as_the_best():
    assert _aligned("foo_bar", "foo_bar", "fb") == [0, 4]
    assert _aligned("xaab", "xaab", "ab") == [2, 3]


def test_globs(spark):
    for path, globs, out in [("/a/b.log", ["*.log"], True), ("/a/b.log", ["/a/*"], True), ("/a/c/b.log", ["/a/*"], False), ("/a/b1", ["b[0-9]"], True), ("/a/bx", ["b[^a-w]"], True), ("/a/b", [], False)]:
        assert one(spark, path, lambda c: M.excluded(c, globs)) is out
    with pytest.raises(ValueError):
        M.glob_pattern("a[")


def test_terms():
    assert [t.text for t in M.terms(" Foo\u00a0BAR\x1cx ")] == ["foo", "bar\x1cx"] and not M.term("é").ascii
