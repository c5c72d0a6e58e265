import random
import re

from pyspark.sql import functions as F

from lumisift.functions import matching as M
from lumisift.operators import ranking, search


def table(spark, rows):
    return spark.createDataFrame(rows, "parent_dir string, name string, is_dir boolean")


def test_golden_name_order(spark):
    rows = [("/b", "report", True), ("/a", "report", False), ("/c", "report", False), ("/longer", "report", False), ("/a", "report2", True), ("/a", "reports.txt", False), ("/a", "myreport.txt", False)]
    got = [r.path for r in search.search(table(spark, rows[::-1]), "report").orderBy("rank").collect()]
    assert got == ["/b/report", "/a/report", "/c/report", "/longer/report", "/a/report2", "/a/reports.txt", "/a/myreport.txt"]


def test_golden_path_order(spark):
    files = ["/etc/hosts", "/etc/hosts.d/extra", "/backup/etc/hosts", "/old/etc/hosts.bak", "/var/etcetera/hosts"]
    rows = [(p.rpartition("/")[0], p.rpartition("/")[2], False) for p in files] + [("/etc", "hosts.d", True), ("/", "etc", True)]
    got = [r.path for r in search.search(table(spark, rows), "/etc/hosts").orderBy("rank").collect()]
    assert got == ["/etc/hosts", "/backup/etc/hosts", "/etc/hosts.d", "/etc/hosts.d/extra", "/old/etc/hosts.bak"]
    assert "/etc" not in [r.path for r in search.search(table(spark, rows), "etc/").collect()]


def oracle(rows, query, limit):
    """The naive search, row by row."""
    terms = [w.lower() for w in query.split()]

    def numbers(path):
        return [(0, -int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"[0-9]+|[^0-9]+", path)]

    out = []
    for parent, name, is_dir in rows:
        low, path = name.lower(), (parent if parent.endswith("/") else parent + "/") + name
        if len(terms) == 1:
            t = terms[0]
            cls = 0 if low == t else 1 if low.startswith(t) else 2 if t in low else None
        else:
            cls = 2 if all(t in low for t in terms) else None
        if cls is not None:
            out.append((cls, not is_dir, len(path.encode()), numbers(path), path))
    return [x[-1] for x in sorted(out, key=lambda x: (x[0], x[1], x[2]) + (_Key(x[4]),))][:limit]


class _Key(str):
    """Compares as the total order does: runs of digits by falling value."""

    def __lt__(self, other):
        i = j = 0
        a, b = str(self), str(other)
        while i < len(a) and j < len(b):
            if a[i].isdigit() and b[j].isdigit():
                x, y = re.match("[0-9]+", a[i:])[0], re.match("[0-9]+", b[j:])[0]
                if int(x) != int(y):
                    return int(x) > int(y)
                i, j = i + len(x), j + len(y)
            elif a[i] != b[j]:
                return a[i].encode() < b[j].encode()
            else:
                i, j = i + 1, j + 1
        return len(a) - i < len(b) - j if (len(a) - i) != (len(b) - j) else a < b


def test_random_stores(spark):
    rng = random.Random(11)
    words = ["data", "report", "Img", "v", "old", "x9"]
    rows = list({(f"/d{rng.randrange(4)}", f"{rng.choice(words)}_{rng.choice(words)}_{rng.randrange(30)}.{rng.choice(['txt', 'md'])}", rng.random() < 0.2) for _ in range(300)})
    ready = search.prepared(table(spark, rows)).cache()
    for query in ("data", "re", "v_", "img old", "qqq", "x9 md"):
        got = [r.path for r in search.search(ready, query, 20, fuzzy=False).orderBy("rank").collect()]
        assert got == oracle(rows, query, 20), query


def test_fuzzy_after_substring(spark):
    rows = [("/a", "fxoxo", False), ("/a", "foo", False), ("/a", "bar", False), ("/a", "afoob", False)]
    got = [(r["name"], r["class"]) for r in search.search(table(spark, rows), "foo").orderBy("rank").collect()]
    assert got == [("foo", 0), ("afoob", 2), ("fxoxo", 3)]
    assert [r.name for r in search.search(table(spark, rows), "foo", fuzzy=False).orderBy("rank").collect()] == ["foo", "afoob"]


def test_nothing_to_find(spark):
    rows = table(spark, [("/a", "foo", False)])
    for query in ("", "  ", "a\0b", "/" + "x" * 2000):
        assert search.search(rows, query).count() == 0
    assert search.search(rows, "foo", 0).count() == 0
    assert search.search(table(spark, []), "foo").count() == 0


def test_blend_without_signals_changes_nothing(spark):
    rows = table(spark, [("/a", f"foo{i}", False) for i in range(9)])
    plain = [r.path for r in search.search(rows, "foo").orderBy("rank").collect()]
    assert [r.path for r in search.search(rows, "foo", blend=search.Blend(noise_weight=0.0)).orderBy("rank").collect()] == plain
    boost = spark.createDataFrame([("/a/foo3", 9.0)], "path string, value double")
    first = search.search(rows, "foo", blend=search.Blend(boost=boost)).orderBy("rank").head()
    assert (first.path, first["class"], first["eff_class"]) == ("/a/foo3", 1, 0)


def test_bands_never_overlap(spark):
    rows = spark.createDataFrame([(t, 400, 16, h) for t in range(1, 6) for h in (0.0, None, 100.0)], "tier int, score int, units int, hint double")
    got = rows.select("tier", ranking.band_score(F.col("tier"), F.col("score"), F.col("units"), F.col("hint")).alias("s")).collect()
    bands = [[r.s for r in got if r.tier == t] for t in range(1, 6)]
    assert all(min(a) > max(b) for a, b in zip(bands, bands[1:]))


def test_modes(spark):
    rows = spark.createDataFrame([("a", 1, None, 0), ("B", 2, 90.0, 1), ("c", 2, 10.0, 2)], "display string, tie_break long, hint double, ord int").withColumn("sort_key", F.col("display"))
    assert [r.display for r in ranking.rank_listed(rows).orderBy("rank").collect()] == ["B", "c", "a"]
    assert [r.display for r in ranking.rank_claimed(rows).orderBy("rank").collect()] == ["B", "a", "c"]
    assert [r.score for r in ranking.rank_given(rows, 2).orderBy("rank").collect()] == [100.0, 99.0]
    assert ranking.rank_matched(rows, [F.col("display")], "zz").count() == 0
    assert M.match_fields([], M.terms("x")) is not None
