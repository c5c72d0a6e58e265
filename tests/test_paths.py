from pyspark.sql import functions as F

from lumisift.functions import paths as P


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string").orderBy("i").select(column(F.col("s"))).collect()]


def test_penalties(spark):
    paths = ["/tmp/x/log.txt", "/home/u/.config/app/s.json", "/home/u/.bashrc", "/home/.cache", "/u/.cache/tmp/x", "/1/2/3/4/5/6/7", "/" + "/".join(map(str, range(16))), "C:\\u\\Cache\\f", ""]
    assert [round(v, 6) for v in values(spark, paths, P.path_penalty)] == [0.3, 0.1, 0, 0, 0.6, 0.05, 0.25, 0.3, 0]


def test_directory_boost(spark):
    paths = ["/proj", "/proj/a", "/proj/a/b", "/proj/a/b/c", "/projX/a", "/"]
    assert values(spark, paths, lambda c: P.cwd_boost(c, "/proj", 10.0)) == [10, 10, 5, 2.5, 0, 0]
    assert values(spark, ["/a"], lambda c: P.cwd_boost(c, "/", 10.0)) == [0]


def test_keys(spark):
    assert values(spark, ["/x/PHOTO.JPG", "a.tar.gz", "Makefile", "/a.b/c", ".bashrc"], P.extension_key) == [".jpg", ".gz", "", "", ".bashrc"]
    assert values(spark, ["/home/me/projects/app/main.go", "/file.txt", "//x//y/z.txt"], P.directory_key) == ["/home/me/projects", "", "//x//y"]
    assert values(spark, ["/etc/hosts", "x"], P.top_component) == ["/etc", ""]


def test_number_order(spark):
    pairs = [("/a/2026-x", "/a/2024-x"), ("v2", "v1"), ("img_09", "img_01"), ("a12b3", "a1b23"), ("a01b2", "a1b02"), ("/backup/2026", "/backup/2024"), ("abc", "abcd")]
    for a, b in pairs:
        keys = values(spark, [a, b], P.number_key)
        assert (keys[0], a) < (keys[1], b), (a, b)


def test_recency(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.0, 1.0, 24.0, 168.0, 720.0)], "h double").select(P.recency_score(F.col("h"))).collect()]
    assert [round(x, 2) for x in got] == [1.0, 0.89, 0.51, 0.22, 0.0]


def test_ranges(spark):
    row = spark.range(1).select(P.merge_positions(F.array(*(F.lit(x) for x in (4, 0, 1, 1)))), P.merge_ranges(F.array(F.array(F.lit(-2), F.lit(3)), F.array(F.lit(3), F.lit(5)), F.array(F.lit(8), F.lit(99)), F.array(F.lit(6), F.lit(6))), F.lit(10)), P.merge_positions(F.array().cast("array<int>"))).head()
    assert list(row) == [[[0, 2], [4, 5]], [[0, 5], [8, 10]], []]


def test_hash_bucket(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) % 2**32
        return h % 16

    words = [".go", ".jpeg", "", "é", "firefox-tabs"]
    assert values(spark, words, lambda c: P.fnv_bucket(c, 16)) == [fnv(w) for w in words]


def test_colors(spark):
    got = spark.createDataFrame([(255, 0, 0), (0, 128, 255), (10, 10, 10)], "r int, g int, b int").select(P.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b")).alias("h")).select("h.*").collect()
    assert [tuple(x) for x in got] == [(0, 100, 50), (210, 100, 50), (0, 0, 4)]


def test_urls(spark):
    urls = ["http://a.b:80/c", "ftp://a", "https:///x", "nonsense", None]
    assert values(spark, urls, P.is_web_url) == [True, False, False, False, False]
