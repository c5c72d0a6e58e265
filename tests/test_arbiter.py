"""The arbiter, small values and system tables against known results."""

import random

from pyspark.sql import functions as F

from lumisift.functions import values as V
from lumisift.operators import arbiter
from lumisift.sources import system
from lumisift.streaming.changes import admitted

SCHEMA = "imp long, ts timestamp, joined boolean, pos int, picked boolean, kind string, query string, hour int, plugin string, score int, priority int, source_rank int, class int, eff_class int, align int, boost double, recency double, cwd double, penalty double, is_dir boolean, depth int, ext string"


def shown(spark, n, seed=1):
    """Impressions of five files; the most opened one is picked, wherever it stands."""
    from datetime import datetime, timedelta

    rng, rows = random.Random(seed), []
    for imp in range(n):
        boosts = [rng.random() * 5 for _ in range(5)]
        for pos, boost in enumerate(boosts):
            rows.append((imp, datetime(2024, 1, 1) + timedelta(minutes=imp), True, pos, boost == max(boosts), "file", " ab c/ ", 13, None, None, None, None, 2, 2, 64, boost, 0.0, 0.0, 0.1, False, 3, ".TXT"))
    return spark.createDataFrame(rows, SCHEMA)


def test_features(spark):
    rows = shown(spark, 1).withColumn("boost", F.lit(1.0)).limit(1)
    x = {f.idx: f.value for f in arbiter.features(rows).head().x}
    base = {0: 1.0, 1: 1.0, 5: 1.0, 8: 0.25, 9: 0.5, 12: 0.1, 14: 1.0, 50: 1.0, 57: 1.0, 59: 1.0, 63: 1.0}
    assert {k: v for k, v in x.items() if not 18 <= k < 34} == base and sum(18 <= k < 34 for k in x) == 1 and arbiter.DIM == 69
    assert len(arbiter.features(rows).select(arbiter.dense(F.col("x")).alias("d")).head().d) == 69


def test_training(spark):
    rows = arbiter.features(shown(spark, 220)).select("imp", "ts", "joined", "pos", "picked", "x").cache()
    out = arbiter.train(rows)
    assert out.weights and out.model > 0.95 > out.baseline and out.picks == 220 and out.weights[9] > 0
    assert arbiter.train(rows.where("imp < 100")).weights is None
    by_order = rows.withColumn("picked", F.col("pos") == 0)
    assert arbiter.train(by_order).weights is None


def test_values(spark):
    row = spark.range(1).select(
        V.rate_text(F.lit(1536.0)).alias("a"), V.rate_text(F.lit(20.4)).alias("b"), V.used_of_total(F.lit(6.694e9), F.lit(17.07e9)).alias("c"), V.percent(F.lit(11.5)).alias("d"), V.hex_color(F.lit("#0fA")).alias("e"), V.hex_color(F.lit("#12345")).alias("f"),
        V.leading_int(F.lit(" 42 x")).alias("g"), V.app_key(F.lit(""), F.array(F.lit("open"), F.lit("-a"))).alias("h"),
    ).head()
    assert (row.a, row.b, row.c, row.d, tuple(row.e), row.f, row.g, row.h) == ("1.5K", "20B", "6.2/16G", "12%", (0, 255, 170), None, 42, "app:open -a")
    data = [(b"\x89PNG\r\n\x1a\nx", "image/png"), (b"RIFF1234WEBP", "image/webp"), (b"\xef\xbb\xbf \n<svg>", "image/svg+xml"), (b"BMx", "image/bmp"), (b"text", None), (b"", None)]
    rows = spark.createDataFrame([(bytearray(d), k) for d, k in data], "d binary, k string").withColumn("got", V.image_type(F.col("d"))).collect()
    assert all(r.got == r.k for r in rows)


def test_system_tables(spark):
    def lines(*values):
        return spark.createDataFrame([("h", v) for v in values], "host string, value string")

    memory = system.memory_info(lines("MemTotal:  16 kB", "MemAvailable: x kB", "SwapFree: 2 kB", "junk"), ["host"]).head()
    assert (memory.total, memory.available, memory.swap_total, memory.swap_free) == (16384, None, None, 2048)
    cpu = system.cpu_counters(lines("cpu  1 2 3 4 5 6 7 8 9 10", "cpu0 1 1 1 1 1"), ["host"]).collect()
    assert [(r.total, r.busy) for r in cpu] == [(36, 27)]
    stats = system.process_stats(lines("12 (a b) c) S 7 12 12 34816 99 0", "x")).collect()
    assert [tuple(r) for r in stats] == [(12, 7, 99)]
    globs = system.type_globs(spark.createDataFrame([(0, "50:text/plain:*.txt"), (1, "90:text/other:*.txt"), (0, "#x"), (0, "50:text/x-make:makefile"), (0, "10:a/b:x*y")], "dir int, value string")).collect()
    assert {r.glob: (r.type, r.weight, r.form) for r in globs} == {"*.txt": ("text/plain", 50, "suffix"), "makefile": ("text/x-make", 50, "literal"), "x*y": ("a/b", 10, "complex")}
    ini = spark.createDataFrame([(1, "Install4F", "Default", "p1"), (1, "Profile0", "Path", "p0"), (1, "Profile0", "Default", "1"), (2, "Profile0", "Path", "q0"), (2, "Profile1", "Path", "q1"), (2, "Profile1", "Default", "1"), (3, "Profile0", "Path", "r0"), (4, "General", "Path", "s")], "file int, section string, key string, value string")
    assert {r.file: r.path for r in system.default_profile(ini).collect()} == {1: "p1", 2: "q1", 3: "r0"}
    live, stored = (spark.createDataFrame(rows, "conn int, url string") for rows in ([(1, "a"), (3, "c")], [(1, "old"), (2, "b"), (4, "gone")]))
    got = system.live_or_stored(live, stored, spark.createDataFrame([(1,), (4,)], "conn int"), ["conn"]).collect()
    assert {tuple(r) for r in got} == {(1, "a"), (2, "b")}


def test_token_bucket(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2024-01-01 00:00:0{s}") for s in (0, 0, 0, 0, 1, 1, 5)] + [("b", "2024-01-01 00:00:00")], "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = admitted(spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.key, r.n) for r in spark.table("admitted").groupBy("key").agg(F.count("*").alias("n")).collect()} == {("a", 5), ("b", 1)}
