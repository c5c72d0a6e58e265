"""Usage tables, stores, streams, sources and providers."""

import json
import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumisift.operators import providers, series, usage, web
from lumisift.plans import store
from lumisift.sources import logs
from lumisift.sources.tree import TreeSource, outermost_roots
from lumisift.streaming import changes

T0 = datetime(2024, 1, 1)


def test_open_counts_match_a_fold(spark):
    times = [T0 + timedelta(days=d) for d in (0, 3, 3, 20, 41)]
    now = T0 + timedelta(days=50)
    c, last = 0.0, None
    for t in times:
        c = (c * 2 ** (-(t - last).total_seconds() / (14 * 86400)) if last else 0.0) + 1
        last = t
    c *= 2 ** (-(now - last).total_seconds() / (14 * 86400))
    got = usage.open_counts(spark.createDataFrame([("/a", t) for t in times] + [("", T0), (None, T0)], "path string, ts timestamp"), F.lit(now)).collect()
    assert len(got) == 1 and math.isclose(got[0].boost, c)


def test_bootstrap_of_rates(spark):
    shown = spark.createDataFrame([("/x/a.go",)], "path string")
    picks = spark.createDataFrame([], "path string")
    weights = spark.createDataFrame([("/x/b.md", 3.0), ("/y/c.go", 1.0)], "path string, weight double")
    got = {r.key: (r.picks, r.impressions) for r in usage.rate_tables(shown, picks, F.regexp_extract("path", r"(\.\w+)$", 1), 10, weights).collect()}
    assert got == {".go": (1.0, 5.0), ".md": (3.0, 4.0)}


def test_valid_counts(spark):
    rows = spark.createDataFrame([("/a", 1.0, T0), ("", 1.0, T0), ("/b", 0.0, T0), ("/c", float("nan"), T0), ("/d", float("inf"), T0), ("/e", 1.0, None)], "path string, count double, touched timestamp")
    assert [r.path for r in usage.valid_counts(rows).collect()] == ["/a"]


def test_cache_and_history(spark):
    items = spark.createDataFrame([("a", 100, 3), ("b", 500, 2), ("c", 9999, 5)], "key string, size long, used long")
    assert [r.key for r in usage.cache_budget(items, 800).collect()] == ["a"]
    rows = spark.createDataFrame([(1, "x "), (2, "y"), (3, " x"), (4, "  ")], "ord long, entry string")
    assert [r.entry for r in usage.history(rows).orderBy("place").collect()] == ["y", "x"]


def test_snapshot(spark):
    log = spark.createDataFrame([(1, "add", "/a/b/f", False), (2, "add", "/a/g", False), (3, "remove", "/a/b", False), (4, "add", "/a/b/h", False), (5, "remove", "/a/g", False), (6, "add", "/a/g", True)], "seq long, op string, path string, is_dir boolean")
    got = {(r.parent_dir, r.name): (r.id, r.is_dir, r.tombstone) for r in store.snapshot(log).collect()}
    assert got == {("/a/b", "f"): (1, False, True), ("/a", "g"): (2, True, False), ("/a/b", "h"): (4, False, False)}
    assert store.tombstone_ratio(store.snapshot(log)).head()[0] == 1 / 3
    assert store.tombstone_ratio(store.snapshot(log.where("seq > 99"))).head()[0] == 0


def test_roots_and_names(spark):
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/a/b/c",)], "path string")
    assert sorted(r.path for r in store.outermost(roots).collect()) == ["/a", "/ab"]
    assert outermost_roots(["/a/b", "/a", "/ab"]) == ["/a", "/ab"]
    names = spark.createDataFrame([("a",), ("",), ("..",), ("a/b",), (None,)], "n string")
    assert [r[0] for r in names.select(store.valid_name(F.col("n"))).collect()] == [True, False, False, False, False]


def test_debounce_rules():
    out, pending, first, last = changes.batches_of([(0, "a"), (100, "b"), (200, "a"), (500, "c"), (700, "d"), (900, "e"), (1100, "f"), (1300, "g"), (1499, "h"), (1600, "i")], [], 0, 0)
    assert out == [(450, ["a", "b"]), (1500, ["c", "d", "e", "f", "g", "h"])] and pending == ["i"]
    assert changes.batches_of([(0, "a"), (1, "b"), (2, "c")], [], 0, 0, most=2)[0] == [(1, ["a", "b"])]


def _run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append" if name != "opened" else "update").start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    rows = [("r", f"/p{i % 3}", T0 + timedelta(milliseconds=100 * i + (2000 if i > 4 else 0))) for i in range(8)] + [("r", "/z", T0 + timedelta(seconds=60))]
    spark.createDataFrame(rows, "root string, path string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("root string, path string, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    _run(changes.debounced(events), "debounced")
    got = {}
    for r in spark.table("debounced").orderBy("closed", "ord").collect():
        got.setdefault(r.closed, []).append(r.path)
    assert list(got.values())[:2] == [["/p0", "/p1", "/p2"], ["/p2", "/p0", "/p1"]]
    _run(changes.opened(events.select("path", "ts")), "opened")
    batch = {r.path: r.boost for r in usage.open_counts(spark.read.parquet(str(tmp_path / "in")), F.lit(T0 + timedelta(seconds=60))).collect()}
    for r in spark.table("opened").collect():
        age = (T0 + timedelta(seconds=60) - r.touched).total_seconds()
        assert math.isclose(r["count"] * 2 ** (-age / (14 * 86400)), batch[r.path], rel_tol=1e-6)
    _run(changes.throttled(events.select(F.col("path").alias("key"), "ts"), 1.0), "throttled")
    assert spark.table("throttled").where("key = '/p0'").count() == 2


def test_reconcile_converges(spark):
    schema = "parent_dir string, name string, is_dir boolean"
    index = spark.createDataFrame([("/r", "a", True), ("/r/a", "x", False), ("/r", "b", False), ("/r", "keep", False)], schema)
    truth = spark.createDataFrame([("/r", "a", False), ("/r", "c", True), ("/r/c", "y", False), ("/r", "keep", False)], schema)
    dirty = spark.createDataFrame([("/r/a",), ("/r/b",), ("/r/c",)], "path string")
    assert sorted(changes.reconciled(index, truth, dirty).collect()) == sorted(truth.collect())


def test_watch_in_batches(spark, tmp_path):
    schema = "parent_dir string, name string, is_dir boolean"
    truth = spark.createDataFrame([("/r", "n", False)], schema)
    kept = {"index": spark.createDataFrame([("/r", "o", False)], schema)}
    spark.createDataFrame([("/r/o",), ("/r/n",)], "path string").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("path string").parquet(str(tmp_path / "in"))
    q = changes.watch(events, lambda: kept["index"], lambda: truth, lambda d: kept.update(index=spark.createDataFrame(d.collect(), schema)), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert kept["index"].collect() == truth.collect()


def test_excluded_events(spark):
    rows = spark.createDataFrame([("/a/.git/x", "create"), ("/a/b", "create"), ("/a/c", "chmod")], "path string, op string")
    assert [r.path for r in changes.wanted(rows, [".git"]).collect()] == ["/a/b"]


def test_log_reader(spark, tmp_path):
    row = {"v": 1, "ts": "2024-01-01T00:00:00Z", "query": "q", "joined": True, "shown": [{"rank": 0, "kind": "file", "path": "/a"}, {"rank": 1, "kind": "plugin", "plugin": "p"}], "picked": {"rank": 1, "kind": "plugin", "plugin": "p"}}
    odd = {**row, "shown": [{"rank": 0, "kind": "other"}]}
    (tmp_path / "log").write_text("\n".join([json.dumps(row), json.dumps(row)[:40], json.dumps({**row, "v": 2}), json.dumps(odd)]))
    log = logs.pick_log(spark, [str(tmp_path / "log")])
    assert log.count() == 2
    assert [tuple(r) for r in logs.pick_records(log).select("shown", "path").collect()] == [(["/a"], None)]
    assert [(r.pos, r.picked) for r in logs.impressions(log).orderBy("pos").collect()] == [(0, False), (1, True)]


def test_ini(spark):
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["x=0", "[A]", "k = 1", "; no", "k=2", "[B]", "k=3"])], "file string, n int, value string")
    assert sorted((r.section, r.key, r.value) for r in logs.ini_sections(lines).collect()) == [("A", "k", "2"), ("B", "k", "3")]


def test_desktop_apps(spark):
    good = ["[Desktop Entry]", "Type=Application", "Name=X", "Exec=x"]
    rows = [("u/x", 1, "x", i, v) for i, v in enumerate(good)] + [("l/x", 0, "x", i, v) for i, v in enumerate([*good, "Hidden=true"])] + [("u/y", 1, "y", i, v) for i, v in enumerate(good)]
    assert [r.id for r in logs.desktop_apps(spark.createDataFrame(rows, "file string, dir int, id string, n int, value string")).collect()] == ["y"]


def test_tree_source(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/f.txt").write_text("x")
    (tmp_path / "a/skip.log").write_text("x")
    (tmp_path / "g").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    spark.dataSource.register(TreeSource)
    got = spark.read.format("tree").option("roots", str(tmp_path)).option("excludes", "*.log").load()
    assert sorted((r.parent_dir.removeprefix(str(tmp_path)), r.name, r.is_dir) for r in got.collect()) == [("", "a", True), ("", "g", False), ("", "link", False), ("/a", "b", True), ("/a/b", "f.txt", False)]


def test_mounts(spark):
    lines = spark.createDataFrame([("proc /proc proc rw",), ("//h/s /home/u/my\\040nas cifs rw",), ("/dev/a /home ext4 rw",), ("x /home fuse.sshfs rw",), ("y /home/z fuse.sshfs rw",)], "value string")
    assert [r.path for r in series.mount_skips(series.mounts(lines), ["/home"]).collect()] == ["/home/u/my nas", "/home/z"]


def test_rates(spark):
    rows = spark.createDataFrame([(1, 0, 0), (2, 10, 5), (3, 5, 6), (4, 15, 20)], "ts int, total int, busy int").withColumn("k", F.lit(0))
    assert [r.pct for r in series.busy_rates(rows, ["k"]).orderBy("ts").collect()] == [None, 50.0, None, 100.0]


def test_page_icons(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x"), (2, "https://www.b.org/"), (3, "https://c.org/")], "page_id int, page_url string")
    bridge = spark.createDataFrame([(1, 10), (1, 11)], "page_id int, icon_id int")
    icons = spark.createDataFrame([(10, "https://a.org/16.png", 16, False, 0, 5), (11, "https://a.org/64.png", 64, False, 1, 5), (12, "http://b.org/favicon.ico", 16, True, 2, 5)], "id int, icon_url string, width int, root boolean, ord int, size long")
    assert sorted((r.page_url, r.icon_url) for r in web.page_icons(pages, bridge, icons, 32).collect()) == [("https://a.org/x", "https://a.org/64.png"), ("https://c.org/", None), ("https://www.b.org/", "http://b.org/favicon.ico")]


def test_providers(spark):
    def rows(names):
        return lambda s, q: s.createDataFrame([(n, [n], 0, n, None, i, "https://x.org", "rm") for i, n in enumerate(names)], providers.CANDIDATE)

    def broken(s, q):
        raise RuntimeError("no")

    reg = providers.Registry([providers.Provider("apps", rows(["Firefox", "Files"]), command="app", priority=1), providers.Provider("calc", rows(["4"]), providers.Trigger(prefix="="), command="calc"), providers.Provider("bad", broken), providers.Provider("apps", broken)])
    assert len(reg.errors) == 1
    got = reg.dispatch(spark, "fire").collect()
    assert [(r.source, r.display, r.command) for r in got] == [("apps", "Firefox", None)] and len(reg.errors) == 2
    assert [r.source for r in reg.dispatch(spark, "=2+2").where("source = 'calc'").collect()] == ["calc"]
    assert reg.dispatch(spark, "!ap").count() == 2
    assert reg.dispatch(spark, "?").count() == 0
