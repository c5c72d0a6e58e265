"""Gates on streams, sessions, themes, manifests, trees by frontiers, probes and the engine's own sources."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumisift.functions import heads
from lumisift.operators import arbiter, probe, providers, series, sessions, themes, web
from lumisift.sources import logs, manifests, tree
from lumisift.streaming import gates

T0 = datetime(2024, 1, 1)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def run(stream, spark, name, path, mode):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", gates.ROCKSDB)
    try:
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.table(name)


def test_hold_until_ready(spark, tmp_path):
    schema = "root string, seq long, kind string, path string"
    batches = [
        [("a", 1, "change", "/x"), ("a", 2, "change", "/y"), ("b", 1, "change", "/1"), ("b", 2, "change", "/2"), ("b", 3, "change", "/1"), ("b", 4, "change", "/3"), ("b", 5, "change", "/4"), ("c", 1, "overflow", None), ("d", 1, "change", "/q")],
        [("a", 3, "change", "/x"), ("a", 4, "ready", None), ("a", 5, "change", "/z"), ("b", 6, "change", "/5"), ("c", 2, "ready", None)],
        [("b", 7, "ready", None), ("a", 6, "overflow", None), ("a", 7, "change", "/x"), ("b", 8, "ready", None)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(gates.held(source, most=3), spark, "held", tmp_path / "at", "append").collect()
    told = {root: [(r.kind, r.path) for r in sorted((r for r in got if r.root == root), key=lambda r: r.ord)] for root in "abcd"}
    assert told["a"] == [("change", "/x"), ("change", "/y"), ("change", "/z"), ("rescan", "a"), ("change", "/x")]  # in the order they came first, then as they come
    assert told["b"] == [("change", "/1"), ("change", "/2"), ("change", "/3"), ("rescan", "b")]  # beyond three paths some are lost
    assert told["c"] == [("rescan", "c")] and told["d"] == []  # d was never ready


def test_sessions(spark, tmp_path):
    def tabs(*ids):
        return json.dumps([{"id": i, "url": f"https://t{i}.org/", "title": f"T{i}"} for i in ids])

    schema = "conn long, seq long, at timestamp, kind string, tabs string"
    batches = [
        [(2, 1, T0, "tabs", tabs(7, 5)), (1, 1, T0, "tabs", tabs(1, -1, 2)), (3, 1, T0, "tabs", tabs(9))],
        [(1, 3, T0 + timedelta(seconds=5), "tabs", tabs(4)), (3, 2, T0, "close", None)],
        [(1, 2, T0, "tabs", tabs(8, 8)), (3, 3, T0 + timedelta(seconds=9), "tabs", tabs()), (2, 2, T0, "close", None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states = run(gates.sessions(source), spark, "states", tmp_path / "at", "update")
    assert [(r.conn, r.pos, r.id, r.url) for r in sessions.merged(states).orderBy("conn", "pos").collect()] == [(1, 0, 4, "https://t4.org/")]
    assert rows_of(sessions.fresh(states)) == {(2, T0 + timedelta(seconds=9))}  # an empty list is a connection, too
    every = spark.read.parquet(str(tmp_path / "in"))
    assert rows_of(sessions.merged(sessions.latest(every))) == rows_of(sessions.merged(states))
    early = sessions.merged(sessions.latest(every.where("seq = 1"))).orderBy("conn", "pos").select("conn", "id").collect()
    assert [tuple(r) for r in early] == [(1, 1), (1, 2), (2, 7), (2, 5), (3, 9)]


def index_lines(spark, **files):
    return spark.createDataFrame([(name, n, line) for name, text in files.items() for n, line in enumerate(text.splitlines())], "theme string, n int, value string")


def test_theme_index(spark):
    text = "# no\n[Icon Theme]\nName=X\nInherits = a, b ,,c\n[16x16/apps]\nSize=16\nType=Fixed\n; no\n[s]\nSize = 32\nType=scalable\nMinSize=8\nMaxSize=x\nScale=2\n[bad]\nSize=-1\n[none]\nType=Fixed\n[t]\nSize=48\nThreshold=0\nSize=24\n"
    sections = themes.index_sections(index_lines(spark, x=text))
    assert rows_of(themes.inherits(sections)) == {("x", 0, "a"), ("x", 1, "b"), ("x", 2, "c")}
    dirs = themes.theme_dirs(sections).orderBy("ord").drop("ord").collect()
    assert [tuple(r) for r in dirs] == [("x", "16x16/apps", 16, 1, 16, 16, 2, "fixed"), ("x", "s", 32, 2, 8, 32, 2, "scalable"), ("x", "t", 24, 1, 24, 24, 2, "threshold")]


def test_theme_sizes(spark):
    cases = [  # size, scale, least, most, threshold, type, wanted, serves, distance
        (16, 1, 16, 16, 2, "fixed", 16, True, 0), (16, 2, 16, 16, 2, "fixed", 32, True, 0), (16, 1, 16, 16, 2, "fixed", 24, False, 8), (64, 1, 8, 128, 2, "scalable", 8, True, 0), (64, 1, 16, 128, 2, "scalable", 8, False, 8), (64, 2, 16, 128, 2, "scalable", 300, False, 44),
        (24, 1, 24, 24, 2, "threshold", 22, True, 0), (24, 1, 24, 24, 2, "threshold", 21, False, 3), (24, 1, 24, 24, 2, "threshold", 30, False, 6), (24, 2, 24, 24, 2, "threshold", 51, True, 0),
    ]
    rows = spark.createDataFrame(cases, "size int, scale int, least int, most int, threshold int, type string, w int, s boolean, d int")
    got = rows.select("s", themes.serves(F.col("w")), "d", themes.distance(F.col("w"))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_theme_chains(spark):
    edges = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("d", 0, "a"), ("d", 1, "c"), ("c", 0, "e"), ("n0", 0, "hicolor")] + [(f"n{k}", 1, f"n{k + 1}") for k in range(12)], "theme string, ord int, above string")
    got = {}
    for r in themes.chains(spark.createDataFrame([("a",), ("n0",), ("",), ("zz",)], "start string"), edges).orderBy("ord").collect():
        got.setdefault(r.start, []).append(r.theme)
    assert got == {"a": ["a", "b", "d", "c", "e", "Adwaita", "hicolor"], "n0": ["n0", "hicolor", *(f"n{k}" for k in range(1, 9)), "Adwaita"], "": ["Adwaita", "hicolor"], "zz": ["zz", "Adwaita", "hicolor"]}


def test_theme_lookup(spark):
    dirs = themes.theme_dirs(themes.index_sections(index_lines(spark, one="[16]\nSize=16\nType=Fixed\n[48]\nSize=48\nType=Fixed\n", two="[32]\nSize=32\nType=Fixed\n")))
    chain = spark.createDataFrame([("one", 0, "one"), ("one", 1, "two")], "start string, ord int, theme string")
    files = [
        (0, "one", "16", "web", ".png", 5), (1, "one", "48", "web", ".svg", 5), (0, "two", "32", "web", ".png", 5), (0, "two", "32", "only", ".png", 5), (0, "one", "48", "big", ".png", 9_999_999), (0, "two", "32", "big", ".svg", 5),
        (1, "one", "16", "both", ".png", 5), (0, "one", "16", "both", ".svg", 5), (0, "one", "16", "pair", ".svg", 5), (0, "one", "16", "pair", ".png", 5), (0, None, None, "loose", ".svg", 5), (2, None, None, "pix", ".png", 5), (1, None, None, "pix", ".svg", 0), (0, None, None, "web", ".png", 5), (0, "one", "16", "x", ".xpm", 5),
    ]
    table = spark.createDataFrame([(*f, "/".join(map(str, (f[0], f[1], f[2], f[3] + f[4])))) for f in files], "base int, theme string, dir string, name string, ext string, bytes long, path string")
    asked = [("web", 48), ("web", 16), ("web", 30), ("web", 33), ("only", 16), ("big", 48), ("both", 16), ("pair", 16), ("loose", 16), ("pix", 16), ("../web", 16), ("none", 16), ("x", 16)]
    got = {(r.name, r.pixels): r.path for r in themes.lookup(spark.createDataFrame([("one", *a) for a in asked], "start string, name string, pixels int"), chain, dirs, table).collect()}
    assert got == {("web", 48): "1/one/48/web.svg", ("web", 16): "0/one/16/web.png", ("web", 30): "0/one/16/web.png", ("web", 33): "1/one/48/web.svg", ("only", 16): "0/two/32/only.png", ("big", 48): "0/two/32/big.svg", ("both", 16): "0/one/16/both.svg", ("pair", 16): "0/one/16/pair.png", ("loose", 16): "0/None/None/loose.svg", ("pix", 16): "2/None/None/pix.png"}
    lines = spark.createDataFrame([(1, 0, "a/b:late"), (0, 0, "# no"), (0, 1, " a/b:first "), (0, 2, "c/d:"), (0, 3, "e"), (1, 1, "f/g:h:i")], "dir int, n int, value string")
    assert rows_of(themes.generic_icons(lines)) == {("a/b", "first"), ("f/g", "h:i")}
    ranks = spark.createDataFrame([(64,), (32,), (16,), (0,), (128,)], "s int").orderBy(themes.size_rank(F.col("s"), F.lit(32))).collect()
    assert [r.s for r in ranks] == [32, 64, 128, 16, 0]
    assert [r[0] for r in spark.createDataFrame([("a.PNG",), ("org.x.Calc",), ("b.xpm",)], "n string").select(themes.bare_name(F.col("n"))).collect()] == ["a", "org.x.Calc", "b"]


def test_manifests(spark, tmp_path):
    good = {"v": 1, "id": "calc", "type": "command", "command": {"argv": ["./calc"]}, "timeout_ms": 5, "bangs": ["Calc", "calc", "c"], "context": ["running", "running"]}
    texts = {
        "a": json.dumps(good), "b": "{broken", "c": json.dumps(good | {"name": "Late"}), "d": json.dumps(good | {"id": "NO"}), "e": json.dumps({"id": "web", "type": "http", "http": {"url": "https://x.org", "headers": {"k": "v"}}, "allow_run_command": True}),
        "f": json.dumps(good | {"id": "f", "bangs": []}), "g": json.dumps(good | {"id": "g", "bangs": [], "trigger": {"regex": "^=", "min_query_len": 3}}), "h": json.dumps(good | {"id": "h", "trigger": {"regex": "(("}}), "i": json.dumps(good | {"id": "i", "v": 2}),
        "j": json.dumps(good | {"id": "j", "command": {"argv": ["x", ""]}}), "k": json.dumps(good | {"id": "k", "trigger": {"focused_app": {}}}), "l": json.dumps(good | {"id": "l", "timeout_ms": 99_999}),
    }
    for name, text in texts.items():
        os.makedirs(tmp_path / "p" / name)
        (tmp_path / "p" / name / "manifest.json").write_text(text)
    os.makedirs(tmp_path / "p" / "without")
    found, bad = manifests.manifests(manifests.read(spark, str(tmp_path / "p")))
    assert {r.dir: (r.id, r.name, r.timeout_ms, r.bangs, r.context) for r in found.collect()} == {
        "a": ("calc", "calc", 100, ["calc", "c"], ["running"]), "e": ("web", "web", 1500, ["web"], []), "g": ("g", "g", 100, [], ["running"]), "l": ("l", "l", 10_000, ["calc", "c"], ["running"]),
    }
    assert rows_of(bad) == {("b", "not readable"), ("c", "id taken by a"), ("d", "id"), ("f", "not reachable"), ("h", "pattern"), ("i", "version"), ("j", "empty argument"), ("k", "empty gate")}
    assert rows_of(manifests.command_table(found)) == {("calc", "calc"), ("c", "calc"), ("web", "web")}


def test_walk_by_frontiers(spark, tmp_path):
    top = tmp_path / "r" / "one"
    for d in range(40):
        os.makedirs(top / f"d{d}")
        for f in range(20):
            (top / f"d{d}" / f"f{f}").touch()
    deep = top / "d0"
    for k in range(12):
        deep = deep / f"n{k}"
        os.makedirs(deep)
    os.symlink(top / "d1", top / "link")
    os.makedirs(top / "skip" / "in")
    root = str(tmp_path / "r")
    want = {(p, n, n in ds) for p, ds, fs in os.walk(root) for n in ds + fs if not p.startswith(str(top / "skip")) and n != "skip"}
    want = {(p, n, d and n != "link") for p, n, d in want}
    for share, tasks in ((50, 6), (100_000, 6)):
        found = tree.walk(spark, [root, root + "/one"], str(tmp_path / f"at{share}"), excludes=["skip"], tasks=tasks, share=share)
        assert rows_of(found.select("parent_dir", "name", "is_dir")) == want
    # the forty directories under the one top directory are dealt out to as many tasks as asked for
    assert len([f for f in os.listdir(tmp_path / "at50/level-000002") if f.endswith(".parquet")]) == 6


def test_vanished_entries(tmp_path, monkeypatch):
    os.makedirs(tmp_path / "a")
    (tmp_path / "a/f").touch()
    (tmp_path / "a/g").touch()
    found = tree._listed(str(tmp_path / "a"))
    os.remove(tmp_path / "a/f")
    assert [tree._entry("/a", e) is None for e in found] == [True, False] and tree._listed(str(tmp_path / "none")) == []


def test_probe(spark):
    def at(seconds):
        return T0 + timedelta(seconds=seconds)

    memory = spark.createDataFrame([("/a", 5, at(90)), ("/a", 4, at(10)), ("/b", None, at(95)), ("/c", 7, at(30)), ("/z", 1, at(99))], "path string, recent long, checked timestamp")
    asked = spark.createDataFrame([("/a",), ("/a",), ("/b",), ("/c",), ("/d",), ("/e",), ("",)], "path string")
    now = F.lit(at(100))
    known, open_ = probe.split(asked, memory, now, fresh=60)
    assert rows_of(known) == {("/a", 5), ("/b", None)} and rows_of(open_.select("path")) == {("/c",), ("/d",), ("/e",)}
    chosen = probe.budgeted(open_, 2)
    assert rows_of(chosen) == {("/d",), ("/e",)}  # what was never asked comes first
    answers = spark.createDataFrame([("/d", 9)], "path string, recent long")
    assert rows_of(probe.answered(known, open_, answers)) == {("/a", 5), ("/b", None), ("/c", None), ("/d", 9), ("/e", None)}
    keep = lambda most: {r.path: r.recent for r in probe.remembered(memory, chosen, answers, now, 60, most).collect()}
    assert keep(100) == {"/a": 5, "/b": None, "/c": 7, "/z": 1, "/d": 9, "/e": None}
    assert keep(5) == {"/a": 5, "/b": None, "/z": 1, "/d": 9, "/e": None} and keep(3) == {"/d": 9, "/e": None}


def test_command_lines(spark):
    cases = [
        ('run "a b" c', ["run", "a b", "c"]), ("run %f --x=%%y %U", ["run", "--x=%y"]), ('a"b c"d', ["ab cd"]), ('"a\\"b" c', ['a"b', "c"]), ("a\\ b", ["a\\", "b"]), ('run ""', ["run", ""]), ('run "open', ["run", "open"]), ('"%f"', ["%f"]), ("", []), ("  \t ", []), ("x%q", ["x%q"]),
        ('"tail\\', ["tail"]), ("50%", ["50%"]), ('a%f"b"', ["ab"]), ('"a\\\\b"', ["a\\b"]), ('"' + "x" * 1_000_000 + '"', ["x" * 1_000_000]), ("y" * 500_000 + " z", ["y" * 500_000, "z"]), ('"' + "\\a" * 2_000 + '"', ["a" * 2_000]),
    ]
    rows = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(cases)], "i int, line string").select("i", web.exec_arguments(F.col("line")).alias("a"))
    assert {r.i: r.a for r in rows.collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_replacement_characters_are_text(spark):
    data = [("�".encode() * 50, False), (b"\xff\xfe" * 50, True), (b"plain \xef\xbf\xbd text", False), (b"\xef\xbf" * 40, True), (b"a\0b", True)]
    got = spark.createDataFrame([(bytearray(d), w) for d, w in data], "d binary, w boolean").select(heads.is_binary(F.col("d")).alias("b"), "w").collect()
    assert all(r.b == r.w for r in got)


def test_records_come_back(spark, tmp_path):
    shown = [("file", "/d/a.txt", None, 0, None), ("plugin", None, "calc", 70, "= 4"), ("file", "/d/unknown", None, 0, None)]
    rows = [(1, T0, " q ", shown, (1, "run", False), 10), (2, T0, "q", shown, (0, "open", True), None), (3, T0, " ", shown, (0, "open", False), 10), (4, T0, "q", shown, (9, "open", False), 10)]
    reports = spark.createDataFrame(rows, "id int, ts timestamp, query string, shown array<struct<kind:string,path:string,plugin:string,score:int,title:string>>, picked struct<rank:int,action:string,revealed:boolean>, imp int")
    signals = ", ".join(f"{c} {k}" for c, k in arbiter.SIGNALS.items())
    known = spark.createDataFrame([(10, True, "/d/a.txt", 1, 1, 40, 2.5, 0.5, 0.1, 0.2, False)], "imp int, blend boolean, path string, " + signals)
    arbiter.report_records(reports, known).select("value").write.text(str(tmp_path / "log"))
    log = logs.pick_log(spark, [str(tmp_path / "log")])
    got = logs.with_hours(logs.impressions(log), "Asia/Tokyo").select("joined", "pos", "picked", "row.kind", "row.path", "row.boost", "row.plugin", "row.title", "row.score", "row.depth", "row.ext", "hour").collect()
    assert {tuple(r) for r in got if r.joined} == {(True, 0, False, "file", "/d/a.txt", 2.5, None, None, None, 2, ".txt", 9), (True, 1, True, "plugin", None, None, "calc", "= 4", 70, None, None, 9), (True, 2, False, "file", "/d/unknown", 0.0, None, None, None, 2, "", 9)}
    assert {(r.pos, r.picked, r.boost) for r in got if not r.joined} == {(0, True, 0.0), (1, False, None), (2, False, 0.0)}
    assert rows_of(logs.impressions(log).select("imp").distinct()) == rows_of(logs.impressions(log).select("imp").distinct())  # the same at each reading


def test_picks_outside_the_shown_rows(spark):
    shown = spark.createDataFrame([(1, T0, "q", 0, "/a")], "imp int, ts timestamp, query string, rank int, path string")
    picks = spark.createDataFrame([(1, "/elsewhere", "open")], "imp int, path string, action string")
    assert json.loads(arbiter.pick_records(shown, picks).head().value)["picked"] == {"path": "/elsewhere", "action": "open"}


def test_own_sources(spark):
    frequent = spark.createDataFrame([("https://www.fire.org/", "", "fire.org", 30), ("https://x.org/", "Campfire", "x.org", 90)], "url string, title string, host string, c30 long")
    tabs = spark.createDataFrame([("https://t.org/", "Fire alarm", 1, 5, 100), ("https://u.org/", "Bonfire", 1, 6, 200)], "url string, title string, conn int, id int, last_accessed long")
    apps = spark.createDataFrame([("ff", "Firefox", "firefox %u"), ("no", "Nothing", "%f"), ("cf", "Campfire", "camp")] + [(f"a{k}", f"Fire {k}", f"run {k}") for k in range(30)], "id string, name string, exec string")
    reg = providers.Registry(providers.built_in(frequent, tabs, apps, None, {"quit": "Leave"}), suggest=True)
    got = reg.dispatch(spark, "fire").orderBy("section_rank", "row_rank").collect()
    assert not reg.errors
    told = {}
    for r in got:
        told.setdefault((r.source, r.priority), []).append(r.display)
    assert told["firefox-tabs", 1] == ["Fire alarm", "Bonfire"] and told["firefox-frequent", 1][0] == "www.fire.org" and len(told["apps-search", 1]) == 6 and "Campfire" not in told["apps-search", 1]
    assert [(r.display, r.command) for r in reg.dispatch(spark, "!tab bonf").collect()] == [("Bonfire", "tab 1 6")]
    weak = reg.dispatch(spark, "ampfir", fuzzy=False)
    assert rows_of(weak.select("source", "priority")) == {("apps-search", 0), ("firefox-frequent", 0)}  # no match at a word's start
    assert [(r.display, r.command) for r in reg.dispatch(spark, "!quit").collect()] == [("Leave", "quit")]
    assert [(r.display, r.command) for r in reg.dispatch(spark, "@ x y").where("source = 'commands'").orderBy("row_rank").collect()] == [("!app", "@app x y"), ("!quit", "@quit x y"), ("!site", "@site x y"), ("!tab", "@tab x y")]
    assert [(r.display, r.subtitle) for r in reg.cheat_sheet(spark).orderBy("rank").collect()] == [("!app", "Apps"), ("!quit", "Leave"), ("!site", "Frequent sites"), ("!tab", "Open tabs")]


def test_long_process_chains(spark):
    edges = spark.createDataFrame([(k + 2, 1) for k in range(5)], "pid long, ppid long")
    series.descendants(edges, 1).count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "-1"
