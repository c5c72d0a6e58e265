"""Rows that the steps of a query make, held against those of its input."""

import zlib

from pyspark.ml.functions import vector_to_array

from lumisift import queries as Q
from lumisift.functions import paths as P
from lumisift.operators import arbiter, series
from lumisift.plans import reconcile as R
from lumisift.plans import store
from tests.test_stores import rows_of


def most_rows(df):
    """The most rows that an operator of the plan has made."""
    df.collect()
    most, waiting = 0, [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        else:
            waiting += [node.children().apply(k) for k in range(node.children().size())]
        told = node.metrics().get("numOutputRows")
        most = max(most, told.get().value()) if told.isDefined() else most
    return most


def test_removals_and_entries_of_a_directory_arent_paired(spark, tmp_path):
    user = next(u for u in range(30) if zlib.crc32(f"/r/u{u}/k0".encode()) % 4)
    rows = [(k, user + 30 * (k % 40), "error" if k % 3 == 0 else "view", 1.0, f'{{"k": {k % 50 * 10}}}') for k in range(1500)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp_seconds(event_id) as ts")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = Q.QUERIES["rescanned_entries"](spark, str(tmp_path))
    assert rows_of(got) == rows_of(R.replayed(Q._log(spark, str(tmp_path))).select("path"))
    assert most_rows(got) < 4 * len(rows)


def test_parents(spark):
    paths = {"/a": "/", "/a/b": "/a", "a": "/", "/a\nb/c": "/a\nb", "/ä/ö/": "/ä/ö", "/": "/", "": "/", None: None}
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.up for r in rows.select("path", R.parent(rows.path).alias("up")).collect()} == paths


def test_holders_stand_for_paths(spark):
    paths = ["/a", "/a/b", "/a/b/c", "a", "a/b", "a/b/c", "/a\nb/c", "/ä/ö/", "//a", "/a//b", "/", ""]
    rows = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    told = rows.select("path", P.ancestors(rows.path).alias("own"), P.above(P.holder(rows.path)).alias("held")).collect()
    assert all(r.own is None and r.held is None if r.path is None else set(r.own) == set(r.held) for r in told)


def test_removals_above_are_sought_once_for_a_directory(spark, tmp_path):
    rows = [(k, "add", f"/r/a/b/c/d{k % 5}/f{k}", False) for k in range(2000)] + [(2000, "remove", "/r/a/b/c/d1", None), (2001, "remove", "/r/a/b/c/d2/f2", None), (2002, "add", "/r/a/b/c/d1/f1", False), (2003, "add", "/r/x\ny/z", False)]
    spark.createDataFrame(rows, "seq long, op string, path string, is_dir boolean").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    got = store.snapshot(log)
    live = {p for _, op, p, _ in rows if op == "add" and (p == "/r/a/b/c/d1/f1" or not p.startswith("/r/a/b/c/d1/") and p != "/r/a/b/c/d2/f2")}
    assert {f"{r.parent_dir}/{r.name}" for r in got.where("not tombstone").collect()} == live
    assert most_rows(got) <= len(rows)
    adds = log.where("op = 'add'").select("path", "is_dir")
    left = R.applied(adds, log.where("op = 'remove'"))
    assert rows_of(left) == {(p, False) for _, op, p, _ in rows if op == "add" and not p.startswith("/r/a/b/c/d1/") and p != "/r/a/b/c/d2/f2"}
    assert most_rows(left) <= len(rows)


def test_new_entries_meet_new_directories_by_their_holders(spark, tmp_path):
    names = [("/r/a/b/c", True), ("/r/a", True), ("/r/a/b", True)] + [(f"/r/a/b/c/f{k}", False) for k in range(2000)] + [(f"/r/o/f{k}", False) for k in range(100)]
    spark.createDataFrame(names, "path string, is_dir boolean").write.parquet(str(tmp_path / "truth"))
    truth, dirty = spark.read.parquet(str(tmp_path / "truth")), spark.createDataFrame([("/r",)], "path string")
    made = R.changes(truth.limit(0), truth, dirty)
    assert rows_of(made) == {(p, "add", is_dir, 1) for p, is_dir in names if not p.startswith("/r/o/")}
    assert most_rows(made) <= 2 * len(names)


def test_passes_store_what_differs(spark, tmp_path, monkeypatch):
    plans, real = [], R.EntryTable.append
    monkeypatch.setattr(R.EntryTable, "append", lambda table, batch, made: (plans.append(made._jdf.queryExecution().optimizedPlan().toString()), real(table, batch, made)))
    table = R.EntryTable(spark, str(tmp_path / "index"))
    table.load(spark.createDataFrame([("/r/a", False), ("/r/d", True), ("/r/d/x", False), ("/r/e", True)], "path string, is_dir boolean"))
    truth = spark.createDataFrame([("/r/b", False), ("/r/d", True), ("/r/d/y", False), ("/r/n", True), ("/r/n/z", False)], "path string, is_dir boolean")
    dirs = spark.sql("SELECT path, timestamp'2024-01-01' AS mtime FROM VALUES ('/r'), ('/r/d'), ('/r/n') AS t(path)")
    roots, none = spark.createDataFrame([("/r",)], "path string"), spark.createDataFrame([], "path string")
    sweeper = R.Sweeper(table, str(tmp_path / "state"))
    sweeper.run(dirs.head().mtime, dirs, truth, roots, none, pages=2)
    assert rows_of(table.read().select("path", "is_dir")) == rows_of(truth)
    assert rows_of(table.read(dirty=dirs.where("path = '/r/n'")).select("path", "is_dir")) == {("/r/n", True), ("/r/n/z", False)}
    assert len(plans) == 2 and not any("FullOuter" in p for p in plans)  # neither table is read anew by the steps


def test_sweeps_without_times(spark, tmp_path):
    for name in ("part", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(60 if name == "part" else 0).write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = str(tmp_path)
    assert rows_of(Q.QUERIES["sweep_passes"](spark, sf)) == rows_of(Q._truth(Q._entry_paths(spark, sf).where("path <> '/catalog'"), "8"))


def test_process_trees_send_no_edges_to_the_driver(spark):
    # two trees, a cycle below one of them, a process of two parents
    rows = [(1, 0, -1, "/"), (2, 1, -1, "/b"), (3, 1, -1, "/c"), (4, 2, 9, "/d"), (4, 3, 9, "/d"), (5, 3, 3, "/"), (1, 5, -1, "/"), (6, 6, -1, "/f"), (7, 6, -1, None), (8, 7, -1, "/home/u"), (9, 0, -1, "/n")]
    processes = spark.createDataFrame(rows, "pid long, ppid long, tpgid long, cwd string")
    tree = series.descendants(processes.select("pid", "ppid"), 1)
    assert "strategy=merge" in tree._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(tree.select("pid", "depth")) == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 2)}
    assert rows_of(series.foregrounds(processes, [1, 6, 3, 3])) == {(1, 9), (3, 9)}
    assert rows_of(series.foreground(processes, 3)) == {(9,)} and series.foreground(processes, 6).isEmpty()
    assert rows_of(series.working_directories(processes, [1, 6, 8], "/home/u")) == {(1, "/n"), (6, "/f")}
    assert rows_of(series.working_directory(processes.where("pid <> 9"), 1, "/home/u")) == {("/d",)}


def test_differences_are_made_by_block(spark):
    at = "array<struct<idx:int,value:double>>"
    rows = [(1, True, [(0, 1.0), (5, 0.5), (5, 0.25)]), (1, False, [(0, 1.0), (7, 2.0)]), (1, False, []), (2, True, [(68, 1.0), (69, 9.0), (-1, 9.0)]), (2, False, [(68, 0.25)]), (3, True, [(1, 1.0)]), (4, True, None), (4, False, [(2, 3.0)])]
    rows = spark.createDataFrame(rows, f"imp long, picked boolean, x {at}")
    made = arbiter.differences(rows)
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    told = [(r.label, tuple((k, v) for k, v in enumerate(r.d) if v), len(r.d)) for r in made.select("label", vector_to_array("features").alias("d")).collect()]
    one = [((5, 0.75), (7, -2.0)), ((0, 1.0), (5, 0.75)), ((68, 0.75),), ((2, -3.0),)]
    assert sorted(told) == sorted((label, tuple((k, v if label else -v) for k, v in d), arbiter.DIM) for d in one for label in (1.0, 0.0))
