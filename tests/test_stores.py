"""Stores that are replaced whole, reconciliation, sweeps and rescans against plain replays."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumisift.plans import reconcile as R
from lumisift.plans.versions import Conflict, Versions
from lumisift.streaming import changes

T0 = datetime(2024, 1, 1)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_versions(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    assert table.latest() == 0
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(spark.range(3)) == 1
    held = table.read()
    assert table.update(lambda rows: rows.union(spark.range(3, 5).select("id"))) == 2
    assert held.count() == 3 and table.read().count() == 5 and table.read(1).count() == 3
    with pytest.raises(Conflict):
        table.replace(spark.range(9), base=1)
    assert table.latest() == 2 and table.versions() == [1, 2]
    # writers that died: rows without a commit, and a commit that was never written
    spark.range(99).write.parquet(str(tmp_path / "t/v-000000000003-dead"))
    (tmp_path / "t/_commits/000000000003").touch()
    assert table.latest() == 2 and table.read().count() == 5 and table.replace(spark.range(7), base=2) == 4
    assert table.read().count() == 7
    gone = table.vacuum(keep=1)
    assert len(gone) == 3 and table.versions() == [4] and table.read().count() == 7


def test_a_writer_that_fails_leaves_the_old_version(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    table.replace(spark.range(3))
    with pytest.raises(Exception, match="no luck"):
        table.replace(spark.range(100).select(F.when(F.col("id") < 50, F.col("id")).otherwise(F.raise_error(F.lit("no luck")).cast("long")).alias("id")))
    assert table.versions() == [1] and table.read().count() == 3


def test_an_update_starts_anew_from_what_came_meanwhile(spark, tmp_path):
    table, other = Versions(spark, str(tmp_path / "t")), Versions(spark, str(tmp_path / "t"))
    table.replace(spark.range(1))
    calls = []

    def more(rows):
        if not calls:
            other.replace(other.read().union(spark.range(10, 11)))
        calls.append(1)
        return rows.union(spark.range(20, 21))

    table.update(more)
    assert len(calls) == 2 and rows_of(table.read()) == {(0,), (10,), (20,)}


# --- reconciliation against a plain walk ------------------------------------------------------


def tree(rng, size=60):
    """A random well-formed tree: {path: is_dir}."""
    found = {"/r": True}
    for _ in range(size):
        over = rng.choice([p for p, d in found.items() if d])
        found[f"{over}/{rng.choice('abcdef')}"] = rng.random() < 0.5
        found = {p: d for p, d in found.items() if all(found.get(q, False) for q in above(p))}
    return found


def above(path):
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(2, len(parts))]


def plain_changes(indexed, truth, dirty):
    """The index after each dirty path has been reconciled in turn, as a watcher would do it."""
    now = dict(indexed)

    def remove(path):
        for p in [p for p in now if p == path or p.startswith(path + "/")]:
            del now[p]

    def scan(path):
        for p, d in truth.items():
            if p.startswith(path + "/"):
                now[p] = d

    for path in dirty:
        if path not in truth:
            remove(path)
            continue
        if not truth[path]:
            if any(p.startswith(path + "/") for p in now):
                remove(path)
            now[path] = False
            continue
        if now.get(path) is False:
            remove(path)
        now[path] = True
        for p in {p for p in (*truth, *now) if p.rsplit("/", 1)[0] == path}:
            if p not in truth:
                remove(p)
            elif now.get(p) != truth[p]:
                remove(p)
                now[p] = truth[p]
                if truth[p]:
                    scan(p)
    return now


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_of_dirty_paths(spark, tmp_path, seed):
    rng = random.Random(seed)
    indexed, truth = tree(rng), tree(rng)
    dirty = rng.sample(sorted({*indexed, *truth}), 8) + ["/r/zz"]
    # a dirty path below one that isn't there yet would make an entry without its directories
    dirty = [p for p in dirty if all(indexed.get(q) for q in above(p)) or p not in truth]
    at = lambda t: spark.createDataFrame(sorted(t.items()), "path string, is_dir boolean")
    marks = spark.createDataFrame([(p,) for p in dirty], "path string")
    made = R.changes(R.pruned(R.sharded(at(indexed)), marks), R.pruned(R.sharded(at(truth)), marks), marks)
    want = plain_changes(indexed, truth, dirty)
    assert rows_of(R.applied(at(indexed), made)) == set(want.items())
    table = R.EntryTable(spark, str(tmp_path / "t"))
    table.load(at(indexed))
    table.append(table.next_batch(), made)
    assert rows_of(table.read().select("path", "is_dir")) == set(want.items())
    table.compact()
    assert rows_of(table.read().select("path", "is_dir")) == set(want.items()) and table.next_batch() == 1


def test_only_dirty_shards_are_read(spark, tmp_path):
    entries = spark.createDataFrame([(f"/r/{a}/{b}", False) for a in "abcdefgh" for b in range(5)], "path string, is_dir boolean")
    held = Versions(spark, str(tmp_path / "t"))
    held.replace(R.sharded(entries), partition_by=("shard",))
    dirty = spark.createDataFrame([("/r/c/1",), ("/r/e",)], "path string")
    found = R.pruned(held.read(), dirty)
    assert found.count() == 10
    assert "dynamicpruning" in found._jdf.queryExecution().toString()


def test_watch_appends_to_the_log(spark, tmp_path):
    table = R.EntryTable(spark, str(tmp_path / "index"))
    old = {"/r/a": True, "/r/a/x": False, "/r/b": True, "/r/b/y": False, "/r/c": True, "/r/c/z": False}
    new = {"/r/a": True, "/r/a/x2": False, "/r/b": False, "/r/c": True, "/r/d": True, "/r/d/e": True, "/r/d/e/f": False}
    at = lambda t: spark.createDataFrame(sorted(t.items()), "path string, is_dir boolean")
    table.load(at(old))
    base = set(os.listdir(tmp_path / "index/base"))
    spark.createDataFrame([("/r/a",), ("/r/b",), ("/r/d",), ("/r/a",)], "path string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string").parquet(str(tmp_path / "in"))
    query = changes.watch_table(stream, table, lambda: at(new), str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    want = {**new, "/r/c/z": False}
    assert rows_of(table.read().select("path", "is_dir")) == set(want.items())
    assert set(os.listdir(tmp_path / "index/base")) == base  # nothing was rewritten
    table.append(0, spark.createDataFrame([("/r/a/x2", "add", False, 1)], "path string, op string, is_dir boolean, step int"))
    assert ("/r/b/y", False) in rows_of(table.read().select("path", "is_dir"))  # the batch took its own place


# --- sweeps --------------------------------------------------------------------------------------


def test_sweeps(spark, tmp_path):
    table = R.EntryTable(spark, str(tmp_path / "index"))
    frame = lambda t: spark.createDataFrame(sorted(t.items()), "path string, is_dir boolean")
    names = lambda *ps: spark.createDataFrame([(p,) for p in ps], "path string")
    times = lambda **ts: spark.createDataFrame([("/" + k.replace("_", "/"), T0 + timedelta(seconds=s)) for k, s in ts.items()], "path string, mtime timestamp")
    table.load(frame({"/r/a": True, "/r/a/old": False, "/r/gone": True, "/r/gone/x": False}))
    sweeper = R.Sweeper(table, str(tmp_path / "state"))
    truth = {"/r/a": True, "/r/a/new": False, "/r/b": True, "/r/b/c": False}
    dirs = times(r=0, r_a=0, r_b=0)

    class Killed(Exception):
        pass

    def kill(page):
        raise Killed

    with pytest.raises(Killed):  # after its first page of three
        sweeper.run(T0, dirs, frame(truth), names("/r"), names(), pages=3, after_page=kill)
    assert sweeper.state.latest() == 0
    assert sweeper.run(T0 + timedelta(seconds=10), dirs, frame(truth), names("/r"), names("/r/m"), pages=3) >= 3
    assert rows_of(table.read().select("path", "is_dir")) == set(truth.items())
    # what changes without a new time isn't seen, unless it's a mount
    later = {**truth, "/r/a/quiet": False, "/r/b/loud": False, "/r/m": True, "/r/m/n": False}
    dirs = times(r=0, r_a=0, r_b=9, r_m=0)
    paths = R.sweep_paths(dirs, table.read(), names("/r"), spark.createDataFrame([("/r", T0 + timedelta(seconds=10))], "root string, started timestamp"), names("/r/m"), names())
    assert rows_of(paths) == {("/r", "/r/b", "touched"), ("/r", "/r/m", "mount")}
    sweeper.run(T0 + timedelta(seconds=20), dirs, frame(later), names("/r"), names())
    assert rows_of(table.read().select("path")) == {("/r/a",), ("/r/a/new",), ("/r/b",), ("/r/b/c",), ("/r/b/loud",), ("/r/m",), ("/r/m/n",)}
    # a vanished root loses what it had
    sweeper.run(T0 + timedelta(seconds=30), times(q=0), frame({"/q/z": False}), names("/r"), names())
    assert table.read().count() == 0


# --- rescans ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_a_slow_scan_merges_with_the_log(spark, seed):
    rng = random.Random(seed)
    now, log, states = {"/r": True}, [(0, "add", "/r", True)], [{"/r": True}]
    for seq in range(1, 80):
        if rng.random() < 0.3 and len(now) > 1:
            path = rng.choice(sorted(p for p in now if p != "/r"))
            now = {p: d for p, d in now.items() if p != path and not p.startswith(path + "/")}
            log.append((seq, "remove", path, None))
        else:
            path, is_dir = f"{rng.choice(sorted(p for p, d in now.items() if d))}/{rng.choice('abcd')}", rng.random() < 0.5
            if path in now:
                path, is_dir = path, now[path]
            now = {**now, path: is_dir}
            log.append((seq, "add", path, is_dir))
        states.append(now)
    # each directory is listed at a time of its own, if it's there then
    dirs, listing = [("/", 0)], [("/r", True)]
    for path in sorted({p for s in states for p, d in s.items() if d}):
        at = rng.randrange(80)
        if states[at].get(path):
            dirs.append((path, at))
            listing += [(p, d) for p, d in states[at].items() if p.rsplit("/", 1)[0] == path]
    got = R.rescanned(spark.createDataFrame(dirs, "dir string, seq long"), spark.createDataFrame(listing, "path string, is_dir boolean"), spark.createDataFrame(log, "seq long, op string, path string, is_dir boolean"))
    assert rows_of(got) == set(now.items())
