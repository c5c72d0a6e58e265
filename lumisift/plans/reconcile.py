"""Keeping the entry table current: changes of dirty paths, a table of a base and a change log, sweeps behind a watermark, rescans.

Entries are rows (path, is_dir). A dirty path is held against the truth as it stands, whatever events it came from:
what is gone loses its subtree, what is new comes with its subtree, a directory that both sides know is compared child by child and
no deeper. Only what lies at or below dirty paths is read: tables are partitioned by ``shard``, the first components of the path, and
dirty shards are joined to them by partition.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from . import store
from .versions import Versions

#: Components of a path that tell its shard.
DEPTH = 2
#: What a sweep allows for times that come late, in seconds.
SLACK = 2.0
#: The most dirty paths that a sweep broadcasts.
FEW = 20_000


def parent(path: Column) -> Column:
    """The directory of a path; that of ``/a`` is ``/``."""
    head = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)
    return F.when(head == "", "/").otherwise(head)


above = P.above


def shard(path: Column, depth: int = DEPTH) -> Column:
    return F.substring_index(path, "/", depth + 1)


def sharded(entries: DataFrame) -> DataFrame:
    return entries.select("path", "is_dir", shard(F.col("path")).alias("shard"))


def dirty_shards(shards: DataFrame, dirty: DataFrame) -> DataFrame:
    """Those of the shards (shard) that hold a dirty path (path), its children or what lies below."""
    keys = dirty.select(shard(F.col("path")).alias("key")).distinct()
    keyed = shards.distinct().select("shard", F.explode(above(F.col("shard"))).alias("key"))
    # the condition is true of all; it tells Spark that the shards are few enough to prune partitions by
    return keyed.join(keys, "key").select("shard").distinct().where("shard > ''")


def pruned(table: DataFrame, dirty: DataFrame) -> DataFrame:
    """The rows of a sharded table in dirty shards; of a stored table the other partitions aren't read."""
    return table.join(F.broadcast(dirty_shards(table.select("shard"), dirty)), "shard", "left_semi")


def changes(indexed: DataFrame, truth: DataFrame, dirty: DataFrame, roots: DataFrame | None = None, small: bool = False, stored: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(path, op, is_dir, step) that bring the index to the truth at dirty paths (path): removals of subtrees (step 0), then additions (step 1).

    indexed, truth: (path, is_dir), all entries below an entry that isn't there are missing, too. roots (path) have no entry of their own, so only what lies in them changes.
    small: the dirty paths are few enough to be broadcast. stored: stores what differs between both, so that it's sought once rather than by each step, and gives it back.
    """
    marks = F.broadcast(dirty.select(F.col("path").alias("mark")).distinct()) if small else dirty.select(F.col("path").alias("mark")).distinct()
    both = indexed.select("path", F.col("is_dir").alias("was")).join(truth.select("path", F.col("is_dir").alias("now")), "path", "full_outer").where("not (was <=> now)")
    both = both if stored is None else stored(both)
    # at or directly in a dirty path: what is deeper and known stays as it is, and goes with what is above it
    near = both.select("path", "was", "now", F.explode(F.array_distinct(F.array(F.col("path"), parent(F.col("path"))))).alias("mark")).join(marks, "mark")
    if roots is not None:
        near = near.join(F.broadcast(roots.select("path").distinct()), "path", "left_anti")
    gone, come = F.struct(F.lit("remove").alias("op"), F.lit(None).cast("boolean").alias("is_dir"), F.lit(0).alias("step")), F.struct(F.lit("add").alias("op"), F.col("now").alias("is_dir"), F.lit(1).alias("step"))
    ops = F.filter(F.array(F.when(F.col("was").isNotNull(), gone), F.when(F.col("now").isNotNull(), come)), lambda x: x.isNotNull())
    told = near.select("path", F.inline(ops))
    tops = near.where("now").select(F.col("path").alias("top")).distinct()
    # what lies below a new directory: its holders are sought, not each entry
    new = both.where("now is not null and was is null").select("path", P.holder(F.col("path")).alias("dir"), F.col("now").alias("is_dir"))
    inside = new.select("dir").distinct().select("dir", F.explode(above(F.col("dir"))).alias("top")).join(tops, "top", "left_semi").select("dir").distinct()
    new = new.join(inside, "dir", "left_semi")
    return told.union(new.select("path", F.lit("add"), "is_dir", F.lit(1))).distinct()


def applied(indexed: DataFrame, made: DataFrame) -> DataFrame:
    """The index (path, is_dir) after changes (path, op, is_dir)."""
    gone = made.where("op = 'remove'").select(F.col("path").alias("top")).distinct()
    over = indexed.select(P.holder(F.col("path")).alias("dir")).distinct().select("dir", F.explode(above(F.col("dir"))).alias("top")).join(gone, "top", "left_semi").select("dir").distinct()
    come = made.where("op = 'add'").groupBy("path").agg(F.max("is_dir").alias("is_dir"))
    still = indexed.select("path", "is_dir", P.holder(F.col("path")).alias("dir")).join(over, "dir", "left_anti").select("path", "is_dir")
    return still.join(gone.withColumnRenamed("top", "path"), "path", "left_anti").join(come, "path", "left_anti").union(come.select("path", "is_dir"))


class EntryTable:
    """The index as a base, a version of its own, and a log of changes since, a folder for each batch.

    A batch that is written again (a stream does so after a failure) takes the place of its first writing. Reading replays the log over the base in the shards
    that it concerns; all others pass as they are. ``compact`` makes a new base of both.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.base = Versions(spark, f"{self.path}/base")
        self.log = f"{self.path}/log"

    def load(self, entries: DataFrame, upto: int = -1) -> None:
        """A new base of these entries that holds all batches up to this one; the version before stays readable."""
        self.base.replace(sharded(entries).withColumn("upto", F.lit(upto).cast("long")), partition_by=("shard",))

    def append(self, batch: int, made: DataFrame) -> None:
        made.select("path", "op", "is_dir", "step").write.mode("overwrite").parquet(f"{self.log}/batch={batch:018d}")

    def _log(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema("path string, op string, is_dir boolean, step int, batch long").option("basePath", self.log).parquet(self.log)

    def next_batch(self) -> int:
        log = self._log()
        last = None if log is None else log.agg(F.max("batch")).head()[0]
        return max(-1 if last is None else last, self._upto()) + 1

    def _upto(self) -> int:
        found = self.base.read().agg(F.max("upto")).head()[0]
        return -1 if found is None else found

    def read(self, before: int | None = None, dirty: DataFrame | None = None) -> DataFrame:
        """(path, is_dir, shard) as of the last batch, or of the last one before this number; with dirty paths (path) only the shards that these concern are read and replayed."""
        base, log = self.base.read(), self._log()
        entries = base.select("path", "is_dir", "shard")
        if log is None:
            return entries if dirty is None else pruned(entries, dirty)
        since = log.where((F.col("batch") > self._upto()) & (F.lit(True) if before is None else F.col("batch") < before))
        shards = entries.select("shard").union(since.select(shard(F.col("path")))).distinct()
        touched = dirty_shards(shards, since)
        if dirty is not None:
            only = F.broadcast(dirty_shards(shards, dirty))
            adds = since.where("op = 'add'").withColumn("shard", shard(F.col("path"))).join(only, "shard", "left_semi").drop("shard")
            entries, since = entries.join(only, "shard", "left_semi"), adds.unionByName(since.where("op = 'remove'"))
        still = entries.join(F.broadcast(touched), "shard", "left_anti")
        old = entries.join(F.broadcast(touched), "shard", "left_semi").select(F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), "path", "is_dir")
        replay = old.union(since.select((F.col("batch") * 2 + F.col("step")).alias("seq"), "op", "path", "is_dir"))
        now = replayed(replay).select("path", "is_dir", shard(F.col("path")).alias("shard"))
        return still.select("path", "is_dir", "shard").union(now)

    def compact(self) -> None:
        last = self.next_batch() - 1
        self.load(self.read(), last)


def replayed(log: DataFrame) -> DataFrame:
    """(path, is_dir) that live after a log (seq, op, path, is_dir): the last operation that concerns a path decides, its own or a removal above it."""
    return store.snapshot(log).where("not tombstone").select(P.entry_path(F.col("parent_dir"), F.col("name")).alias("path"), "is_dir")


def rescanned(dirs: DataFrame, listing: DataFrame, log: DataFrame) -> DataFrame:
    """(path, is_dir) after a scan that took its time, merged with the changes that came meanwhile.

    dirs: (dir, seq), each directory listed and the change that its listing was made after; listing: (path, is_dir), what stood in them;
    log: (seq, op, path, is_dir). A listing knows all that came up to its own seq, so an addition counts only if it's later than the listing
    of its directory, or if that was never listed; a removal takes away what was listed or added before it.
    """
    listed = listing.withColumn("dir", parent(F.col("path"))).join(dirs, "dir").select("seq", F.lit("add").alias("op"), "path", "is_dir")
    adds = log.where("op = 'add'").withColumn("dir", parent(F.col("path"))).join(dirs.select("dir", F.col("seq").alias("at")), "dir", "left")
    later = adds.where("at is null or seq > at").select("seq", "op", "path", "is_dir")
    return replayed(listed.union(later).union(log.where("op = 'remove'").select("seq", "op", "path", "is_dir")))


def sweep_paths(dirs: DataFrame, indexed: DataFrame, roots: DataFrame, watermarks: DataFrame, mounts_before: DataFrame, mounts: DataFrame, slack: float = SLACK) -> DataFrame:
    """(root, path, reason): directories that a sweep has to hold against the truth: ``gone``, ``touched`` since the root's watermark, or a ``mount`` come or gone.

    dirs: (path, mtime), all that exist; indexed: (path, is_dir); roots: (path); watermarks: (root, started), none for a root that was never swept;
    mounts: (path). Roots are looked at, too, for a file made in one moves only its own time.
    """
    tops = roots.select(F.col("path").alias("root")).distinct()
    live = indexed.where("is_dir").select("path").union(roots.select("path")).distinct()
    told = live.select("path", F.explode(above(F.col("path"))).alias("root")).join(F.broadcast(tops), "root").join(F.broadcast(watermarks.select("root", "started")), "root", "left").join(dirs.select("path", "mtime"), "path", "left")
    reason = F.when(F.col("mtime").isNull(), "gone").when(F.col("started").isNull() | (F.col("mtime") >= F.col("started") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(slack))), "touched")
    moved = store.symmetric_difference(mounts_before.select("path"), mounts.select("path")).select("path", F.explode(above(F.col("path"))).alias("root")).join(F.broadcast(tops), "root")
    return told.select("root", "path", reason.alias("reason")).where("reason is not null").union(moved.select("root", "path", F.lit("mount").alias("reason")))


class Sweeper:
    """Sweeps of an entry table. The watermark of a root is the start of its last pass that ran to its end, with the mounts that it saw, as a version of its own.

    A pass is done in pages, each a batch of the table's log. One that is killed has moved no watermark, so the next one looks at all its directories again;
    what is right already makes no change.
    """

    def __init__(self, table: EntryTable, path: str):
        self.table, self.state = table, Versions(table.spark, path)

    def _before(self) -> DataFrame:
        schema = "root string, started timestamp, mount string"
        return self.state.read() if self.state.latest() else self.table.spark.createDataFrame([], schema)

    def run(self, started: datetime, dirs: DataFrame, truth: DataFrame, roots: DataFrame, mounts: DataFrame, pages: int = 1, after_page: Callable[[int], None] | None = None) -> int:
        """One pass over (path, mtime) and (path, is_dir); the number of directories that it held against the truth. after_page is called with each page's number.

        A truth that is stored by shard (shard) is read in dirty shards only.
        """
        truth = truth if "shard" in truth.columns else sharded(truth)
        before = self._before()
        watermarks = before.where("mount is null").select("root", "started")
        paths = sweep_paths(dirs, self.table.read(), roots, watermarks, before.where("mount is not null").select(F.col("mount").alias("path")), mounts)
        chosen = Versions(self.table.spark, f"{self.state.path}-paths")
        at = chosen.replace(paths)  # what a pass looks at doesn't move under it
        dirty = chosen.read(at)
        swept = dirty.select("path").distinct().count()
        found = Versions(self.table.spark, f"{self.state.path}-differences")
        for page in range(pages):
            own = dirty.where(F.pmod(F.xxhash64("path"), F.lit(pages)) == page)
            made = changes(self.table.read(dirty=own), pruned(truth, own), own, roots, swept <= FEW, lambda rows: found.read(found.replace(rows)))
            self.table.append(self.table.next_batch(), made)
            if after_page:
                after_page(page)
        marks = roots.select(F.col("path").alias("root"), F.lit(started).cast("timestamp").alias("started"), F.lit(None).cast("string").alias("mount"))
        self.state.replace(marks.union(mounts.select(F.lit(None).cast("string"), F.lit(started).cast("timestamp"), F.col("path"))), self.state.latest())
        for held in (chosen, found):
            held.vacuum(keep=1)
        return swept
