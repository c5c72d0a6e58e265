"""Directory trees as tables: a Python data source with a partition for each directory under the roots, and a walk by frontiers for trees of any shape."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.matching import glob_pattern


#: Rows that are handed over at once, about.
BATCH = 10_000


def outermost_roots(roots: list[str]) -> list[str]:
    """Absolute roots that lie in no other, the shortest first."""
    kept: list[str] = []
    for root in sorted({os.path.abspath(r) for r in roots}, key=lambda r: (len(r), r)):
        if not any(root == k or root.startswith(k.rstrip("/") + "/") for k in kept):
            kept.append(root)
    return kept


def _listed(path: str) -> list[os.DirEntry]:
    """What a directory holds, by name; nothing if it can't be read or is gone."""
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _entry(parent: str, e: os.DirEntry) -> tuple[str, str, bool, float] | None:
    """The row of an entry; None if it has gone since the directory was read."""
    try:
        is_dir = e.is_dir(follow_symlinks=False)
        stat = e.stat(follow_symlinks=False)
    except OSError:
        return None
    return parent, e.name, is_dir, max(stat.st_atime, stat.st_mtime)


@dataclass
class _Part(InputPartition):
    path: str
    deep: bool


class Excluder:
    """Tells excluded entries by globs: those with a slash by the whole path, others by the name."""

    def __init__(self, globs: list[str]):
        # the same patterns as the filters have, in Python's notation
        self.patterns = [("/" in g, re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), glob_pattern(g)), re.S)) for g in globs]

    def __call__(self, path: str, name: str) -> bool:
        return any(pattern.match(path if whole else name) for whole, pattern in self.patterns)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = outermost_roots([r for r in options.get("roots", options.get("path", "")).split(",") if r])
        self._out = Excluder([g for g in options.get("excludes", "").split(",") if g])

    def partitions(self):
        parts = []
        for root in self.roots:
            parts.append(_Part(root, False))
            with os.scandir(root) as found:
                parts += [_Part(e.path, True) for e in found if e.is_dir(follow_symlinks=False) and not self._out(e.path, e.name)]
        return parts

    def read(self, part: _Part):
        open_, rows = [part.path], []
        while open_:
            here = open_.pop()
            for e in _listed(here):
                if self._out(e.path, e.name):
                    continue
                row = _entry(here, e)
                if row is None:
                    continue
                is_dir = row[2]
                rows.append(row)
                if is_dir and part.deep:
                    open_.append(e.path)
            if len(rows) >= BATCH or (rows and not open_):
                yield _batch(rows)
                rows = []


class TreeSource(DataSource):
    """``spark.dataSource.register(TreeSource)``; ``spark.read.format("tree").option("roots", "/a,/b").load()``. Links are rows and aren't followed. All executors must see the roots."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "parent_dir string, name string, is_dir boolean, recent double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


_ENTRY = "parent_dir string, name string, is_dir boolean, recent double"
#: Entries that a task lists before it hands the directories that are left to the next level.
SHARE = 20_000


def _walk(excludes: list[str], share: int):
    """Directories (path) -> their entries; directories still to be listed come as rows without a name."""

    def run(batches):
        out = Excluder(excludes)
        seen = 0
        for batch in batches:
            open_ = batch.column(0).to_pylist()
            while open_ and seen < share:
                here = open_.pop()
                rows = [row for e in _listed(here) if not out(e.path, e.name) and (row := _entry(here, e))]
                seen += len(rows)
                open_ += [f"{here.rstrip('/')}/{name}" for _, name, is_dir, _ in rows if is_dir]
                for at in range(0, len(rows), BATCH):
                    yield _batch(rows[at : at + BATCH])
            for at in range(0, len(open_), BATCH):
                yield _batch([(path, None, True, None) for path in open_[at : at + BATCH]])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.bool_(), pa.float64()))], ["parent_dir", "name", "is_dir", "recent"])


def walk(spark: SparkSession, roots: list[str], folder: str, excludes: list[str] = (), tasks: int | None = None, share: int = SHARE) -> DataFrame:
    """(parent_dir, name, is_dir, recent) of all below the roots, by frontiers: the directories of a level are dealt out anew to ``tasks`` tasks.

    A task lists its directories and what lies below them until it has seen ``share`` entries; the directories that are left then are the next frontier. So
    neither one wide nor one deep directory under a root is one task's. Each level is stored in ``folder``, which all executors share, as
    they must the roots. Links are rows and aren't followed; what can't be read or is gone has no rows.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(r,) for r in outermost_roots(roots)], "path string")
    levels = []
    while True:
        at = f"{folder.rstrip('/')}/level-{len(levels):06d}"
        dealt = frontier.repartition(tasks, "path") if levels else frontier.repartition(tasks)
        dealt.mapInArrow(_walk(list(excludes), share if levels else 1), _ENTRY).write.parquet(at)
        level = spark.read.schema(_ENTRY).parquet(at)
        levels.append(level.where("name is not null"))
        frontier = level.where("name is null").select(F.col("parent_dir").alias("path"))
        if frontier.isEmpty():
            break
    found = levels[0]
    for more in levels[1:]:
        found = found.union(more)
    return found
