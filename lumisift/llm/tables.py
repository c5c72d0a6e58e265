"""Small helpers shared by the operators: shared storage, key runs, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker gets at once, at most.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumisift-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder: later reads survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lumisift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hand_back() -> None:
    """Gives memory that Python and Arrow no longer use back to the system: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that takes batches in small slices and hands memory back when its task ends."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, batch.num_rows, BATCH_ROWS))
        finally:
            hand_back()

    return inner


def lean_group(run: Callable) -> Callable:
    """The same for applyInArrow."""

    def inner(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            hand_back()

    return inner


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that go to a Python worker at once, for texts are long. It lowers the session's setting and never raises it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows that stand together with equal keys (sorted within the partition), one table for each key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = None
        for key in keys:
            col = batch.column(key)
            differs = pc.not_equal(col.slice(1), col.slice(0, len(col) - 1))
            change = differs if change is None else pc.or_(change, differs)
        cuts = [0, *(pc.indices_nonzero(change).to_numpy() + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            now = tuple(part.column(k)[0].as_py() for k in keys)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            last = now
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of each component.

    Alternating stars: each node hangs its larger neighbours on its smallest neighbour, then
    its smaller ones, until nothing changes. The edges never exceed what came in, each
    round is a partial aggregation and two equi-joins, and each is stored, so that the plan
    stays short and lost executors cost one round.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        now = stored(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
