"""The change pipeline on Structured Streaming: debounced batches, reconciliation, decayed counters, throttles.

State is kept per key; a key is a root (or another part of the tree), so that roots are watched in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import reconcile as R
from ..plans import store

QUIET_MS, OLDEST_MS, MOST_PENDING = 250, 1000, 4096


def _likes(pattern: str):
    return lambda a: a.rlike(pattern)


def wanted(events: DataFrame, globs: list[str]) -> DataFrame:
    """Events (path, op, ts) that create, remove or rename and aren't excluded, at or above their path."""
    from ..functions import matching as M
    from ..functions import paths as P

    chain = F.array_append(P.ancestors(F.col("path")), F.col("path"))
    out = F.lit(False)
    for g in globs:
        pattern = M.glob_pattern(g)
        held = chain if "/" in g else F.transform(chain, lambda a: F.regexp_extract(a, "([^/]*)$", 1))
        out = out | F.exists(held, _likes(pattern))
    return events.where(F.col("op").isin("create", "remove", "rename") & ~out)


def batches_of(events: list[tuple[int, str]], pending: list[str], first: int, last: int, quiet: int = QUIET_MS, oldest: int = OLDEST_MS, most: int = MOST_PENDING) -> tuple[list[tuple[int, list[str]]], list[str], int, int]:
    """Batches (time, paths) that events (ms, path) in order of time close, and what is pending then.

    A batch closes ``quiet`` after its last event, ``oldest`` after its first, or with ``most`` paths.
    """
    out = []
    for ts, path in events:
        if pending and ts >= min(last + quiet, first + oldest):
            out.append((min(last + quiet, first + oldest), pending))
            pending = []
        if not pending:
            first = ts
        if path not in pending:
            pending = [*pending, path]
        last = ts
        if len(pending) >= most:
            out.append((ts, pending))
            pending = []
    return out, pending, first, last


def debounced(events: DataFrame, key: str = "root") -> DataFrame:
    """(key, closed, ord, path): paths of each closed batch in order of arrival. events: (key, path, ts timestamp), a stream with a watermark on ts."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, first, last = state.get if state.exists else ([], 0, 0)
        pending = list(pending)
        if state.hasTimedOut:
            closed, pending = [(min(last + QUIET_MS, first + OLDEST_MS), pending)] if pending else [], []
        else:
            rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
            closed, pending, first, last = batches_of(list(zip((rows["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist(), rows["path"])), pending, first, last)
        if pending:
            state.update((pending, first, last))
            due = min(last + QUIET_MS, first + OLDEST_MS)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        out = [(name[0], pd.Timestamp(at, unit="ms"), i, p) for at, paths in closed for i, p in enumerate(paths)]
        yield pd.DataFrame(out, columns=[key, "closed", "ord", "path"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, closed timestamp, ord int, path string", "pending array<string>, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def opened(events: DataFrame, half_life_days: float = 14.0, key: str = "path") -> DataFrame:
    """(key, count, touched): the decayed count after each micro-batch's opens. events: (key, ts), a stream."""
    life = half_life_days * 86_400_000.0

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, touched = state.get if state.exists else (0.0, 0)
        for ts in sorted(x for frame in frames for x in (frame["ts"].astype("datetime64[ns]").astype("int64") / 1e6).tolist()):
            count = count * 2.0 ** (-max(ts - touched, 0.0) / life) + 1.0 if count else 1.0
            touched = ts
        state.update((count, float(touched)))
        yield pd.DataFrame([(name[0], count, pd.Timestamp(int(touched * 1000), unit="us"))], columns=[key, "count", "touched"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, count double, touched timestamp", "count double, touched double", "update", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, seconds: float = 5.0, key: str = "key") -> DataFrame:
    """(key, ts): each key's events that come ``seconds`` or more after the last one let through. events: (key, ts), a stream."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for ts in sorted(x for frame in frames for x in (frame["ts"].astype("datetime64[ns]").astype("int64") // 1000).tolist()):
            if last is None or ts - last >= seconds * 1e6:
                out.append((name[0], pd.Timestamp(ts, unit="us")))
                last = ts
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "ts"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def admitted(events: DataFrame, burst: int = 3, per_second: float = 1.0, key: str = "key") -> DataFrame:
    """(key, ts): events that a token bucket of each key lets through: ``burst`` at once, ``per_second`` in the long run. events: (key, ts), a stream."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(burst), None)
        out = []
        for ts in sorted(x for frame in frames for x in (frame["ts"].astype("datetime64[ns]").astype("int64") // 1000).tolist()):
            tokens = min(float(burst), tokens + max(ts - last, 0) / 1e6 * per_second) if last is not None else tokens
            last = ts if last is None else max(last, ts)
            if tokens >= 1:
                tokens -= 1
                out.append((name[0], pd.Timestamp(ts, unit="us")))
        if last is not None:
            state.update((tokens, last))
        yield pd.DataFrame(out, columns=[key, "ts"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, ts timestamp", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


def reconciled(indexed: DataFrame, truth: DataFrame, dirty: DataFrame) -> DataFrame:
    """The index (parent_dir, name, is_dir) after dirty paths have been held against the truth.

    What lies at, below or directly in a dirty path is taken from the truth; kinds and order of events don't count.
    """
    kept = store.remove_subtrees(indexed, dirty)
    found = truth.withColumn("_key", F.lit(1))
    now = found.subtract(store.remove_subtrees(truth, dirty).withColumn("_key", F.lit(1))).drop("_key")
    return kept.unionByName(now).distinct()


def watch(events: DataFrame, read_index, read_truth, write_index, checkpoint: str):
    """A streaming query that reconciles the index for each micro-batch of events (path). The tables come and go through the callables, so a snapshot is swapped whole; ``watch_table`` writes what changes only."""

    def apply(batch: DataFrame, _: int) -> None:
        dirty = batch.select("path").distinct()
        write_index(reconciled(read_index(), read_truth(), dirty))

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def watch_table(events: DataFrame, table: R.EntryTable, read_truth: Callable[[], DataFrame], checkpoint: str, roots: DataFrame | None = None):
    """A streaming query that holds the dirty paths of each micro-batch of events (path) against the truth (path, is_dir) and appends what changes to the table's log.

    Only dirty shards are read. A micro-batch that runs again after a failure writes the same batch of the log again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        dirty = batch.select("path").distinct().persist()
        try:
            made = R.changes(table.read(number, dirty), R.pruned(R.sharded(read_truth()), dirty), dirty, roots)
            table.append(number, made)
        finally:
            dirty.unpersist()

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
