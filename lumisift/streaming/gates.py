"""Stateful gates on ``transformWithState``: a hold until a snapshot is ready, and live sessions.

State is kept by key in RocksDB, entry by entry, so a long hold isn't written anew with each micro-batch. Sessions that use these need
``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKSDB``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Paths that are held for one root, at most.
MOST_HELD = 65_536


class _Hold(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "path string", "ord long")
        self.flags = handle.getValueState("flags", "released boolean, dropped boolean, lost boolean, size long, next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        released, dropped, lost, size, at = self.flags.get() if self.flags.exists() else (False, False, False, 0, 0)
        out: list[tuple] = []

        def give(kind: str, path: str) -> None:
            nonlocal at
            out.append((key[0], kind, path, at))
            at += 1

        for kind, path in pd.concat(list(rows)).sort_values("seq", kind="stable")[["kind", "path"]].itertuples(index=False):
            if kind == "ready" and not released:
                released = True
                for _, (held,) in sorted(((v[0], k) for k, v in self.held.iterator()), key=lambda x: x[0]):
                    give("change", held)
                self.held.clear()
                if dropped or lost:
                    give("rescan", key[0])
            elif kind == "overflow":
                if released:
                    give("rescan", key[0])
                lost = True
            elif kind == "change" and released:
                give("change", path)
            elif kind == "change" and not self.held.containsKey((path,)):
                if size >= self.most:
                    dropped = True
                else:
                    self.held.updateValue((path,), (size,))
                    size += 1
        self.flags.update((released, dropped, lost, size, at))
        yield pd.DataFrame(out, columns=["root", "kind", "path", "ord"])

    def close(self) -> None:
        pass


def held(events: DataFrame, most: int = MOST_HELD) -> DataFrame:
    """(root, kind, path, ord): changes that are held back until their root is ready, then given in the order in which their paths came first, and what comes later as it comes.

    events: (root, seq, kind, path), a stream; kind ``change``, ``overflow`` (the source lost events) or ``ready``. Up to then a path is held once, and beyond
    ``most`` paths of a root new ones are dropped. Whatever was dropped or lost before makes one row of kind ``rescan`` for the root at
    release, behind what was held; a loss after it makes one at once. Rows of one micro-batch count in order of seq.
    """
    return events.groupBy("root").transformWithStateInPandas(_Hold(most), "root string, kind string, path string, ord long", "Append", "None")


class _Sessions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = pd.concat(list(rows)).sort_values("seq", kind="stable").iloc[-1]
        if self.last.exists() and self.last.get()[0] >= int(newest["seq"]):
            yield pd.DataFrame([], columns=["conn", "seq", "at", "closed", "tabs"])
            return
        closed = newest["kind"] == "close"
        self.last.update((int(newest["seq"]), closed))
        yield pd.DataFrame([(key[0], int(newest["seq"]), newest["at"], closed, None if closed else newest["tabs"])], columns=["conn", "seq", "at", "closed", "tabs"])

    def close(self) -> None:
        pass


def sessions(messages: DataFrame) -> DataFrame:
    """(conn, seq, at, closed, tabs) whenever what a connection holds has changed: its last list as a whole, or that it's closed.

    messages: (conn, seq, at, kind, tabs), a stream; kind ``tabs`` with a JSON list, or ``close``. Messages older than what is known are left out.
    ``operators.sessions.merged`` makes the tabs that are live now of the newest row of each connection.
    """
    return messages.groupBy("conn").transformWithStateInPandas(_Sessions(), "conn long, seq long, at timestamp, closed boolean, tabs string", "Update", "None")
