"""Tabs that live connections report: each connection's last list, as a whole, until it's closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One tab as it comes over the wire (fixed names).
TAB = "id:long,windowId:long,title:string,url:string,pinned:boolean,lastAccessed:double,active:boolean,favIconUrl:string"


def latest(messages: DataFrame) -> DataFrame:
    """(conn, seq, at, closed, tabs): the newest message of each connection. messages: (conn, seq, at, kind, tabs), kind ``tabs`` with a JSON list or ``close``."""
    best = messages.groupBy("conn").agg(F.max(F.struct("seq", "at", "kind", "tabs")).alias("m"))
    return best.select("conn", "m.seq", "m.at", (F.col("m.kind") == "close").alias("closed"), F.when(F.col("m.kind") != "close", F.col("m.tabs")).alias("tabs"))


def merged(states: DataFrame) -> DataFrame:
    """(conn, pos, id, window_id, title, url, pinned, last_accessed, active, icon_url) of all connections that aren't closed: by connection, then in wire order.

    states: (conn, seq, at, closed, tabs), several rows of a connection count by their newest. Tabs without an address of their own (id below 0) are left out, and so is a
    list that can't be read.
    """
    now = states.groupBy("conn").agg(F.max(F.struct("seq", "closed", "tabs")).alias("m")).where("not m.closed").select("conn", F.posexplode(F.from_json("m.tabs", f"array<struct<{TAB}>>")).alias("pos", "t"))
    return now.where("t.id >= 0").select(
        "conn", "pos", "t.id", F.col("t.windowId").alias("window_id"), "t.title", "t.url", F.coalesce("t.pinned", F.lit(False)).alias("pinned"), F.col("t.lastAccessed").cast("long").alias("last_accessed"),
        F.coalesce("t.active", F.lit(False)).alias("active"), F.col("t.favIconUrl").alias("icon_url"),
    )


def fresh(states: DataFrame) -> DataFrame:
    """(connections, at): how many connections live, and when the newest list of theirs came; null if there is none."""
    now = states.groupBy("conn").agg(F.max(F.struct("seq", "closed", "at")).alias("m")).where("not m.closed")
    return now.agg(F.count("*").alias("connections"), F.max("m.at").alias("at"))
