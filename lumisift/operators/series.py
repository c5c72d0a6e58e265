"""Rates of sampled counters, process trees and lists of mounts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: File systems without files of their own, and remote ones (fixed values); the overlay of a container's root is neither.
VIRTUAL_FS = ["proc", "sysfs", "devtmpfs", "devpts", "tmpfs", "cgroup", "cgroup2", "pstore", "securityfs", "debugfs", "tracefs", "fusectl", "configfs", "ramfs", "autofs", "mqueue", "hugetlbfs", "binfmt_misc", "rpc_pipefs"]
NETWORK_FS = ["nfs", "nfs4", "cifs", "smb3", "smbfs", "sshfs", "9p", "afs", "glusterfs", "ceph", "davfs"]


def skips_fs(kind: Column) -> Column:
    return kind.isin([*VIRTUAL_FS, *NETWORK_FS, "fuse"]) | kind.startswith("fuse.")


def mounts(lines: DataFrame) -> DataFrame:
    """(device, path, kind) and the other columns of mount lines (value): octal escapes that the kernel writes resolved, doubled and last slashes gone."""
    parts = F.split(F.trim("value"), r"[ \t]+")
    path = parts[1]
    for code, char in (("040", " "), ("011", "\t"), ("012", "\n"), ("043", "#"), ("134", "\\")):
        path = F.replace(path, F.lit("\\" + code), F.lit(char))
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(.)/$", "$1")
    return lines.where(F.size(parts) >= 3).select(parts[0].alias("device"), path.alias("path"), parts[2].alias("kind"), *(c for c in lines.columns if c != "value"))


def _within(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return (path == (root or "/")) | path.startswith(root + "/")


def mount_skips(mounted: DataFrame, roots: list[str], most: int = 256) -> DataFrame:
    """Mount points of virtual and network file systems under a root that are no root themselves, without glob characters; the first ``most`` by ord, where that column is given."""
    path = F.col("path")
    under = reduce(lambda a, b: a | b, (_within(path, r) for r in roots), F.lit(False)) & ~path.isin([r.rstrip("/") or "/" for r in roots])
    rows = mounted.where(skips_fs(F.col("kind")) & path.startswith("/") & (path != "/") & under & ~path.rlike(r"[*?\[\\]"))
    return rows.orderBy("ord" if "ord" in mounted.columns else "path").limit(most).select("path")


def real_mounts(mounted: DataFrame, roots: list[str]) -> DataFrame:
    """Mounts of walkable file systems at or under a root."""
    path = F.col("path")
    return mounted.where(~skips_fs(F.col("kind")) & path.startswith("/") & reduce(lambda a, b: a | b, (_within(path, r) for r in roots), F.lit(False)))


def busy_rates(samples: DataFrame, by: list[str], interval: float | None = None) -> DataFrame:
    """Samples (ts in seconds, total, busy) with pct, the busy share since the sample before, 0 to 100, and shown_pct, the newest one so far.

    pct is null where counters stand still or run backwards, or where the sample before is older than three intervals.
    """
    w = Window.partitionBy(*by).orderBy("ts")
    total, busy = F.col("total") - F.lag("total").over(w), F.col("busy") - F.lag("busy").over(w)
    recent = F.lit(True) if interval is None else F.col("ts") - F.lag("ts").over(w) <= 3 * interval
    rows = samples.withColumn("pct", F.when((total > 0) & (busy >= 0) & recent, F.least(F.lit(100.0), 100.0 * busy / total)))
    return rows.withColumn("shown_pct", F.last("pct", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def counter_rates(samples: DataFrame, by: list[str], interval: float) -> DataFrame:
    """Samples (ts in seconds, bytes) with rate per second; null on a reset, and carried forward where the sample before is too old."""
    w = Window.partitionBy(*by).orderBy("ts")
    dt, db = F.col("ts") - F.lag("ts").over(w), F.col("bytes") - F.lag("bytes").over(w)
    fresh = samples.withColumn("rate", F.when((dt > 0) & (dt <= 3 * interval) & (db >= 0), db / dt))
    return fresh.withColumn("shown_rate", F.last("rate", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def trees(edges: DataFrame, roots: list[int], most_depth: int = 32) -> DataFrame:
    """(root, pid, depth, way) from some roots down in (pid, ppid), by one recursive query; way: the processes on the way, which no process is on twice.

    Each level is a join by shuffles: a broadcast would send the edges through the driver once a level. Spark ends a recursive query of more than
    ``spark.sql.cteRecursionRowLimit`` rows with an error; the session's limit is lifted, as the depth bounds the query.
    """
    edges.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", -1)
    name = f"edges_{uuid.uuid4().hex}"
    edges.createOrReplaceTempView(name)
    tops = ", ".join(f"CAST({int(root)} AS BIGINT)" for root in dict.fromkeys(roots))
    found = edges.sparkSession.sql(
        f"WITH RECURSIVE tree(root, pid, depth, way) AS (SELECT r, r, 0, array(r) FROM (SELECT explode(array({tops})) AS r) UNION ALL SELECT /*+ MERGE(e) */ t.root, CAST(e.pid AS BIGINT), t.depth + 1, array_append(t.way, CAST(e.pid AS BIGINT)) "
        f"FROM tree t JOIN {name} e ON e.ppid = t.pid WHERE t.depth < {int(most_depth)} AND NOT array_contains(t.way, CAST(e.pid AS BIGINT))) SELECT root, pid, depth, way FROM tree"
    )
    edges.sparkSession.catalog.dropTempView(name)
    return found


def descendants(edges: DataFrame, root: int, most_depth: int = 32) -> DataFrame:
    """(pid, depth, way) from a root down in (pid, ppid)."""
    return trees(edges, [root], most_depth).drop("root")


def foregrounds(processes: DataFrame, roots: list[int]) -> DataFrame:
    """(root, group), a row at most for each root: the first positive terminal group of (pid, ppid, tpgid) below it, level by level, children by number."""
    rows = trees(processes.select("pid", "ppid"), roots).join(processes.where("tpgid > 0").select("pid", "tpgid").hint("merge"), "pid")
    return rows.groupBy("root").agg(F.min_by(F.col("tpgid").cast("long"), F.struct("depth", "way")).alias("group"))


def foreground(processes: DataFrame, root: int) -> DataFrame:
    """One row (group) at most: that of one root."""
    return foregrounds(processes, [root]).select("group")


def working_directories(processes: DataFrame, roots: list[int], home: str = "") -> DataFrame:
    """(root, cwd), a row at most for each root: the working directory of the foreground process of (pid, ppid, tpgid, cwd), or else of the deepest process below the root; / and the home count as none."""
    tells = F.col("cwd").isNotNull() & ~F.col("cwd").isin("", "/", home)
    below = trees(processes.select("pid", "ppid"), roots).join(processes.select("pid", "tpgid", "cwd").hint("merge"), "pid")
    front = F.when(F.col("tpgid") > 0, F.struct("depth", "way"))
    deepest = F.when(tells, F.struct(-F.col("depth"), "way"))
    told = below.groupBy("root").agg(F.min_by("tpgid", front).alias("group"), F.min_by("cwd", deepest).alias("deepest"))
    own = processes.where(tells).select(F.col("pid").alias("group"), "cwd").hint("merge")
    return told.join(own, "group", "left").groupBy("root").agg(F.coalesce(F.min("cwd"), F.min("deepest")).alias("cwd")).where("cwd is not null")


def working_directory(processes: DataFrame, root: int, home: str = "") -> DataFrame:
    """One row (cwd) at most: that of one root."""
    return working_directories(processes, [root], home).select("cwd")
