"""Small system tables as text lines (by, value): memory, network and processor counters, processes, type globs, profiles, listings.

``by`` are columns that tell sources apart, such as host and sample, so that many hosts' tables are one DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Beginnings of virtual interfaces' names (fixed values); ``lo`` is one, too.
VIRTUAL = ["veth", "docker", "br-", "virbr", "vnet", "tap", "tun", "wg", "zt", "dummy", "ifb", "kube", "cni", "flannel", "cali"]
#: Memory keys that are read (fixed values).
MEMORY = {"MemTotal": "total", "MemAvailable": "available", "SwapTotal": "swap_total", "SwapFree": "swap_free"}


def memory_info(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, available, swap_total, swap_free) in bytes, null where a key is missing or no number."""
    key, kb = F.regexp_extract("value", "^([^:]*):", 1), F.regexp_extract("value", r"^[^:]*:\s*([0-9]+)(\s|$)", 1)
    parts = lines.select(*by, key.alias("key"), (kb.try_cast("long") * 1024).alias("bytes"))
    return parts.groupBy(*by).agg(*(F.max(F.when(F.col("key") == k, F.col("bytes"))).alias(name) for k, name in MEMORY.items()))


def net_counters(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, rx, tx): bytes of all interfaces that aren't virtual."""
    name, fields = F.trim(F.regexp_extract("value", "^([^:]*):", 1)), F.filter(F.split(F.regexp_extract("value", "^[^:]*:(.*)$", 1), r"\s+"), lambda x: x != "")
    real = ~name.isin("", "lo") & ~name.rlike("^(" + "|".join(VIRTUAL) + ")")
    rx, tx = F.get(fields, 0).try_cast("long"), F.get(fields, 8).try_cast("long")
    good = real & rx.isNotNull() & tx.isNotNull()
    return lines.groupBy(*by).agg(F.coalesce(F.sum(F.when(good, rx)), F.lit(0)).alias("rx"), F.coalesce(F.sum(F.when(good, tx)), F.lit(0)).alias("tx"))


def cpu_counters(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, busy) of each line of all processors: the first 8 fields, less idle and waiting ones."""
    fields = F.transform(F.slice(F.split(F.trim("value"), r"\s+"), 2, 8), lambda x: x.try_cast("long"))
    rows = lines.where(F.col("value").rlike(r"^cpu\s")).select(*by, fields.alias("f")).where("size(f) >= 5")
    total = F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return rows.select(*by, total.alias("total"), (total - F.coalesce(F.get("f", 3), F.lit(0)) - F.coalesce(F.get("f", 4), F.lit(0))).alias("busy"))


def process_stats(lines: DataFrame) -> DataFrame:
    """(pid, ppid, tpgid) of process lines (value); the name in brackets may hold brackets and blanks."""
    rest = F.split(F.trim(F.regexp_extract("value", r"^.*\)(.*)$", 1)), r"\s+")
    return lines.select(F.regexp_extract("value", r"^\s*([0-9]+)", 1).try_cast("long").alias("pid"), F.get(rest, 1).try_cast("long").alias("ppid"), F.get(rest, 5).try_cast("long").alias("tpgid")).where("pid is not null and ppid is not null")


def type_globs(lines: DataFrame) -> DataFrame:
    """(glob, type, weight, form) of ``weight:type:glob`` lines (dir, value): form is literal, suffix or complex. The earliest directory's line of a glob counts."""
    parts = F.split("value", ":", 4)
    rows = lines.where(~F.col("value").startswith("#") & (F.size(parts) >= 3)).select("dir", F.get(parts, 0).try_cast("int").alias("weight"), F.get(parts, 1).alias("type"), F.get(parts, 2).alias("glob")).where("weight is not null")
    form = F.when(~F.col("glob").rlike(r"[*?\[]"), "literal").when(F.col("glob").rlike(r"^\*[^*?\[]+$"), "suffix").otherwise("complex")
    best = rows.groupBy("glob").agg(F.min(F.struct("dir", -F.col("weight"), "type")).alias("b"))
    return best.select("glob", F.col("b.type").alias("type"), (-F.col("b.col2")).alias("weight"), form.alias("form"))


def default_profile(sections: DataFrame) -> DataFrame:
    """(file, path) from INI rows (file, section, key, value): the install's default, else the profile marked so, else the only one."""
    wide = sections.groupBy("file", "section").pivot("key", ["Default", "Path"]).agg(F.first("value"))
    install, profile = F.col("section").startswith("Install"), F.col("section").startswith("Profile")
    found = wide.groupBy("file").agg(
        F.min_by(F.when(install, F.col("Default")), F.when(install & F.col("Default").isNotNull(), F.col("section"))).alias("installed"),
        F.min_by(F.when(profile, F.col("Path")), F.when(profile & (F.col("Default") == "1"), F.col("section"))).alias("marked"),
        F.when(F.count_if(profile) == 1, F.max(F.when(profile, F.col("Path")))).alias("only"),
    )
    return found.select("file", F.coalesce("installed", "marked", "only").alias("path")).where("path is not null")


def listing(entries: DataFrame, most: int) -> DataFrame:
    """The first ``most`` children of each directory (parent_dir, name, is_dir): directories first, by lower-cased name; with place, total and truncated."""
    w = Window.partitionBy("parent_dir").orderBy(F.desc("is_dir"), F.lower("name"), "name")
    total = entries.groupBy("parent_dir").agg(F.count("*").alias("total"))
    rows = entries.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)
    return rows.join(total, "parent_dir").withColumn("truncated", F.col("total") > most)


def live_or_stored(live: DataFrame, stored: DataFrame, connected: DataFrame, by: list[str]) -> DataFrame:
    """Live rows of sources that are connected (by), even if they have none, and the stored rows of all others."""
    return live.join(connected, by, "left_semi").unionByName(stored.join(connected, by, "left_anti"))


def active_profile(profiles: DataFrame, by: list[str]) -> DataFrame:
    """The profile (by, base, path) in use: that whose history was written last; the earlier base on ties. profiles: (by, base, path, mtime), mtime null if there is no history."""
    best = profiles.groupBy(*by).agg(F.max(F.struct(F.coalesce("mtime", F.lit(0).cast("timestamp")).alias("mtime"), (-F.col("base")).alias("turn"), "path")).alias("b"))
    return best.select(*by, (-F.col("b.turn")).alias("base"), "b.path")
