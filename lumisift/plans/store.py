"""The entry table as snapshots and a change log: upserts, subtree deletes, differences, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def valid_name(name: Column) -> Column:
    """A name that an entry may have."""
    return F.coalesce(name.isNotNull() & ~name.isin("", ".", "..") & ~name.rlike(r"[/\\\x00]"), F.lit(False))


def snapshot(log: DataFrame) -> DataFrame:
    """Entries (id, parent_dir, name, is_dir, tombstone) of a log (seq, op, path, is_dir), op ``add`` or ``remove``.

    The last operation that concerns a path decides: its own, or a removal of a directory above it. Only the latest removal of each path counts;
    those above are sought through the few ancestors of each directory, once for all that it holds. id is the first seq that added the path.
    """
    name = F.substring_index("path", "/", -1)
    parent = F.substring("path", F.lit(1), F.length("path") - F.length(name) - 1)
    adds = log.where("op = 'add'").groupBy("path").agg(F.min("seq").alias("id"), F.max("seq").alias("seq"), F.max_by("is_dir", "seq").alias("is_dir"))
    gone = log.where("op = 'remove'").groupBy("path").agg(F.max("seq").alias("gone"))
    dirs = log.where("op = 'add'").select(P.holder(F.col("path")).alias("dir")).distinct()
    over = dirs.select("dir", F.explode(P.above(F.col("dir"))).alias("path")).join(gone, "path").groupBy("dir").agg(F.max("gone").alias("over"))
    rows = adds.join(gone, "path", "left").withColumn("dir", P.holder(F.col("path"))).join(over, "dir", "left").withColumn("tombstone", F.coalesce(F.greatest("gone", "over") > F.col("seq"), F.lit(False)))
    return rows.select("id", F.when(parent == "", "/").otherwise(parent).alias("parent_dir"), name.alias("name"), "is_dir", "tombstone").where(valid_name(F.col("name")))


def remove_subtrees(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries that lie neither at nor below a removed path (column path), by their ancestors and an anti-join."""
    keyed = entries.withColumn("_path", P.entry_path(F.col("parent_dir"), F.col("name")))
    hit = keyed.select("_path", F.explode(F.array_append(P.ancestors(F.col("_path")), F.col("_path"))).alias("above")).join(roots.select(F.col("path").alias("above")), "above", "left_semi").select("_path").distinct()
    return keyed.join(hit, "_path", "left_anti").drop("_path")


def outermost(roots: DataFrame) -> DataFrame:
    """Roots (path) that lie in no other."""
    above = roots.select("path", F.explode(P.ancestors(F.col("path"))).alias("above")).where("above <> path")
    nested = above.join(roots.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path").distinct()
    return roots.select("path").distinct().join(nested, "path", "left_anti")


def difference(indexed: DataFrame, truth: DataFrame) -> DataFrame:
    """(parent_dir, name, change) between two listings (parent_dir, name, is_dir): ``add``, ``remove`` or ``flip``."""
    a, b = (d.select("parent_dir", "name", F.col("is_dir").alias(k)) for d, k in ((indexed, "was"), (truth, "now")))
    change = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "remove").when(F.col("was") != F.col("now"), "flip")
    return a.join(b, ["parent_dir", "name"], "full_outer").select("parent_dir", "name", change.alias("change")).where("change is not null")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, once each."""
    return a.subtract(b).union(b.subtract(a))


def live_dirs_page(entries: DataFrame, start: int, size: int) -> DataFrame:
    """A page of live directories by id: (id, path, next_id), next_id -1 on the last page."""
    live = entries.where((F.col("id") >= start) & F.col("is_dir") & ~F.col("tombstone")).orderBy("id").limit(size + 1)
    more = live.agg(F.count("*").alias("n"), F.max("id").alias("last"))
    page = live.orderBy("id").limit(size).select("id", P.entry_path(F.col("parent_dir"), F.col("name")).alias("path"))
    return page.join(F.broadcast(more), F.lit(True)).select("id", "path", F.when(F.col("n") > size, F.col("last")).otherwise(-1).cast("long").alias("next_id"))  # one row is joined


def tombstone_ratio(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.avg(F.col("tombstone").cast("double")), F.lit(0.0)).alias("ratio"))


def footprint(entries: DataFrame) -> DataFrame:
    """Bytes of a columnar entry table: (entries, name_bytes, offset_bytes, parent_bytes, flag_bytes, bytes_per_entry)."""
    n, names = F.count("*"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)) + F.count("*")
    total = names + 4 * (n + 1) + 4 * n + n
    return entries.agg(n.alias("entries"), names.alias("name_bytes"), (4 * (n + 1)).alias("offset_bytes"), (4 * n).alias("parent_bytes"), n.alias("flag_bytes"), F.when(n > 0, total / n).otherwise(0.0).alias("bytes_per_entry"))


def changed_since(dirs: DataFrame, watermark: Column, slack_seconds: float = 2.0) -> DataFrame:
    """Directories (path, mtime) to be listed again: those touched since the watermark, less the slack for late times."""
    return dirs.where(F.col("mtime") >= watermark - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(slack_seconds)))


def watch_set(dirs: DataFrame, budget: int) -> DataFrame:
    """Directories (path, is_root, is_home, ord) to be watched: all roots, the home tree up to three quarters of the budget, others up to the whole.

    Only numbers come to the driver; each part is a bounded top-k.
    """
    roots = dirs.where("is_root").count()
    home = dirs.where("not is_root and is_home").orderBy("ord", "path").limit(max(0, budget - budget // 4 - roots))
    rest = dirs.where("not is_root and not is_home").orderBy("ord", "path").limit(max(0, budget - roots - home.count()))
    return dirs.where("is_root").union(home).union(rest)


def newest_generation(rows: DataFrame, by: list[str], generation: str = "gen") -> DataFrame:
    """Rows of the newest generation of each key; results of older ones have come too late."""
    return rows.join(rows.groupBy(*by).agg(F.max(generation).alias(generation)), [*by, generation], "left_semi")


def children(entries: DataFrame, directory: str) -> DataFrame:
    """Entries directly in a directory."""
    return entries.where(F.col("parent_dir") == directory)
