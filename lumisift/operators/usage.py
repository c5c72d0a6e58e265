"""Usage analytics: decayed opens, pick priors, the pairwise arbiter, histories and caches.

Logs go in as rows; each operator is an aggregation or a window that keeps per-group state out of the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matching as M
from ..functions import paths as P
from ..plans.versions import Versions

#: Bounds of the remembered tables (fixed values).
OPEN_KEYS, QUERIES, ROWS_PER_QUERY, EXTENSIONS, DIRECTORIES, EXACT_BYTES = 4096, 2048, 4, 512, 2048, 512 << 10
QUERY_BYTES, PATH_BYTES, QUERY_OVERHEAD, ROW_OVERHEAD, FEW_PICKS = 256, 1024, 64, 48, 20


def seconds(ts: Column) -> Column:
    """A timestamp as seconds, with microseconds as the fraction."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def open_counts(opens: DataFrame, now: Column, key: str = "path", ts: str = "ts") -> DataFrame:
    """(key, boost, touched) of a log of opens in order of time: each open halves for each half-life since. One partial and final aggregation."""
    age = seconds(now) - seconds(F.col(ts))
    return opens.where(F.col(key).isNotNull() & (F.col(key) != "") & F.col(ts).isNotNull()).groupBy(key).agg(F.sum(P.decayed(F.lit(1.0), age)).alias("boost"), F.max(ts).alias("touched"))


def keep_most_opened(counts: DataFrame, most: int = OPEN_KEYS, key: str = "path") -> DataFrame:
    """The keys of the highest counts; ties: the last touched, then the key."""
    return counts.orderBy(F.desc("boost"), F.desc("touched"), key).limit(most)


def valid_counts(stored: DataFrame) -> DataFrame:
    """Rows (path, count, touched) of a stored table that can be used: no empty path, a positive finite count, a time."""
    c = F.col("count")
    return stored.where((F.coalesce("path", F.lit("")) != "") & (c > 0) & ~F.isnan(c) & (c < float("inf")) & F.col("touched").isNotNull())


def rate_tables(shown: DataFrame, picks: DataFrame, key: Column, most: int, weights: DataFrame | None = None) -> DataFrame:
    """(key, picks, impressions) of shown (path) and picked (path) rows; under FEW_PICKS picks the open counts (path, weight) join in.

    The most shown keys are kept; ties by picks, then by key.
    """
    parts = shown.select(key.alias("key"), F.lit(0.0).alias("picks"), F.lit(1.0).alias("impressions")).union(picks.select(key.alias("key"), F.lit(1.0), F.lit(0.0)))
    if weights is not None:
        few = picks.agg((F.count("*") < FEW_PICKS).alias("few"))
        total = weights.agg(F.sum("weight").alias("total"))
        start = weights.groupBy(key.alias("key")).agg(F.sum("weight").alias("w"))
        parts = parts.union(start.join(F.broadcast(few.join(total, F.lit(True))), F.col("few")).select("key", "w", "total"))  # one row is joined
    return parts.groupBy("key").agg(F.sum("picks").alias("picks"), F.sum("impressions").alias("impressions")).orderBy(F.desc("impressions"), F.desc("picks"), "key").limit(most)


def exact_picks(picks: DataFrame, now: Column) -> DataFrame:
    """(query, path, weight) of picks (ord, ts, query, path) in order of time, each pick halved for each half-life.

    The strongest rows of each query are kept, then the strongest queries within the bounds of number and bytes.
    """
    q = M.rune_fold(F.regexp_replace("query", r"(?U)^\s+|\s+$", ""))
    rows = picks.withColumn("query", q).where((F.col("query") != "") & (F.octet_length("query") <= QUERY_BYTES) & (F.octet_length("path") <= PATH_BYTES) & (F.col("path") != ""))
    kept = rows.groupBy("query", "path").agg(F.sum(P.decayed(F.lit(1.0), seconds(now) - F.coalesce(seconds(F.col("ts")), seconds(now)))).alias("weight"))
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "path"))).where(F.col("n") <= ROWS_PER_QUERY).drop("n")
    sizes = kept.groupBy("query").agg(F.max("weight").alias("best"), (F.octet_length("query") + QUERY_OVERHEAD + F.sum(F.octet_length("path") + ROW_OVERHEAD)).alias("bytes"))
    # no more than QUERIES queries can stay, so the running sum is over as many rows
    strongest = sizes.orderBy(F.desc("best"), F.desc("query")).limit(QUERIES)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("best"), F.desc("query")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stay = strongest.withColumn("upto", F.sum("bytes").over(w)).where(F.col("upto") <= EXACT_BYTES).select("query")
    return kept.join(F.broadcast(stay), "query", "left_semi")


def priors(paths: DataFrame, query: str, exact: DataFrame, extensions: DataFrame, directories: DataFrame) -> DataFrame:
    """(path, value): the prior of each path for a query, from the three bounded tables."""
    q = "".join(M.term(query.strip()).text) if query.strip().isascii() else M.term(query.strip()).text
    known = exact.where(F.col("query") == q).select("path", "weight")
    rate = [t.select(F.col("key").alias(k), P.rate_term(F.col("picks"), F.col("impressions")).alias(f"{k}_rate")) for t, k in ((extensions, "ext"), (directories, "dir"))]
    rows = paths.select("path").withColumn("ext", P.extension_key(F.col("path"))).withColumn("dir", P.directory_key(F.col("path")))
    out = rows.join(F.broadcast(known), "path", "left").join(F.broadcast(rate[0]), "ext", "left").join(F.broadcast(rate[1]), "dir", "left")
    return out.select("path", (P.exact_term(F.col("weight")) + F.coalesce("ext_rate", F.lit(0.0)) + F.coalesce("dir_rate", F.lit(0.0))).alias("value"))


def source_ranks(shown: DataFrame) -> DataFrame:
    """Shown rows (imp, pos, plugin) with source_rank: the number of earlier rows of the same plugin in the impression."""
    return shown.withColumn("source_rank", F.row_number().over(Window.partitionBy("imp", "plugin").orderBy("pos")).cast("long") - 1)


def pairs(rows: DataFrame) -> DataFrame:
    """Each impression's picked row against its others: (imp, picked_pos, pos, picked_score, score). rows: (imp, pos, picked boolean, score)."""
    good = rows.where("picked").select("imp", F.col("pos").alias("picked_pos"), F.col("score").alias("picked_score"))
    return rows.where(~F.col("picked")).select("imp", "pos", "score").join(good, "imp").select("imp", "picked_pos", "pos", "picked_score", "score")


def pair_accuracy(paired: DataFrame) -> DataFrame:
    """(pairs, model, baseline): shares of pairs that the score, and the shown order, put right; 0 without pairs."""
    right = F.when(F.col("picked_score") > F.col("score"), 1.0).otherwise(0.0)
    first = F.when(F.col("picked_pos") < F.col("pos"), 1.0).otherwise(0.0)
    return paired.agg(F.count("*").alias("pairs"), F.coalesce(F.avg(right), F.lit(0.0)).alias("model"), F.coalesce(F.avg(first), F.lit(0.0)).alias("baseline"))


def holdout(impressions: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Impressions (imp, ts) with holdout: the newest fraction, rounded up. The cut is found by counts per day, then within one day."""
    days = impressions.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    every, newer = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.desc("day"))  # a row for each day
    told = days.select("day", "n", (F.sum("n").over(newer) - F.col("n")).alias("later"), F.ceil(F.sum("n").over(every) * fraction).alias("need"))
    rows = impressions.withColumn("day", F.to_date("ts")).join(F.broadcast(told), "day")
    cut = (F.col("later") < F.col("need")) & (F.col("later") + F.col("n") > F.col("need"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("ts"), F.desc("imp")))
    within = rows.where(cut).withColumn("holdout", place + F.col("later") <= F.col("need"))
    return within.unionByName(rows.where(~cut).withColumn("holdout", F.col("later") < F.col("need"))).drop("day", "n", "later", "need")


#: Places of the feature vector (fixed values): sizes of the one-hot groups and sources with a feature of their own.
DEPTHS, EXTS, PLUGINS, LENGTHS, TIMES = 4, 16, 8, 4, 4
SOURCES = ["apps-search", "windows", "firefox-tabs", "firefox-frequent"]


def depth_bucket(depth: Column) -> Column:
    return F.when(depth <= 3, 0).when(depth <= 6, 1).when(depth <= 9, 2).otherwise(3)


def length_bucket(query: Column) -> Column:
    n = F.length(query)
    return F.when(n <= 2, 0).when(n <= 5, 1).when(n <= 11, 2).otherwise(3)


def file_features(rows: DataFrame) -> DataFrame:
    """Rows of files with x, an array of (idx, value) of the features that vary among files and of the bias, in order of idx.

    rows: class, eff_class, align, boost, recency, cwd, penalty, is_dir, depth, ext.
    """

    def at(i: Column | int, v: Column | float) -> Column:
        return F.struct((F.lit(i) if isinstance(i, int) else i).cast("int").alias("idx"), (F.lit(v) if isinstance(v, (int, float)) else v).cast("double").alias("value"))

    ext_base = 14 + DEPTHS
    every = F.array(
        at(0, 1.0), at(1, 1.0), at(3 + P.clamp(F.col("class"), 0, 3), 1.0), at(7, F.when(F.col("eff_class") < F.col("class"), 1.0).otherwise(0.0)), at(8, P.clamp(F.col("align") / 256.0, 0.0, 1.0)),
        at(9, P.saturate(F.col("boost"))), at(10, P.clamp(F.col("recency"), 0.0, 1.0)), at(11, P.saturate(F.col("cwd"))), at(12, P.clamp(F.col("penalty"), 0.0, 1.0)), at(13, F.col("is_dir").cast("double")),
        at(14 + depth_bucket(F.col("depth")), 1.0), at(ext_base + P.fnv_bucket(F.col("ext"), EXTS), F.when(F.col("ext") != "", 1.0).otherwise(0.0)),
    )
    return rows.withColumn("x", F.array_sort(F.filter(every, lambda f: f["value"] != 0)))


def dot(x: Column, weights: list[float]) -> Column:
    """The product of sparse features and a weight vector."""
    w = F.array(*(F.lit(float(v)) for v in weights))
    return F.aggregate(x, F.lit(0.0), lambda s, f: s + F.get(w, f["idx"]) * f["value"])


def file_delta(x: Column, weights: list[float], most: float = 2.0) -> Column:
    """The bounded score of the features that vary among files, as a signal of the blend."""
    last = 14 + DEPTHS + EXTS
    return P.clamp(dot(F.filter(x, lambda f: (f["idx"] >= 3) & (f["idx"] < last)), weights), -most, most)


def history(entries: DataFrame, most: int = 100) -> DataFrame:
    """The last occurrence of each trimmed entry (ord, entry), the newest ``most``, oldest first: (place, entry)."""
    last = entries.withColumn("entry", F.regexp_replace("entry", r"(?U)^\s+|\s+$", "")).where("entry <> ''").groupBy("entry").agg(F.max("ord").alias("ord")).orderBy(F.desc("ord")).limit(most)
    return last.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord")).cast("long").alias("place"), "entry")


def cache_budget(items: DataFrame, budget: int, overhead: int = 256, most: int = 64) -> DataFrame:
    """Items (key, size, used) that a least-recently-used cache keeps: the newest within the bounds, the newest of all in any case if it fits."""
    newest = items.where(F.col("size") + overhead <= budget).orderBy(F.desc("used"), "key").limit(most)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("used"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return newest.withColumn("upto", F.sum(F.col("size") + overhead).over(w)).where(F.col("upto") <= budget).select("key", "size", "used", "upto")


def merged_counts(stored: DataFrame | None, opens: DataFrame, now: Column, most: int = OPEN_KEYS) -> DataFrame:
    """(path, count, touched) after opens (path, ts): what is stored and each open, halved for each half-life up to the last open; the ``most`` opened are kept.

    stored: (path, count, touched), rows that can't be used are left out; None if there is nothing yet.
    """
    rows = opens.where(F.col("path").isNotNull() & (F.col("path") != "") & F.col("ts").isNotNull()).select("path", F.lit(1.0).alias("w"), F.col("ts").alias("t"))
    if stored is not None:
        rows = rows.union(valid_counts(stored).select("path", F.col("count").alias("w"), F.col("touched").alias("t")))
    sums = rows.groupBy("path").agg(F.sum(P.decayed(F.col("w"), seconds(now) - seconds(F.col("t")))).alias("boost"), F.max("t").alias("touched"))
    return keep_most_opened(sums, most).select("path", (F.col("boost") / P.decayed(F.lit(1.0), seconds(now) - seconds(F.col("touched")))).alias("count"), "touched")


def record_opens(table: Versions, opens: DataFrame, now: Column, most: int = OPEN_KEYS) -> int:
    """Makes the counts after these opens the table's next version; one that another writer has made meanwhile is built upon."""
    return table.update(lambda stored: merged_counts(stored, opens, now, most))


def record_queries(table: Versions, entries: DataFrame, most: int = 100) -> int:
    """Makes the history (place, entry) after entries (ord, entry) the table's next version."""
    new = entries.select((F.col("ord") + (1 << 40)).alias("ord"), "entry")
    return table.update(lambda stored: history(new if stored is None else stored.select(F.col("place").alias("ord"), "entry").union(new), most))


def table_sizes(exact: DataFrame, extensions: DataFrame, directories: DataFrame) -> DataFrame:
    """One row (queries, extensions, directories): how many keys each table of priors has."""
    parts = [t.select(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, (t, c) in enumerate(((exact, "query"), (extensions, "key"), (directories, "key")))]
    every = parts[0].union(parts[1]).union(parts[2])
    return every.agg(*(F.count_distinct(F.when(F.col("kind") == k, F.col("key"))).alias(name) for k, name in enumerate(("queries", "extensions", "directories"))))
