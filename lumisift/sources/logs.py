"""Readers of logs and small system tables, with explicit schemas and tolerance of broken rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Built-in sources that stand above the files (fixed names).
ABOVE = ["apps-search", "firefox-frequent", "firefox-tabs"]
_ROW = "rank int, kind string, path string, class int, effClass int, align int, boost double, recency double, cwd double, penalty double, isDir boolean, depth int, ext string, plugin string, title string, score int"
LOG_SCHEMA = f"v int, ts string, query string, blendActive boolean, joined boolean, refined boolean, shown array<struct<{', '.join(c.replace(' ', ':', 1) for c in _ROW.split(', '))}>>, picked struct<rank:int,kind:string,path:string,plugin:string,action:string,revealed:boolean>"


def pick_log(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of JSON-lines logs of version 1; torn lines are left out. Columns: LOG_SCHEMA with ts as a timestamp, and file and line order by ``gen``."""
    rows = None
    for gen, path in enumerate(paths):
        part = spark.read.schema(LOG_SCHEMA + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad").withColumn("gen", F.lit(gen))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("v = 1").withColumn("ts", F.try_to_timestamp("ts"))


def pick_records(log: DataFrame) -> DataFrame:
    """(ts, query, shown, path): file rows shown and the file picked, of records that have either."""
    files = F.transform(F.filter("shown", lambda r: r["kind"] == "file"), lambda r: r["path"])
    picked = F.when(F.col("picked.kind") == "file", F.col("picked.path"))
    return log.select("ts", "query", files.alias("shown"), picked.alias("path")).where((F.size("shown") > 0) | (F.coalesce("path", F.lit("")) != ""))


def impressions(log: DataFrame) -> DataFrame:
    """(imp, ts, query, joined, pos, picked, row) of valid records: the picked rank lies in the list and every row is a file or a plugin row.

    imp is a hash of the record, so it's the same whenever the log is read; equal records are one impression.
    """
    rows = log.dropDuplicates(["ts", "query", "shown", "picked"]).withColumn("imp", F.xxhash64("ts", "query", "shown", "picked"))
    known = F.forall("shown", lambda r: r["kind"].isin("file", "plugin"))
    rows = rows.where(F.col("picked.rank").between(0, F.size("shown") - 1) & known)
    return rows.select("imp", "ts", "query", "joined", "picked.rank", F.posexplode("shown").alias("pos", "row")).select("imp", "ts", "query", "joined", "pos", (F.col("pos") == F.col("rank")).alias("picked"), "row")


def with_hours(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Impressions with the hour of their day in a time zone, and the priority of the built-in sources: 1 for those that stand above the files, else 0."""
    hour = F.hour(F.from_utc_timestamp(F.to_utc_timestamp("ts", F.current_timezone()), F.lit(zone)))
    return rows.withColumns({"hour": hour, "priority": F.when(F.col("row.plugin").isin(ABOVE), 1).otherwise(0)})


def pick_error(report: DataFrame) -> DataFrame:
    """Reports (query, shown_rows, rank, kind, path, plugin) with error, the first reason to reject one, null if none."""
    error = (
        F.when(F.coalesce("query", F.lit("")) == "", "empty query").when(~F.col("kind").isin("file", "plugin"), "unknown kind").when((F.col("rank") < 0) | (F.col("rank") >= F.col("shown_rows")), "rank out of range")
        .when((F.col("kind") == "file") & (F.coalesce("path", F.lit("")) == ""), "file without path").when((F.col("kind") == "plugin") & (F.coalesce("plugin", F.lit("")) == ""), "plugin row without plugin")
    )
    return report.withColumn("error", error)


def open_count_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, count, touched) of a version-1 table of open counts; unusable rows are left out."""
    from ..operators.usage import valid_counts

    schema = T.StructType().add("v", "int").add("entries", T.MapType(T.StringType(), T.StructType().add("c", "double").add("t", "string")))
    rows = spark.read.schema(schema).option("multiLine", True).json(path).where("v = 1").select(F.explode("entries").alias("path", "e"))
    return valid_counts(rows.select("path", F.col("e.c").alias("count"), F.try_to_timestamp("e.t").alias("touched")))


def ini_sections(lines: DataFrame) -> DataFrame:
    """(file, section, key, value) of INI lines (file, n, value): sections by a running mark, the last value of a key."""
    text = F.trim("value")
    w = Window.partitionBy("file").orderBy("n")
    rows = lines.withColumn("text", text).where(~F.col("text").rlike("^([;#].*)?$")).withColumn("head", F.when(F.col("text").rlike(r"^\[.*\]$"), F.expr("substring(text, 2, length(text) - 2)")))
    rows = rows.withColumn("section", F.last("head", ignorenulls=True).over(w)).where("head is null and section is not null and text like '%=%'")
    key, value = F.trim(F.regexp_extract("text", "^([^=]*)=", 1)), F.trim(F.regexp_extract("text", "^[^=]*=(.*)$", 1))
    return rows.select("file", "section", key.alias("key"), "n", value.alias("value")).groupBy("file", "section", "key").agg(F.max_by("value", "n").alias("value"))


def desktop_apps(lines: DataFrame, dir_order: str = "dir") -> DataFrame:
    """(id, name, exec) of application entries: files by (file, dir, id, n, value) lines. The earliest directory's file of an id counts, even if it is unusable."""
    keys = ini_sections(lines).where("section = 'Desktop Entry'").groupBy("file").pivot("key", ["Type", "Name", "Exec", "NoDisplay", "Hidden", "Terminal"]).agg(F.first("value"))
    files = lines.select("file", dir_order, "id").distinct()
    first = files.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(dir_order))).where("n = 1")
    off = [F.coalesce(F.lower(k) != "true", F.lit(True)) for k in ("NoDisplay", "Hidden", "Terminal")]
    good = (F.col("Type") == "Application") & (F.coalesce("Name", F.lit("")) != "") & (F.coalesce("Exec", F.lit("")) != "") & off[0] & off[1] & off[2]
    return first.join(keys, "file").where(good).select("id", F.col("Name").alias("name"), F.col("Exec").alias("exec"))
