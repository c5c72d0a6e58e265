"""Manifests of external providers: many small JSON files, the good ones as rows, the others with the first reason against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import is_web_url

#: Bounds and defaults (fixed values).
ID, DEFAULT_MS, LEAST_MS, MOST_MS, PARTS = "^[a-z0-9][a-z0-9_-]{0,31}$", 1500, 100, 10_000, ["focused", "running", "installed"]
TRIGGER = "struct<prefix:string,regex:string,all_queries:boolean,min_query_len:int,debounce_ms:int,focused_app:struct<name_regex:string,exe_regex:string>,focused_boost:int>"
SCHEMA = f"v int, id string, name string, type string, command struct<argv:array<string>>, http struct<url:string,headers:map<string,string>>, timeout_ms int, bangs array<string>, context array<string>, trigger {TRIGGER}, allow_run_command boolean, _bad string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(dir, value) of all ``folder/*/manifest.json``: the directory's name and the text."""
    rows = spark.read.option("wholetext", True).text(f"{folder.rstrip('/')}/*/manifest.json")
    return rows.select(F.regexp_extract(F.input_file_name(), "([^/]*)/[^/]*$", 1).alias("dir"), "value")


def _valid_pattern(pattern: Column) -> Column:
    """Whether a regular expression can be read: brackets of both kinds that pair up, and nothing that repeats nothing."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"(?s)\\.", "x"), r"\[\^?\]?[^\]]*\]", "x")
    opened, closed = F.regexp_count(bare, F.lit(r"\(")), F.regexp_count(bare, F.lit(r"\)"))
    return (opened == closed) & ~bare.contains("[") & ~bare.rlike(r"^[*+?]|[(|][*+?](?!:|i|P|<|=|!)|[*+?]{3}|\\$") & ~bare.rlike(r"^[^(]*\)")


def checked(files: DataFrame) -> DataFrame:
    """(dir, id, name, type, argv, url, headers, timeout_ms, bangs, context, trigger, allow_run_command, error) of manifests (dir, value).

    error is the first reason to leave a manifest out, null for the good ones. Of good ones that share an id the first directory's counts. Commands are lower-cased, and
    they and the context's parts count once; a missing name is the id, missing commands are the id, and the timeout is kept within its bounds.
    """
    m = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = files.select("dir", m.alias("m")).select("dir", "m.*")
    bangs = F.transform(F.coalesce("bangs", F.array("id")), F.lower)
    argv = F.coalesce("command.argv", F.array().cast("array<string>"))
    text = lambda c: F.coalesce(c, F.lit(""))
    app = F.col("trigger.focused_app")
    error = (
        F.when(F.col("_bad").isNotNull() | F.col("dir").isNull(), "not readable").when(~F.coalesce("v", F.lit(1)).isin(0, 1), "version").when(~text(F.col("id")).rlike(ID), "id")
        .when((F.col("type") == "command") & (F.size(argv) == 0), "no command").when((F.col("type") == "command") & F.exists(argv, lambda a: text(a) == ""), "empty argument")
        .when((F.col("type") == "http") & (text(F.col("http.url")) == ""), "no address").when((F.col("type") == "http") & ~is_web_url(F.col("http.url")), "address")
        .when(~text(F.col("type")).isin("command", "http"), "type").when(F.col("trigger").isNull() & (F.size(bangs) == 0), "not reachable")
        .when(F.exists(bangs, lambda b: ~text(b).rlike(ID)), "command name").when(F.exists(F.coalesce("context", F.array().cast("array<string>")), lambda c: ~text(c).isin(PARTS)), "context")
        .when(~_valid_pattern(text(F.col("trigger.regex"))), "pattern").when(app.isNotNull() & (text(app["name_regex"]) == "") & (text(app["exe_regex"]) == ""), "empty gate")
        .when(~_valid_pattern(text(app["name_regex"])) | ~_valid_pattern(text(app["exe_regex"])), "gate pattern")
    )
    asked = F.when(F.coalesce("timeout_ms", F.lit(0)) == 0, DEFAULT_MS).otherwise(F.col("timeout_ms"))
    told = rows.select(
        "dir", "id", F.when(text(F.col("name")) == "", F.col("id")).otherwise(F.col("name")).alias("name"), "type", argv.alias("argv"), F.col("http.url").alias("url"), F.col("http.headers").alias("headers"),
        F.greatest(F.lit(LEAST_MS), F.least(F.lit(MOST_MS), asked)).alias("timeout_ms"), F.array_distinct(bangs).alias("bangs"), F.array_distinct(F.coalesce("context", F.array().cast("array<string>"))).alias("context"),
        "trigger", F.coalesce("allow_run_command", F.lit(False)).alias("allow_run_command"), error.alias("error"),
    )
    good = told.where("error is null").groupBy("id").agg(F.min("dir").alias("first"))
    late = F.when(F.col("error").isNull() & (F.col("dir") > F.col("first")), F.concat(F.lit("id taken by "), "first"))
    return told.join(good, "id", "left").withColumn("error", F.coalesce("error", late)).select(*told.columns)


def manifests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good manifests, without error, and (dir, error) of the others."""
    every = checked(files)
    return every.where("error is null").drop("error"), every.where("error is not null").select("dir", "error")


def command_table(good: DataFrame) -> DataFrame:
    """(command, provider) of good manifests; a command that several claim is the first directory's."""
    rows = good.select("dir", F.col("id").alias("provider"), F.explode("bangs").alias("command"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("command").orderBy("dir"))).where("n = 1").select("command", "provider")
