"""The sample tables read as what the engine works on: entries, opens, visits, impressions, samples, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as a tree: /catalog/<brand>/<type>/<name>_<key>.<ext>, with its directories."""
    part = table(spark, sf_dir, "part")
    brand, slash = F.concat(F.lit("/catalog/"), F.col("p_brand")), F.lit("/")
    ext = F.element_at(F.array(*(F.lit(x) for x in (".txt", ".log", ".csv", ".md"))), F.col("p_size") % 4 + 1)
    files = part.select(F.concat(brand, slash, F.col("p_type")).alias("parent_dir"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey"), ext).alias("name"), F.lit(False).alias("is_dir"))
    kinds = part.select(brand.alias("parent_dir"), F.col("p_type").alias("name"), F.lit(True).alias("is_dir")).distinct()
    brands = part.select(F.lit("/catalog").alias("parent_dir"), F.col("p_brand").alias("name"), F.lit(True).alias("is_dir")).distinct()
    top = part.select(F.lit("/").alias("parent_dir"), F.lit("catalog").alias("name"), F.lit(True).alias("is_dir")).distinct()
    return files.union(kinds).union(brands).union(top)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.from_json("props", "k int")["k"].alias("k"))


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opens of files: each event opens the file of its property."""
    return events(spark, sf_dir).select("event_id", "ts", F.concat(F.lit("/home/u/"), F.when(F.col("k") % 3 == 0, ".cache/").otherwise(""), F.lit("d"), F.col("k") % 7, F.lit("/f"), F.col("k"), F.when(F.col("k") % 2 == 0, ".TXT").otherwise(".md")).alias("path"), "user_id")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of up to five rows: a user's consecutive events; the one of the highest value is picked."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, sf_dir).withColumn("n", F.row_number().over(w) - 1).withColumn("imp", F.col("user_id") * 100000 + F.floor(F.col("n") / 5)).withColumn("pos", F.col("n") % 5)
    best = F.max(F.struct("value", -F.col("pos"))).over(Window.partitionBy("imp"))
    return rows.withColumn("picked", F.col("pos") == -best["col2"]).select("imp", F.col("pos").cast("int").alias("pos"), "ts", "picked", F.col("event_type").alias("plugin"), "value", "k", "event_id")


#: The same views in SQL.
SQL_ENTRIES = """
    raw_entries AS (
        SELECT '/catalog/' || p_brand || '/' || p_type AS parent_dir, replace(p_name, ' ', '_') || '_' || p_partkey || (['.txt', '.log', '.csv', '.md'])[p_size % 4 + 1] AS name, false AS is_dir FROM part
        UNION ALL SELECT DISTINCT '/catalog/' || p_brand, p_type, true FROM part UNION ALL SELECT DISTINCT '/catalog', p_brand, true FROM part UNION ALL SELECT DISTINCT '/', 'catalog', true FROM part),
    entries AS (SELECT *, CASE WHEN parent_dir = '/' THEN '/' || name ELSE parent_dir || '/' || name END AS path, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS name_fold FROM raw_entries),
    ready AS (SELECT *, translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS path_fold, strlen(path) AS path_len,
        array_to_string(list_transform(regexp_extract_all(path, '([0-9]+|[^0-9]+)'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN '0' || lpad((999999 - length(regexp_replace(r, '^0+', '')))::VARCHAR, 6, '0') || translate(regexp_replace(r, '^0+', ''), '0123456789', '9876543210') ELSE r END), '') AS numkey FROM entries)"""
SQL_EVENTS = "ev AS (SELECT event_id, ts, user_id, event_type, value, (props->>'k')::INT AS k FROM events)"
SQL_OPENS = SQL_EVENTS + ", opens AS (SELECT event_id, ts, user_id, '/home/u/' || CASE WHEN k % 3 = 0 THEN '.cache/' ELSE '' END || 'd' || k % 7 || '/f' || k || CASE WHEN k % 2 = 0 THEN '.TXT' ELSE '.md' END AS path FROM ev)"
SQL_IMPRESSIONS = SQL_EVENTS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM ev),
    listed AS (SELECT user_id * 100000 + n // 5 AS imp, (n % 5)::INT AS pos, ts, event_type AS plugin, value, k, event_id FROM numbered),
    imps AS (SELECT *, row_number() OVER (PARTITION BY imp ORDER BY value DESC, pos) = 1 AS picked FROM listed)"""
