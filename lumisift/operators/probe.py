"""How recently paths were touched, with a memory of answers: fresh ones cost nothing, misses are remembered, too, and what is asked anew has a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How long an answer is fresh, and how many are remembered, at most (fixed values).
FRESH_SECONDS, MOST_REMEMBERED = 60.0, 65_536


def _age(now: Column) -> Column:
    return F.unix_micros(now) - F.unix_micros("checked")


def newest_answers(memory: DataFrame) -> DataFrame:
    """(path, recent, checked): the newest answer for each path; recent is null for a path that wasn't there."""
    return memory.groupBy("path").agg(F.max(F.struct("checked", "recent")).alias("m")).select("path", "m.recent", "m.checked")


def split(asked: DataFrame, memory: DataFrame, now: Column, fresh: float = FRESH_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(known, open): rows (path, recent) of paths asked for whose answer is fresh, and (path, checked) of those to be asked, never checked ones first.

    asked: (path), repeated and empty ones count once and never; memory: (path, recent, checked).
    """
    rows = asked.select("path").where("path <> ''").distinct().join(newest_answers(memory), "path", "left").withColumn("fresh", F.coalesce(_age(now) < F.lit(int(fresh * 1e6)), F.lit(False)))
    return rows.where("fresh").select("path", "recent"), rows.where("not fresh").select("path", "checked")


def budgeted(open_: DataFrame, budget: int) -> DataFrame:
    """Those of the open paths that are asked now: the ``budget`` that have waited longest; the others have no answer this time."""
    return open_.orderBy(F.asc_nulls_first("checked"), "path").limit(max(0, budget)).select("path")


def answered(known: DataFrame, open_: DataFrame, answers: DataFrame) -> DataFrame:
    """(path, recent) of all paths asked for: null where a path isn't there or where no answer has come."""
    return known.union(open_.join(answers.select("path", "recent"), "path", "left").select("path", "recent"))


def remembered(memory: DataFrame, asked: DataFrame, answers: DataFrame, now: Column, fresh: float = FRESH_SECONDS, most: int = MOST_REMEMBERED) -> DataFrame:
    """(path, recent, checked) after the answers (path, recent) for the paths asked (path) have come; those without an answer are remembered as misses.

    Within the bound the memory keeps all; beyond it what isn't fresh goes, and if that isn't enough all but the new answers.
    """
    new = asked.select("path").distinct().join(answers.select("path", "recent"), "path", "left").select("path", "recent", now.alias("checked"))
    every = newest_answers(memory.select("path", "recent", "checked").union(new))
    size = F.struct(F.count("*").alias("n"), F.count_if(_age(now) < F.lit(int(fresh * 1e6))).alias("fresh"))
    told = every.join(F.broadcast(every.agg(size.alias("size"))), F.lit(True))  # one row is joined
    stays = F.when(F.col("size.n") <= most, True).when(F.col("size.fresh") <= most, _age(now) < F.lit(int(fresh * 1e6))).otherwise(F.col("checked") == now)
    return told.where(stays).select("path", "recent", "checked")
