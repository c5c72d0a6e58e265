"""The pairwise arbiter: features of shown rows of any kind, training behind a gate, and picks joined to what was shown.

A shown row has (imp, ts, joined, pos, picked, kind ``file`` or ``plugin``, query, hour) and the columns of its kind; those of
the other kind may be null. Training sees differences between an impression's picked row and its others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..plans.shared import shared_dir
from ..sources import logs
from . import usage as U

#: Bounds of the normalised ranks (fixed values), picks that training needs, its penalty, and the share that tests it.
MOST_RANK, MOST_PRIORITY, LEAST_PICKS, PENALTY, HOLDOUT = 10, 3, 200, 1e-4, 0.2
_SOURCE = 14 + U.DEPTHS + U.EXTS
_HASHED = _SOURCE + len(U.SOURCES)
_SCORE = _HASHED + U.PLUGINS
_LENGTH = _SCORE + 3
_SPACE = _LENGTH + 2 * U.LENGTHS
_TIME = _SPACE + 4
#: Length of the weight vector.
DIM = _TIME + 2 * U.TIMES
#: Pairs whose differences are made at once.
BATCH = 4096


def _at(place: Column | int, value: Column | float) -> Column:
    place = F.lit(place) if isinstance(place, int) else place
    value = F.lit(value) if isinstance(value, (int, float)) else value
    return F.struct(place.cast("int").alias("idx"), value.cast("double").alias("value"))


def _plugin_array() -> Column:
    plugin = F.coalesce("plugin", F.lit(""))
    known = F.array_position(F.array(*(F.lit(s) for s in U.SOURCES)), plugin)
    place = F.when(known > 0, known + _SOURCE - 1).otherwise(P.fnv_bucket(plugin, U.PLUGINS) + _HASHED)
    ranks = [P.clamp(F.coalesce(c, F.lit(0)), 0, most) / float(most) for c, most in (("priority", MOST_PRIORITY), ("source_rank", MOST_RANK))]
    return F.array(_at(0, 1.0), _at(2, 1.0), _at(place, 1.0), _at(_SCORE, P.clamp(F.coalesce("score", F.lit(0)) / 100.0, 0.0, 1.0)), _at(_SCORE + 1, ranks[0]), _at(_SCORE + 2, ranks[1]))


def _query_array(kind: Column) -> Column:
    """What the query and the hour tell, apart for files (kind 0) and plugin rows (kind 1)."""
    q = F.regexp_replace(F.coalesce("query", F.lit("")), r"(?U)^\s+|\s+$", "")
    hour = F.floor(P.clamp(F.coalesce("hour", F.lit(0)), 0, 23) / 6)
    return F.array(
        _at(kind * U.LENGTHS + U.length_bucket(q) + _LENGTH, 1.0), _at(kind + _SPACE, q.contains(" ").cast("double")),
        _at(kind + _SPACE + 2, q.rlike(r"[/\\]").cast("double")), _at(kind * U.TIMES + hour + _TIME, 1.0),
    )


def features(rows: DataFrame) -> DataFrame:
    """Rows with x, the array of (idx, value) of all features that aren't 0, in order of idx; rows of another kind have the bias only."""
    file = U.file_features(rows.withColumn("ext", F.lower(F.coalesce("ext", F.lit(""))))).withColumnRenamed("x", "_file")
    kind = (F.col("kind") == "plugin").cast("int")
    own = F.when(F.col("kind") == "file", F.col("_file")).when(F.col("kind") == "plugin", _plugin_array())
    every = F.when(own.isNotNull(), F.concat(own, _query_array(kind))).otherwise(F.array(_at(0, 1.0)))
    return file.withColumn("x", F.array_sort(F.filter(every, lambda f: f["value"] != 0))).drop("_file")


def dense(x: Column) -> Column:
    """The feature array as DIM values."""
    return F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.aggregate(F.filter(x, lambda f: f["idx"] == i), F.lit(0.0), lambda s, f: s + f["value"]))


def usable(rows: DataFrame) -> DataFrame:
    """Rows of impressions that training may use: joined, two rows or more, one of them picked."""
    good = rows.groupBy("imp").agg(F.bool_and("joined").alias("j"), F.count("*").alias("n"), F.count_if("picked").alias("p")).where("j and n > 1 and p = 1")
    return rows.join(good.select("imp"), "imp", "left_semi")


def _both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature arrays (a, b) of pairs -> (label, d): a - b as DIM values, and b - a."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            n = part.num_rows
            d = np.zeros(n * DIM)
            for name, sign in (("a", 1.0), ("b", -1.0)):
                x = part.column(name)
                idx, value = (pc.struct_field(x.flatten(), k).to_numpy(zero_copy_only=False) for k in ("idx", "value"))
                place = np.repeat(np.arange(n) * DIM, pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))
                known = (idx >= 0) & (idx < DIM)
                d += np.bincount(place[known] + idx[known], sign * value[known], minlength=n * DIM)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n * DIM + 1, DIM), pa.int32()), pa.array(np.concatenate([d, 0.0 - d])))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([1.0, 0.0], n)), values], ["label", "d"])


def differences(rows: DataFrame) -> DataFrame:
    """(label, features): the picked row less each other, and the same the other way round."""
    good = rows.where("picked").select("imp", F.col("x").alias("a"))
    pairs = rows.where("not picked").select("imp", F.col("x").alias("b")).join(good, "imp")
    return pairs.select("a", "b").mapInArrow(_both_ways, "label double, d array<double>").select("label", array_to_vector("d").alias("features"))


def fit(rows: DataFrame, rounds: int = 50) -> list[float]:
    """Weights by logistic regression on the differences, a distributed fit."""
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=PENALTY, maxIter=rounds).fit(differences(rows))
    return [float(w) for w in model.coefficients.toArray()]


@dataclass(frozen=True)
class Outcome:
    """What training has found; weights is None where the gate refuses."""

    picks: int
    model: float
    baseline: float
    weights: list[float] | None
    reason: str


def scored(rows: DataFrame, weights: list[float]) -> DataFrame:
    return rows.withColumn("score", U.dot(F.col("x"), weights))


def train(rows: DataFrame, least: int = LEAST_PICKS) -> Outcome:
    """Trains on the older impressions, tests on the newest, and refits on all if the model puts more pairs right than the shown order did.

    rows: (imp, ts, joined, pos, picked, x).
    """
    rows = usable(rows)
    picks = rows.where("picked").count()
    if picks < least:
        return Outcome(picks, 0.0, 0.0, None, f"inactive: {picks} picks, {least} needed")
    # every fit and score reads these rows, so they are stored: their features are made once
    at = f"{shared_dir(rows.sparkSession)}/training"
    rows.select("imp", "pos", "picked", "x").join(U.holdout(rows.where("picked").select("imp", "ts"), HOLDOUT).select("imp", "holdout"), "imp", "left").write.parquet(at)
    parts = rows.sparkSession.read.parquet(at)
    first = fit(parts.where("not holdout"))
    found = U.pair_accuracy(U.pairs(scored(parts.where("holdout"), first))).head()
    if found["model"] <= found["baseline"]:
        return Outcome(picks, found["model"], found["baseline"], None, "inactive: the model is no better than the shown order")
    last = fit(parts)
    if not finite(last):
        return Outcome(picks, found["model"], found["baseline"], None, "inactive: the weights aren't finite")
    return Outcome(picks, found["model"], found["baseline"], last, "active")


def finite(weights: list[float]) -> bool:
    return all(math.isfinite(w) for w in weights)


def impressions_of_picks(log: DataFrame, by: list[str], last: int = 8) -> DataFrame:
    """(by, seq, imp_seq) for each pick: the newest impression of its query among the ``last`` ones before it, null if there is none.

    log: (by, seq, query, shown boolean), rows that aren't shown are picks. Bounded as-of join by two windows over each session.
    """
    before = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*by, "query").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumn("_n", F.count_if("shown").over(before)).withColumn("_at", F.last(F.when(F.col("shown"), F.struct("_n", "seq")), ignorenulls=True).over(same))
    return rows.where("not shown").select(*by, "seq", F.when(F.col("_n") - F.col("_at._n") < last, F.col("_at.seq")).alias("imp_seq"))


def arbitrate(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of other sources (query, source, priority, ord, model) with place, their place in the section by model score, and the section's new priority.

    A section of no priority goes above the files if its best row's score is over that of the best file row of the same query (files: query,
    model); without file rows it stays. Ties keep their order.
    """
    best = rows.groupBy("query", "source").agg(F.max("model").alias("best"))
    top = files.groupBy("query").agg(F.max("model").alias("file"))
    sections = best.join(top, "query", "left").select("query", "source", (F.col("best") > F.col("file")).alias("over"))
    place = F.row_number().over(Window.partitionBy("query", "source").orderBy(F.desc("model"), "ord")).cast("long")
    return rows.withColumn("place", place).join(sections, ["query", "source"]).withColumn("priority", F.when((F.col("priority") <= 0) & F.col("over"), 1).otherwise(F.col("priority"))).drop("over")


def pick_records(shown: DataFrame, picks: DataFrame) -> DataFrame:
    """(imp, value): one JSON line for each pick: the impression's rows in order with their signals, and what was picked.

    shown: (imp, ts, query, rank and signals); picks: (imp, path, action). A pick without an impression is a record without rows, and one of a path that wasn't shown has no rank. Write the lines with
    ``df.select("value").write.mode("append").text(folder)``; ``sources.logs`` reads them.
    """
    signals = [c for c in shown.columns if c not in ("imp", "ts", "query")]
    rows = shown.groupBy("imp").agg(F.min("ts").alias("ts"), F.min("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", *(c for c in signals if c != "rank")))).alias("shown"))
    made = picks.join(rows, "imp", "left").withColumn("picked", F.struct(F.get(F.filter("shown", lambda r: r["path"] == F.col("path")), F.lit(0))["rank"].alias("rank"), "path", "action"))
    return made.select("imp", F.to_json(F.struct(F.lit(1).alias("v"), "ts", "query", F.col("shown").isNotNull().alias("joined"), F.coalesce("shown", F.expr("array()").cast(rows.schema["shown"].dataType)).alias("shown"), "picked")).alias("value"))


#: Signals of a shown file, as the log names them (fixed names).
SIGNALS = {"class": "int", "effClass": "int", "align": "int", "boost": "double", "recency": "double", "cwd": "double", "penalty": "double", "isDir": "boolean"}


def report_records(reports: DataFrame, impressions: DataFrame) -> DataFrame:
    """(id, value): the log line of each report of a pick, its rows as reported and their signals from the impression only.

    reports: (id, ts, query, shown array of (kind, path, plugin, score, title), picked (rank, action, revealed), imp), imp the impression that the pick is joined to or null;
    impressions: (imp, blend, path and the columns of SIGNALS). Reports without a query and those that ``sources.logs.pick_error`` rejects make no line. A file that the impression doesn't know, or a report without
    one, has signals of nought. ``sources.logs`` reads the lines back.
    """
    target = F.get("shown", F.col("picked.rank"))
    bad = logs.pick_error(reports.select("id", F.trim("query").alias("query"), F.size("shown").alias("shown_rows"), F.col("picked.rank").alias("rank"), target["kind"].alias("kind"), target["path"].alias("path"), target["plugin"].alias("plugin"))).where("error is null")
    good = reports.join(bad.select("id"), "id", "left_semi").where(F.trim("query") != "")
    rows = good.select("id", "imp", F.posexplode("shown").alias("rank", "r")).select("id", "imp", "rank", "r.*")
    known = impressions.select("imp", "path", *SIGNALS).dropDuplicates(["imp", "path"]).withColumn("known", F.lit(True))
    told = rows.join(known, ["imp", "path"], "left")
    file = F.col("kind") == "file"
    fields = [F.col("rank"), F.col("kind"), F.when(file, F.col("path")).alias("path"), *(F.when(file, F.coalesce(c, F.lit(0).cast(k))).alias(c) for c, k in SIGNALS.items())]
    fields += [F.when(file, F.size(P.components(F.col("path")))).alias("depth"), F.when(file, F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("ext"), *(F.when(~file, F.col(c)).alias(c) for c in ("plugin", "score", "title"))]
    shown = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))  # a report's rows are few
    blend = impressions.groupBy("imp").agg(F.max("blend").alias("blend"))
    made = good.join(shown, "id").join(blend, "imp", "left")
    target = F.get("rows", F.col("picked.rank"))
    picked = F.struct("picked.rank", target["kind"].alias("kind"), target["path"].alias("path"), target["plugin"].alias("plugin"), "picked.action", F.coalesce("picked.revealed", F.lit(False)).alias("revealed"))
    line = F.struct(F.lit(1).alias("v"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts"), F.trim("query").alias("query"), F.coalesce("blend", F.lit(False)).alias("blendActive"), F.col("blend").isNotNull().alias("joined"), F.lit(False).alias("refined"), F.col("rows").alias("shown"), picked.alias("picked"))
    return made.select("id", F.to_json(line).alias("value"))
