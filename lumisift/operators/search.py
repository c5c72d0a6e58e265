"""Ranked search over an entry table: names, several terms, fuzzy and path queries, with the usage blend.

An entry table has (parent_dir, name, is_dir). ``prepared`` adds what every query needs: store it once
and each query is a scan with a filter, a bounded top-k and joins of that top-k to the signals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matching as M
from ..functions import paths as P

#: Bytes of a path pattern beyond which nothing is found.
LONGEST_PATTERN = 1024
#: Alignment points that weigh as one open.
ALIGN_UNIT = 64.0
LIMIT = 50


def prepared(entries: DataFrame) -> DataFrame:
    """Entries with path, name_fold, path_fold, path_len and numkey, to be stored and read by all queries."""
    rows = entries.withColumn("path", P.entry_path(F.col("parent_dir"), F.col("name")))
    return rows.withColumns({"name_fold": M.ascii_fold(F.col("name")), "path_fold": M.ascii_fold(F.col("path")), "path_len": F.octet_length("path"), "numkey": P.number_key(F.col("path"))})


def exclude(entries: DataFrame, globs: list[str]) -> DataFrame:
    """Entries that no glob leaves out, by name or, for globs with a separator, by path."""
    return entries.where(~M.excluded(P.entry_path(F.col("parent_dir"), F.col("name")), globs))


def order(cls: str = "class", score: str = "align") -> list[Column]:
    """The total order: class, alignment, directories, shorter paths, larger numbers, the path."""
    return [F.col(cls), F.desc(score), F.desc("is_dir"), F.col("path_len"), F.col("numkey"), F.col("path")]


@dataclass(frozen=True)
class Blend:
    """Signals that reorder the best matches: tables (path, value) and weights; a weight of 0 or less switches its signal off."""

    boost: DataFrame | None = None
    recency_hours: DataFrame | None = None
    prior: DataFrame | None = None
    model: DataFrame | None = None
    cwd: str = ""
    frecency_weight: float = 1.0
    recency_weight: float = 1.0
    cwd_weight: float = 1.0
    noise_weight: float = 1.0
    tier_jump: float = 3.0


def _classes(rows: DataFrame, query: str, fuzzy: bool) -> tuple[DataFrame, list[M.Term]]:
    """Rows that match, with class and align."""
    name, path = F.col("name"), F.col("path")
    none = rows.where(F.lit(False)).withColumn("class", F.lit(0)).withColumn("align", F.lit(0))
    if not query or "\0" in query:
        return none, []
    if "/" in query:
        t = M.term(query)
        if len(query.encode()) > LONGEST_PATTERN:
            return none, []
        folded = F.col("path_fold") if t.ascii else M.rune_fold(path)
        cls = F.when(folded == t.text, 0).when(folded.endswith(t.text), 1).when(folded.startswith(t.text), 2).when(folded.contains(t.text), 3)
        return rows.where(folded.contains(t.text)).withColumn("class", cls).withColumn("align", F.lit(0)), [t]
    found = M.terms(query)
    if not found:
        return none, []

    def fold(t: M.Term) -> Column:
        return F.col("name_fold") if t.ascii else M.rune_fold(name)

    if len(found) == 1:
        t = found[0]
        cls = F.when(fold(t) == t.text, 0).when(fold(t).startswith(t.text), 1).when(fold(t).contains(t.text), 2)
        if not fuzzy or t.units < 2:
            return rows.where(fold(t).contains(t.text)).withColumn("class", cls).withColumn("align", F.lit(0)), found
        hits = rows.where(M.is_subsequence(name, t)).withColumn("class", cls.otherwise(3))
        return hits.withColumn("align", F.when(F.col("class") == 3, M.term_score(name, t)).otherwise(0)), found
    longest = sorted(found, key=lambda t: -t.units)
    every = reduce(lambda a, b: a & b, (fold(t).contains(t.text) for t in longest))
    if not fuzzy:
        return rows.where(every).withColumn("class", F.lit(2)).withColumn("align", F.lit(0)), found
    loose = reduce(lambda a, b: a & b, (M.is_subsequence(name, t) if t.units > 1 else fold(t).contains(t.text) for t in longest))
    hits = rows.where(loose).withColumn("class", F.when(every, 2).otherwise(3))
    total = reduce(lambda a, b: a + b, (M.term_score(name, t) for t in found))
    return hits.withColumn("align", F.when(F.col("class") == 3, total).otherwise(0)), found


def matches(entries: DataFrame, query: str, fuzzy: bool = True) -> DataFrame:
    """All entries that match, with class and align, in no order."""
    rows = entries if "numkey" in entries.columns else prepared(entries)
    return _classes(rows, query, fuzzy)[0]


def search(entries: DataFrame, query: str, limit: int = LIMIT, fuzzy: bool = True, blend: Blend | None = None, widen: int = 1) -> DataFrame:
    """The best ``limit`` entries: rank (from 1), path, name, is_dir, class and align; with a blend also its signals.

    The blend sees the best limit * widen matches, which are few, so the signal tables are joined to those.
    """
    found = matches(entries, query, fuzzy)
    if limit <= 0:
        found = found.where(F.lit(False))
    top = found.orderBy(*order()).limit(max(limit, 1) * (widen if blend else 1))
    if blend:
        return blended(top, blend).orderBy("rank").limit(max(limit, 1))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order())).cast("long")).select("rank", "path", "name", "is_dir", "class", "align")


def blended(top: DataFrame, blend: Blend) -> DataFrame:
    """A bounded set of matches in blended order, with every signal as a column."""
    out = top
    for name, table in (("boost", blend.boost), ("hours", blend.recency_hours), ("prior", blend.prior), ("model", blend.model)):
        out = out.join(table.select(F.col("path"), F.col("value").cast("double").alias(name)), "path", "left") if table is not None else out.withColumn(name, F.lit(None).cast("double"))
    out = out.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("boost", "prior", "model")})
    out = out.withColumn("recency", F.when(F.col("hours").isNotNull(), P.recency_score(F.col("hours"))).otherwise(0.0)).withColumn("cwd", P.cwd_boost(F.col("path"), blend.cwd, blend.cwd_weight)).withColumn("penalty", P.path_penalty(F.col("path")))
    jumps = (F.col("boost") > blend.tier_jump) & (F.col("class") > 0) if blend.tier_jump > 0 else F.lit(False)
    score = (
        F.col("align") / ALIGN_UNIT + max(blend.frecency_weight, 0.0) * F.col("boost") + F.when(F.col("boost") == 0, max(blend.recency_weight, 0.0) * F.col("recency")).otherwise(0.0)
        + F.col("cwd") - max(blend.noise_weight, 0.0) * F.col("penalty") + F.col("prior") + F.col("model")
    )
    out = out.withColumn("eff_class", F.when(jumps, F.col("class") - 1).otherwise(F.col("class"))).withColumn("blended", score)
    w = Window.partitionBy(F.lit(0)).orderBy("eff_class", F.desc("blended"), *order())
    return out.withColumn("rank", F.row_number().over(w).cast("long")).select("rank", "path", "name", "is_dir", "class", "eff_class", "align", "boost", "recency", "cwd", "penalty", "prior", "model", "blended")


def name_ranges(rows: DataFrame, query: str) -> DataFrame:
    """Rows of a path query with the range of the name that the pattern's last part covers."""
    rest = M.term(query.rpartition("/")[2])
    covers = F.lit(bool(rest.text)) & M.is_prefix(F.col("name"), rest)
    return rows.withColumn("ranges", F.when(covers, F.array(F.array(F.lit(0), F.lit(rest.units)))))


def search_many(entries: DataFrame, queries: list[str], limit: int = LIMIT) -> DataFrame:
    """(query, rank, path, name, is_dir, class): the best entries of each of a stated list of one-word queries of ASCII characters, in one pass over the entries.

    Every task keeps the best ``limit`` of each query before anything is shuffled. Queries are those of ``search`` without the fuzzy tier.
    """
    rows = entries if "numkey" in entries.columns else prepared(entries)
    words = {q: M.terms(q) for q in dict.fromkeys(queries)}
    bad = [q for q, found in words.items() if len(found) != 1 or not q.isascii() or "/" in q or "\0" in q]
    if bad:
        raise ValueError(f"not one word of ASCII characters: {bad[0]!r}")
    wanted = entries.sparkSession.createDataFrame([(q, found[0].text) for q, found in words.items()] or [], "query string, text string")
    name, text = F.col("name_fold"), F.col("text")
    met = rows.join(F.broadcast(wanted), name.contains(text)).withColumn("class", F.when(name == text, 0).when(name.startswith(text), 1).otherwise(2)).withColumn("align", F.lit(0))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order())))
    return ranked.where(F.col("rank") <= limit).select("query", F.col("rank").cast("long").alias("rank"), "path", "name", "is_dir", "class")
