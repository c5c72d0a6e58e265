"""Ranking of candidates from any source: bands by tier, modes of listing, sections.

A candidate has (display, texts, tie_break, sort_key, hint, ord). Ranks come from one window over the
candidates of one query; partition columns keep many queries or sources apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matching as M

#: Bands of scores (fixed values): exact, prefix, word start, substring; the fuzzy band, listed rows, and rows that a source claims.
BANDS = {M.EXACT: 83.0, M.PREFIX: 73.0, M.WORD_START: 63.0, M.SUBSTRING: 53.0}
FUZZY_BASE, FUZZY_SPAN, LISTED, CLAIMED_BASE, CLAIMED_SPAN, NUDGE, NEUTRAL = 16.0, 30.0, 50.0, 86.0, 14.0, 2.0, 50.0


def hint_value(hint: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(hint.cast("double"), F.lit(NEUTRAL))))


def band_score(tier: Column, score: Column, units: Column, hint: Column) -> Column:
    """The score of a tier's band, moved within it by the hint and, for fuzzy matches, by the alignment."""
    base = F.when(tier == M.EXACT, BANDS[M.EXACT])
    for k in (M.PREFIX, M.WORD_START, M.SUBSTRING):
        base = base.when(tier == k, BANDS[k])
    return base.otherwise(FUZZY_BASE + FUZZY_SPAN * M.normalize_score(score, units)) + NUDGE * (hint_value(hint) - NEUTRAL) / NEUTRAL


def _capped(rows: DataFrame, by: list[str], keys: list[Column], limit: int) -> DataFrame:
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*keys)
    if limit > 0 and not by:
        rows = rows.orderBy(*keys).limit(limit)  # each task keeps its best, and the window sees no more than the limit
    out = rows.withColumn("rank", F.row_number().over(w).cast("long"))
    return out.where(F.col("rank") <= limit) if limit > 0 else out


def rank_matched(candidates: DataFrame, fields: list[Column], query: str, fuzzy: bool = True, limit: int = 0, by: list[str] = ()) -> DataFrame:
    """Candidates that match, with tier, field, score and rank."""
    wanted = M.terms(query)
    rows = candidates.withColumn("m", M.match_fields(fields, wanted, fuzzy)).where("m is not null")
    rows = rows.withColumns({"tier": F.col("m.tier"), "field": F.col("m.field"), "score": band_score(F.col("m.tier"), F.col("m.score"), F.col("m.units"), F.col("hint"))}).drop("m")
    return _capped(rows, list(by), [F.col("tier"), F.col("field"), F.desc("score"), F.desc("tie_break"), M.rune_fold(F.col("display")), F.col("display"), F.col("sort_key"), F.col("ord")], limit)


def rank_listed(candidates: DataFrame, limit: int = 0, by: list[str] = ()) -> DataFrame:
    """All candidates of a targeted source with an empty query."""
    rows = candidates.withColumns({"tier": F.lit(0), "field": F.lit(0), "score": F.lit(LISTED)})
    return _capped(rows, list(by), [F.desc("tie_break"), M.rune_fold(F.col("display")), F.col("display"), F.col("sort_key"), F.col("ord")], limit)


def rank_claimed(candidates: DataFrame, limit: int = 0, by: list[str] = ()) -> DataFrame:
    """Candidates of a source that has answered the query: by hint, then as given."""
    rows = candidates.withColumns({"tier": F.lit(0), "score": CLAIMED_BASE + CLAIMED_SPAN * hint_value(F.col("hint")) / 100})
    return _capped(rows, list(by), [F.desc("score"), F.col("ord")], limit)


def rank_given(candidates: DataFrame, limit: int = 0, by: list[str] = ()) -> DataFrame:
    """Candidates whose order is their ranking: scores fall from 100 to the claimed band."""
    rows = _capped(candidates, list(by), [F.col("ord")], limit)
    return rows.withColumns({"tier": F.lit(0), "score": F.greatest(F.lit(CLAIMED_BASE), F.lit(101.0) - F.col("rank"))})


def sections(results: DataFrame) -> DataFrame:
    """Results (source, priority, score, ord) with section_rank and row_rank: sections by priority, best score, source; rows by score, as given on ties."""
    score = F.coalesce("score", F.lit(50.0))
    best = results.groupBy("source").agg(F.max("priority").alias("p"), F.greatest(F.lit(0.0), F.max(score)).alias("best"))
    ranked = best.withColumn("section_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("p"), F.desc("best"), "source")).cast("long")).select("source", "section_rank")
    rows = results.withColumn("row_rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(score), "ord")).cast("long"))
    return rows.join(F.broadcast(ranked), "source")  # a row for each source


def cut_priority(rows: DataFrame, by: list[str]) -> DataFrame:
    """Where a source has a match of word start or better, only such rows; else all."""
    best = F.min("tier").over(Window.partitionBy(*by))
    return rows.withColumn("priority", (best <= M.WORD_START).cast("int")).where((F.col("priority") == 0) | (F.col("tier") <= M.WORD_START))
