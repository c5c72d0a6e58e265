"""Document fingerprints by I-Match with randomised lexicons.

A text's terms are its lower-cased words. The lexicon holds the terms whose document frequency lies in a band; of the lexicon, randomised
subsets of several sizes are taken, so that a short and a long text each meet some in a few terms. A fingerprint has one
hash for each subset: that of the text's distinct terms in it, sorted (by their 64-bit hashes, which stand for the terms).
The likeness of two fingerprints is the share of equal hashes among the subsets that either text meets.

The lexicon has at most (mean distinct terms of a text) / LOW terms, however large the corpus. It's counted, and broadcast up to
BROADCAST_TERMS; a larger one (of very long texts) is joined by a shuffle.

Each document's successor is found in buckets of doc_ids. Where more than HOT rows meet in a bucket (one doc_id, or none, for many
rows), repeated rows are counted and the rest is dealt out by ranges of doc_id and the first RANGE_CHARS characters of the text; repeated rows come back at the end.

A null text is empty. An empty text, without terms, meets no subset; a text none of whose terms lies in the band is
taken by all its terms. Equal texts have equal fingerprints, and the likeness of equal fingerprints is 1. Documents stand in order of doc_id (null
first), those of equal doc_id in order of text; repeated rows have a fingerprint each. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import stored

#: The band of document frequency, as shares of the documents.
LOW, HIGH = 1 / 2000, 1 / 20
#: Subsets of the lexicon, 63 at most: each takes one term in so many, by a hash of its own. Sparse ones tell half-equal texts from others.
SUBSETS = [1] + [12] * 3 + [36] * 8 + [108] * 16 + [324] * 20 + [972] * 15
#: doc_ids that stand in one bucket to find each document's successor (a power of two).
BUCKET = 256
#: Rows of a bucket beyond which it's dealt out by ranges of about as many different rows.
HOT = 8192
#: Characters of a text that ranges are cut by; Spark samples these, never whole texts.
RANGE_CHARS = 64
#: Buckets to be dealt out, and terms of the lexicon, that are broadcast at most.
BROADCAST_BUCKETS = 100_000
BROADCAST_TERMS = 1_000_000
#: Repeated rows that one task brings back from one row.
REPEATS = 10_000

_SPACE = r"[\x20\x09-\x0D]+"
#: The term of the row that every text has; it lies in no subset.
_NONE = 0


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words."""
    return F.array_distinct(F.transform(F.array_remove(F.split(F.lower(text), _SPACE), ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, subsets): hashes of the terms in the band, counted over all documents, each with a bit for every subset that has it."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    least = max(2, math.ceil(n * low))
    within = [F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(m)) == 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, m in enumerate(SUBSETS)]
    return counts.where(F.col("df").between(least, max(least, math.floor(n * high)))).select("term", reduce(lambda a, b: a.bitwiseOR(b), within).alias("subsets"))


def _low(x: Column) -> Column:
    """The low 32 bits as an int."""
    return (F.pmod(x, F.lit(1 << 32)) - (1 << 31)).cast("int")


def _in_any(bits: int):
    return lambda x: x["subsets"].bitwiseAND(F.lit(bits).cast("long")) != 0


def fingerprint_rows(rows: DataFrame, words: DataFrame, keys: list[str], small: bool = True) -> DataFrame:
    """keys, terms (array of hashes) -> keys, subsets: an array with the hash of each subset, null where the text doesn't meet it.

    Only lexicon terms go on from the join; a row of no subset, which every text is given, keeps texts without any.
    Rows are told apart by keys. If they're partitioned by some of keys and the lexicon is small, so that it's broadcast, nothing is shuffled.
    """
    every = F.when(F.size("terms") > 0, F.xxhash64(F.sort_array("terms")))
    # every is computed before the rows are spread, once for each text
    spread = rows.select(*keys, every.alias("every"), "terms").select(*keys, "every", F.explode(F.concat(F.array(F.lit(_NONE).cast("long")), F.col("terms"))).alias("term"))
    none = words.sparkSession.range(1).select(F.lit(_NONE).cast("long").alias("word"), F.lit(0).cast("long").alias("subsets"))
    known = words.where(F.col("term") != _NONE).select(F.col("term").alias("word"), "subsets").union(none)
    met = spread.join(F.broadcast(known) if small else known, F.col("term") == F.col("word"))
    held = met.groupBy(*keys, "every").agg(F.sort_array(F.collect_list(F.when(F.col("subsets") != 0, F.struct("word", "subsets")))).alias("met"))
    # terms of the subsets of one size first, few where subsets are sparse; each subset picks from those
    sizes = {m: sum(1 << k for k, other in enumerate(SUBSETS) if other == m) for m in SUBSETS}
    held = held.select("*", *(F.filter("met", _in_any(bits)).alias(f"met_{m}") for m, bits in sizes.items()))
    hashes = F.array(*(F.xxhash64(F.filter(f"met_{m}", _in_any(1 << k))) for k, m in enumerate(SUBSETS)))
    subsets = F.when(F.size("met") == 0, F.array_repeat(_low(F.col("every")), len(SUBSETS))).otherwise(F.transform(hashes, lambda h: F.when(h != F.xxhash64(F.array().cast("array<long>")), _low(h))))
    return held.select(*keys, subsets.alias("subsets"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes, 0 to 1."""
    either = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    equal = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"]))
    return F.when(either == 0, 1.0).otherwise(equal / either)


def as_text(subsets: Column) -> Column:
    return F.array_join(F.transform(subsets, lambda h: F.when(h.isNull(), "-").otherwise(F.lower(F.lpad(F.hex(h.cast("long") + (1 << 31)), 8, "0")))), ".")


def _following(cells: DataFrame) -> DataFrame:
    """(bucket, sub, after): the next larger cell (bucket, sub), that of the largest the smallest. Windows within two levels of parents, then over the parents' parents."""
    up = cells.select("bucket", F.struct("bucket", "sub").alias("cell")).distinct().withColumn("p1", F.shiftright("bucket", 12)).withColumn("p2", F.shiftright("bucket", 24))

    def step(rows: DataFrame, by: list[str], key: str, least: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(key)
        return rows.withColumn("next_" + key, F.lead(least).over(w))

    one = step(up, ["p1", "p2"], "cell", "cell")
    firsts1 = up.groupBy("p1", "p2").agg(F.min("cell").alias("f1"))
    two = step(firsts1, ["p2"], "p1", "f1")
    firsts2 = up.groupBy("p2").agg(F.min("cell").alias("f2"))
    three = firsts2.withColumn("next_p2", F.lead("f2").over(Window.partitionBy(F.lit(0)).orderBy("p2"))).withColumn("first", F.min("f2").over(Window.partitionBy(F.lit(0))))
    return (
        one.join(two.select("p1", "p2", "next_p1"), ["p1", "p2"]).join(three.select("p2", "next_p2", "first"), "p2")
        .select("cell.bucket", "cell.sub", F.coalesce("next_cell", "next_p1", "next_p2", "first").alias("after"))
    )


def _dealt(docs: DataFrame, hot: DataFrame, rows: int, small: bool) -> DataFrame:
    """The rows of hot buckets, repeated ones once with their number, in cells by ranges of doc_id and text; all others as they are."""
    hot = F.broadcast(hot) if small else hot
    many = docs.join(hot, "bucket", "left_semi").groupBy("bucket", "doc_id", "text").agg(F.count("*").alias("copies"))
    ranges = many.repartitionByRange(max(1, math.ceil(rows / HOT)), "bucket", F.col("doc_id").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS))
    dealt = stored(ranges.withColumn("sub", F.spark_partition_id()))
    return docs.join(hot, "bucket", "left_anti").unionByName(dealt)


def with_next(rows: DataFrame, column: str, order: list[str], after: DataFrame) -> DataFrame:
    """Rows (by bucket and sub) with next_<column>, that of the following row; after the last comes the first."""
    w = Window.partitionBy("bucket", "sub").orderBy(*(F.asc_nulls_first(c) for c in order))
    ahead = rows.withColumn("_lead", F.lead(F.struct(column)).over(w)).withColumn("_rank", F.row_number().over(w))
    firsts = ahead.where("_rank = 1").select(F.struct("bucket", "sub").alias("after"), F.struct(column).alias("_first"))
    beyond = firsts.join(after, "after").select("bucket", "sub", "_first")
    return ahead.join(beyond, ["bucket", "sub"]).withColumn("next_" + column, F.coalesce("_lead", "_first")[column]).drop("_lead", "_first")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, text hashes of its edited text, its fingerprints and their likeness.

    The edited text is the document's with its last floor(n_chars / 2) characters replaced by as many first ones of the next document.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("bucket", F.shiftright(F.coalesce("doc_id", F.lit(-(1 << 63))), BUCKET.bit_length() - 1))
    words = stored(lexicon(docs))
    sizes = stored(docs.groupBy("bucket").agg(F.count("*").alias("n")))
    hot = sizes.where(F.col("n") > HOT)
    buckets, repeated = hot.agg(F.count("*"), F.sum("n")).head()
    docs = docs.withColumns({"sub": F.lit(0), "copies": F.lit(1).cast("long")})
    if buckets:
        docs = _dealt(docs, hot.select("bucket"), repeated, buckets <= BROADCAST_BUCKETS)
        after = stored(_following(docs.select("bucket", "sub")))
    else:
        after = stored(_following(sizes.select("bucket", F.lit(0).alias("sub"))))
    rows = with_next(docs, "text", ["doc_id", "text"], after)
    # of repeated rows all but the last are followed by one of their own
    last = F.struct(F.lit(1).alias("turn"), F.col("next_text").alias("next_text"), F.lit(1).cast("long").alias("copies"))
    if buckets:
        own = F.struct(F.lit(0).alias("turn"), F.col("text").alias("next_text"), (F.col("copies") - 1).alias("copies"))
        rows = rows.select("bucket", "sub", "_rank", "doc_id", "text", F.inline(F.when(F.col("copies") > 1, F.array(own, last)).otherwise(F.array(last))))
    else:
        rows = rows.withColumn("turn", F.lit(1))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))")))
    rows = rows.select("bucket", "sub", "_rank", "turn", "copies", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array(F.struct(F.lit(False).alias("edit"), terms(F.col("text")).alias("terms")), F.struct(F.lit(True).alias("edit"), terms(F.col("edited")).alias("terms"))).alias("both"))
    keys = ["bucket", "sub", "_rank", "turn", "copies", "doc_id", "n_chars", "edited_sha256"]
    marked = fingerprint_rows(rows.select(*keys, F.inline("both")), words, [*keys, "edit"], words.count() <= BROADCAST_TERMS)
    pair = marked.groupBy(*keys).agg(F.max(F.when(~F.col("edit"), F.col("subsets"))).alias("own"), F.max(F.when(F.col("edit"), F.col("subsets"))).alias("edited"))
    found = with_next(stored(pair).withColumnRenamed("_rank", "place"), "own", ["place", "turn"], after)
    if buckets:
        found = found.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / REPEATS).cast("int"))))
        found = found.repartition("bucket", "sub", "place", "turn", "part").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.col("copies") - F.col("part") * REPEATS).cast("int"))))
    return found.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
