"""Filter interaction audit by a subset-zeta transform.

Each document has a mask of the filters that it fails. Per part of the corpus the masks are counted, and the
zeta transform over subsets turns the 2**f counts into z[T], the documents that fail filters of T only. The survivors of a
set of filters S are z[complement of S]; so what any step of any order removes is the
difference between two neighbouring subsets, and every order is read off the same 2**f numbers. The same holds for
documents with a label.

The counting is done in steps that shrink before they shuffle: rows of equal (doc_id, text, part), then those of
equal (text, part, labels), then masks. Texts are shuffled as their SHA-256 digests only, and no group is ever collected: a
text or a part that has a third of all rows is a few rows after the first partial sums.

Null texts are empty. A null part is the empty string. A null doc_id is smaller than none and has none smaller, so it
never repeats another's text, and has no labels. Repeated rows count each; equal doc_ids are neither smaller nor larger, so equal texts of one doc_id don't fail the
filter on repeats. Several labels of one doc_id count once, as their largest; null labels and labels of other doc_ids have no
influence. Very long texts are read whole. Columns other than those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that part words.
SEPARATORS = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> list[Column]:
    """Failure conditions on one text: few words, repeated words, capitals, marks."""
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    many, distinct = F.size(words), F.size(F.array_distinct(words))
    return [many < 200, 100 * distinct < 50 * many, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), F.regexp_like(text, F.lit("[#$%&*|]"))]


def mask_counts(docs: DataFrame, labels: DataFrame, filters=text_filters, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask; bit i is filter i, the last one whether the text is that of a smaller doc_id.

    filters: a function from the text to failure conditions. labels: (doc_id, quality, toxic).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    fails = filters(F.col("text"))
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("own")).groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("c"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    told = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # per text, part and labels: all rows, those without an id, and those of the smallest id
    several = told.groupBy("digest", "own", "part", "good", "toxic").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))).alias("first"))
    least = several.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    once = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    counted = several.join(least, "digest").select("part", "own", "good", "toxic", once.alias("once"), (F.col("c") - once).alias("again"))
    both = F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("once").alias("n")), F.struct((F.col("own") + (1 << len(fails))).alias("mask"), F.col("again").alias("n"))))
    each = counted.select("part", "good", "toxic", both.alias("e")).select("part", "good", "toxic", "e.*").where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def _pass(counts: Column, bit: int) -> Column:
    """One pass of the zeta transform: what stands without the bit is added to what stands with it."""
    return F.transform(counts, lambda x, i: F.when(i.bitwiseAND(bit) > 0, x + F.get(counts, i - bit)).otherwise(x))


def survivors(masks: DataFrame, filters: int) -> DataFrame:
    """(part, n, good, toxic): for each part arrays z, where z[T] is how many documents fail filters of T only."""
    kinds = ("n", "good", "toxic")
    z = masks.groupBy("part").agg(*(F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(1 << filters))).alias(c) for c in kinds))
    for k in range(filters):
        z = z.select("part", *(_pass(F.col(c), 1 << k).alias(c) for c in kinds))
    return z


def filter_audit(docs: DataFrame, labels: DataFrame, names: str = "ABCDE", filters=text_filters, part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order of the filters and step.

    names: a letter for each of the filters and, last, one for the filter on repeats.
    """
    f = len(names)
    every = (1 << f) - 1
    z = survivors(mask_counts(docs, labels, filters, part), f)

    def shapley(k: int) -> Column:
        """Removed by filter k, over all orders: each set S of filters applied before it stands for |S|! * (f - 1 - |S|)! orders."""
        sets = [s for s in range(1 << f) if not s >> k & 1]
        return sum((factorial(s.bit_count()) * factorial(f - 1 - s.bit_count()) * (F.get("n", F.lit(every ^ s)) - F.get("n", F.lit(every ^ s ^ 1 << k))) for s in sets), F.lit(0))

    z = z.withColumn("shares", F.array(*(shapley(k) for k in range(f))))
    orders = F.lit(" ".join("".join(p) for p in permutations(names)))
    steps = z.select("*", F.explode(F.split(orders, " ")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(f))).alias("step"))
    place = [F.instr("filter_order", x) for x in names]
    before = sum((F.when(p < F.col("step"), F.lit(1 << k)).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    own = F.coalesce(*(F.when(p == F.col("step"), F.lit(k)) for k, p in enumerate(place)))
    steps = steps.select("*", (F.lit(every) - before).alias("left"), own.alias("own")).withColumn("bit", F.expr("shiftleft(1, own)"))

    def lost(c: str) -> Column:
        return F.get(c, F.col("left")) - F.get(c, F.col("left") - F.col("bit"))

    fails = F.get("n", F.lit(every)) - F.get("n", F.lit(every) - F.col("bit"))
    return steps.select(
        "part", "filter_order", "step", F.get("n", F.col("left") - F.col("bit")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        (F.get("n", F.col("bit")) - F.get("n", F.lit(0))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("own")).alias("shapley"),
    )
