"""The corpus pipeline: what a training corpus goes through, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents (doc_id, text, lang, source, n_chars). ``run`` writes each stage's rows as Parquet in the shared folder
and reads them again for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.decontamination import decontaminate
from lumisift.llm.ngram_join import ngram_join
from lumisift.llm.packing import pieces, place
from lumisift.llm.queries import held_out, word_tokenizer
from lumisift.llm.substring_dedup import substring_dedup
from lumisift.llm.tables import stored
from lumisift.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows' hashes that are broadcast at most (some 10 MB); beyond, the texts are shuffled to them.
BROADCAST_ROWS = 250_000
_CARRY = ("lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, learn=~held_out(), carry=_CARRY).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, that of the smallest doc_id (nulls last) and then of the smallest hash of the text.

    A row is known by a 64-bit hash of doc_id and text; of equal rows one stays. Documents without words are alike in nothing and stay.
    """
    rows = docs.withColumn("row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = stored(ngram_join(rows.select(F.col("row").alias("doc_id"), "text"), n=5, threshold=0.75).where("n_shingles > 0").groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"), F.count("*").alias("copies")))
    several = found.groupBy("component").agg(F.sum("copies").alias("members")).where("members > 1").select("component")
    members = stored(found.join(several, "component").join(rows.select("row", F.col("doc_id").cast("long").alias("doc_id")).distinct(), "row"))
    best = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")).select("component", F.col("best.row").alias("stays"))
    gone = stored(members.join(best, "component").where("row <> stays or copies > 1").select("row", (F.col("row") == F.col("stays")).alias("once")))
    few = gone.count() <= BROADCAST_ROWS
    rest = rows.join(F.broadcast(gone) if few else gone, "row", "left_anti").select(*COLUMNS)
    once = gone.where("once").select("row")
    if once.isEmpty():
        return rest
    return rest.union(rows.join(F.broadcast(once) if few else once, "row").dropDuplicates(["row"]).select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that stand in an earlier document; a text of which nothing is left goes."""
    done = substring_dedup(docs, window=50, carry=_CARRY)
    changed = F.col("n_removed") > 0
    return (
        done.where("n_removed = 0 or n_removed < n_words")
        .withColumn("n_chars", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
        .withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
        .select(*COLUMNS)
    )


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, least=4, threshold=0.5, carry=_CARRY).where(F.size("leaks") == 0).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents, packed into sequences of 2048 tokens."""
    cut = pieces(docs, word_tokenizer(), width=2048, end_id=1)
    return place(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), width=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: No stage but the second and third can be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return stored(STAGES[-1][1](spark, docs, sf_dir))
