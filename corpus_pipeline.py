"""The corpus pipeline: rejects poor and toxic documents, removes near-duplicates, masks personal data, mixes the
sources and packs the result into batches.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of
`documents`. Repeated rows, null columns, empty and very long texts and empty tables go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neolexis.llm.common import Scratch, word_count
from neolexis.llm.mixing import mix, training_order
from neolexis.llm.packing import pack
from neolexis.llm.pii import redact
from neolexis.llm.quality import classify
from neolexis.llm.simhash import similar_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Fingerprints of shingle sets of similarity 0.8 differ in 39 of 256 bits (in 48 at most, for sets of 4 and 5 members),
#: with a deviation of 6; pairs further apart than this are not compared.
BITS_APART = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Near copies have sets of five-word shingles of Jaccard similarity 0.8 or more, compared exactly. One row of
    each group stays; a document without id stays only if no other of its group has one.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_print"))
    found = similar_documents(keyed, "doc_id", "_print", most=BITS_APART)
    # ids that are null come last; of rows with one id, the smallest hash of a text
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_print")).alias("_least"))
    stay = least.select(F.col("_least.doc_id").alias("_id"), F.col("_least._print").alias("_p"))
    rows = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["_id"]) & (keyed["_print"] == stay["_p"]))
    once = Window.partitionBy("doc_id", "_print").orderBy("source", "lang", "n_chars")
    return rows.withColumn("_row", F.row_number().over(once)).where("_row = 1").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows."""
    clean = redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document, in training order.

    Texts stay whole: where a source's stream meets its target inside a document, that use is a row if at least
    half of it lies before the target, and none otherwise, whichever comes nearer.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_print"))
    uses = mix(keyed, Scratch(spark), ["doc_id", "_print"])
    # rows equal in id and text share one list of uses each: number them to pair them one to one
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_print").orderBy(F.lit(0))))
    left = number(keyed)
    right = number(uses.where("taken > 0")).select(F.col("doc_id").alias("_id"), F.col("_print").alias("_p"), F.col("_n").alias("_m"), "size", "uses")
    rows = left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & left["_print"].eqNullSafe(right["_p"]) & (left["_n"] == right["_m"]))
    rows = training_order(rows.select(*COLUMNS, "size", "uses")).where("2 * words >= size")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, bucket, bucket_tokens, batch, slot of each row."""
    return pack(docs, Scratch(spark), ["doc_id", "source"], word_count(F.col("text")), F.xxhash64(F.lit(6), "doc_id", "text"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("PII", personal_data), ("mixing", mixing), ("packing", packing)]
#: Trained models and fingerprints can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
