"""The corpus pipeline: from ``documents`` to packed bins of clean, distinct text.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet to the shared folder and reread as the next stage's docs.  All but the last
return the columns of ``documents``; other columns are ignored.

Near-dedup and decontamination judge texts, not ids: a row with a null doc_id, or with one
that other rows have too, is known by a hash of id and text (``text_ids``), so that no
text goes because of another that shares its id.

Defined cases: null and empty texts break a quality rule and go.  Of a group of near
copies the least doc_id that is in one row stays, or, if all of them are shared or null,
the row of least hash; of rows that are equal in id and text, the one of least (lang,
source, n_chars), nulls first.  An empty table gives an empty result of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm import decontaminate, neardup, packing, quality, secrets
from finloom.llm.common import Staging, few, read, staged, text_ids, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that break a rule go."""
    return quality.good_documents(docs.select(*COLUMNS))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, five words and 80 %: of every group of near copies one row stays."""
    docs = docs.select(*COLUMNS)
    tables = Staging(spark, "distinct")
    known = text_ids(docs, tables)
    judged = neardup.near_duplicates(known.select(F.col("text_id").alias("doc_id"), "text"))
    touched = tables.put(judged.groupBy(F.col("doc_id").alias("text_id")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"), "touched")
    left = without(known, touched.where("NOT kept").select("text_id"), "text_id")
    again = touched.where("kept").select("text_id")
    if again.isEmpty():
        return left.select(*COLUMNS)
    rest = ["text", "doc_id", "lang", "source", "n_chars"]
    once = left.join(few(again), "text_id", "left_semi").groupBy("text_id").agg(F.min(F.struct(*rest)).alias("row")).select("row.*")
    return without(left, again, "text_id").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go."""
    tables = Staging(spark, "leaks")
    known = text_ids(docs.select(*COLUMNS), tables)
    found = decontaminate.contaminated(known.select(F.col("text_id").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return without(known, tables.put(found.select(F.col("doc_id").alias("text_id")).distinct(), "ids"), "text_id").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every secret is replaced in the text; n_chars follows."""
    found = secrets.scan(docs.select(*COLUMNS), *COLUMNS)
    masked = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: what is left, in bins."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_distinct),
    ("decontamination", drop_leaks),
    ("secret_scans", mask_secrets),
    ("packing", pack_bins),
]

#: MinHash and best-fit packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tables = Staging(spark, "pipeline")
    for name, stage in STAGES:
        with staged() as opened:
            before, docs = docs, tables.put(stage(spark, docs, sf_dir), name)
        for used in opened:
            used.clear()
        tables.drop(before)
    return docs
