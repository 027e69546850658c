"""A training-data pipeline of five stages over the documents table.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the columns of documents, whatever
their names.

In all stages a row is a document of its own: where doc_ids are null or repeated, rows are told apart by a number
(`with_rows`), so that what a stage decides about one row touches no other. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrum.llm.bpe import bpe_round_trip
from clustrum.llm.common import forget, settled, table, with_rows
from clustrum.llm.jaccard import one_of_each
from clustrum.llm.mixing import served
from clustrum.llm.quality import verdicts
from clustrum.llm.secrets import redact

#: Up to so many ids (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 400_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts, and those under 50 words, have failed and go; very
    long texts are judged whole; equal rows share a verdict, rows of one doc_id with different texts need not."""
    columns = docs.columns
    docs, row = with_rows(docs)
    judged = verdicts(docs.select(F.col(row).alias("row"), "doc_id", "text"), table(spark, sf_dir, "labels"))
    gone = settled(judged.where("NOT kept").select(F.col("row").alias(row)))
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id (null last). Rows without words, null texts
    included, are in no group and all stay; of repeated rows one stays; different texts of one doc_id are different documents."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with secrets replaced by their kind; n_chars is that of the new text. A null text stays null, and its
    n_chars too; an empty one stays empty."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix serves them: one served twice is there twice. Null and wordless texts have size 0 and
    are never served; a null source is a source; rows of one doc_id are served each by itself."""
    columns = docs.columns
    docs, row = with_rows(docs)
    taken = served(docs.select(F.col(row).alias("row"), "doc_id", "text", "source"))
    times = settled(taken.where("taken > 0").select(F.col("row").alias(row), (F.col("taken") / F.col("size")).cast("int").alias("times")))
    again = "times" if "times" not in columns else row + "times"
    times = times.withColumnRenamed("times", again)
    repeated = docs.join(F.broadcast(times) if times.count() <= BROADCAST_IDS else times, row)
    return repeated.withColumn(row + "copy", F.explode(F.sequence(F.lit(1), again))).select(*columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each row's whole text; a null text is an empty one."""
    import public_tokenizers

    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("encoded", encoded)]

#: The fitted models of the stages are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, settled(stage(spark, docs, sf_dir))
        forget(before)
    return docs
